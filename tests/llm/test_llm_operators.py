"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and extra columns."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillspark.llm import embedding, html, jaccard, kneserney, language, mixing, packing, rules, text, tokens, toxicity
from rillspark.llm.cluster import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def words_of(t):
    return WORD.findall(t or "")


def doc_rows():
    g = random.Random(7)
    base = {"en": "the of and to in that was for with from".split(), "de": "der die und nicht mit ein auf ist".split()}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        w = [g.choice(base[lang]) if g.random() < 0.6 else "".join(g.choice(["thi", "ren", "sto", "ing"] if lang == "en" else ["sch", "ung", "kei", "ver"]) for _ in range(g.randint(1, 3))) for _ in range(g.randint(60, 140))]
        rows.append((i, " ".join(w).capitalize() + ".\nNext line, too.", lang, f"src{i % 5}", 0))
    one = rows[3][1]
    rows += [(200, one, "en", "src0", 0), (201, one.replace("the", "The"), "en", "src0", 0), (202, one + " extra", "en", None, 0), (203, None, "en", "src1", None), (204, "", None, "src1", 0), (205, "  \n\t ", "en", None, 0), (206, "one two", "en", "src2", 0), (207, "One TWO", "en", "src2", 0), (208, "12 34 !!", "en", "src2", 0)]
    rows += [(209, "é" * 30 + " x" * 3000, "en", "src3", 0), (3, one, "en", "src3", 0), (None, "no id here", "en", "src3", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).withColumn("row", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 7 > 0), int(i % 9 == 0)) for i in range(160)] + [(0, 1, 0), (None, 1, 1), (999, None, None)], LABELS)


def test_words_and_hashes():
    values = ["a b  c", None, "", " \t", "ünï çode", "x" * 5000, "a\x85b a\xa0c"]
    w = text.words(pa.array(values))
    assert [w.string(k) for k in range(len(w.hash))] == [x for v in values for x in words_of(v)]
    assert list(np.diff(w.first)) == [len(words_of(v)) for v in values]
    assert list(text.hash_of([w.string(k) for k in range(len(w.hash))])) == list(w.hash)
    part = pa.RecordBatch.from_arrays([pa.array(values)], ["t"])
    assert sum(s.num_rows for s in text.slices([part], "t", 3)) == len(values)


def test_components(spark):
    g = random.Random(1)
    links = [(g.randrange(300), g.randrange(300)) for _ in range(200)] + [(500 + k, 501 + k) for k in range(40)] + [(None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_quality_rules(docs, labels):
    got = {(r.doc_id, r.n_words): r for r in rules.judge(docs, labels, buckets=256).collect()}
    for i, t, *_ in doc_rows():
        w = words_of(t)
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.kept and r.base_failed)
    empty = rules.judge(docs.where("false"), labels, buckets=256)
    assert empty.count() == 0


def test_quality_rules_use_all_trusted_documents(spark):
    """More trusted documents than 20,000 are fitted, and more than that set the threshold."""
    held = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(5)) == 0
    few = spark.range(28_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    marks = few.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    ratios = rules.weights(few.where(~held), marks, 1 << 22)
    assert few.where(~held).count() > 22_000 and ratios.where(F.col("ratio") < -1e-9).count() == 0
    many = spark.range(110_000).select(F.col("id").alias("doc_id")).where(held).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.col("w"), k.cast("string"))), " ")
    at = F.row_number().over(Window.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id"))
    many = many.withColumn("w", F.when(at > 20_000, "bad").otherwise("good")).select("doc_id", words.alias("text")).localCheckpoint()
    bad = [int(r.b) for r in many.where("text LIKE 'bad%'").limit(1).select(F.explode(rules._buckets("split(text, ' ')", 1 << 10)).alias("b")).collect()]
    good = {int(r.b) for r in many.where("text LIKE 'good%'").limit(1).select(F.explode(rules._buckets("split(text, ' ')", 1 << 10)).alias("b")).collect()}
    table = F.array(*[F.lit(-1.0 if k in set(bad) - good else 0.0) for k in range(1 << 10)])
    marks = many.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert many.where("text LIKE 'bad%'").count() > 0.02 * many.count() and rules.threshold(many, marks, table, 1 << 10) < -0.5


def test_quality_rules_ratio_is_the_mean_log_ratio(spark):
    d = spark.createDataFrame([(1, "a b a b c"), (2, "x y x y z"), (3, "a b x")], "doc_id long, text string")
    l = spark.createDataFrame([(1, 1, 0)], LABELS)  # noqa: E741
    got = {r.doc_id: r.ratio for r in rules.judge(d, l, buckets=1 << 12).collect()}
    assert got[1] > got[3] > got[2]


def test_kneserney_terms_add_up(spark):
    """The sum over n-grams equals the interpolated probability, word by word."""
    texts = ["a b a b c", "b c a b", "c c a"] * 3 + ["d e f g a b"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    model, terms = kneserney.fit(d, d.select(F.lit(0).cast("long").alias("h"), "text"))
    rest = {r.key: r.term for r in terms.collect()}
    head = dict(zip(model.head_keys.tolist(), model.head_terms.tolist()))
    big, ctx = Counter(), defaultdict(Counter)
    ids = {x: int(k) for x, k in zip(model.keys.tolist(), model.ids.tolist())}
    for t in texts:
        s = [kneserney.START] + [ids[int(h)] for h in text.hash_of(t.split())] + [kneserney.STOP]
        for v, w in zip(s, s[1:]):
            big[v, w] += 1
            ctx[v][w] += 1
    n = Counter(min(c, 5) for c in big.values())
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    steps = [1 - 2 * y * n[2] / n[1] if n[1] and n[2] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] and n[3] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] and n[4] else 1.5]
    disc = [0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(steps, 1))]
    for (v, w), c in big.items():
        total = sum(ctx[v].values())
        p1 = np.exp(model.start[w])
        gamma = sum(disc[min(k, 3)] for k in ctx[v].values()) / total
        want = np.log(max(c - disc[min(c, 3)], 0) / total + gamma * p1)
        key = v << 16 | w
        got = model.start[w] + model.context[v] + head.get(key, rest.get(key, np.nan))
        assert got == pytest.approx(want, rel=1e-5)


def test_quality_classifier(docs, labels):
    got = kneserney.classify(docs, labels).collect()
    assert len(got) == len(doc_rows())
    by = {r.doc_id: r for r in got}
    assert not by[203].kept and by[203].perplexity is None and not by[204].kept
    assert by[209].perplexity > by[5].perplexity and all(r.log_prob < 0 for r in got)
    assert sum(r.doc_id == 3 for r in got) == 2
    left = kneserney.keep_good(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.kept}
    assert kneserney.classify(docs.where("false"), labels).count() == 0
    assert all(r.kept == (r.n_tokens > 0) for r in kneserney.classify(docs, labels.where("false")).collect())


def test_quality_classifier_keeps_words_without_an_id_apart(docs, labels, monkeypatch):
    """Which words have an id changes speed only."""
    want = {r.row: r for r in kneserney.classify(docs, labels).collect()}
    monkeypatch.setattr(kneserney, "VOCABULARY", 20)
    got = {r.row: r for r in kneserney.classify(docs, labels).collect()}
    assert want.keys() == got.keys()
    for row, r in want.items():
        assert got[row].log_prob == pytest.approx(r.log_prob, rel=1e-6) and got[row].kept == r.kept


def test_quality_classifier_thresholds_by_language(docs, labels):
    """A few held-out documents move their language's threshold off that of all languages, by their number."""
    got = kneserney.classify(docs, labels).collect()
    limit = {r.lang: np.log(r.threshold) for r in got}
    assert len({r.threshold for r in got if r.lang == "en"}) == 1 and limit["en"] != limit["de"]
    assert min(limit["en"], limit["de"]) < limit[None] < max(limit["en"], limit["de"]) + 1e-9


def test_kneserney_scores_add_up_over_rounds(spark, monkeypatch):
    """Every key counts in one round, as often as the document has it; the round's bitmap keeps all keys and few others."""
    monkeypatch.setattr(kneserney, "VOCABULARY", 3)
    monkeypatch.setattr(kneserney, "HEAD", 4)
    texts = ["a b a b c a b", "b c a b x y x y", "c c a", "q a r", ""]
    d = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    fitted = d.where("doc_id < 3").select("text")
    model, terms = kneserney.fit(fitted, fitted.select(F.lit(0).cast("long").alias("h"), "text"))
    known = dict(zip(model.head_keys.tolist(), model.head_terms.tolist())) | {r.key: r.term for r in terms.collect()}
    got = {r.doc_id: r.log_prob for r in kneserney.score(d, model, terms).collect()}
    for k, t in enumerate(texts):
        codes, at = kneserney._codes(pa.array([t]), model.keys, model.ids)
        before = kneserney._before(codes, at)
        want = sum(model.start[w if w < kneserney.IDS else 0] + (model.context[v] if v < kneserney.IDS else 0) for v, w in zip(before, codes))
        want += sum(known.get(int(x), 0.0) for x in [*kneserney._key(before, codes), *codes[codes >= kneserney.IDS]])
        assert got[k] == pytest.approx(want, rel=1e-6)
    keys = spark.range(1 << 20).select(F.expr("xxhash64(id) & 4611686018427387903").alias("key"))
    mine, bits = keys.toArrow()["key"].to_numpy(), kneserney._known(keys)
    assert kneserney._may_hold(bits, mine).all() and kneserney._may_hold(bits, mine ^ 12345).mean() < 0.005


def test_quality_classifier_leaves_no_shuffle_files(spark, docs, labels):
    """What each query shuffled is deleted when it ends, not when the driver happens to collect its garbage."""

    def files() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
        return {x.rsplit("/", 1)[-1] for x in found.split(",") if "/shuffle_" in x}

    before = files()
    kneserney.classify(docs, labels)
    for _ in range(20):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before


def test_quality_classifier_hands_texts_over_in_small_batches(spark, labels, monkeypatch):
    """However long the texts are, a worker gets few bytes of them at once; the session's settings stay as they were."""
    d = spark.range(600, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 5000) AS text", "'en' AS lang")
    sizes, fit = [], kneserney.fit

    def probed(trusted, listed, bitmap=None):
        def size(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

        sizes.extend(r.n for r in listed.mapInArrow(size, "n bigint").collect())
        return fit(trusted, listed, bitmap)

    monkeypatch.setattr(kneserney, "fit", probed)
    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(k) for k in keys]
    assert kneserney.classify(d, labels).count() == 600
    assert sum(sizes) > 8 << 20 and max(sizes) < 3 << 20
    assert [spark.conf.get(k) for k in keys] == before


def test_jaccard_join_against_brute_force(spark, docs):
    rows = [r for r in doc_rows() if r[0] is not None]
    extra = []
    g = random.Random(3)
    for k in range(60):  # a family of near copies, some far
        w = rows[10][1].split()
        for _ in range(g.choice([0, 0, 1, 1, 2, 6])):
            w[g.randrange(len(w))] = f"w{g.randrange(9999)}"
        extra.append((1000 + k, " ".join(w), "en", "src0", 0))
    table = spark.createDataFrame(rows + extra, DOCS).repartition(5)

    def shingles(t):
        w = words_of((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t, *_ in rows + extra}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_classes(table, shingle=3, num=90, den=100).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    left = jaccard.one_of_each(docs, shingle=3, num=90, den=100)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns and len(ids) == len(set(ids)) and 200 not in ids and 207 not in ids and 204 in ids and None in ids
    assert jaccard.link_classes(docs.where("false")).count() == 0


def vector_rows():
    g = np.random.default_rng(5)
    base = g.standard_normal((6, 16))
    rows = [(k, [float(x) for x in base[k % 6] + 0.12 * g.standard_normal(16)], k % 2 if k % 11 else None) for k in range(240)]
    rows += [(300 + k, rows[0][1], 0) for k in range(40)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] + [1.0] * 15, 0), (403, [None] + [1.0] * 15, 0), (404, [], 0), (405, [1.0, 2.0], 0), (406, [2.0, 4.0], 0), (407, [float("inf")] * 16, 1), (None, [1.0] * 16, 1), (300, rows[0][1], 0)]
    return rows


def test_embedding_dedup_against_brute_force(spark):
    rows = vector_rows()
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash")).repartition(4)
    good = [k for k, (i, e, l) in enumerate(rows) if i is not None and l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in good}
    n, parent = Counter(), {k: k for k in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                n[a] += 1
                n[b] += 1
                parent[find(a)] = find(b)
    low = defaultdict(lambda: 1 << 60)
    for k in good:
        low[find(k)] = min(low[find(k)], rows[k][0])
    want = Counter((r[0], n[k] if k in parent else 0, low[find(k)] if k in parent else r[0]) for k, r in enumerate(rows))
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embedding.near_duplicates(d, chunk=16).collect())
    assert sum((want - got).values()) <= 0.02 * len(rows)
    assert sum(r[1] * c for r, c in got.items()) <= sum(r[1] * c for r, c in want.items())
    assert embedding.near_duplicates(d.where("false")).count() == 0


def test_embedding_dedup_keeps_rows_that_share_an_id_apart(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.001, 0.0], 0), (3, [0.0, 1.0, 0.001], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_jaccard_join_of_null_and_repeated_ids(spark):
    a, b, c = "a b c d e f g h", "r s t u v w x y", "k l m n o p q z"
    rows = [(1, a), (1, b), (5, b), (None, a), (None, c), (None, c), (7, None), (7, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1)).withColumn("_gone", F.lit(2)).withColumn("cid", F.lit(3))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.link_classes(d).collect())
    assert got == sorted([("1", 4, "1"), ("1", 4, "1"), ("5", 4, "1"), ("None", 4, "1"), ("None", 4, "None"), ("None", 4, "None"), ("7", 0, "7"), ("7", 0, "7")])
    left = jaccard.one_of_each(d)
    assert left.columns == d.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("1", a), ("1", b), ("None", c), ("7", None)], key=str)


def test_stages_take_clashing_columns(spark, docs, labels):
    named = ["_row", "_letters", "_copy", "_times", "_finish", "row", "key"]
    d = docs.drop("row", "key").withColumns({c: F.lit(5) for c in named})
    for out in (language.keep_identified(d), kneserney.keep_good(d, labels), mixing.mixed(d)):
        assert out.columns == d.columns and {tuple(r[c] for c in named) for r in out.collect()} == {(5,) * len(named)}


def test_quality_rules_reject_junk_by_the_ratio(spark):
    g = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    junk = [f"{x}{y}" for x in "qxz" for y in ("wv", "jk", "pf", "gh", "tr")]
    rows = [(i, " ".join(g.choice(junk if i % 10 == 0 else words) + str(g.randrange(40)) for _ in range(120))) for i in range(300)]
    marks = [(i, int(i % 10 > 0), 0) for i in range(0, 300, 2)]
    got = rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, LABELS), buckets=1 << 12).collect()
    assert not any(r.base_failed for r in got)
    assert [r.doc_id for r in got if not r.kept and r.doc_id % 10] == [] and [r.doc_id for r in got if r.kept and r.doc_id % 10 == 0] == []


def test_token_automaton_against_greedy(spark, docs):
    pieces = [b" ", b" a", b" ab", b" abc", b"a", b"b", b"bc", b"bcd", b"cd", b"c", b"abcx", b" the", b"the", b"e", b"h"]
    auto = tokens.Automaton(pieces)
    g = random.Random(2)
    words = ["".join(g.choice("abcdxeht") for _ in range(g.randint(1, 12))).encode() for _ in range(500)]

    def greedy(w):
        s, n = b" " + w, 0
        while s:
            k = next((k for k in range(len(s), 0, -1) if s[:k] in set(pieces)), 0)
            if not k:
                return -1
            s, n = s[k:], n + 1
        return n

    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert list(auto.counts(data, ends - [len(w) for w in words], ends)) == [greedy(w) for w in words]
    tools = pytest.importorskip("public_tokenizers")
    out = {(r.doc_id, r.n_words): r for r in tokens.count_tokens(docs, tools.path("byte_bpe_50k.json")).collect()}
    assert len(out) == len({(i, len(words_of(t))) for i, t, *_ in doc_rows()}) and out[203, 0].n_tokens == 0 and out[209, 3001].n_tokens >= 3001


def test_html_blocks():
    page = "<html><head><title>T</title><style>p{}</style></head><body><script>var a='</p><p>no';</script><nav><a href=x>menu</a></nav><!-- <p>gone</p> --><div id='c'><h1>A &amp; B</h1><p>One&nbsp; two<br>three <b>four</b> 1 < 2<p>Five<ul><li>six<li>seven</ul>tail</div></body>"
    got = [b.text for b in html.blocks(page)]
    assert got == ["menu", "A & B", "One two three four 1 < 2", "Five", "six", "seven", "tail"]
    assert html.blocks("") == [] and html.blocks("plain & simple <") != [] and html.blocks("<p") is not None


def test_html_keeps_what_is_shown():
    def texts(page):
        return [b.text for b in html.blocks(page)]

    assert texts("<body><p>Let <math><mi>x</mi></math> be</p><svg><g><svg></svg></g><text>no</text></svg><p>two</p>") == ["Let x be", "two"]
    assert texts("<body><div><noscript><p>one</div><p>two</p>") == ["one", "two"]
    assert texts("<head><title>T</title><p>One<p>two") == ["One", "two"]
    deep = html.blocks("".join(f"<div>w{k}" for k in range(3000)))
    assert len(deep) == 3000 and html.vectors(deep).shape == (3000, html.SIZE)
    long = " ".join(f"w{k}" for k in range(300))
    a, b = (html.vectors(html.blocks(f"<p>{long} {x}</p>")) for x in ("alpha", "omega"))
    assert (a != b).any()


def test_html_extraction_held_out(spark):
    model = html.trained()
    g = np.random.default_rng(99)
    right = total = 0
    for _ in range(120):
        page, main = html.sample_page(g)
        b = html.blocks(page)
        mark = model.main_blocks([html.vectors(b)])[0]
        want = {" ".join(x.split()) for x in main}
        right += sum((x.text in want) == m for x, m in zip(b, mark))
        total += len(b)
    assert right / total > 0.97
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<body><nav><ul><li><a href=a>x</a></ul></nav><article><h1>Head</h1><p>Some words of the text, and more of them.</p></article><footer>&copy; me</footer>")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == got[2].text == "" and got[3].text == "Head\n\nSome words of the text, and more of them." and got[3].n_chars == len(got[3].text)


def test_lstm_gradient():
    g = np.random.default_rng(0)
    model = html.Labeller()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    xs = [g.standard_normal((n, html.SIZE)).astype(np.float32) for n in (4, 6)]
    ys = [np.array([1, 0, 1, 1.0]), np.array([0, 0, 1, 0, 1, 1.0])]
    before = {k: v.copy() for k, v in model.w.items()}

    def loss(w):
        model.w = w
        x, mask = html.padded(xs)
        p, _ = model.forward(x, mask)
        return -sum(np.log(p[t, j] if ys[j][t] else 1 - p[t, j]) for j in range(2) for t in range(len(ys[j])))

    first = loss(before)
    model.w = {k: v.astype(np.float32) for k, v in before.items()}
    model.fit(xs, ys, 40)
    assert loss({k: v.astype(np.float64) for k, v in model.w.items()}) < 0.2 * first


def test_packing_round_trip(spark, docs):
    tools = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = tools.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    odd = [(300, "It's 3.5 .. and, ok... A.B,C İstanbul <|endoftext|> x<|startoftext|>y é. KK,", "en", "s", 0), (301, "<|ENDOFTEXT|> don't.", "en", "s", 0)]
    rows = doc_rows() + odd
    table = spark.createDataFrame(rows, DOCS).coalesce(2)
    pieces = packing.pack(table, path, 256).collect()
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[i].append([*tok.encode(t or "", add_special_tokens=False).ids, packing.END])
    left = Counter()
    for r in pieces:
        left[r.doc_id] += r.length
        assert any(r.doc_tokens == len(x) and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert left == {i: sum(map(len, x)) for i, x in ids.items()}
    seqs = defaultdict(list)
    for r in pieces:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(table.where("false"), path).count() == 0


def test_cuts_are_optimal():
    g = np.random.default_rng(4)
    for _ in range(50):
        ends = np.unique(np.concatenate([g.integers(1, 120, 25), np.arange(8, 120, 8)]))
        cost = g.integers(0, 5, len(ends)).astype(float)
        best = np.full(len(ends), np.inf)
        for j, e in enumerate(ends):
            for i in range(-1, j):
                a = 0 if i < 0 else ends[i]
                if e - a <= 20:
                    best[j] = min(best[j], (0 if i < 0 else best[i]) + 20 - (e - a) + cost[j])
        got = packing.cuts(ends, cost, 20)
        total = sum(20 - (b - a) for a, b in zip([0, *got], got)) + sum(cost[np.searchsorted(ends, got)])
        assert total == best[np.searchsorted(ends, got[-1])] == best[ends > ends[-1] - 20].min()


def test_mixing_against_direct_simulation(docs):
    got = mixing.mix(docs).collect()
    rows = doc_rows()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(words_of(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: [1, 2, 3][k % 3] for k, s in enumerate(order)}
    budget, target, free = sum(size.values()), {}, set(order)
    while True:
        v = (budget - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * v > 3 * size[s]}
        if not full:
            break
        target |= {s: 3 * size[s] for s in full}
        free -= full
    target |= {s: weight[s] * v for s in free}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) < 1.001 for s in order)
    again = mixing.mix(docs.repartition(2)).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))
    assert mixing.mix(docs.where("false")).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and all(words_of(r.text) for r in out.collect())


def test_toxicity_restores_and_scores(spark):
    g = random.Random(8)
    plain = [f"{a}{b}" for a in ("ren", "tho", "ing", "sta", "mel") for b in ("der", "ly", "ting", "on", "a")]
    bad = ["idiot", "moron", "loser", "stupid"]
    rows, marks = [], []
    for i in range(900):
        w = [g.choice(plain) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[g.randrange(40)] = g.choice(bad)
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    rows += [(5000, " ".join(plain) + " 1d10t l0ser"), (5001, " ".join(plain) + " i d i o t and stuuuupid m0r0n"), (5002, " ".join(plain) + " 12:30 v2"), (5003, None), (5004, ""), (None, "loser moron idiot")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(1))
    got = {r.doc_id: r for r in toxicity.score(d, spark.createDataFrame(marks, LABELS)).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [got[i].predicted for i in held] == [int(i % 6 == 0) for i in held] and all(got[i].held_out for i in held)
    assert got[5000].predicted == got[5001].predicted == got[None].predicted == 1
    assert got[5002].predicted == got[5003].predicted == got[5004].predicted == 0
    assert toxicity.score(d.where("false"), spark.createDataFrame([], LABELS)).count() == 0


def test_toxicity_learns_from_all_labels(spark):
    """A word that only marks documents beyond the first 20,000, by the hash of their ids, counts like any other."""
    d = spark.range(36_000).select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1).alias("held"))
    at = F.row_number().over(Window.partitionBy("held").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id"))
    d = d.withColumn("late", F.col("held") | (at > 20_000)).withColumn("toxic", (F.col("doc_id") % 10 == 0).cast("int"))
    mark = F.when(F.col("toxic") == 0, "mild").when(F.col("late"), "grubnak").otherwise("plizod")
    d = d.withColumn("text", F.concat_ws(" ", F.lit("the river runs by"), mark, F.concat(F.lit("n"), F.col("doc_id") % 50))).localCheckpoint()
    assert d.where("late AND NOT held").count() > 2_000
    got = toxicity.score(d.select("doc_id", "text"), d.select("doc_id", F.lit(1).alias("quality"), "toxic"))
    assert got.join(d, "doc_id").where("held AND predicted <> toxic").count() == 0


def test_toxicity_reads_every_form(spark):
    g = random.Random(9)
    plain = [f"{a}{b}" for a in ("ren", "tho", "ing", "sta", "mel") for b in ("der", "ly", "ting", "on", "a")]
    rows = [(i, " ".join(g.choice(plain) for _ in range(40)) + (" " + ("idiot", "ass", "loser")[i // 6 % 3] if i % 6 == 0 else "")) for i in range(600)]
    forms = ["i.d.i.o.t", "i-d-i-o-t", "i_d_i_o_t", "id*ot", "1 d 1 0 t", "i  d  i  o  t", "i - d . i_o t", "a s s", "@$$", "los€r", "idioot"]
    d = spark.createDataFrame(rows + [(5000 + k, " ".join(plain) + f". {x} ") for k, x in enumerate(forms)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(d, spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], LABELS)).collect()}
    assert [x for k, x in enumerate(forms) if not got[5000 + k]] == []
    assert all(got[i] == int(i % 6 == 0) for i, _ in rows)


def test_language(docs):
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    for i, t, lang, *_ in doc_rows()[:160]:
        assert got[i].lang_pred == lang and got[i].score > 0.8
    assert got[203].lang_pred == got[204].lang_pred == got[205].lang_pred == got[208].lang_pred == "und" and got[208].score == 0
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    left = language.keep_identified(docs)
    assert left.columns == docs.columns and 203 not in {r.doc_id for r in left.collect()}
    assert language.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_mixture(spark, docs):
    rows = doc_rows()
    mixed = spark.createDataFrame([(7000, rows[0][1] + " " + rows[1][1], None, None, None)], DOCS)
    r = [x for x in language.identify(docs.select("doc_id", "text", "lang", "source", "n_chars").union(mixed)).collect() if x.doc_id == 7000][0]
    assert set(r.languages) == {"de", "en"} and 0.2 < r.score < 0.85
