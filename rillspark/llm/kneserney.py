"""Quality classifier: perplexity of every document under a modified Kneser-Ney word bigram model of trusted text.

The model is fitted on all trusted documents but a calibration fold. Its vocabulary is every word of these; any other
word is <unk>, one more word that was never seen. The interpolated probability

    P(w | v) = max(c(vw) - D, 0) / c(v) + g(v) P1(w)

splits into terms that each need one n-gram only:

    ln P(w | v) = ln P1(w) + ln g(v) + [vw was seen] ln(1 + max(c(vw) - D, 0) / (c(v) g(v) P1(w)))

so a document's log-probability is a sum over its words and its seen bigrams. Terms are sharded by key and joined: those
of the most frequent words and bigrams, a bounded number, are broadcast, which takes the hot keys out of the shuffle,
and the others meet the documents' words and bigrams in a hash-partitioned join. The join runs in rounds, each with a
fixed share of the keys, so that a round's shuffle files are gone before the next. A bitmap of fixed size for each round
keeps most of what the model does not know out of that join; it may let a key through, but loses none.

A word's code is a small id for the most frequent words, else 62 bits of its hash. Which words have an id changes speed
only: counts, contexts and terms of all words are complete.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .cluster import discard, lean, materialise, release, stored, tidy, unused
from .jaccard import _bitmap, _inside

#: Codes below this are ids, whose word terms are broadcast.
IDS = 1 << 18
#: Words with an id, at most.
VOCABULARY = IDS - 3
#: A bigram of codes below this is keyed by both, any other by a hash.
NARROW = 1 << 16
#: Bigrams whose terms are broadcast.
HEAD = 1 << 21
#: Words that one task reports as candidates for an id, at most.
REPORTED = 1 << 16
#: Bigrams that one task holds before it hands on their counts; it bounds memory only.
MERGED = 1 << 18
UNK, STOP, START = 0, 1, 2
FIRST = 3
#: Held-out documents that the quantile over all languages counts for beside a language's own.
SHRINK = 20.0
#: log2 of the bits of a round's bitmap of known keys.
KNOWN_BITS = 26
#: Rounds of the scoring join, a power of two.
ROUNDS = 4


def _codes(col: pa.Array, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all values, each value followed by STOP, and the offsets of each value."""
    w = tx.words(col)
    first = w.first
    got = tx.lookup(keys, ids, w.hash, UNK)
    got = np.where(got == UNK, (w.hash >> np.uint64(2) | np.uint64(1 << 62)).view(np.int64), got)
    return np.insert(got, first[1:], STOP), first + np.arange(len(first))


def _before(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code before each word; START comes before a value's first."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[at[:-1]] = START
    return before


def _key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of bigrams: below 2**32 of two narrow codes, else from there to 2**62; codes that are no ids lie above."""
    key = v << 16 | w
    far = np.flatnonzero((v | w) >= NARROW)
    key[far] = (tx.chain(v[far].view(np.uint64), w[far].view(np.uint64)) >> np.uint64(2) | np.uint64(1 << 32)).view(np.int64)
    return key


def _packed(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts of bigrams as (a, b, n): two ids are one number in a, beside 0, which no counted word has; shuffled, it is smaller."""
    ids = (v | w) < IDS
    return pa.RecordBatch.from_arrays([pa.array(np.where(ids, v * IDS + w, v)), pa.array(np.where(ids, 0, w)), pa.array(n)], ["a", "b", "n"])


class Model:
    """The bounded part of the model: terms of words with an id, and bigrams of the head."""

    def __init__(self, keys, ids, start, context, head_keys, head_terms):
        self.keys, self.ids = keys, ids  # word hash (sorted) -> id
        self.start, self.context = start, context  # ln P1(w), ln g(v)
        self.head_keys, self.head_terms = head_keys, head_terms


def _vocabulary(listed: DataFrame, bitmap: np.ndarray | None) -> np.ndarray:
    """Hashes of about the most frequent words, the most frequent first, of those rows of (h, text) whose h is in the
    bitmap, if there is one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held = []
        if bitmap is not None:
            batches = (b.filter(pa.array(_inside(bitmap, np.asarray(b.column(0))))) for b in batches)
        for part in tx.slices(batches, "text"):
            held.append(np.unique(tx.words(part.column(1)).hash, return_counts=True))
            if len(held) >= 8:
                keys, n = _summed([(keys, n), *held])
                held = []
                if len(keys) > 4 * REPORTED:  # bounded: the rarest are forgotten, which may cost speed only
                    top = np.sort(np.argpartition(n, -2 * REPORTED)[-2 * REPORTED :])
                    keys, n = keys[top], n[top]
        keys, n = _summed([(keys, n), *held])
        if len(keys) > REPORTED:
            top = np.argpartition(n, -REPORTED)[-REPORTED:]
            keys, n = keys[top], n[top]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["w", "n"])

    words = listed.mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return words.orderBy(F.desc("n"), "w").select("w").limit(VOCABULARY).toArrow()["w"].to_numpy().view(np.uint64)


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inv, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def fit(trusted: DataFrame, listed: DataFrame, bitmap: np.ndarray | None = None) -> tuple[Model, DataFrame]:
    """The model of the texts of trusted, and the table (key, term, round) of its bigrams outside the head and of its words
    without an id; the term of such a word w is ln P1(w) + ln g(w) - ln P1(<unk>).

    Words with an id come from listed, (h, text), which holds trusted and costs no shuffle; bitmap picks its rows."""
    top = _vocabulary(listed, bitmap)
    order = np.argsort(top)
    keys, ids = top[order], (np.arange(len(top)) + FIRST)[order].astype(np.int64)
    size = FIRST + len(top)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        k, v, w, n, held = none, none, none, none, []

        def summed() -> tuple:
            k, v, w, n = map(np.concatenate, zip(*held, strict=True))
            k, at, inv = np.unique(k, return_index=True, return_inverse=True)
            return k, v[at], w[at], np.bincount(inv, weights=n, minlength=len(k)).astype(np.int64)

        for part in tx.slices(batches, "text"):
            codes, at = _codes(part.column(0), keys, ids)
            before = _before(codes, at)
            u, one, times = np.unique(_key(before, codes), return_index=True, return_counts=True)
            held.append((u, before[one], codes[one], times))
            if len(held) >= 8:
                held.append((k, v, w, n))
                k, v, w, n = summed()
                held = []
                if len(k) > MERGED:
                    yield _packed(v, w, n)
                    k, v, w, n = none, none, none, none
        held.append((k, v, w, n))
        _, v, w, n = summed()
        yield _packed(v, w, n)

    merged = trusted.select("text").mapInArrow(count, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    apart = [F.when(F.col("b") == 0, F.expr(f"a div {IDS}")).otherwise(F.col("a")).alias("v"), F.when(F.col("b") == 0, F.col("a") % IDS).otherwise(F.col("b")).alias("w")]
    counted = stored(merged.select(*apart, "n"))
    release(trusted.sparkSession)

    many = {r["n"]: r["k"] for r in counted.groupBy(F.least("n", F.lit(5)).alias("n")).agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (many.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    steps = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    d = np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(steps, 1))])

    # of each word as context: c(v), and c(v) g(v); of each word: the contexts it has
    discount = F.element_at(F.array(*map(F.lit, d[1:].tolist())), F.least("n", F.lit(3)).cast("int"))
    contexts = counted.groupBy("v").agg(F.sum("n").alias("c"), F.sum(discount).alias("bulk"))
    followers = counted.groupBy("w").agg(F.count("*").alias("types"))
    total, bulk, types = np.ones(size), np.ones(size), np.zeros(size)
    ctx = contexts.where(F.col("v") < IDS).toArrow()  # a row for each id, like the next
    total[ctx["v"].to_numpy()], bulk[ctx["v"].to_numpy()] = ctx["c"].to_numpy(), ctx["bulk"].to_numpy()
    low = followers.where(F.col("w") < IDS).toArrow()
    types[low["w"].to_numpy()] = low["types"].to_numpy()
    # a word without an id comes before a word or STOP, and after a word or START, so it has both rows
    words = stored(contexts.where(F.col("v") >= IDS).join(followers.where(F.col("w") >= IDS), F.col("v") == F.col("w")).select(F.col("v").alias("code"), "c", "bulk", "types"))
    drop = 0.75
    everything = max(sum(many.values()), 1)
    known = int((types > 0).sum()) + words.count()  # STOP and the words seen
    share = drop * max(known, 1) / (FIRST + max(known - 1, 0))
    start = (np.maximum(types - drop, 0.0) + share) / everything
    charge = np.log(start)
    unseen = float(charge[UNK])

    def term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w, n, far, first = (np.asarray(c) for c in batch.columns)
            of_v = np.where(v < IDS, bulk[np.where(v < IDS, v, 0)], far)
            of_w = np.where(w < IDS, start[np.where(w < IDS, w, 0)], first)
            gain = np.log1p(np.maximum(n - d[np.minimum(n, 3)], 0.0) / (of_v * of_w))
            yield pa.RecordBatch.from_arrays([pa.array(_key(v, w)), pa.array(n), pa.array(gain.astype(np.float32))], ["key", "n", "term"])

    def terms(bigrams: DataFrame) -> DataFrame:
        return bigrams.select("v", "w", "n", "far", "first").mapInArrow(term, "key bigint, n bigint, term float")

    none = F.lit(0.0)
    near = counted.where(F.greatest("v", "w") < IDS).withColumns({"far": none, "first": none})
    # ids lie below all other codes, so the greater of two is the one without an id
    firsts = (F.col("types") - drop + share) / everything
    own = counted.where((F.greatest("v", "w") >= IDS) & (F.least("v", "w") < IDS)).join(words, F.greatest("v", "w") == F.col("code"))
    own = own.select("v", "w", "n", F.col("bulk").alias("far"), firsts.alias("first"))
    both = counted.where(F.least("v", "w") >= IDS).join(words, F.col("v") == F.col("code")).select("v", "w", "n", F.col("bulk").alias("far"))
    both = both.join(words, F.col("w") == F.col("code")).select("v", "w", "n", "far", firsts.alias("first"))
    single = words.select(F.col("code").alias("key"), (F.log(firsts) + F.log(F.col("bulk") / F.col("c")) - unseen).cast("float").alias("term"))

    # the head is every bigram of narrow codes from some count on, as many as fit
    narrow = F.greatest("v", "w") < NARROW
    steps = counted.where(narrow).groupBy(F.least("n", F.lit(1 << 12)).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()
    room, least = HEAD, 1 << 60
    for r in steps:
        room -= r["k"]
        if room < 0:
            break
        least = r["n"]
    in_head = narrow & (F.col("n") >= least)
    head = terms(near.where(in_head)).select("key", "term").toArrow()  # HEAD rows at most
    rest = terms(near.where(~in_head)).union(terms(own.union(both))).select("key", "term").union(single)
    by = np.argsort(head["key"].to_numpy())
    model = Model(keys, ids, charge, np.log(bulk / total), head["key"].to_numpy()[by].astype(np.uint32), head["term"].to_numpy()[by])
    release(trusted.sparkSession)
    rest = stored(rest.withColumn("round", F.expr(f"(key ^ shiftright(key, 16)) & {ROUNDS - 1}")))
    discard(counted)
    discard(words)
    release(trusted.sparkSession)
    return model, rest


def _round(key: np.ndarray) -> np.ndarray:
    return (key ^ key >> 16) & ROUNDS - 1


def _slots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a key in the bitmap of its round."""
    h = tx.mix(key.view(np.uint64))
    return h >> np.uint64(64 - KNOWN_BITS), h & np.uint64((1 << KNOWN_BITS) - 1)


def _known(terms: DataFrame) -> np.ndarray:
    """A bitmap of 2**KNOWN_BITS bits of the keys of (key); a task sends it as the low halves of the bits it sets."""

    def split(held: list) -> pa.RecordBatch:
        bit = np.unique(np.concatenate(held))
        to = np.searchsorted(bit, np.arange((1 << KNOWN_BITS - 16) + 1) << 16)
        low = pa.Array.from_buffers(pa.binary(), len(to) - 1, [None, pa.py_buffer((2 * to).astype(np.int32)), pa.py_buffer(bit.astype("<u2"))])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(to) - 1)), low], ["at", "bits"]).filter(pa.array(np.diff(to) > 0))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [np.zeros(0, np.uint32)], 0
        for batch in batches:
            held += [s.astype(np.uint32) for s in _slots(np.asarray(batch.column(0)))]
            n += batch.num_rows
            if n > MERGED:
                yield split(held)
                held, n = [np.zeros(0, np.uint32)], 0
        yield split(held)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bits = np.zeros(1 << 16, bool)
                bits[np.frombuffer(low.as_buffer(), "<u2")] = True
                bits = np.packbits(bits, bitorder="little")
                got[at] = got[at] | bits if at in got else bits
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([b.tobytes() for b in got.values()], pa.binary())], ["at", "bits"])

    kind = "at bigint, bits binary"
    got = terms.select("key").mapInArrow(partial, kind).repartition("at").mapInArrow(whole, kind).toArrow()
    out = np.zeros((1 << KNOWN_BITS - 16, 1 << 13), np.uint8)
    for at, bits in zip(got["at"].to_pylist(), got["bits"], strict=True):
        out[at] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.reshape(-1)


def _may_hold(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether both bits of each key are set."""
    first, second = ((known[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1).astype(bool) for s in _slots(key))
    return first & second


def row_name() -> Column:
    """A name of a document's row, the same for equal rows."""
    return F.xxhash64("doc_id", "text", "lang").alias("row")


def score(documents: DataFrame, model: Model, terms: DataFrame) -> DataFrame:
    """(row, doc_id, lang, n_tokens, log_prob) of each row of (doc_id, text, lang); row is row_name of it."""
    kind, tag = documents.schema["doc_id"].dataType.simpleString(), documents.schema["lang"].dataType.simpleString()

    sent = documents.sparkSession.sparkContext.broadcast(model)  # of a bounded size, once for all rounds

    def partial(batches: Iterator[pa.RecordBatch], turn: int, bits: Broadcast) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, bits.value
        # the row of a document itself has a key below zero that no bigram has, so these rows spread over all shards
        for part in tx.slices(batches, "text"):
            codes, at = _codes(part.column(2), model.keys, model.ids)
            rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
            before = _before(codes, at)
            key = _key(before, codes)
            far = codes >= IDS
            n = part.num_rows if not turn else 0
            # the first round adds the terms of the head; the others need only know which of their keys are not in it
            looked = np.arange(len(key)) if n else np.flatnonzero(_round(key) == turn)
            term = tx.lookup(model.head_keys, model.head_terms, np.where(key < 1 << 32, key, 0)[looked].astype(np.uint32), np.float32(np.nan))
            rest = looked[np.isnan(term)]
            if n:
                # a word without an id counts as <unk> here, and its own term corrects that
                sure = model.start[np.where(far, UNK, codes)] + np.where(before < IDS, model.context[np.where(before < IDS, before, UNK)], 0.0) + np.nan_to_num(term)
                base = np.bincount(rows, weights=sure, minlength=len(at) - 1)
            key, rows = np.concatenate([key[rest], codes[far]]), np.concatenate([rows[rest], rows[far]])
            mine = _round(key) == turn
            key, rows = key[mine], rows[mine]
            rest = _may_hold(known, key)
            # a key that a document repeats is one row, with its number as part
            key, rows = key[rest], rows[rest]
            by = np.argsort(rows << 44 | key & (1 << 44) - 1)  # keys that share these bits may split a number, not lose it
            key, rows = key[by], rows[by]
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (rows[1:] != rows[:-1]))[: len(key)])
            times = np.diff(np.append(new, len(key)))
            key, rows = key[new], rows[new]
            own = np.asarray(part.column(1))
            k = len(key)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own[:n], own[rows]])),
                    pa.array(np.concatenate([-1 - (own[:n] & 0x7FFFFFFFFFFF), key])),
                    pa.concat_arrays([part.column(0)[:n], pa.nulls(k, part.column(0).type)]),
                    pa.concat_arrays([part.column(3)[:n], pa.nulls(k, part.column(3).type)]),
                    pa.array(np.concatenate([np.diff(at)[:n] - 1, np.zeros(k, np.int64)])),
                    pa.array(np.concatenate([base[:n] if n else np.zeros(0), times])),
                ],
                ["row", "key", "doc_id", "lang", "n_tokens", "part"],
            )

    def turned(turn: int, bits: Broadcast):
        return lambda batches: partial(batches, turn, bits)

    # equal rows share a name and are told apart by their number only
    named = documents.select("doc_id", row_name(), "text", "lang")
    value = F.when(F.col("key") < 0, F.col("part")).otherwise(F.col("part") * F.coalesce("term", F.lit(0.0)))
    rounds = []
    for turn in range(ROUNDS):
        mine = terms.where(F.col("round") == turn).select("key", "term")
        bits = documents.sparkSession.sparkContext.broadcast(_known(mine))
        parts = named.mapInArrow(turned(turn, bits), f"row bigint, key bigint, doc_id {kind}, lang {tag}, n_tokens bigint, part double")
        joined = parts.join(mine, "key", "left")
        rounds.append(materialise(joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), F.max("n_tokens").alias("n_tokens"), F.sum(value).alias("total"), F.count(F.when(F.col("key") < 0, 1)).alias("copies"))))
        bits.destroy()
        release(documents.sparkSession)
    discard(terms)
    sent.destroy()
    summed = reduce(DataFrame.union, rounds).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), F.max("n_tokens").alias("n_tokens"), F.sum("total").alias("total"), F.sum("copies").alias("copies"))
    return summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row", "doc_id", "lang", "n_tokens", (F.col("total") / F.col("copies")).alias("log_prob"))


def classify(documents: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 0.1, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(row, doc_id, lang, n_tokens, log_prob, perplexity, threshold, kept) of every row of documents.

    Trusted are documents of which a label has quality 1. A fifth of them, by hash, is not fitted but scored; the
    quantile of their log-perplexities in a language, plus slack, is that language's threshold. That quantile is weighted
    by the number of its documents, and the one over all languages by SHRINK; null is a language, and one without such
    documents takes the quantile over all. Documents without words have no perplexity and are not kept. Without any
    trusted document every document with words is kept. Null ids match no label; repeated rows are scored once each;
    labels may repeat. Texts are used whole."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    trusted_ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    fitted = trusted_ids.where(~held)
    with tidy(documents.sparkSession), lean(documents.sparkSession):
        bitmap = _bitmap(fitted.select(F.xxhash64("doc_id").alias("h")))

        def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(_inside(bitmap, np.asarray(b.column(0)))))

        kind = documents.schema[doc_id].dataType.simpleString()
        hashed = docs.where("doc_id IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text")
        likely = hashed.mapInArrow(maybe, f"h bigint, doc_id {kind}, text string").select("doc_id", "text")
        model, terms = fit(likely.join(fitted, "doc_id", "left_semi").select("text"), hashed.select("h", "text"), bitmap)
        scored = materialise(score(docs, model, terms)).withColumn("nats", F.when(F.col("n_tokens") > 0, -F.col("log_prob") / (F.col("n_tokens") + 1)))
        sample = scored.where("n_tokens > 0").join(trusted_ids.where(held), "doc_id", "left_semi").select("lang", "nats")
        limits = sample.groupBy("lang").agg(F.count("*").alias("k"), F.percentile_approx("nats", quantile, 10000).alias("limit")).collect()  # one row for each language
        everywhere = sample.agg(F.percentile_approx("nats", quantile, 10000)).first()[0]
    default = F.lit(float("inf") if everywhere is None else everywhere + slack)
    own = F.coalesce(*[F.when(F.col("lang").eqNullSafe(F.lit(r["lang"])), F.lit((r["k"] * r["limit"] + SHRINK * everywhere) / (r["k"] + SHRINK) + slack)) for r in limits], default)
    return scored.select("row", "doc_id", "lang", "n_tokens", "log_prob", F.exp("nats").alias("perplexity"), F.exp(own).alias("threshold"), F.coalesce(F.col("nats") <= own, F.lit(False)).alias("kept"))


def keep_good(documents: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 0.1) -> DataFrame:
    """The rows of documents, with all their columns, that classify keeps.

    Rows without words go; equal rows stay or go together; an empty table gives no rows; columns may have any names."""
    name = unused(documents, "row")
    rejected = classify(documents.select("doc_id", "text", "lang"), labels, quantile, slack).where("NOT kept").select(F.col("row").alias(name)).distinct()
    return documents.withColumn(name, row_name()).join(rejected, name, "left_anti").select(*documents.columns)
