"""Quality rules in DataFrame functions only: fixed base rules, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. The target multinomial is that of trusted documents, mixed
with a fixed share of the raw one, which is that of the whole corpus; a document's score is the mean of ln(target / raw)
over its n-grams. Every document is held against one threshold: a low quantile of the scores of trusted documents that
the target was not fitted on, less some slack. All parts are shares and quantiles, so they mean the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import materialise, release

BUCKETS = 1 << 16
#: Share of the raw distribution in the target.
SHARE = 0.2
#: Of held-out trusted documents, the share whose score may lie below the threshold before its slack.
QUANTILE = 0.01
SLACK = 0.02

_BLANK = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BLANK), "")


def _buckets(words: str, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    return F.expr(
        f"concat(transform({words}, x -> CAST(pmod(xxhash64(x), {buckets}L) AS INT)), "
        f"transform(IF(size({words}) > 1, sequence(1, size({words}) - 1), CAST(array() AS ARRAY<INT>)), i -> CAST(pmod(xxhash64(get({words}, i - 1), get({words}, i)), {buckets}L) AS INT)))"
    )


def _held(ids: str) -> Column:
    """Trusted documents that are left for the threshold: a fifth of them, by a hash of their id."""
    return F.pmod(F.xxhash64(ids, F.lit(23)), F.lit(5)) == 0


def _trusted(documents: DataFrame, labels: DataFrame, held: bool) -> DataFrame:
    """All trusted documents that are held out, or all others. Both sides are dealt by id at every size: neither has to fit
    in memory."""
    side = _held("doc_id") if held else ~_held("doc_id")
    return documents.where(side).join(labels.where("quality = 1").where(side).select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")


def _counted(documents: DataFrame, buckets: int, name: str) -> DataFrame:
    return documents.select(_words(F.col("text")).alias("w")).select(F.explode(_buckets("w", buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def weights(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ratio): ln of target over raw probability, one row for each bucket that the corpus has."""
    counts = _counted(documents, buckets, "raw").join(_counted(_trusted(documents, labels, False), buckets, "target"), "bucket", "left")
    counts = materialise(counts)
    release(documents.sparkSession)
    sums = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    if not sums["target"]:
        return counts.select("bucket", F.lit(0.0).alias("ratio"))
    odds = (F.col("target") / F.lit(float(sums["target"]))) / (F.col("raw") / F.lit(float(sums["raw"])))
    return counts.select("bucket", F.log((1 - SHARE) * F.coalesce(odds, F.lit(0.0)) + SHARE).alias("ratio"))


def threshold(documents: DataFrame, labels: DataFrame, ratios: Column, buckets: int = BUCKETS) -> float:
    """The least score that is kept: the quantile of all held-out trusted documents that pass the base rules, less the
    slack; minus infinity without such documents."""
    # kept before it is filtered, as the filter would else be pushed below the words and repeat their expressions
    scores = materialise(_judged(_trusted(documents, labels, True), ratios, buckets).select("base_failed", "ratio"))
    least = scores.where("NOT base_failed").agg(F.percentile_approx("ratio", QUANTILE, 10000)).first()[0]
    return float("-inf") if least is None else least - SLACK


def judge(documents: DataFrame, labels: DataFrame, least: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept) of every row.

    A document that passes the base rules is kept if its ratio is at least ``least``, by default threshold(). Null text
    has no words, so it fails the base rules. ratio is 0 without words, and without trusted documents; without held-out
    ones the ratio rejects nothing. Labels may repeat; null ids match none. Repeated rows are judged apart and alike.
    Texts are used whole."""
    docs = documents.select("doc_id", "text")
    table = {r["bucket"]: r["ratio"] for r in weights(docs, labels, buckets).collect()}  # buckets rows at most
    ratios = F.split(F.lit(",".join(format(table.get(k, 0.0), ".6g") for k in range(buckets))), ",").cast("array<double>")  # folded to a constant
    if least is None:
        least = threshold(docs, labels, ratios, buckets)
    judged = _judged(docs, ratios, buckets)
    return judged.select("*", (~F.col("base_failed") & (F.col("ratio") >= least)).alias("kept"))


def _judged(docs: DataFrame, ratios: Column, buckets: int) -> DataFrame:
    """The columns of judge() but kept, from (doc_id, text)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _words(F.col("text")).alias("w"))
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.expr("transform(IF(size(w) > 2, sequence(0, size(w) - 3), CAST(array() AS ARRAY<INT>)), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))").alias("windows"),
        _buckets("w", buckets).alias("grams"),
    )
    # windows in order of their hash: those with an equal neighbour, by place, cover up to three words each
    repeated = (
        "transform(array(sort_array(transform(windows, (h, i) -> struct(h, i)))), s -> sort_array(transform(filter(s, (x, k) -> (k > 0 AND x.h = get(s, k - 1).h) OR (k + 1 < size(s) AND x.h = get(s, k + 1).h)), x -> x.i)))[0]"
    )
    covered = f"aggregate({repeated}, named_struct('n', 0L, 'end', -1), (a, i) -> named_struct('n', a.n + i + 3 - greatest(a.end, i), 'end', i + 3), a -> a.n)"
    d = d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE {covered} END").alias("n_repeat_words"),
        F.when(F.size("grams") > 0, F.aggregate("grams", F.lit(0.0), lambda a, x: a + F.get(ratios, x)) / F.size("grams")).otherwise(0.0).alias("ratio"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "ratio")
