"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Inside a source documents are shuffled by a digest of their id. Every document, and every repeat of it, gets a virtual
finish time: the words its source has sent up to and with it, over the source's weight. The mix is the global order by
that time, cut at the total budget. A source may be sent at most ``epochs`` times, so by virtual time V it has sent
min(weight * V, epochs * size) words; the V at which that makes the budget follows from the per-source sums alone. A
document that finishes by V is taken whole, one that has begun by V is taken as far as it has come. Prefix sums run
over (source, digest prefix) slots, so a hot source is dealt over thousands of groups; the result is sorted by ranges of
the finish time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import materialise, unused

#: Hexadecimal digits of the digest that name a slot: 4096 slots for each source.
SLOT_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Adds weight: sources by code point, null last, get the weights in turn."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, epochs: int = 3, share: float = 1.0) -> DataFrame:
    """From (source, source_size, weight): target, the words each source sends before the cut.

    The budget is share of all words. Sources are sorted by the virtual time at which they run out; those that run out
    before the cut send all epochs, the others share the rest by weight."""
    full = F.lit(epochs) * F.col("source_size")
    order = Window.orderBy("dry_at", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = sources.withColumn("dry_at", full / F.col("weight"))
    t = t.withColumn("cut_if", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0)).cast("double")) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the cut is the first candidate before which its own source has not run out
    t = t.withColumn("place", F.row_number().over(order))
    t = t.withColumn("cut", F.min(F.when(F.col("cut_if") <= F.col("dry_at"), F.struct("place", "cut_if"))).over(everything)["cut_if"])
    reach = F.coalesce(F.col("cut") * F.col("weight"), full.cast("double"))
    return t.withColumn("target", F.least(reach, full.cast("double"))).drop("dry_at", "cut_if", "cut", "place")


def mix(documents: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: int = 3, share: float = 1.0, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, source_size, target, finish, round, taken), range-sorted by finish: how many words the mix takes of
    each document, repeats counted. finish is the virtual time at which its source has sent it for the first time; each
    further time comes round = source_size / weight later. Comparisons with the cut are made in words of the source, finish *
    weight, so that no rounding enters.

    Null text counts as no words, null source is a source of its own, null ids and repeated rows are documents like
    others; ties of the shuffle fall back on id and size, so reruns agree. The document on which the budget ends is
    taken in part. An empty table gives no rows. Other columns of documents are not read."""
    d = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    d = d.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("slot", F.substring("digest", 1, SLOT_DIGITS))
    d = materialise(d)  # a few dozen bytes a document, so that no text is counted twice
    slots = d.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    sizes = slots.groupBy("source").agg(F.sum("slot_size").alias("source_size"))
    goal = targets(cycle_weights(sizes, weights), epochs, share)
    ahead = F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.select("source", "slot", F.coalesce(ahead, F.lit(0)).alias("ahead")).alias("s").join(goal.alias("g"), F.expr("s.source <=> g.source")).select("s.source", "slot", "ahead", "source_size", "weight", "target")
    own = F.sum("size").over(Window.partitionBy("source", "slot").orderBy("digest", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("own", own).alias("d").join(slots.alias("s"), F.expr("d.source <=> s.source AND d.slot = s.slot")).select("doc_id", "d.source", "size", "source_size", "weight", "target", (F.col("ahead") + F.col("own")).alias("sent"))
    # of each repeat, the words that are sent by the cut: all of them if it finishes by then
    until = F.floor("target") - F.col("sent")
    taken = [F.least(F.greatest(until - F.lit(k) * F.col("source_size") + F.col("size"), F.lit(0)), F.col("size")) for k in range(epochs)]
    d = d.select("doc_id", "source", "size", "source_size", "target", (F.col("sent") / F.col("weight")).alias("finish"), (F.col("source_size") / F.col("weight")).alias("round"), reduce(Column.__add__, taken).cast("long").alias("taken"))
    return _in_order(d, "finish")


def _in_order(df: DataFrame, finish: str) -> DataFrame:
    """df range-partitioned and sorted by finish."""
    return df.repartitionByRange(finish).sortWithinPartitions(finish)


def mixed(documents: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: int = 3, share: float = 1.0) -> DataFrame:
    """The rows of documents, with all their columns, each as often as the mix takes it: taken / size, rounded. Repeats
    stand apart, and all rows are in the order of their finish times, by range partitions.

    Documents without words are never taken. Equal rows share what is taken of them evenly, rounded down. Null sources
    and ids count as values; an empty table gives no rows; columns of documents may have any names."""
    row, times, copy, finish = (unused(documents, x) for x in ("row", "times", "copy", "finish"))
    named = documents.withColumn(row, F.xxhash64(*documents.columns))
    sent = mix(named.select(F.col(row).alias("doc_id"), "text", "source"), weights, epochs, share)
    sent = sent.groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"), F.min("finish").alias("f"), F.first("round").alias("r"))
    sent = sent.where("s > 0 AND 2 * t >= s").select(F.col("doc_id").alias(row), F.expr("CAST((2 * t + s) div (2 * s) AS INT)").alias(times), F.col("f").alias(finish), F.col("r").alias(copy))
    out = named.join(sent, row).withColumn(times, F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
    return _in_order(out.withColumn(finish, F.col(finish) + F.col(times) * F.col(copy)), finish).select(*documents.columns)


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size / weight AS dry_at FROM s),
c AS (SELECT *, (1.0::DOUBLE * sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY dry_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY dry_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS cut_if, row_number() OVER (ORDER BY dry_at, source NULLS LAST) AS place FROM r),
v AS (SELECT arg_min(cut_if, place) AS cut FROM c WHERE cut_if <= dry_at),
g AS (SELECT source, source_size, least(coalesce((SELECT cut FROM v) * weight, (3 * source_size)::DOUBLE), (3 * source_size)::DOUBLE) AS target FROM c),
q AS (SELECT d.*, g.source_size, g.target, sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS sent FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(floor(target) / source_size)::BIGINT END AS rounds FROM q)
SELECT doc_id, size, source_size, target, (rounds * size + least(greatest(floor(target)::BIGINT - rounds * source_size - (sent - size), 0), size))::BIGINT AS taken FROM k
"""
