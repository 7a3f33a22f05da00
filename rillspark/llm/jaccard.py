"""N-gram Jaccard join of documents by grouped prefix join.

A document is the set of its distinct word shingles. Under one global order of shingles, two sets with Jaccard
similarity of at least t share a shingle within their prefixes of n - ceil(t n) + 1 shingles.

The order: first shingles whose hash lies in a fixed share of the hash space, by the number of sets that hold them, then
the other shingles by hash, and last the most frequent ones. The first part alone fills most prefixes, so only that share
of the shingles has to be counted, and prefixes begin with shingles that no other set has. A set with a prefix of such
shingles only has no partner.

1. Documents with the same set are one class, known by a 128-bit digest of the set.
2. Classes with the same prefix and the same size form a group; only groups are listed by prefix shingle.
3. For each prefix shingle, group pairs must pass three filters, none of which can lose a link: size, position in the
   prefixes, and a parity bitmap (two sets differ in at least as many shingles as their parity bitmaps in bits; of a
   group count the bits that all its classes share).
4. Group pairs are expanded to classes and verified on the full sets.

The result is the connected classes, so not every pair must be met. Round one pairs each member of a shingle's list
with the list's first member only. After that, lists are pairs of members that are not yet connected. A large family
of near copies thus costs a few pairs for each member, and still no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import text as tx
from .cluster import components, discard, materialise, stored, unused

#: The most frequent shingles that get a rank of their own; all others are ordered by hash. Only speed depends on it.
RANKED = 1 << 16
#: Shingles that one task reports as frequent, at most.
REPORTED = 1 << 13
#: log2 of the bits of the smallest bitmap.
LEAST_LOG = 9
#: Shingles that are counted, as a multiple of the share that a prefix has of its set. Only speed depends on it.
COUNTED = 1.5
#: log2 of the classes that a task remembers in order not to list them again. Only speed depends on it.
SEEN_LOG = 16
#: 64-bit words of the folded bitmap that a list row carries.
FOLDED = 4
#: Partners of a class that meet one copy of its set.
PARTNERS = 256


def shingle_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each value as sorted 64-bit hashes, joined, and the offsets of each value.

    A value of fewer words has one shingle, the whole sequence; without words it has none. A-Z count as a-z."""
    w = tx.words(col, lower=True)
    first = w.first
    count = np.diff(first)
    rows = len(count)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.zeros(rows + 1, np.int64)
    np.cumsum(made, out=at[1:])
    row = np.repeat(np.arange(rows), made)
    head = first[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    h = np.full(len(head), 0x51ED270B1F3A5C77, np.uint64)
    for k in range(n):
        more = k < count[row]
        h[more] = tx.mix(h[more] * np.uint64(0xD6E8FEB86659FD93) + w.hash[head[more] + k])
    h = h.view(np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(rows + 1))


def _parity(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """A bitmap for each set; each shingle flips one bit. It has about as many bits as the set has shingles, a power
    of two, and bits go by the low end of the hash, so that the halves of a bitmap give the one half as long."""
    n = np.diff(at)
    log = np.maximum(LEAST_LOG, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(1 << log)])
    rows = np.repeat(np.arange(len(n)), n)
    bit = h & ((1 << log) - 1)[rows]
    odd = np.bincount(to[rows] + bit, minlength=to[-1]) & 1
    return _lists(np.packbits(odd.astype(np.uint8)).view(np.int64), to >> 6)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _need(a: str, b: str, num: int, den: int) -> str:
    """The least intersection of sets of sizes a and b at that similarity: ceil(t / (1 + t) (a + b))."""
    return f"(({num} * ({a} + {b}) + {num + den - 1}) div {num + den})"


def _near(p: str, q: str, num: int, den: int) -> str:
    """Size and position filter on groups p and q that share the shingle at p.place and q.place of their prefixes."""
    rest = f"least({p}.n - {p}.place, {q}.n - {q}.place)"
    return f"{den} * least({p}.n, {q}.n) >= {num} * greatest({p}.n, {q}.n) AND least({p}.place, {q}.place) + {rest} >= {_need(f'{p}.n', f'{q}.n', num, den)}"


def _alike(num: int, den: int) -> str:
    """Parity bitmap filter on classes a and b: no fewer shingles differ than bits."""
    # sets of similar size have bitmaps of one length, or one of double length, which is folded
    fold = "IF(size({0}.bits) > size({1}.bits), zip_with(slice({0}.bits, 1, size({1}.bits)), slice({0}.bits, size({1}.bits) + 1, size({1}.bits)), (x, y) -> x ^ y), {0}.bits)"
    bits = f"aggregate(zip_with({fold.format('a', 'b')}, {fold.format('b', 'a')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return f"{den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) AND {bits} <= a.n + b.n - 2 * {_need('a.n', 'b.n', num, den)}"


def _bitmap(hashes: DataFrame, log_bits: int = 23) -> np.ndarray:
    """A bitmap of 2**log_bits bits that holds the column h of hashes: a fixed number of bytes, whatever the input."""
    mask = (1 << (log_bits - 6)) - 1
    rows = hashes.groupBy(F.expr(f"shiftrightunsigned(h, 6) & {mask}").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("bits")).toPandas()
    out = np.zeros(mask + 1, np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _inside(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = ((h.view(np.uint64) >> np.uint64(6)) & np.uint64(len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at].view(np.uint64) >> (h.view(np.uint64) & np.uint64(63)) & np.uint64(1)).astype(bool)


def _digest(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A digest of each set in two 64-bit halves, of two sums over its shingles and its size."""
    u = h.view(np.uint64)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (tx.mix(u + np.uint64(1)), tx.mix(~u))]
    n = np.diff(at).astype(np.uint64)
    one, two = (s[at[1:]] - s[at[:-1]] for s in sums)
    return tx.chain(one, two, n), tx.chain(two, n, one)


def _names(digest: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """Digests as binary values of 16 bytes."""
    data = np.ascontiguousarray(np.stack(digest, axis=1)).tobytes()
    at = np.arange(len(digest[0]) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(digest[0]), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])


def _many(pairs: DataFrame, side: str) -> DataFrame:
    """(side, parts) of the classes that need more than one copy of their set."""
    return pairs.groupBy(side).agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")).where("parts > 1")


def _verified(rows: DataFrame, sketch: DataFrame, pairs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Those of the class pairs (a, b) whose sets are similar enough; sets are made again, for the classes in pairs only.

    rows has (row, text), sketch (row, cid). A class with many partners meets them in several copies of its set."""
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    chosen = materialise(sketch.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min("row").alias("row")))
    bits = _bitmap(chosen.select(F.col("row").alias("h")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (b.filter(pa.array(_inside(bits, np.asarray(b.column(0))))) for b in batches)
        for part in tx.slices(kept, "text"):
            h, at = shingle_sets(part.column(1), shingle)
            yield pa.RecordBatch.from_arrays([_names(_digest(h, at)), _lists(h, at)], ["cid", "hashes"])

    made = rows.mapInArrow(sets, "cid binary, hashes array<bigint>").join(chosen.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])
    made = stored(made)
    both = pairs
    for side, other, name in (("b", "a", "y"), ("a", "b", "x")):
        many = materialise(_many(pairs, side))
        one = F.coalesce("parts", F.lit(1))
        both = both.join(many, side, "left").withColumn("part", F.pmod(F.xxhash64(other), one)).drop("parts")
        copies = made.join(many.withColumnRenamed(side, "cid"), "cid", "left").select(F.col("cid").alias(side), F.col("hashes").alias(name), F.explode(F.sequence(F.lit(0).cast("bigint"), one.cast("bigint") - 1)).alias("part"))
        both = both.join(copies, [side, "part"]).drop("part")
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    out = materialise(both.where(f"{den} * common >= {num} * (size(x) + size(y) - common)").select("a", "b"))
    discard(made)
    return out


def _frequent(held: list, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys with the sums of their counts; the most frequent ones only, if they are too many."""
    u, inv = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    c = np.bincount(inv, weights=np.concatenate([x[1] for x in held]), minlength=len(u)).astype(np.int64)
    if len(u) > most:
        top = np.sort(np.argpartition(c, -most)[-most:])
        u, c = u[top], c[top]
    return u, c


def _classified(docs: DataFrame, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, text): (row, doc_id, n, cid) of every row, and (cid, component) of classes that have links.

    row is xxhash64 of a row; cid is the digest of its set."""
    g = gcd(num, den)
    num, den = num // g, den // g
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and one for each shingle that is frequent in the task, which has no digest."""
        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for part in tx.slices(batches, "text"):
            h, at = shingle_sets(part.column(2), shingle)
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), _names(_digest(h, at)), _parity(h, at)], ["row", "doc_id", "n", "cid", "bits"])
            u, c = np.unique(h, return_counts=True)
            often = c > 1
            held.append((u[often], c[often]))
            size += int(often.sum())
            if size > 1 << 18:  # bounded: the rarest are forgotten, which may cost speed, never a link
                held, size = [_frequent(held, 8 * REPORTED)], 0
        u, c = _frequent(held, REPORTED)
        u, c = u[c >= 4], c[c >= 4]
        none = [pa.nulls(len(u), kind) for kind in (docs_type, pa.binary(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(u), none[0], pa.array(c), none[1], none[2]], ["row", "doc_id", "n", "cid", "bits"])

    kind = docs.schema["doc_id"].dataType
    docs_type = to_arrow_type(kind)
    both = stored(docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").mapInArrow(sketched, f"row bigint, doc_id {kind.simpleString()}, n bigint, cid binary, bits array<bigint>"))
    sketch = both.where("cid IS NOT NULL")
    counted = both.where("cid IS NULL").groupBy("row").agg(F.sum("n").alias("n"))
    ranked = counted.orderBy(F.desc("n"), "row").limit(RANKED).toPandas()  # RANKED rows at most
    by_key = np.argsort(ranked["row"].to_numpy())
    rank_keys, ranks = ranked["row"].to_numpy()[by_key], (len(ranked) - np.arange(len(ranked)))[by_key].astype(np.int64)
    share = np.uint64(min(1.0, COUNTED * (1 - num / den)) * ((1 << 32) - 1))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each set, all shingles of the first part of the order, with place -1 - (their number), and as many of the
        others, with their places, as the prefix still needs."""
        seen = np.zeros(1 << SEEN_LOG, np.uint64)
        for part in tx.slices(batches, "text"):
            h, at = shingle_sets(part.column(1), shingle)
            digest = _digest(h, at)
            n = np.diff(at)
            slot = (digest[0] >> np.uint64(64 - SEEN_LOG)).astype(np.int64)
            new = np.zeros(len(n), bool)
            new[np.unique(digest[0], return_index=True)[1]] = True
            new &= (seen[slot] != digest[1]) & (n > 0)
            seen[slot[new]] = digest[1][new]
            inside = np.repeat(new, n)
            h, row = h[inside], np.repeat(np.arange(len(n)), n)[inside]
            rank = tx.lookup(rank_keys, ranks, h, 0)
            first = (rank == 0) & (h.view(np.uint64) >> np.uint64(32) <= share)
            s = np.bincount(row[first], minlength=len(n))
            need = n - (num * n + den - 1) // den + 1
            h2, row2, rank2 = h[~first], row[~first], rank[~first]
            order = np.lexsort((h2, rank2, row2))
            h2, row2 = h2[order], row2[order]
            begin = np.searchsorted(row2, np.arange(len(n)))
            place = np.arange(len(row2)) - begin[row2] + s[row2]
            more = place < need[row2]
            keys, of = np.concatenate([h[first], h2[more]]), np.concatenate([row[first], row2[more]])
            place = np.concatenate([-1 - s[row[first]], place[more]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), _names((digest[0][of], digest[1][of])), pa.array(n[of].astype(np.int32)), pa.array(place.astype(np.int32))], ["key", "cid", "n", "place"])

    # a set that two tasks list follows itself
    by_key, by_set = Window.partitionBy("key"), Window.partitionBy("cid")
    listed = rows.mapInArrow(indexed, "key bigint, cid binary, n int, place int").repartition("key")
    listed = listed.withColumn("before", F.lag("cid").over(by_key.orderBy("cid"))).where("before IS NULL OR before <> cid").drop("before")
    listed = listed.withColumn("sets", F.count("*").over(by_key)).where("sets > 1")
    shared = F.count(F.when(F.col("place") < 0, 1)).over(by_set)
    at = F.row_number().over(by_set.orderBy(F.expr("IF(place < 0, 0, 1)"), "sets", "key")) - 1
    listed = listed.withColumn("at", F.when(F.col("place") < 0, at + (-1 - F.col("place")) - shared).otherwise(F.col("place")))
    need = f"(n - ({num} * CAST(n AS BIGINT) + {den - 1}) div {den} + 1)"
    listed = listed.where(f"at < {need}").select("key", "cid", "n", F.col("at").cast("int").alias("place"))
    # a prefix that holds a shingle of no other set is the prefix of no other set
    whole = F.count("*").over(by_set) == F.expr(need)
    same = F.unhex(F.md5(F.concat_ws(" ", "n", F.expr("bit_xor(xxhash64(key, 1))").over(by_set), F.expr("bit_xor(xxhash64(key, 2))").over(by_set)).cast("binary")))
    listed = stored(listed.withColumn("gid", F.when(whole, same).otherwise(F.col("cid"))))

    # size and bitmap follow from the set, so first() picks one of equals
    grouped = listed.select("cid", "gid").distinct()
    slim = stored(grouped.join(sketch.groupBy("cid").agg(F.first("n").cast("int").alias("n"), F.first("bits").alias("bits")), "cid"))
    listing = Window.partitionBy("key").orderBy("place", "gid")
    lists = listed.select("key", "gid", "n", "place").repartition("key").withColumn("before", F.lag("gid").over(listing)).where("before IS NULL OR before <> gid").drop("before")
    lists = lists.withColumn("hub", F.first(F.struct("gid", "n", "place")).over(listing.rowsBetween(Window.unboundedPreceding, 0)))
    lists = stored(lists.withColumn("groups", F.count("*").over(by_key)).where("groups > 1").drop("groups"))

    def paired(group_pairs: DataFrame, first: DataFrame, second: DataFrame, apart: str) -> DataFrame:
        """Pairs of classes whose bitmaps are close, from group pairs (p, q)."""
        met = group_pairs.alias("m").join(first.alias("a"), F.expr("m.p = a.gid")).join(second.alias("b"), F.expr(f"m.q = b.gid AND a.cid <> b.cid AND {apart} AND " + _alike(num, den)))
        return met.select(F.least("a.cid", "b.cid").alias("a"), F.greatest("a.cid", "b.cid").alias("b")).distinct()

    # each group of a list against the first group, by its first class; each group's classes against the group's first
    stars = lists.where("gid <> hub.gid").select("gid", "hub", F.struct("n", "place").alias("t")).where(_near("t", "hub", num, den)).select(F.col("hub.gid").alias("p"), F.col("gid").alias("q")).distinct()
    crowded = slim.groupBy("gid").agg(F.count("*").alias("k"), F.min("cid").alias("cid"))
    stars = stars.union(crowded.where("k > 1").select(F.col("gid").alias("p"), F.col("gid").alias("q")))
    leads = slim.join(crowded.select("gid", "cid"), ["gid", "cid"], "left_semi")
    stars = materialise(paired(stars, leads, slim, "true"))
    links = _verified(rows, sketch, stars, shingle, num, den)
    joined = materialise(components(links, "a", "b"))

    # what is not connected yet: all group pairs of a list, but those that lie in one component as wholes
    where = materialise(slim.join(joined.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component"))
    brief = [F.expr(f"aggregate(sequence(0, size(bits) div {FOLDED} - 1), 0L, (a, i) -> a ^ bits[{FOLDED} * i + {k}])") for k in range(FOLDED)]
    folded = where.select("gid", "comp", *(x.alias(f"f{k}") for k, x in enumerate(brief)))
    spans = folded.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.array(*(F.expr(f"bit_and(f{k})") for k in range(FOLDED))).alias("all"), F.array(*(F.expr(f"bit_or(f{k})") for k in range(FOLDED))).alias("any"))
    spread = lists.drop("hub").join(spans, "gid")
    spread = spread.withColumn("l", F.min("low").over(by_key)).withColumn("h", F.max("high").over(by_key)).where("l <> h").drop("l", "h")
    spread = stored(spread)
    p, q = spread.alias("p"), spread.alias("q")
    differ = " + ".join(f"bit_count((p.all[{k}] & ~q.any[{k}]) | (q.all[{k}] & ~p.any[{k}]))" for k in range(FOLDED))
    met = p.join(q, F.expr("p.key = q.key AND p.gid < q.gid AND NOT (p.low = p.high AND q.low = q.high AND p.low = q.low) AND " + _near("p", "q", num, den) + f" AND {differ} <= p.n + q.n - 2 * {_need('p.n', 'q.n', num, den)}")).select(F.col("p.gid").alias("p"), F.col("q.gid").alias("q")).distinct()
    met = met.union(spans.where("low <> high").select(F.col("gid").alias("p"), F.col("gid").alias("q")))
    rest = materialise(paired(met, where, where, "a.comp <> b.comp").join(stars, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        joined = materialise(components(links.union(_verified(rows, sketch, rest, shingle, num, den)), "a", "b"))
    for done in (listed, slim, lists, spread):
        discard(done)
    return sketch.select("row", "doc_id", "n", "cid"), joined.select(F.col("id").alias("cid"), "component")


def link_classes(documents: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: its set's size and the smallest doc_id that links reach.

    Two documents link when den * |intersection| >= num * |union|. Documents of null text or without words have an
    empty set and link with nothing. Rows that repeat a doc_id are documents of their own, which share a name; rows of
    null id link like others and name a component only where no other does. Texts are used whole. Shingles are compared
    as 64-bit hashes, whole sets as 128-bit digests. Other columns are not read; an empty table gives no rows."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketch, joined = _classified(docs, shingle, num, den)
    ids = sketch.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("id"))
    top = ids.join(joined, "cid", "left").select("cid", "id", F.coalesce("component", "cid").alias("comp"))
    named = top.join(top.groupBy("comp").agg(F.min("id").alias("component_id")), "comp").select("cid", "component_id")
    return sketch.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of documents, with all their columns, of one document of each component: that of the smallest id.

    A row of null id stays only where its component has no other; of several rows of the smallest id that of the least
    hash stays. Documents without words all stay, but of rows that repeat an id and a text one. An empty table gives no
    rows; columns of documents may have any names."""
    name, again = unused(documents, "row"), unused(documents, "again")
    sketch, joined = _classified(documents.select("doc_id", "text"), shingle, num, den)
    comp = F.when(F.col("n") > 0, F.coalesce("component", "cid")).otherwise(F.unhex(F.hex("row")))
    of_row = materialise(sketch.join(joined, "cid", "left").groupBy("row", "doc_id", comp.alias("comp")).agg(F.count("*").alias("copies")))
    best = of_row.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("b")).select(F.col("b.row").alias("row"))
    left = documents.withColumn(name, F.xxhash64("doc_id", "text"))
    gone = of_row.select("row").distinct().join(best, "row", "left_anti").withColumnRenamed("row", name)
    left = left.join(gone, name, "left_anti")
    repeated = materialise(of_row.where("copies > 1").join(best, "row", "left_semi").select(F.col("row").alias(name)))
    if repeated.isEmpty():
        return left.select(*documents.columns)
    order = F.row_number().over(Window.partitionBy(name).orderBy(F.xxhash64(*documents.columns)))
    one = left.join(repeated, name, "left_semi").withColumn(again, order).where(F.col(again) == 1)
    return left.join(repeated, name, "left_anti").select(*documents.columns).union(one.select(*documents.columns))


LINK_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
r(i, j) AS (SELECT DISTINCT a, a FROM e UNION SELECT i, b FROM r JOIN e ON j = a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT i AS doc_id, min(j) AS component_id FROM r GROUP BY i) c USING (doc_id)
"""
