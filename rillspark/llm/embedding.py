"""Embedding near-dedup by Euclidean p-stable hashing with exact cosine checks.

Vectors of one label are normalised and projected on Gaussian directions; floor((a x + b) / width) of several
projections names a bucket, in several tables. Vectors that share a bucket are compared exactly. A bucket of any size
is dealt into chunks, and chunk pairs are the unit of work, so a task holds two chunks at most. Equal vectors are one
class with a count. A block gives sums of links and a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import components, materialise

TABLES = 24
PROJECTIONS = 4
WIDTH = 1.0
#: Vectors in a chunk of a bucket.
CHUNK = 1024


def _directions(dim: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64([dim, tables, projections]))
    return g.standard_normal((dim, tables * projections)), g.uniform(0, WIDTH, tables * projections)


def bucket_keys(x: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS) -> np.ndarray:
    """A 32-bit bucket of each normalised vector in each table."""
    a, b = _directions(x.shape[1], tables, projections)
    cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), tables, projections)
    h = np.zeros((len(x), tables), np.uint64)
    for k in range(projections):
        h = (h ^ cell[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation, the first row that its component holds."""
    n = len(linked)
    label = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        low = np.array([label[r].min() for r in reach])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Runs of rows of one (bucket, i, j), across batches; rows arrive sorted."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        b, i, j = (np.asarray(batch.column(k)) for k in range(3))
        edge = np.flatnonzero((b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for s, e in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(b)]]), strict=True):
            if e == s:
                continue
            own = (b[s], i[s], j[s])
            if own != name and held:
                yield pa.Table.from_batches(held)
                held = []
            name = own
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, projections: int = PROJECTIONS, chunk: int = CHUNK, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two vectors link when their labels are equal and not null and their cosine is at least threshold. Vectors that are
    null, empty, zero or hold null or non-finite components, of null label or of null id, link with nothing; vectors of
    different lengths do not link. Rows that repeat an id are vectors of their own. The hashing may miss a pair near
    the threshold with a probability below one in a hundred; no pair below the threshold is ever linked."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e"), F.col(label).alias("label"))
    fine = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND size(e) > 0 AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(e, x -> x <> 0)")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("cls", F.when(F.col("fine"), F.xxhash64("label", "e")))
    classes = rows.where("fine").groupBy("cls").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("e").alias("e"))
    kind = "bigint"  # a class goes by cls, as several may share an id

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            size = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten(), dtype=np.float64)
            at = np.concatenate([[0], np.cumsum(size)])
            keys = np.zeros((batch.num_rows, tables), np.int32)
            units: list[bytes] = [b""] * batch.num_rows
            for d in np.unique(size):
                mine = np.flatnonzero(size == d)
                x = flat[at[mine][:, None] + np.arange(d)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                keys[mine] = bucket_keys(x, tables, projections)
                for k, u in zip(mine, x, strict=True):
                    units[k] = u.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(size.astype(np.int32)), pa.array(units, pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.ListArray.from_arrays(pa.array((np.arange(len(keys) + 1) * tables).astype(np.int32)), pa.array(keys.reshape(-1)))], ["rep", "m", "label", "dim", "unit", "keys", "list"])

    tag = vectors.schema[label].dataType.simpleString()
    units = materialise(classes.select(F.col("cls").alias("rep"), "m", "label", "e").mapInArrow(hashed, f"rep {kind}, m bigint, label {tag}, dim int, unit binary, keys binary, list array<int>"))
    spots = units.select("rep", F.xxhash64("label", "dim").alias("block"), F.posexplode("list").alias("t", "key")).select("rep", F.xxhash64("block", "t", "key").alias("b"), "t")
    full = spots.groupBy("b").agg(F.count("*").alias("g")).where("g > 1").select("b", F.ceil(F.col("g") / chunk).cast("int").alias("parts"))
    dealt = spots.join(full, "b").withColumn("c", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("b", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "t", "rep").join(units.select("rep", "m", "unit", "keys"), "rep")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n = block.num_rows
            c, t = np.asarray(block["c"]), int(block["t"][0].as_py())
            i, j = int(block["i"][0].as_py()), int(block["j"][0].as_py())
            x = np.frombuffer(b"".join(block["unit"].to_pylist()), np.float64).reshape(n, -1)
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= c[:, None] != c[None, :]  # pairs of one chunk belong to its own block
            if not linked.any():
                continue
            label = _forest(linked)
            # a pair counts in the first table in which it shares a bucket
            keys = np.frombuffer(b"".join(block["keys"].to_pylist()), np.int32).reshape(n, tables)
            a, b = np.nonzero(linked)
            first = np.ones(len(a), bool)
            for s in range(t):
                first &= keys[a, s] != keys[b, s]
            m = np.asarray(block["m"])
            count = np.bincount(a[first], weights=m[b[first]], minlength=n).astype(np.int64)
            keep = np.flatnonzero((count > 0) | (label != np.arange(n)))
            rep = block["rep"].combine_chunks()
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(keep)), rep.take(pa.array(label[keep])), pa.array(count[keep])], ["rep", "root", "n"])

    met = dealt.select("b", "i", "j", "c", "t", "rep", "m", "unit", "keys").repartition("b", "i", "j").sortWithinPartitions("b", "i", "j").mapInArrow(compared, f"rep {kind}, root {kind}, n bigint")
    met = materialise(met)
    links = met.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(met, "rep", "root")
    by_class = classes.select("cls", "id", "m").join(links.withColumnRenamed("rep", "cls"), "cls", "left").join(joined.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
    named = by_class.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_class = by_class.join(named, "comp").select("cls", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cls").join(by_class, "cls", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
