"""Helpers for jobs that outlive an executor: shared checkpoints, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that goes to Python, unless one row alone is longer, and rows that Spark reads from Parquet at once, in lean().
BATCH_BYTES = 1 << 21
READ_ROWS = 512


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: that of ``spark.checkpoint.dir``.

    A folder of this machine is made only in local mode, and only where that setting is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rillspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, without its lineage."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read again: smaller than a checkpoint, for wide rows."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that stored() made, once everything that reads it has been computed and kept."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    name, taken = f"_{stem}", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone.

    It does so when the driver's JVM collects garbage, which holds what Python still refers to, and in a thread of its
    own, which gets a second before the next shuffle is written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


@contextmanager
def _with_conf(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def tidy(spark: SparkSession):
    """Spark deletes the shuffle files of each query that is made and run inside as soon as that query ends.

    release() has to wait for the driver's garbage, and leaves the files of the query that ran last. A frame made inside
    that is run a second time computes its shuffles again."""
    return _with_conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def lean(spark: SparkSession):
    """Queries run inside read and hand long texts to Python in small batches; only memory depends on it.

    Spark counts rows by default, 4,096 and 10,000; an executor holds such a batch in its heap, beside it, and in a worker."""
    return _with_conf(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS)})


def fold(column: str | Column) -> Column:
    """crc32 of an id written as text, modulo 3; rows with 1 are held out of every training."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % 3


def _edges_stat(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id in the links a-b: component is the smallest id that links reach.

    Alternating large-star and small-star steps over distributed tables; each step is checkpointed. Rows of one node
    meet only in sums with partial aggregation and in joins that adaptive execution can split. Links with a null end
    and loops are ignored; an empty table gives an empty result."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.expr("u > v")).distinct()
    e = materialise(e)
    stat = _edges_stat(e)
    while stat[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _edges_stat(e)
        if now == stat:
            break
        stat = now
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
