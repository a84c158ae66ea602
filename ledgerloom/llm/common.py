"""What the training-data operators share: tables in the shared folder, and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a temporary one where that is unset and all run
    on one machine (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, large: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that it is computed once and survives a lost executor. Large
    tables are compressed harder."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd" if large else "snappy").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table that `written` made, once nothing that is still to run reads it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(conf).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long: a row (node, root) for every node that has an edge.

    Nodes are renamed by a bijective hash so that their order is random. In each round every node u learns the
    smallest node m(u) beside it and links its neighbours to m(u); paths shorten and stars end in two or three
    rounds. A round is one aggregation and one join, written to the shared folder. Root is the member with the
    smallest hash, an arbitrary but deterministic one. Self loops and repeated edges are harmless; no edges give
    no rows; edges with a null end are dropped.
    """
    spark = edges.sparkSession
    named = edges.where("a is not null and b is not null and a <> b")
    hashed = named.select(F.xxhash64("a").alias("p"), F.xxhash64("b").alias("q"))
    links = written(_down(hashed), "edges")
    while not _is_forest_of_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hops = both.join(least, "u").select(F.col("v").alias("p"), F.col("m").alias("q"))
        links, before = written(_down(hops.unionByName(least.select(F.col("u").alias("p"), F.col("m").alias("q")))), "edges"), links
        discard(before)
    names = named.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("u", F.xxhash64("node"))
    tops = links.select(F.col("u"), F.col("v").alias("root"))
    return names.join(tops, "u", "left").select("node", F.coalesce("root", "u").alias("root"))


def _down(pairs: DataFrame) -> DataFrame:
    return pairs.where("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct()


def _is_forest_of_stars(links: DataFrame) -> bool:
    ends = links.select("u", F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("top")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up > 1 or (up = 1 and top = 1)").isEmpty()


def give_back() -> None:
    """Return to the system what a worker has freed but still holds: it lives on after its task, beside other tasks'."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose `column` (binary) has about `limit` bytes, or one row; empty pieces are left out. What
    Arrow keeps of batches that are done goes back to the system, as a worker lives on after its task."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.nan_to_num(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last
    give_back()
