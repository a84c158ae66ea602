"""Tables in the folder that driver and executors share: computed once, safe from a lost executor, and without lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or where that is unset and all run on one machine (tests) a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back."""
    path = f"{folder(df.sparkSession)}/ledgerloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def observed(df: DataFrame, label: str, **what: Column) -> tuple[DataFrame, dict]:
    """`stored`, and aggregates over its rows from the same job."""
    seen = Observation()
    back = stored(df.observe(seen, *(x.alias(name) for name, x in what.items())), label)
    return back, seen.get


def dropped(df: DataFrame) -> None:
    """Delete a table that `stored` made, once nothing that is still to run reads it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(conf).delete(path, True)
