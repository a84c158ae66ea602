"""The row fact as a table laid out by tenant and company and bucketed by batch.

A reader names the companies that it may see; only their folders are read, whether they are constants or come from a
join, in which case Spark prunes partitions when the other side is known. Rows of a batch lie in one bucket of their
company, sorted, so that totals by batch need no exchange, and a hot company is as many files as it has buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.shared import folder

LAYOUT = ("tenant", "company")
BUCKETS = 8


def store(rows: DataFrame, name: str | None = None, buckets: int = BUCKETS, path: str | None = None) -> str:
    """Write rows (tenant, company, batch_id, ...) as a table and return its name. Every file holds a bucket of a company: rows
    are dealt by company and bucket first, so no task writes to every folder. Rows without a tenant or a company lie in
    the default partition and stay readable; an existing table of that name is replaced."""
    spark = rows.sparkSession
    name = name or f"invoice_rows_{uuid.uuid4().hex}"
    bucket = F.pmod(F.hash("batch_id"), F.lit(buckets))
    columns = [c for c in rows.columns if c not in LAYOUT]
    dealt = rows.repartition(*LAYOUT, bucket).select(*columns, *LAYOUT)
    dealt.write.mode("overwrite").option("path", path or f"{folder(spark)}/ledgerloom/{name}").partitionBy(*LAYOUT).bucketBy(buckets, "batch_id").sortBy("batch_id").saveAsTable(name)
    return name


def replace(rows: DataFrame, name: str) -> None:
    """Replace the companies that rows belong to, and no others, by rows: for a job that is run again."""
    spark = rows.sparkSession
    held = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", held)


def scoped(spark: SparkSession, name: str, scopes: DataFrame) -> DataFrame:
    """The rows of the companies in scopes (tenant, company), which should be few: the fact's partitions are pruned by what
    scopes holds when the query runs."""
    return spark.table(name).join(scopes.select(*LAYOUT).distinct(), list(LAYOUT), "left_semi")
