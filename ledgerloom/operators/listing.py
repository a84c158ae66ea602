"""Listings, filters and upkeep of batches: small operators over state tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.shared import stored

#: Below this confidence a row is in the reviewer's list of unsure rows.
UNSURE = 0.7


#: An order: columns with their directions, the last one unique. Nulls are the least values, so they come first in ascending
#: order and last in descending order.
Order = list[tuple[str, str]]


def _sorted_by(order: Order) -> list[Column]:
    return [F.asc_nulls_first(c) if way == "asc" else F.desc_nulls_last(c) for c, way in order]


def following(rows: DataFrame, order: Order, last: dict | None = None, size: int = 50) -> DataFrame:
    """The page of `size` rows after the row last (its values of the columns of order), or the first page. Only rows beyond last
    are kept, and of those each task keeps `size`, so no page sorts the table."""
    own = rows
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for c, way in order:
            value = F.lit(last[c]).cast(rows.schema[c].dataType)
            more = (F.col(c) > value) if way == "asc" else (F.col(c) < value)
            step = F.coalesce(more, F.lit(False)) | ((value.isNull() & F.col(c).isNotNull()) if way == "asc" else (value.isNotNull() & F.col(c).isNull()))
            beyond, same = beyond | (same & step), same & F.col(c).eqNullSafe(value)
        own = rows.where(beyond)
    return own.orderBy(*_sorted_by(order)).limit(size)


def numbered(rows: DataFrame, order: Order, size: int = 50) -> DataFrame:
    """rows with `page`, from 0 on, of a listing in this order. Rows are sorted over ranges of the order; each range is counted,
    and a row's place is its place in its range and the rows in those before: no window over all rows."""
    schema = T.StructType([*rows.schema.fields, T.StructField("__range", T.LongType()), T.StructField("__at", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())], names=[*batch.schema.names, "__range", "__at"])
            at += n

    ways = _sorted_by(order)
    ranged = stored(rows.repartitionByRange(*ways).sortWithinPartitions(*ways).mapInArrow(placed, schema), "listing")
    counts = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, first = {}, 0
    for k in sorted(counts):
        before[k], first = first, first + counts[k]
    if not before:
        return ranged.select(*rows.columns, F.lit(0).cast("long").alias("page"))
    ahead = rows.sparkSession.createDataFrame(list(before.items()), "__range long, __before long")
    return ranged.join(F.broadcast(ahead), "__range").select(*rows.columns, F.floor((F.col("__before") + F.col("__at")) / size).alias("page"))


def like(column: str, term: str) -> Column:
    """Whether the term stands in the column, in any case; signs that patterns give a meaning have none."""
    return F.coalesce(F.contains(F.lower(column), F.lit(term.lower())), F.lit(False))


def any_like(columns: list[str], term: str) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | like(c, term)
    return found


def review_list(rows: DataFrame, which: str = "all", file_id: int | None = None) -> DataFrame:
    """The rows that a reviewer asks for: all, needs_review, corrected or low_conf; of one file where it is named."""
    own = rows if file_id is None else rows.where(F.col("file_id") == file_id)
    tests = {"all": F.lit(True), "needs_review": F.col("review_required"), "corrected": F.col("corrected"), "low_conf": F.col("confidence_score") < UNSURE} if which != "all" else {"all": F.lit(True)}
    return own.where(tests[which])


def rule_list(rules: DataFrame, active: bool | None = None, term: str = "") -> DataFrame:
    """Rules that are active or not, with the term in pattern, target or field."""
    own = rules if active is None else rules.where(F.col("active") == active)
    return own.where(any_like(["source_pattern", "target_value", "field_name"], term)) if term else own


def audit_log(events: DataFrame, kinds: list[str] | None, newest: list[str], most: int = 100) -> DataFrame:
    """The newest events of some kinds, 500 at most."""
    own = events if kinds is None else events.where(F.col("kind").isin(kinds))
    return own.orderBy(*[F.desc(c) for c in newest]).limit(min(most, 500))


def first_tenant(links: DataFrame) -> DataFrame:
    """(user_id, tenant): the default tenant of each user, else the first. links: user_id, tenant, is_default."""
    return links.groupBy("user_id").agg(F.min(F.struct((~F.col("is_default")).alias("later"), "tenant")).alias("m")).select("user_id", "m.tenant")


def recovered(batches: DataFrame) -> DataFrame:
    """batches after a restart: one that was being processed is partial."""
    return batches.withColumn("status", F.when(F.col("status") == "processing", "partial").otherwise(F.col("status")))


def deleted(batches: DataFrame, asked: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """`batches` and each of `tables` (with batch_id) without the batches that asked (batch_id) names; those being processed
    stay."""
    gone = asked.join(batches.where("status <> 'processing' or status is null").select("batch_id"), "batch_id", "left_semi").select("batch_id").distinct()
    return {name: df.join(gone, "batch_id", "left_anti") for name, df in (tables | {"batches": batches}).items()}


def taken(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted with whether its key, in any case, is in the table already: what a new row is checked against."""
    held = table.select(F.lower(F.trim(key)).alias("__k")).distinct().withColumn("taken", F.lit(True))
    return wanted.withColumn("__k", F.lower(F.trim(key))).join(held, "__k", "left").select(*wanted.columns, F.coalesce("taken", F.lit(False)).alias("taken"))
