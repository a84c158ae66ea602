"""Aggregates over invoice rows: one shuffle each, on keys of the fact's own layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Below this confidence a row is flagged.
SURE = 0.55


def scoped(rows: DataFrame, tenant: str, company: str | None = None) -> DataFrame:
    """The rows that a tenant may see: every reader starts here, so partitions by tenant and company are pruned."""
    own = rows.where(F.col("tenant") == tenant)
    return own if company is None else own.where(F.col("company") == company)


def flagged() -> Column:
    return F.coalesce(F.col("confidence_score") < SURE, F.lit(False)) | F.col("review_required")


def money(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("double")


def summary(rows: DataFrame, *by: str) -> DataFrame:
    average = (F.sum("confidence_score").cast("double") / F.count("confidence_score")).alias("avg_confidence")
    return rows.groupBy(*by).agg(
        F.count("*").alias("row_count"), F.count_if("review_required").alias("review_count"), money("net_amount").alias("net_total"), money("vat_amount").alias("vat_total"), money("total_amount").alias("grand_total"),
        F.coalesce(average, F.lit(0.0)).alias("avg_confidence"), F.count_distinct("supplier_name").alias("supplier_count"),
    )


def supplier_parts(rows: DataFrame) -> DataFrame:
    """One row for each supplier_id of rows: sums and counts that `summary_of_parts` and `top_of_parts` add up further. What a
    supplier tells of its rows, such as its company, is joined to these few rows afterwards, not to the fact. rows:
    supplier_id, named (whether the row shows its supplier), review_required, the amounts and confidence_score."""
    named = F.when(F.col("named"), F.col("total_amount"))
    return rows.groupBy("supplier_id").agg(
        F.count("*").alias("rows"), F.count_if("review_required").alias("reviews"), F.sum("net_amount").alias("net"), F.sum("vat_amount").alias("vat"), F.sum("total_amount").alias("total"),
        F.sum("confidence_score").alias("sure"), F.count("confidence_score").alias("sure_rows"), F.count_if("named").alias("named_rows"), F.sum(named).alias("named_total"),
    )


def summary_of_parts(parts: DataFrame, *by: str) -> DataFrame:
    """`summary` from `supplier_parts` with the columns of by and supplier_name."""
    average = F.sum("sure").cast("double") / F.sum("sure_rows")
    return parts.groupBy(*by).agg(
        F.sum("rows").alias("row_count"), F.sum("reviews").alias("review_count"), money("net").alias("net_total"), money("vat").alias("vat_total"), money("total").alias("grand_total"),
        F.coalesce(F.when(F.sum("sure_rows") > 0, average), F.lit(0.0)).alias("avg_confidence"), F.count_distinct(F.when(F.col("named_rows") > 0, F.col("supplier_name"))).alias("supplier_count"),
    )


def top_of_parts(parts: DataFrame, n: int = 10) -> DataFrame:
    """`top_suppliers` from `supplier_parts` with supplier_name."""
    spend = parts.where("named_rows > 0").groupBy("supplier_name").agg(money("named_total").alias("grand_total"), F.sum("named_rows").alias("row_count"))
    return spend.orderBy(F.desc("grand_total"), "supplier_name").limit(n)


def monthly(rows: DataFrame, today: str | None = None, months: int = 12) -> DataFrame:
    """Sums by month, from the first of the month of `today` less 31 days for each of `months`; all months without it."""
    dated = rows.where("invoice_date is not null")
    if today is not None:
        dated = dated.where(F.col("invoice_date") >= F.date_sub(F.trunc(F.lit(today).cast("date"), "MM"), months * 31))
    return dated.groupBy(F.date_format("invoice_date", "yyyy-MM").alias("month")).agg(money("net_amount").alias("net_total"), money("vat_amount").alias("vat_total"), money("total_amount").alias("grand_total"), F.count("*").alias("row_count"))


def top_suppliers(rows: DataFrame, n: int = 10) -> DataFrame:
    spend = rows.where("supplier_name is not null").groupBy("supplier_name").agg(money("total_amount").alias("grand_total"), F.count("*").alias("row_count"))
    return spend.orderBy(F.desc("grand_total"), "supplier_name").limit(n)


def capacity(tenants: DataFrame, **held: DataFrame) -> DataFrame:
    """A row for each of tenants (tenant), with or without anything: for each table its rows, and of a column `file_size_bytes`
    the megabytes. Every table is counted by itself, so none multiplies another."""
    out = tenants
    for name, rows in held.items():
        sums = [F.count("*").alias(name)] + ([F.sum("file_size_bytes").alias("__bytes")] if "file_size_bytes" in rows.columns else [])
        out = out.join(rows.groupBy("tenant").agg(*sums), "tenant", "left")
    size = [F.round(F.coalesce("__bytes", F.lit(0)) / (1024 * 1024), 2).alias("storage_mb")] if "__bytes" in out.columns else []
    return out.select(*tenants.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in held], *size)


def modal_nominal(rows: DataFrame, least: int = 2) -> DataFrame:
    """Each supplier's most used account in its tenant and company, ties to the smaller code, if used at least `least`
    times. Rows without an account don't count."""
    scope = ["tenant", "company", "supplier_name"]
    counts = rows.where("supplier_name is not null and nominal_account_code is not null").groupBy(*scope, "nominal_account_code").agg(F.count("*").alias("uses"))
    best = counts.groupBy(*scope).agg(F.min(F.struct((-F.col("uses")).alias("less"), "nominal_account_code", "uses")).alias("b"))
    return best.select(*scope, "b.nominal_account_code", "b.uses").where(F.col("uses") >= least)


def file_review_state(rows: DataFrame, reviewed: DataFrame, fields: str | None = None) -> DataFrame:
    """For each file: flagged rows, those without a review, and whether it is clean, reviewed or waits. reviewed:
    (file_id, page_no) of the rows that a person has seen. fields: where given, the column of comma-joined names from
    which the flagged fields come, sorted."""
    seen = reviewed.select("file_id", "page_no").distinct().withColumn("seen", F.lit(True))
    joined = rows.join(seen, ["file_id", "page_no"], "left")
    own = [] if fields is None else [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(flagged(), names(F.col(fields))))))), ",").alias("flagged_fields")]
    counts = joined.groupBy("file_id").agg(F.count("*").alias("row_count"), F.count_if(flagged()).alias("flagged_count"), F.count_if(flagged() & F.col("seen").isNull()).alias("outstanding"), *own)
    return counts.withColumn("state", F.when(F.col("flagged_count") == 0, "clean").when(F.col("outstanding") > 0, "needs_review").otherwise("reviewed"))


def names(joined: Column) -> Column:
    """Comma-joined names as an array; blanks are none."""
    return F.filter(F.transform(F.split(joined, ","), lambda x: F.trim(x)), lambda x: x != "")


def export_summary(rows: DataFrame, *by: str) -> DataFrame:
    """As the summary sheet has it: a row without confidence counts as 0 there."""
    return rows.groupBy(*by).agg(F.count("*").alias("row_count"), F.count_if("review_required").alias("needs_review"), money("net_amount").alias("net_total"), money("vat_amount").alias("vat_total"), money("total_amount").alias("grand_total"), (F.coalesce(F.sum("confidence_score"), F.lit(0)).cast("double") / F.count("*")).alias("avg_confidence"), F.count_distinct("file_id").alias("files"))


def _file_counts() -> list[Column]:
    return [F.count_if(F.col("status").isin("processed", "partial")).alias("processed_files"), F.count_if(F.col("status") == "failed").alias("failed_files"), F.count("*").alias("total_files")]


def batch_progress(batches: DataFrame, files: DataFrame) -> DataFrame:
    """batches: batch_id and page_count, the pages worked off. files: batch_id, status and page_count. Percent is of pages,
    whole (halves to even), at most 100, and 0 without pages. A partial file counts as processed."""
    done = F.coalesce("page_count", F.lit(0))
    of = files.groupBy("batch_id").agg(*_file_counts(), F.coalesce(F.sum("page_count"), F.lit(0)).alias("total_pages"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("processed_files", "failed_files", "total_files", "total_pages")]
    joined = batches.select("batch_id", done.alias("processed_pages")).join(of, "batch_id", "left").select("batch_id", "processed_pages", *zero)
    share = F.col("processed_pages") / F.col("total_pages") * 100
    return joined.withColumn("percent", F.when(F.col("total_pages") > 0, F.least(F.lit(100), F.bround(share, 0).cast("long"))).otherwise(0))


def status_rollup(files: DataFrame) -> DataFrame:
    """files: batch_id, file_id, rows (inserted) and failed_pages. Each file's own status, and that of its batch: processed
    if all are, failed if all are, else partial."""
    own = F.when(F.col("rows") == 0, "failed").when(F.col("failed_pages") > 0, "partial").otherwise("processed")
    counts = files.withColumn("status", own).groupBy("batch_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "partial", "failed")])
    good = F.col("processed") + F.col("partial")
    return counts.withColumn("status", F.when((good > 0) & (F.col("failed") == 0) & (F.col("partial") == 0), "processed").when(good > 0, "partial").otherwise("failed"))


def batch_detail(batches: DataFrame, files: DataFrame, rows: DataFrame) -> DataFrame:
    """batches with their files by status and their rows; one without any has zeros."""
    of = files.groupBy("batch_id").agg(*_file_counts())
    held = rows.groupBy("batch_id").agg(F.count("*").alias("row_count"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("processed_files", "failed_files", "total_files", "row_count")]
    return batches.join(of, "batch_id", "left").join(held, "batch_id", "left").select(*batches.columns, *zero)


def workspace(rows: DataFrame, *by: str) -> DataFrame:
    """Rows, corrected ones and flagged ones. rows: `corrected`, `review_required`."""
    return rows.groupBy(*by).agg(F.count("*").alias("row_count"), F.count_if("corrected").alias("corrected_count"), F.count_if("review_required").alias("flagged_count"))


def next_version(batches: DataFrame, exports: DataFrame) -> DataFrame:
    """batches (batch_id) with the version that their next export has. exports: batch_id, version."""
    last = exports.groupBy("batch_id").agg(F.max("version").alias("__last"))
    return batches.join(last, "batch_id", "left").select(*batches.columns, (F.coalesce("__last", F.lit(0)) + 1).alias("version"))


def newest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the last in order."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
