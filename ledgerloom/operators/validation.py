"""Reconciliation of amounts and confidence of an extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far totals may be off, the least discount, the most a deposit can be, and the cents it can have.
CLOSE, DISCOUNT, DEPOSIT = "0.10", "-500.00", "200.00"
DEPOSIT_CENTS = ["0.00", "0.10", "0.20", "0.25", "0.40", "0.50", "0.60", "0.75", "0.80"]
VAT_LOW, VAT_HIGH, UNTAXED = "0.015", "0.35", "1.02"


def money(x: str) -> Column:
    return F.lit(x).cast("decimal(14,4)")


def validate(rows: DataFrame) -> DataFrame:
    """rows with diff, status and reasons (array) from net_amount, vat_amount and total_amount: what total has beyond net
    and VAT is a deposit or unexplained, what it lacks a discount or unexplained; VAT has a plausible share of net."""
    net, vat, total = F.col("net_amount"), F.col("vat_amount"), F.col("total_amount")
    diff = (total - (net + F.coalesce(vat, F.lit(0).cast("decimal(14,2)")))).cast("decimal(14,2)")
    odd = (net > 0) & ((vat > net * money(VAT_HIGH)) | ((vat > 0) & (vat < net * money(VAT_LOW))))
    untaxed = (net > 0) & vat.isNull() & (total > net * money(UNTAXED))
    cents = (F.col("diff") % 1).cast("decimal(4,2)").isin([F.lit(c).cast("decimal(4,2)") for c in DEPOSIT_CENTS])
    deposit = (F.col("diff") > money(CLOSE)) & (F.col("diff") <= money(DEPOSIT)) & cents
    discount = (F.col("diff") < -money(CLOSE)) & (F.col("diff") >= money(DISCOUNT))
    # One column for each step, so that none is written out again inside the next.
    seen = rows.withColumn("diff", diff).withColumns({"__odd": F.coalesce(odd, F.lit(False)), "__untaxed": F.coalesce(untaxed, F.lit(False)), "__deposit": F.coalesce(deposit, F.lit(False)), "__discount": F.coalesce(discount, F.lit(False))})
    status = F.when(net.isNull() & total.isNull(), "subtotal_not_found").when(F.col("__deposit"), "ok_with_deposit").when(F.col("__discount"), "ok_with_discount").when(F.abs("diff") > money(CLOSE), "totals_mismatch").when(F.col("__odd"), "vat_anomaly").when(F.col("__untaxed"), "vat_missing").otherwise("ok")
    reasons = F.array_compact(
        F.array(F.when(F.col("__odd"), "vat_anomaly"), F.when(F.col("__untaxed"), "vat_missing"), F.when(F.col("__deposit"), F.concat(F.lit("deposit_component_detected:"), F.col("diff").cast("string"))), F.when(F.col("__deposit"), "totals_mismatch_advisory"), F.when(F.col("status").isin("totals_mismatch", "subtotal_not_found"), F.col("status")))
    )
    return seen.withColumn("status", status).withColumn("reasons", reasons).drop("__odd", "__untaxed", "__deposit", "__discount")


def confidence(rows: DataFrame) -> Column:
    """A share for each field that was found, a bonus where the amounts agree; at most 1."""
    has = lambda name, share: F.when(F.col(name).isNotNull(), F.lit(share)).otherwise(F.lit("0")).cast("decimal(5,2)")
    agree = F.when(F.col("total_amount") == F.col("net_amount") + F.col("vat_amount"), F.lit("0.05")).otherwise(F.lit("0")).cast("decimal(5,2)")
    found = has("supplier_name", "0.2") + has("invoice_number", "0.2") + has("invoice_date", "0.2") + has("total_amount", "0.2") + has("net_amount", "0.1") + has("vat_amount", "0.1")
    return F.least(found + agree, F.lit("1").cast("decimal(5,2)")).cast("decimal(5,2)")


def line_sums(lines: DataFrame, by: list[str], tolerance: str = "0.05") -> DataFrame:
    """Whether the lines of each page add up to its total."""
    sums = lines.groupBy(*by).agg(F.sum("line_total").alias("line_sum"), F.max("page_total").alias("page_total"), F.count("*").alias("line_count"))
    return sums.withColumn("mismatch", F.coalesce(F.abs(F.col("line_sum") - F.col("page_total")) > money(tolerance), F.lit(False)))
