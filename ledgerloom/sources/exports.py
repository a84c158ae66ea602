"""The sheets of an export as DataFrames, and a versioned folder that they are written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import analytics, review, state
from ledgerloom.sources import workbook

# The order of the columns that exports know, and the columns that stay inside.
ORDER = [
    "source_filename", "page_no", "supplier_name", "supplier_posting_account", "supplier_match_method", "nominal_account_code", "nominal_account_name", "classification_method", "invoice_number", "invoice_date", "description", "line_items_raw", "net_amount", "vat_amount", "total_amount",
    "currency", "tax_code", "totals_reconciliation_status", "method_used", "confidence_score", "page_quality_score", "validation_status", "recommended_action", "review_required", "review_priority", "review_reasons", "review_fields", "auto_approved", "header_raw", "totals_raw", "page_text_raw",
]
INTERNAL = ["id", "batch_id", "tenant_id", "company_id", "source_file_id", "created_at"]
EVIDENCE = ["source_filename", "page_no", "invoice_number", "description", "line_items_raw", "header_raw", "totals_raw"]


def export_columns(have: list[str]) -> list[str]:
    """Known columns in their order, then others as they come; internal ones go."""
    return [c for c in ORDER if c in have] + [c for c in have if c not in ORDER and c not in INTERNAL]


def invoices(rows: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """The Invoices sheet. accounts (code, account_name) names nominal accounts; an unknown code has an empty name."""
    if accounts is not None:
        names = accounts.select(F.trim("code").alias("__code"), F.col("account_name").alias("nominal_account_name")).dropDuplicates(["__code"])
        rows = rows.drop("nominal_account_name").join(names, F.trim("nominal_account_code") == F.col("__code"), "left").drop("__code").withColumn("nominal_account_name", F.coalesce("nominal_account_name", F.lit("")))
    if "validation_status" in rows.columns:
        rows = rows.withColumn("recommended_action", review.action(F.col("validation_status")))
    return rows.select(*export_columns(rows.columns))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """The Summary sheet, one row for each `by`, which should hold no more files than a batch does, as their names make one
    cell. Null amounts and confidences count as 0, blank file names not at all."""
    file = F.nullif("source_filename", F.lit(""))
    return rows.groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_set(file)), ", ").alias("uploaded_files"), F.count("*").alias("total_rows"), F.count_if("review_required").alias("needs_review"), analytics.money("net_amount").alias("sum_net_amount"), analytics.money("vat_amount").alias("sum_vat_amount"),
        analytics.money("total_amount").alias("sum_total_amount"), F.coalesce(F.sum("confidence_score").cast("double") / F.count("*"), F.lit(0.0)).alias("avg_confidence"), F.count_distinct(file).alias("distinct_source_files"),
    )


def audit_changes(rows: DataFrame, corrected: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A row for each field that a correction changed: keys, field, old_value and new_value as text."""
    new = corrected.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(f).cast("string").alias(f"__{f}") for f in fields])
    pair: list[Column] = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), F.col(f"__{f}").alias("new_value")) for f in fields]
    changed = rows.join(new, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).select(*keys, F.explode(F.array(*pair)).alias("c"))
    return changed.select(*keys, "c.*").where(F.col("new_value").isNotNull() & ~F.col("new_value").eqNullSafe(F.col("old_value")))


def export_event(exports: DataFrame, batch_id: int, version: int, rows: DataFrame) -> DataFrame:
    """exports (batch_id, version, row_count) with the event of one more export."""
    event = rows.agg(F.count("*").alias("row_count")).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(version).cast("long").alias("version"), "row_count")
    return exports.unionByName(event)


def sheets_of(rows: DataFrame, by: list[str], accounts: DataFrame | None = None, changes: DataFrame | None = None, template: list[dict] | None = None) -> dict[str, DataFrame]:
    """The sheets of an export by name. by: the columns that name a batch, which every sheet keeps and the summary has a row
    for; without any, the rows are one batch. changes: audit rows, with the columns of by; a template makes one more sheet."""
    keep = lambda sheet: sheet if not by else sheet.select(*by, *[c for c in sheet.columns if c not in by])
    named = rows.select(*[F.col(c).alias(f"__{c}") for c in by], "*") if by else rows
    back = lambda sheet: sheet.withColumnsRenamed({f"__{c}": c for c in by}) if by and not set(by) & set(sheet.columns) else sheet.drop(*[f"__{c}" for c in by])
    sheets = {"invoices": keep(back(invoices(named, accounts))), "needs_review": keep(back(invoices(named.where("review_required"), accounts))), "summary": summary(rows, *by)}
    held = [c for c in EVIDENCE if c in rows.columns]
    sheets |= {"evidence": rows.select(*by, *[c for c in held if c not in by])} if held else {}
    sheets |= {"audit_changes": changes} if changes is not None else {}
    sheets |= {"template": state.render(rows, template)} if template and not by else {}
    return sheets


def write(rows: DataFrame, folder: str, version: int, accounts: DataFrame | None = None, changes: DataFrame | None = None, form: str = "parquet", template: list[dict] | None = None, by: list[str] | None = None) -> dict[str, str]:
    """Writes each sheet to folder/version=N/sheet and returns where; the sheets of one version replace earlier tries. A
    template, where given, makes one more sheet. rows are one batch, or by names the columns that tell batches apart."""
    sheets = sheets_of(rows, by or [], accounts, changes, template)
    paths = {name: f"{folder}/version={version}/{name}" for name in sheets}
    for name, sheet in sheets.items():
        sheet.write.mode("overwrite").format(form).options(**({"header": "true"} if form == "csv" else {})).save(paths[name])
    return paths


def write_workbooks(rows: DataFrame, folder: str, version: int, by: str, accounts: DataFrame | None = None, changes: DataFrame | None = None) -> str:
    """A workbook for each batch, named by the column by, in folder/version=N; returns that folder."""
    titles = {"invoices": "Invoices", "needs_review": "Needs Review", "summary": "Summary", "evidence": "Evidence", "audit_changes": "Audit Changes"}
    sheets = {titles[k]: sheet for k, sheet in sheets_of(rows, [by], accounts, changes).items()}
    workbook.write(rows.sparkSession, sheets, f"{folder}/version={version}", by, ["source_filename", "file_id", "page_no", "id"])
    return f"{folder}/version={version}"
