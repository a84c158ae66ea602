"""The review decision: reasons weighed, ordered and turned into a priority and a status."""

from __future__ import annotations

from functools import reduce
from itertools import chain, groupby
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight, band and fields of every reason.
REASONS = {
    "no_supplier": (100, "high", "supplier_name"),
    "no_amount": (100, "high", "total_amount"),
    "ai_validation_failed": (90, "high", "_general"),
    "totals_mismatch": (80, "high", "net_amount|vat_amount|total_amount"),
    "vat_anomaly": (70, "high", "vat_amount"),
    "supplier_unknown": (65, "high", "supplier_name"),
    "invoice_number_missing": (60, "medium", "invoice_number"),
    "invoice_date_missing": (55, "medium", "invoice_date"),
    "vat_missing": (50, "medium", "vat_amount"),
    "ambiguous_date_locale": (45, "medium", "invoice_date"),
    "supplier_low_confidence": (40, "medium", "supplier_name"),
    "line_classification_unresolved": (35, "medium", "nominal_account_code"),
    "totals_mismatch_advisory": (35, "medium", "net_amount|vat_amount|total_amount"),
    "nominal_mapping_uncertain": (30, "medium", "nominal_account_code"),
    "ai_validation_warned": (25, "medium", "_general"),
    "low_confidence": (20, "medium", "confidence_score"),
    "page_quality_low": (15, "low", "_general"),
    "subtotal_not_found": (15, "low", "net_amount"),
    "deposit_component_detected": (10, "low", "total_amount"),
    "line_sum_mismatch": (10, "low", "line_items_raw"),
    "mixed_category_invoice": (10, "low", "nominal_account_code"),
    "low_evidence_density": (5, "low", "_general"),
}
#: Reasons that need no person where they stand alone.
APPROVABLE = ["page_quality_low", "line_sum_mismatch", "mixed_category_invoice", "low_evidence_density"]
#: What a reviewer is told to do, by status.
ACTIONS = {
    "ok": "",
    "ok_warned": "Spot-check recommended — extraction confidence below optimal",
    "ok_with_warnings": "Minor inconsistency noted — verify fields if needed",
    "review_no_supplier": "ACTION REQUIRED: Supplier not identified — add to supplier list or enter manually",
    "review_no_amount": "ACTION REQUIRED: Total amount missing — enter value from original invoice",
    "review_incomplete": "ACTION REQUIRED: Supplier and amount both missing — enter manually from original invoice",
    "review_validation_failed": "ACTION REQUIRED: Extraction inconsistency detected — verify all fields against original",
    "review_amount_mismatch": "ACTION REQUIRED: Line item totals do not match invoice total — verify line amounts",
    "review": "ACTION REQUIRED: Verify all extracted fields against original invoice",
}


def lookup(values: dict[str, object]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


#: Below these a row's reading, or its page, counts as poor.
POOR_READING, POOR_PAGE = 0.55, 0.35


def gather(rows: DataFrame) -> DataFrame:
    """rows with `reasons`: those found before, in supplier_reasons and validation_reasons, then what classification_method,
    confidence, page_quality, the fields and ai_status give. A null confidence or quality is a full one."""
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    method, status = F.col("classification_method"), F.col("ai_status")
    found = [
        (method == "unresolved", "line_classification_unresolved"), (method.isin("default", "llm_fallback"), "nominal_mapping_uncertain"),
        (F.col("confidence") < POOR_READING, "low_confidence"), (F.col("page_quality") < POOR_PAGE, "page_quality_low"),
        (blank("supplier_name"), "no_supplier"), (F.col("total_amount").isNull(), "no_amount"), (blank("invoice_number"), "invoice_number_missing"), (F.col("invoice_date").isNull(), "invoice_date_missing"),
        (status == "failed", "ai_validation_failed"), (status == "passed_with_warnings", "ai_validation_warned"),
    ]
    return rows.withColumn("reasons", F.concat(empty("supplier_reasons"), empty("validation_reasons"), F.array_compact(F.array(*[F.when(test, name) for test, name in found]))))


def decide(rows: DataFrame) -> DataFrame:
    """rows (with `reasons`, an array in the order found) with review_reasons, review_fields, review_priority,
    review_required, auto_approved and validation_status. Reasons keep their first mention and sort by weight, stably.

    The known reasons are looked for in the order of their weights, so nothing is sorted but those of equal weight.
    """
    key = F.transform(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: F.substring_index(r, ":", 1))
    keyed = rows.withColumn("__k", key)
    placed = keyed.withColumns({f"__at_{n}": F.array_position("__k", n) for n in REASONS})
    at, has = (lambda n: F.col(f"__at_{n}")), (lambda n: F.col(f"__at_{n}") > 0)
    strings = "array<string>"

    def held(n: str) -> Column:
        fields = F.array(*map(F.lit, REASONS[n][2].split("|")))
        return F.when(has(n), F.struct(at(n).alias("at"), F.get("reasons", (at(n) - 1).cast("int")).alias("reason"), fields.alias("fields")))

    parts = []
    for _, group in groupby(sorted(REASONS, key=lambda n: -REASONS[n][0]), key=lambda n: REASONS[n][0]):
        same = [held(n) for n in group]
        parts.append(F.array_sort(F.array_compact(F.array(*same))) if len(same) > 1 else F.array_compact(F.array(*same)))
    other = F.array_distinct(F.filter("__k", lambda k: ~k.isin(list(REASONS))))
    unknown = F.transform(other, lambda k: F.struct(F.lit(0).cast("long").alias("at"), F.get("reasons", (F.array_position("__k", k) - 1).cast("int")).alias("reason"), F.array().cast(strings).alias("fields")))
    in_band = lambda b: reduce(or_, [has(n) for n in REASONS if REASONS[n][1] == b])
    unfit = reduce(or_, [has(n) for n in REASONS if n not in APPROVABLE])
    some = F.size("__k") > 0
    status = F.when(in_band("high"), F.when(has("no_supplier") & has("no_amount"), "review_incomplete").when(has("no_supplier"), "review_no_supplier").when(has("no_amount"), "review_no_amount").otherwise("review_validation_failed")).when(in_band("medium"), "ok_warned").otherwise("ok")
    ordered = placed.select(
        *rows.columns, F.when(some, F.concat(*parts, unknown)).alias("__o"), F.when(in_band("high"), "high").when(in_band("medium"), "medium").when(some, "low").alias("review_priority"), in_band("high").alias("review_required"),
        (some & ~unfit & (F.size(other) == 0)).alias("auto_approved"), status.alias("validation_status"),
    )
    none = F.array().cast(strings)
    return ordered.select(*rows.columns, F.coalesce("__o.reason", none).alias("review_reasons"), F.coalesce(F.array_distinct(F.flatten("__o.fields")), none).alias("review_fields"), "review_priority", "review_required", "auto_approved", "validation_status")


def action(status: Column) -> Column:
    known = F.try_element_at(lookup(ACTIONS), status)
    return F.when(F.coalesce(status, F.lit("")) == "", "").otherwise(F.coalesce(known, F.concat(F.lit("Review — "), status)))


#: How the problems of a row are put.
NO_NAME, NO_AMOUNTS = "Supplier name could not be identified", "No amounts extracted (total and net both missing)"


def issues(rows: DataFrame) -> DataFrame:
    """A row for each invoice row with problems: the list of them, a title with the page and the first, and a priority.
    rows: supplier_name, total_amount, net_amount, confidence_score, method_used, description, page_no."""
    failed = F.coalesce(F.col("method_used") == "page_error", F.lit(False))
    nameless = F.coalesce("supplier_name", F.lit("")) == ""
    low = F.coalesce(F.col("confidence_score") < 0.60, F.lit(False))
    failure = F.concat(F.lit("Page processing error: "), F.substring(F.coalesce("description", F.lit("")), 1, 120))
    unsure = F.concat(F.lit("Low extraction confidence ("), F.bround(F.col("confidence_score") * 100, 0).cast("int").cast("string"), F.lit("%)"))
    problems = F.array_compact(F.array(F.when(nameless, NO_NAME), F.when(F.col("total_amount").isNull() & F.col("net_amount").isNull(), NO_AMOUNTS), F.when(failed, failure).when(low, unsure)))
    found = rows.withColumn("problems", problems).where(F.size("problems") > 0)
    title = F.concat(F.lit("Page "), F.col("page_no").cast("string"), F.lit(": "), F.col("problems")[0])
    return found.withColumns({"title": F.substring(title, 1, 255), "priority": F.when(nameless | failed, "high").otherwise("normal")})


def error_rows(pages: DataFrame) -> DataFrame:
    """Invoice rows for pages that failed: pages (tenant, company, batch_id, file_id, page_no, error); a person must see them."""
    error = F.coalesce("error", F.lit(""))
    return pages.select(
        "tenant", "company", "batch_id", "file_id", "page_no", F.concat(F.lit("Page processing error: "), F.substring(error, 1, 180)).alias("description"), F.lit("EUR").alias("currency"), F.lit("page_error").alias("method_used"),
        F.lit(0).cast("decimal(5,2)").alias("confidence_score"), F.lit("review").alias("validation_status"), F.lit(True).alias("review_required"), F.concat(F.lit("PAGE_ERROR="), error).alias("page_text_raw"),
    )
