"""Edits as data: commands over immutable rows become corrections, audit rows and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import listing, state
from ledgerloom.shared import stored

MONEY = "decimal(14,2)"
#: The fields that a person may correct.
CORRECTABLE = ["supplier_name", "supplier_posting_account", "nominal_account_code", "invoice_number", "invoice_date", "description", "net_amount", "vat_amount", "total_amount", "currency", "tax_code"]
AMOUNTS = ["net_amount", "vat_amount", "total_amount"]


def text_of(field: str, value: Column) -> Column:
    """A field's value as the audit shows it: amounts with two decimals, dates in ISO form, blanks as null."""
    if field in AMOUNTS:
        return value.cast(MONEY).cast("string")
    return F.nullif(value.cast("string"), F.lit(""))


def effective(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """rows (row_id and the fields) with `original` and `current`, structs of all the fields that may be corrected, and
    whether any is. corrections: a row at most for each row_id, null where a field is not corrected."""
    have = [f for f in CORRECTABLE if f in rows.columns]
    fixes = corrections.select("row_id", *[F.col(f).alias(f"__{f}") for f in have])
    now = [F.coalesce(f"__{f}", f).alias(f) for f in have]
    some = F.lit(False)
    for f in have:
        some = some | F.col(f"__{f}").isNotNull()
    others = [c for c in rows.columns if c not in have]
    return rows.join(fixes, "row_id", "left").select(*others, F.struct(*have).alias("original"), F.struct(*now).alias("current"), some.alias("is_corrected"))


def checked(rows: DataFrame, corrections: DataFrame, changes: DataFrame, suppliers: DataFrame, accounts: DataFrame) -> DataFrame:
    """changes (row_id, field, value) with old_value, new_value and outcome: applied, unchanged, ignored (no such row, or a
    field that is not to be corrected) or rejected.

    rows: row_id, tenant, company, status (of the batch, null if it has none yet) and the fields. A blank value takes the correction back. Rejected
    are: any change to an exported batch; an amount or date that is none; and, where a company has masters, a supplier or
    an account that is not among them. suppliers: tenant, company, supplier_name; accounts: tenant, company, account_code.
    """
    have = [f for f in CORRECTABLE if f in rows.columns]
    shown = effective(rows, corrections)
    current = F.lit(None).cast("string")
    for f in have:
        current = F.when(F.col("field") == f, text_of(f, F.col("current")[f])).otherwise(current)
    joined = changes.join(shown.select("row_id", "tenant", "company", "status", "current", F.lit(True).alias("__there")), "row_id", "left")
    raw = F.nullif("value", F.lit(""))
    new = F.when(F.col("field").isin(AMOUNTS), raw.try_cast(MONEY).cast("string")).when(F.col("field") == "invoice_date", F.try_to_date(raw, "yyyy-MM-dd").cast("string")).otherwise(raw)
    asked = joined.withColumns({"old_value": current, "new_value": new})
    scope = ["tenant", "company"]
    lists = suppliers.select(*scope, F.lit("supplier_name").alias("field"), F.col("supplier_name").alias("new_value")).unionByName(accounts.select(*scope, F.lit("nominal_account_code").alias("field"), F.col("account_code").alias("new_value"))).distinct()
    listed = asked.join(lists.select(*scope, "field").distinct().withColumn("__listed", F.lit(True)), [*scope, "field"], "left").join(lists.withColumn("__known", F.lit(True)), [*scope, "field", "new_value"], "left")
    outcome = (
        F.when(F.col("__there").isNull() | ~F.col("field").isin(have), "ignored").when(state.normalised_status(F.col("status")) == "exported", "rejected: exported").when(raw.isNotNull() & F.col("new_value").isNull(), "rejected: no value of this field")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").when(F.col("new_value").isNotNull() & F.col("__listed") & F.col("__known").isNull(), "rejected: not in the master list").otherwise("applied")
    )
    return listed.select(*changes.columns, "old_value", "new_value", outcome.alias("outcome"))


def corrected(corrections: DataFrame, done: DataFrame) -> DataFrame:
    """corrections after the applied changes of `checked`: one row for each row_id. A null new value empties the cell."""
    have = [c for c in corrections.columns if c in CORRECTABLE]
    cell = lambda f: F.max(F.when(F.col("field") == f, F.struct(F.lit(True).alias("set"), "new_value"))).alias(f"__{f}")
    cells = done.where("outcome = 'applied'").groupBy("row_id").agg(*map(cell, have))
    joined = corrections.join(cells, "row_id", "full")
    kinds = dict(corrections.dtypes)
    value = lambda f: F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}")["new_value"].cast(kinds[f])).otherwise(F.col(f)).alias(f)
    return joined.select(*[value(c) if c in have else F.col(c) for c in corrections.columns])


def audit(done: DataFrame) -> DataFrame:
    """The audit rows of the applied changes of `checked`."""
    return done.where("outcome = 'applied'").select("row_id", F.col("field").alias("field_name"), "old_value", "new_value", F.lit("edit").alias("action"))


def reverted(corrections: DataFrame, reverts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """corrections without the cells that reverts (row_id, field) name, and the audit rows of those that held something."""
    have = [c for c in corrections.columns if c in CORRECTABLE]
    asked = reverts.where(F.col("field").isin(have)).groupBy("row_id").agg(F.collect_set("field").alias("__fields"))
    joined = corrections.join(asked, "row_id", "left")
    gone = lambda f: F.coalesce(F.array_contains("__fields", f), F.lit(False))
    left = joined.select(*[F.when(~gone(c), F.col(c)).alias(c) if c in have else F.col(c) for c in corrections.columns])
    old = F.explode(F.array_compact(F.array(*[F.when(gone(f) & F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), text_of(f, F.col(f)).alias("old"))) for f in have])))
    seen = joined.withColumn("__x", old).select("row_id", F.col("__x.field").alias("field_name"), F.col("__x.old").alias("old_value"), F.lit(None).cast("string").alias("new_value"), F.lit("revert").alias("action"))
    return left, seen


def merged_fields(old: Column, new: Column) -> Column:
    """Two comma-joined lists of field names as one, sorted, each once."""
    split = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ","), lambda f: f != "")
    return F.array_join(F.array_sort(F.array_distinct(F.concat(split(old), split(new)))), ",")


def marked_reviewed(corrections: DataFrame, marks: DataFrame) -> DataFrame:
    """corrections (row_id, reviewed_fields) with the fields that marks (row_id, field) name; rows without a correction get one."""
    asked = marks.groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("__marked"))
    return corrections.join(asked, "row_id", "full").withColumn("reviewed_fields", F.when(F.col("__marked").isNull(), F.col("reviewed_fields")).otherwise(merged_fields(F.col("reviewed_fields"), F.col("__marked")))).select(*corrections.columns)


def touched(batches: DataFrame, done: DataFrame) -> DataFrame:
    """batches (batch_id, status) after edits: one that was only scanned is in review once a change was applied. done:
    batch_id, outcome."""
    hit = done.where("outcome = 'applied'").select("batch_id").distinct().withColumn("__hit", F.lit(True))
    now = state.normalised_status(F.col("status"))
    return batches.join(hit, "batch_id", "left").withColumn("status", F.when((now == "scanned") & F.col("__hit"), "in_review").otherwise(F.col("status"))).select(*batches.columns)


def wanted_rules(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The rules that applied changes with `save` ask for: what the row said before becomes what it says now. rows: row_id,
    tenant, company, supplier_name, nominal_account_code."""
    kept = done.where("outcome = 'applied' and save and new_value is not null").where(F.col("field").isin("supplier_name", "nominal_account_code")).select("row_id", "field", "new_value")
    joined = kept.join(rows.select("row_id", "tenant", "company", F.col("supplier_name").alias("__s"), F.col("nominal_account_code").alias("__n")), "row_id")
    before = F.lower(F.trim(F.coalesce(F.when(F.col("field") == "supplier_name", F.col("__s")).otherwise(F.col("__n")), F.lit(""))))
    rule_type = F.when(F.col("field") == "supplier_name", "supplier_alias").otherwise("nominal_remap")
    made = joined.select("tenant", "company", rule_type.alias("rule_type"), F.col("field").alias("field_name"), before.alias("source_pattern"), F.trim("new_value").alias("target_value"), F.col("row_id").alias("origin_row_id"))
    return made.where("source_pattern <> '' and source_pattern <> lower(target_value)")


def duplicates(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """A second row, without amounts, for each row that asked (row_id) names; a person must fill it in."""
    zero = F.lit(0).cast(MONEY)
    title = F.regexp_replace(F.concat(F.coalesce("description", F.lit("")), F.lit(" - BCRS/Deposit (manual)")), "^[ -]+|[ -]+$", "")
    new = {"net_amount": zero, "vat_amount": zero, "total_amount": zero, "confidence_score": F.lit(None), "review_required": F.lit(True), "description": title}
    made = rows.join(asked.select("row_id").distinct(), "row_id", "left_semi")
    return made.select(*[new[c].cast(t).alias(c) if c in new else F.col(c) for c, t in rows.dtypes], F.lit("manual_duplicate").alias("method_used"), F.lit("manual").alias("validation_status"), F.lit("high").alias("review_priority"), F.lit("manually_duplicated_for_bcrs").alias("review_reasons"), F.lit("net_amount|vat_amount|total_amount").alias("review_fields"))


def deposits_split(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, new rows) of asked (row_id, amount): an amount above zero and below the row's total becomes a row of its
    own; outcomes name the total that is left, never below net and VAT."""
    amount, total = F.round(F.col("amount"), 2).cast(MONEY), F.coalesce("total_amount", F.lit(0)).cast(MONEY)
    joined = rows.join(asked.withColumn("amount", amount), "row_id")
    outcome = F.when(F.col("amount") <= 0, "rejected: not positive").when((total > 0) & (F.col("amount") >= total), "rejected: not below the total").otherwise("applied")
    judged = joined.withColumn("outcome", outcome)
    left = F.greatest(total - F.col("amount"), F.coalesce("net_amount", F.lit(0)) + F.coalesce("vat_amount", F.lit(0))).cast(MONEY)
    outcomes = judged.select("row_id", "amount", "outcome", total.alias("old_total"), F.when(F.col("outcome") == "applied", left).alias("new_total"))
    bare = F.trim(F.coalesce("description", F.lit("")))
    title = F.when((bare != "") & ~F.contains(F.lower(bare), F.lit("bcrs")), F.concat(bare, F.lit(" - BCRS"))).otherwise(F.coalesce(F.nullif(bare, F.lit("")), F.lit("BCRS")))
    fixed = {
        "net_amount": F.col("amount"), "vat_amount": F.lit(0), "total_amount": F.col("amount"), "description": title, "review_required": F.lit(False), "line_items_raw": F.lit("BCRS surcharge"), "validation_status": F.lit("manual"),
        "review_priority": F.lit(None), "review_fields": F.lit(None), "review_reasons": F.lit("manual_bcrs_split"), "auto_approved": F.lit(False), "method_used": F.concat(F.coalesce("method_used", F.lit("")), F.lit("+bcrs_manual")) if "method_used" in rows.columns else F.lit("+bcrs_manual"),
    }
    more = [fixed[c].cast("string").alias(c) for c in ("review_reasons", "validation_status", "method_used", "line_items_raw") if c not in rows.columns]
    made = judged.where("outcome = 'applied'").select(*[fixed[c].cast(t).alias(c) if c in fixed else F.col(c) for c, t in rows.dtypes], *more)
    return outcomes, made


def split_applied(rows: DataFrame, corrections: DataFrame, asked: DataFrame) -> dict[str, DataFrame]:
    """The state after `deposits_split`: outcomes with the new rows' ids; `made`, the new rows under ids after the last, in the order
    of their sources; `rows`, where a split row has its new total and no review mark; corrections with that total, marked as
    reviewed; and two audit rows for each split. asked: row_id (once), amount. corrections: row_id, total_amount,
    reviewed_fields and others."""
    outcomes, made = deposits_split(rows, asked)
    done = listing.numbered(outcomes.where("outcome = 'applied'").select("row_id", "amount", "old_total", "new_total"), [("row_id", "asc")], 1)
    last = rows.agg(F.coalesce(F.max("row_id"), F.lit(0)).alias("__last"))  # one row
    ids = stored(done.join(F.broadcast(last), F.lit(True)).select("row_id", "amount", "old_total", "new_total", (F.col("__last") + 1 + F.col("page")).alias("new_row_id")), "splits")
    fresh = made.join(ids.select("row_id", "new_row_id"), "row_id").withColumn("row_id", F.col("new_row_id")).select(*made.columns)
    totals = ids.select("row_id", F.col("new_total").alias("__total"))
    split = F.col("__total").isNotNull()
    new = {"total_amount": F.coalesce("__total", "total_amount"), "review_required": F.when(split, False).otherwise(F.col("review_required")) if "review_required" in rows.columns else None, "review_priority": F.when(~split, F.col("review_priority")) if "review_priority" in rows.columns else None}
    after = rows.join(totals, "row_id", "left").select(*[new[c].cast(t).alias(c) if c in new else F.col(c) for c, t in rows.dtypes])
    told = {"total_amount": F.coalesce("__total", "total_amount"), "reviewed_fields": F.when(split, merged_fields(F.col("reviewed_fields"), F.lit("total_amount"))).otherwise(F.col("reviewed_fields"))}
    fixes = corrections.join(totals, "row_id", "full").select(*[told[c].cast(t).alias(c) if c in told else F.col(c) for c, t in corrections.dtypes])
    source = ids.select("row_id", F.lit("total_amount").alias("field_name"), F.col("old_total").cast("string").alias("old_value"), F.col("new_total").cast("string").alias("new_value"), F.lit("bcrs_split_source").alias("action"))
    note = F.concat(F.lit("bcrs_split from row "), F.col("row_id").cast("string"), F.lit(" (amount="), F.col("amount").cast("string"), F.lit(")"))
    there = ids.select(F.col("new_row_id").alias("row_id"), F.lit("_action").alias("field_name"), F.lit(None).cast("string").alias("old_value"), note.alias("new_value"), F.lit("bcrs_split_created").alias("action"))
    return {"outcomes": outcomes.join(ids.select("row_id", "new_row_id"), "row_id", "left"), "made": fresh, "rows": after, "corrections": fixes, "audit": source.unionByName(there)}
