"""State without updates: overlays, imports, splits, rules and templates as joins over immutable tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which status may follow which. An exported batch is opened again by a step of its own.
TRANSITIONS = [("scanned", "in_review"), ("in_review", "approved"), ("in_review", "in_review"), ("approved", "exported"), ("approved", "in_review")]


def normalised_status(status: Column) -> Column:
    """No status, and `created`, are as good as scanned."""
    return F.when(F.coalesce(status, F.lit("")).isin("", "created"), "scanned").otherwise(status)


def overlay(rows: DataFrame, corrections: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """rows with each field's correction where there is one, and whether any was made. A null correction is none."""
    fixes = corrections.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(f).alias(f"__{f}") for f in fields])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = rows.join(fixes, on, "left")
    any_fix = F.coalesce(*[F.col(f"__{f}").isNotNull() & ~F.col(f"__{f}").eqNullSafe(F.col(f)) for f in fields[:1]])
    for f in fields[1:]:
        any_fix = any_fix | (F.col(f"__{f}").isNotNull() & ~F.col(f"__{f}").eqNullSafe(F.col(f)))
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns], any_fix.alias("corrected"))


def scoped_rules(rules: DataFrame, company: str) -> DataFrame:
    """Active rules of a company and global ones."""
    return rules.where(F.col("active") & ((F.col("company") == company) | F.col("company").isNull()))


def upsert(dim: DataFrame, staged: DataFrame, key: str, order: str) -> DataFrame:
    """dim (key, name) with staged rows put over it, and what became of each key. Blank keys and names are skipped; of
    staged rows with one key in any case the first in order counts."""
    good = staged.where((F.trim(key) != "") & (F.trim("name") != ""))
    first = good.withColumn("__k", F.lower(F.trim(key))).withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(order))).where("__n = 1").select("__k", F.col(key).alias("__key"), F.col("name").alias("__name"))
    joined = dim.withColumn("__d", F.lower(key)).join(first, F.col("__d") == F.col("__k"), "full")
    outcome = F.when(F.col("__d").isNull(), "imported").when(F.col("__k").isNull(), "kept").otherwise("updated")
    return joined.select(F.coalesce(F.col(key), F.col("__key")).alias(key), F.coalesce("__name", "name").alias("name"), outcome.alias("outcome"))


def import_suppliers(dim: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dim after the import, outcomes) of staged suppliers of one company.

    dim: code, name, default_nominal; staged: ord, code, name, default_nominal, '' where missing. Blank rows are passed over;
    rows without code or name are rejected, and so are all but the first of a code in any case. A row updates the master of
    its code, else the only one of its name in any case, else it is added. outcomes: ord, outcome.
    """
    full = staged.where("not (code = '' and name = '' and default_nominal = '')")
    w = Window.partitionBy(F.lower("code")).orderBy("ord")
    whole = (F.col("code") != "") & (F.col("name") != "")
    good = full.where(whole).withColumn("__n", F.row_number().over(w))
    first = good.where("__n = 1").drop("__n").withColumn("__low", F.lower("name"))
    of_name = dim.withColumn("__low", F.lower("name")).groupBy("__low").agg(F.count("*").alias("__count"), F.min("code").alias("__of_name")).where("__count = 1")
    by_code = first.join(dim.select(F.col("code").alias("__of_code")), F.col("code") == F.col("__of_code"), "left")
    aimed = by_code.join(of_name, "__low", "left").withColumn("__target", F.coalesce("__of_code", "__of_name"))
    # Two rows may aim at one master: the later one is what stays.
    last = aimed.where("__target is not null").groupBy(F.col("__target").alias("__t")).agg(F.max_by(F.struct("code", "name", "default_nominal"), "ord").alias("__new"))
    kept = dim.join(last, F.col("code") == F.col("__t"), "left").select(*[F.when(F.col("__t").isNotNull(), F.nullif(F.col("__new")[c], F.lit(""))).otherwise(F.col(c)).alias(c) for c in ("code", "name", "default_nominal")])
    added = aimed.where("__target is null").select("code", "name", F.nullif("default_nominal", F.lit("")).alias("default_nominal"))
    outcomes = aimed.select("ord", F.when(F.col("__target").isNull(), "imported").otherwise("updated").alias("outcome"))
    outcomes = outcomes.unionByName(full.where(~whole).select("ord", F.lit("rejected: code and name are required").alias("outcome"))).unionByName(good.where("__n > 1").select("ord", F.lit("rejected: code stands twice").alias("outcome")))
    return kept.unionByName(added), outcomes


def import_nominals(dim: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dim after the import, outcomes) of staged nominal accounts of one company.

    dim: code, name, is_active; staged: ord, code, name, '' where missing. Blank rows are passed over; rows without code or name
    are rejected, and so are all but the first of a code in any case. A row renames the account of its very code and makes
    it active, or is added. outcomes: ord, outcome.
    """
    full = staged.where("not (code = '' and name = '')")
    whole = (F.col("code") != "") & (F.col("name") != "")
    good = full.where(whole).withColumn("__n", F.row_number().over(Window.partitionBy(F.lower("code")).orderBy("ord")))
    first = good.where("__n = 1").select("ord", "code", F.col("name").alias("__name"))
    kept = dim.join(first.drop("ord"), "code", "left").select(*[F.coalesce("__name", "name").alias(c) if c == "name" else (F.col("is_active") | F.col("__name").isNotNull()).alias(c) if c == "is_active" else F.col(c) for c in dim.columns])
    fresh = first.join(dim.select("code"), "code", "left_anti")
    made = {"name": F.col("__name"), "is_active": F.lit(True)}
    kinds = dict(dim.dtypes)
    added = fresh.select(*[(made[c] if c in made else F.col(c) if c == "code" else F.lit(None)).cast(kinds[c]).alias(c) for c in dim.columns])
    told = good.select("ord", F.when(F.col("__n") == 1, "imported").otherwise("rejected: code stands twice").alias("outcome"))
    return kept.unionByName(added), told.unionByName(full.where(~whole).select("ord", F.lit("rejected: code and name are required").alias("outcome")))


def import_counts(outcomes: DataFrame, most: int = 20) -> DataFrame:
    """One row: how many rows an import took (imported, updated), how many it passed over (skipped), and the first `most` errors
    in the order of the rows. outcomes: ord, outcome."""
    bad = F.col("outcome").startswith("rejected")
    errors = outcomes.where(bad).orderBy("ord").limit(most).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "outcome"))), lambda x: F.concat(F.lit("Row "), x["ord"].cast("string"), F.lit(": "), F.substring(x["outcome"], 11, 200))).alias("errors"))
    counts = outcomes.agg(F.count_if(F.col("outcome") == "imported").alias("imported"), F.count_if(F.col("outcome") == "updated").alias("updated"), F.count_if(bad).alias("skipped"))
    return counts.join(F.broadcast(errors), F.lit(True))  # one row each


def deposit_split(rows: DataFrame, deposit: str = "deposit") -> DataFrame:
    """Each row, and for one with a deposit a second row for it; the first then has what is left of the total."""
    has = F.coalesce(F.col(deposit) > 0, F.lit(False))
    zero = F.lit(0).cast("decimal(14,2)")
    kept = F.struct(F.lit("original").alias("kind"), F.col("net_amount").alias("net"), F.col("vat_amount").alias("vat"), F.when(has, F.greatest(F.col("total_amount") - F.col(deposit), F.col("net_amount") + F.col("vat_amount"))).otherwise(F.col("total_amount")).cast("decimal(14,2)").alias("total"))
    split = F.struct(F.lit("deposit").alias("kind"), F.col(deposit).cast("decimal(14,2)").alias("net"), zero.alias("vat"), F.col(deposit).cast("decimal(14,2)").alias("total"))
    out = rows.withColumn("__x", F.explode(F.when(has, F.array(kept, split)).otherwise(F.array(kept))))
    return out.select(*[c for c in rows.columns if c not in ("net_amount", "vat_amount", "total_amount", deposit)], F.col("__x.kind").alias("row_kind"), F.col("__x.net").alias("net_amount"), F.col("__x.vat").alias("vat_amount"), F.col("__x.total").alias("total_amount"))


def allowed(changes: DataFrame) -> DataFrame:
    """changes (status, target) with whether the step is allowed, and whether the batch takes edits and may be reopened."""
    now = normalised_status(F.col("status"))
    step = F.concat_ws(">", now, "target").isin([f"{a}>{b}" for a, b in TRANSITIONS])
    return changes.withColumns({"allowed": step, "editable": now != "exported", "reopens": now == "exported"})


def exclusive_default(accounts: DataFrame, chosen: DataFrame) -> DataFrame:
    """accounts (company, code) with is_default: the chosen code of a company and no other. chosen: (company, code)."""
    pick = chosen.select(F.col("company").alias("__c"), F.col("code").alias("__code"))
    return accounts.join(pick, F.col("company") == F.col("__c"), "left").withColumn("is_default", F.coalesce(F.col("code") == F.col("__code"), F.lit(False))).drop("__c", "__code")


def effective_template(companies: DataFrame, assignments: DataFrame) -> DataFrame:
    """companies (tenant, company) with the template that holds: one assigned to the company, else to its tenant, else
    none; the smallest id of several. assignments: id, tenant, company or null, template, active."""
    live = assignments.where("active")
    own = live.where("company is not null").groupBy("tenant", "company").agg(F.min(F.struct("id", "template")).alias("own"))
    shared = live.where("company is null").groupBy("tenant").agg(F.min(F.struct("id", "template")).alias("shared"))
    return companies.join(own, ["tenant", "company"], "left").join(shared, "tenant", "left").select("tenant", "company", F.coalesce("own.template", "shared.template").alias("template"))


# --- export templates: a list of column specifications compiled into one select --------------------------------------


#: The parts of a date pattern, and the ways in which a date may be written, tried in this order.
PATTERN = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%b": "MMM", "%B": "MMMM"}
DATES = [(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "y-M-d"), (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/y"), (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/y"), (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-y"), (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "y/M/d")]


def transformed(value: Column, rule: str | None) -> Column:
    """uppercase, lowercase, number_format, date_format:pattern, default:value; any other rule leaves the value, and so do
    a number format and a date format where it is no number, or no date in one of the forms of `DATES`."""
    name, _, arg = (rule or "").partition(":")
    if name == "uppercase":
        return F.upper(value.cast("string"))
    if name == "lowercase":
        return F.lower(value.cast("string"))
    if name == "number_format":
        number = value.try_cast("decimal(38,10)")
        plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"0+$", ""), r"\.$", ".0")
        return F.coalesce(plain, value.cast("string"))
    if name == "date_format":
        own, text = reduce(lambda p, x: p.replace(*x), PATTERN.items(), arg), F.trim(value.cast("string"))
        parsed = [F.try_to_date(F.when(text.rlike(shape), text), form) for shape, form in DATES]
        return F.coalesce(F.date_format(F.coalesce(*parsed), own), value.cast("string"))
    if name == "default":
        return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(arg))
    return value.cast("string")


def condition(field: Column, operator: str, value: str | None) -> Column:
    """Comparisons are of numbers where both sides are, else of strings."""
    text = F.coalesce(field.cast("string"), F.lit(""))
    if operator in ("is_null", "is_not_null"):
        return (text == "") if operator == "is_null" else (text != "")
    if operator in ("contains", "not_contains"):
        held = F.contains(F.lower(text), F.lit((value or "").lower()))
        return held if operator == "contains" else ~held
    if operator == "starts_with":
        return F.startswith(F.lower(text), F.lit((value or "").lower()))
    a, b = text.try_cast("double"), F.lit(value).try_cast("double")
    how = {"eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y}[operator]
    return F.when(a.isNotNull() & b.isNotNull(), how(a, b)).otherwise(how(text, F.lit(value)))


def render(rows: DataFrame, template: list[dict]) -> DataFrame:
    """The active columns of a template in their order: static, mapped or conditional."""
    out = []
    for spec in sorted((x for x in template if x.get("is_active", True)), key=lambda x: x["column_order"]):
        if spec["column_type"] == "static":
            value = F.lit(spec.get("static_value") or "")
        elif spec["column_type"] == "conditional":
            value = F.when(F.lit(False), F.lit(""))
            for rule in spec["condition_rules"]:
                value = value.when(condition(F.col(rule["if_field"]), rule["operator"], rule.get("value")), rule["output"])
            value = value.otherwise("")
        else:
            value = F.coalesce(transformed(F.col(spec["source_field"]), spec.get("transform_rule")), F.lit(""))
        out.append(value.alias(spec["column_heading"]))
    return rows.select(*out)
