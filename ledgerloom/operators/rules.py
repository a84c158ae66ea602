"""Correction rules: which hold for a row, their replay over rows, and their upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fields, text
from ledgerloom.operators import rule_graph
from ledgerloom.shared import stored

#: Rule types that replace a whole value, with the field that they replace.
CHAINED = {"supplier_alias": "supplier_name", "nominal_remap": "nominal_account_code"}
#: What makes two rules the same.
IDENTITY = ["tenant", "rule_type", "field_name", "source_pattern", "target_value"]


def active(rules: DataFrame) -> DataFrame:
    """Active rules with a pattern and a target, and both in the form in which they are compared."""
    good = rules.where("active and coalesce(target_value, '') <> ''")
    return good.withColumns({"src": text.supplier_key(F.col("source_pattern")), "next": text.supplier_key(F.col("target_value"))}).where("src <> ''")


def chained(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_type, tenant, company, value, result) for the distinct values (rule_type, tenant, company, value) that rules
    change: the rules of a company and the global ones of its tenant, each applied in the order of their ids to what those
    before it left. Ids are unique within a tenant."""
    own = active(rules).where(F.col("rule_type").isin(*CHAINED))
    return rule_graph.applied(values, own.select("rule_type", "id", "tenant", "company", "src", "next", "target_value"))


def corrections(rules: DataFrame, names: list[str]) -> list[DataFrame]:
    """Of company rules and of global ones, by supplier: for each field the newest text correction whose value fits it."""
    own = active(rules).where("rule_type = 'text_correction'").where(F.col("field_name").isin(names))
    fit = F.lit(False)
    for f in names:
        fit = fit | ((F.col("field_name") == f) & fields.appropriate(f, F.trim("target_value")))
    newest = lambda f: F.max(F.when(F.col("field_name") == f, F.struct("id", F.trim("target_value").alias("to")))).alias(f"__{f}")
    best = own.where(fit)
    return [best.where("company is not null").groupBy("tenant", "company", "src").agg(*map(newest, names)), best.where("company is null").groupBy("tenant", "src").agg(*map(newest, names))]


def replay(rows: DataFrame, rules: DataFrame, names: tuple[str, ...] = ("supplier_name", "nominal_account_code", "invoice_number", "description")) -> DataFrame:
    """rows after the rules that hold for them.

    rules: id, tenant, company (null: all of the tenant's), rule_type, field_name, source_pattern, target_value, active.
    Aliases and remaps come first, in the order of their ids. Then text corrections, for the rows of the supplier that
    they name: one takes effect where the field may be overwritten, reads as the pattern does, and the new value fits it.
    Rules that read a region of the page need the page and never write the value they were made with. rows: tenant,
    company, review_fields, review_required, confidence_score and the fields of `names`.
    """
    values = [rows.select(F.lit(t).alias("rule_type"), "tenant", "company", F.col(f).alias("value")).where("value is not null") for t, f in CHAINED.items()]
    changed, out = stored(chained(reduce(DataFrame.unionByName, values), rules), "chained"), rows
    for rule_type, field in CHAINED.items():
        to = changed.where((F.col("rule_type") == rule_type) & ~F.col("result").eqNullSafe(F.col("value"))).select("tenant", "company", F.col("value").alias(field), F.col("result").alias("__to"))
        out = out.join(to, ["tenant", "company", field], "left").withColumn(field, F.coalesce("__to", field)).select(*rows.columns)
    out = out.withColumn("src", text.supplier_key(F.col("supplier_name")))
    mine, shared = corrections(rules, list(names))
    for f in names:
        shared = shared.withColumnRenamed(f"__{f}", f"__all_{f}")
    joined = out.join(mine, ["tenant", "company", "src"], "left").join(shared, ["tenant", "src"], "left")

    def corrected(f: str) -> Column:
        best = F.greatest(F.col(f"__{f}"), F.col(f"__all_{f}"))
        reads = text.supplier_key(F.trim(F.col(f).cast("string"))) == F.col("src")
        may = fields.eligible(f, F.col(f), F.col("review_fields"), F.col("review_required"), F.col("confidence_score"))
        return F.when((F.col("src") != "") & reads & may & best.isNotNull(), best["to"]).otherwise(F.col(f)).alias(f)

    return joined.select(*[corrected(c) if c in names else F.col(c) for c in rows.columns])


def saved(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """rules with the wanted ones: one that is there already, whatever its state, becomes active and takes the new origin;
    others are added, once each, with ids after the last. wanted: IDENTITY, company, origin_row_id."""
    fresh = wanted.groupBy(*IDENTITY).agg(F.min("company").alias("__company"), F.max("origin_row_id").alias("__origin"))
    joined = rules.join(fresh, IDENTITY, "left")
    kept = joined.select(*[(F.col("active") | F.col("__origin").isNotNull()).alias("active") if c == "active" else F.coalesce("__origin", "origin_row_id").alias(c) if c == "origin_row_id" else F.col(c) for c in rules.columns])
    last = rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))  # one row
    # Ids follow the hash order of the rules' identity within and over partitions: no window over all rows.
    added = fresh.join(rules.select(*IDENTITY), IDENTITY, "left_anti").join(F.broadcast(last), F.lit(True))
    made = added.withColumns({"id": F.col("__last") + 1 + F.monotonically_increasing_id(), "company": F.col("__company"), "active": F.lit(True), "origin_row_id": F.col("__origin")})
    return kept.unionByName(made.select(*rules.columns))


def clashes(rules: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (id and any of source_pattern, target_value) with whether the rule would become one that is there already."""
    asked = updates.select("id", F.col("source_pattern").alias("__s"), F.col("target_value").alias("__t"))
    wanted = rules.join(asked, "id").select("id", *[F.coalesce(f"__{c[0]}", c).alias(c) if c in ("source_pattern", "target_value") else F.col(c) for c in IDENTITY])
    other = (F.col("__low") != F.col("id")) | (F.col("__high") != F.col("id"))
    return wanted.join(_held(rules), IDENTITY, "left").select("id", *IDENTITY, F.coalesce(other, F.lit(False)).alias("clashes"))


def _held(rules: DataFrame) -> DataFrame:
    """The least and the greatest id of each identity: a rule meets another one of it where either is not its own."""
    return rules.groupBy(*IDENTITY).agg(F.min("id").alias("__low"), F.max("id").alias("__high"))


def updated(rules: DataFrame, commands: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rules) after commands, one for each rule: id, tenant (whose user asks; null: an admin), action (update, enable,
    disable or delete), source_pattern, target_value, active, applies_to (all_companies or this_company) and company.

    Outcomes: done; not found; rejected, and why; clash, where another rule as it was has the new identity. An update keeps
    what it does not name; patterns are stored in lower case with single blanks. companies: tenant, company.
    """
    held = rules.select("id", *IDENTITY).withColumnsRenamed({c: f"__{c}" for c in IDENTITY})
    joined = commands.alias("c").join(held.alias("r"), F.col("c.id") == F.col("r.id"), "left").select("c.*", "r.__tenant", "r.__rule_type", "r.__field_name", "r.__source_pattern", "r.__target_value", F.col("r.id").isNotNull().alias("__there"))
    own = companies.select(F.col("tenant").alias("__tenant"), F.col("company").alias("company"), F.lit(True).alias("__own")).distinct()
    asked = joined.join(own, ["__tenant", "company"], "left")
    src = F.lower(F.trim(F.regexp_replace(F.coalesce(F.nullif("source_pattern", F.lit("")), "__source_pattern"), r"\s+", " ")))
    tgt = F.trim(F.coalesce(F.nullif("target_value", F.lit("")), "__target_value", F.lit("")))
    asked = asked.withColumns({"__src": src, "__tgt": tgt})
    others = _held(rules).withColumnsRenamed(dict(zip(IDENTITY, ("__tenant", "__rule_type", "__field_name", "__src", "__tgt"))))
    met = asked.where("action = 'update'").join(others, ["__tenant", "__rule_type", "__field_name", "__src", "__tgt"]).where((F.col("id") != F.col("__low")) | (F.col("id") != F.col("__high"))).select("id", F.lit(True).alias("__clash")).distinct()
    judged = asked.join(met, "id", "left")
    update, narrow = F.col("action") == "update", F.col("applies_to") == "this_company"
    outcome = (
        F.when(~F.col("__there") | ~F.coalesce(F.col("tenant") == F.col("__tenant"), F.col("tenant").isNull()), "not found").when(~update, F.when(F.col("action").isin("enable", "disable", "delete"), "done").otherwise("rejected: no such action"))
        .when(F.col("__src") == "", "rejected: blank pattern").when(F.col("__tgt") == "", "rejected: blank target").when(F.col("__src") == F.lower("__tgt"), "rejected: no effect").when(F.col("__clash"), "clash")
        .when(F.col("applies_to").isNotNull() & ~F.col("applies_to").isin("this_company", "all_companies"), "rejected: no such scope").when(narrow & F.col("company").isNull(), "rejected: no company")
        .when(narrow & F.col("tenant").isNotNull() & F.col("__own").isNull(), "rejected: not a company of the tenant").otherwise("done")
    )
    done = judged.withColumn("outcome", outcome)
    changes = done.where("outcome = 'done'").select("id", F.struct("action", "__src", "__tgt", F.col("active").alias("on"), "applies_to", F.col("company").alias("to")).alias("__d"))
    out = rules.join(changes, "id", "left").where("__d is null or __d.action <> 'delete'")
    change = F.coalesce(F.col("__d.action") == "update", F.lit(False))
    new = {
        "source_pattern": F.when(change, F.col("__d.__src")).otherwise(F.col("source_pattern")), "target_value": F.when(change, F.col("__d.__tgt")).otherwise(F.col("target_value")),
        "active": F.when(F.col("__d.action") == "enable", True).when(F.col("__d.action") == "disable", False).when(change, F.coalesce("__d.on", "active")).otherwise(F.col("active")),
        "company": F.when(change & (F.col("__d.applies_to") == "all_companies"), F.lit(None)).when(change & (F.col("__d.applies_to") == "this_company"), F.col("__d.to")).otherwise(F.col("company")),
    }
    return done.select(*commands.columns, "outcome"), out.select(*[new[c].alias(c) if c in new else F.col(c) for c in rules.columns])
