"""Chains of rules as a graph.

A rule that replaces one value by another hands on to the next rule, in the order of their ids, whose pattern is what it
wrote. So each rule has at most one successor, with a higher id, and a chain ends at a rule without one. Successors are
found in one pass over the rules sorted by pattern; the ends of all chains by pointer jumping, where every jump doubles
the stretch that a pointer spans, so that a chain of n rules takes log2(n) jumps. Values meet the first rule of their
chain in an equi-join on their key. No list of rules is ever held, and no value meets more than one rule.

Stored rules take a byte or two each on disk, as most of what they hold repeats, and by that size they would be broadcast
however many they are; so joins with them are told to sort and merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.shared import dropped, observed, stored

#: A scope is a company with rules of its own, or, for all other companies of a tenant, the tenant itself; types of rules
#: don't meet.
SCOPE = ["rule_type", "tenant", "own", "scope"]
_RULE = ["rule_type", "id", "src", "next", "target_value"]


def visible(rules: DataFrame) -> DataFrame:
    """The rules that each scope has, the global ones of its tenant too: SCOPE, id, src, next, target_value. rules: rule_type,
    id, tenant, company (null: all of the tenant's), src, next, target_value."""
    mine = rules.where("company is not null").select("tenant", F.lit(True).alias("own"), F.col("company").alias("scope"), *_RULE)
    shared = rules.where("company is null").select("tenant", *_RULE)
    theirs = shared.join(mine.select("rule_type", "tenant", "scope").distinct(), ["rule_type", "tenant"]).select("tenant", F.lit(True).alias("own"), "scope", *_RULE)
    return mine.unionByName(theirs).unionByName(shared.select("tenant", F.lit(False).alias("own"), F.lit("").alias("scope"), *_RULE))


def successors(held: DataFrame) -> DataFrame:
    """(SCOPE, id, to): for each rule that has one the rule it hands on to, the next in order of ids whose
    pattern is its target. One sort by key and id, however many rules share a pattern."""
    patterns = held.select(*SCOPE, F.col("src").alias("key"), "id", F.col("id").alias("begins"))
    targets = held.where("next <> ''").select(*SCOPE, F.col("next").alias("key"), "id", F.lit(None).cast("long").alias("begins"))
    later = Window.partitionBy(*SCOPE, "key").orderBy(F.desc("id")).rangeBetween(Window.unboundedPreceding, -1)
    return patterns.unionByName(targets).withColumn("to", F.min("begins").over(later)).where("begins is null and to is not null").select(*SCOPE, "id", "to")


def ends(links: DataFrame) -> DataFrame:
    """(SCOPE, id, to) with every pointer at the end of its chain. links: pointers to higher ids."""
    at = stored(links, "rule-links")
    while True:
        ahead = at.select(*SCOPE, F.col("id").alias("to"), F.col("to").alias("further")).hint("merge")
        once = at.join(ahead, [*SCOPE, "to"], "left").select(*SCOPE, "id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
        twice = once.join(ahead, [*SCOPE, "to"], "left").select(*SCOPE, "id", F.coalesce("further", "to").alias("to"), "moved")
        after, seen = observed(twice, "rule-links", moved=F.count_if("moved"))
        dropped(at)
        if not seen["moved"]:
            return after.drop("moved")
        at = after


def resolved(held: DataFrame) -> DataFrame:
    """(SCOPE, src, result): what a value with the key src becomes in each scope, by the rules of `visible`."""
    first = held.groupBy(*SCOPE, "src").agg(F.min("id").alias("id"))
    last = first.join(ends(successors(held)).hint("merge"), [*SCOPE, "id"], "left").select(*SCOPE, "src", F.coalesce("to", "id").alias("id"))
    return last.join(held.select(*SCOPE, "id", F.col("target_value").alias("result")).hint("merge"), [*SCOPE, "id"]).select(*SCOPE, "src", "result")


def applied(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_type, tenant, company, value, result): the distinct values that a rule changes, and what all rules of the type, in
    order, make of each."""
    held = stored(visible(rules), "rules")
    what = ["rule_type", "tenant", "company", "value"]
    companies = held.where("own").select("rule_type", "tenant", F.col("scope").alias("company"), F.lit(True).alias("has")).distinct()
    asked = values.select(*what).distinct().join(companies, ["rule_type", "tenant", "company"], "left")
    has = F.col("has").isNotNull()
    asked = asked.select(*what, has.alias("own"), F.when(has, F.col("company")).otherwise("").alias("scope"), text.supplier_key(F.col("value")).alias("src"))
    return asked.join(resolved(held), [*SCOPE, "src"]).select(*what, "result")
