"""Chains of rules against the same rules applied one by one."""

from __future__ import annotations

import random
import re
import time
from collections import defaultdict

from ledgerloom.operators import rule_graph, rules

SCHEMA = "id long, tenant string, company string, rule_type string, field_name string, source_pattern string, target_value string, active boolean"
SUFFIX = r"\b(ltd|limited|plc|llc|inc|corp|co|group|trading|holdings|services|solutions)\b"


def key(x):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", " ", re.sub(SUFFIX, "", (x or "").lower()))).strip()


def brute(value, tenant, company, rule_type, held):
    for r in sorted(held):
        _, t, c, kind, _, src, target, active = r
        if active and t == tenant and (c is None or c == company) and kind == rule_type and target and key(src) and key(value) == key(src):
            value = target
    return value


def test_chains_of_rules(spark):
    r = random.Random(3)
    names = ["Alpha Ltd", "alpha", "Beta", "BETA group", "Gamma", "Delta & Co", "Epsilon", "", "Ltd", "Zeta 1", "zeta-1"]
    held = [(k, r.choice(["T1", "T2"]), r.choice([None, None, "A", "B"]), r.choice(list(rules.CHAINED)), "f", r.choice(names), r.choice([*names, None]), r.random() < 0.9) for k in range(150)]
    values = [(kind, t, c, v) for kind in rules.CHAINED for t in ("T1", "T2", "T3") for c in ("A", "B", "C") for v in [*names, "unknown"]]
    got = {(x["rule_type"], x["tenant"], x["company"], x["value"]): x["result"] for x in rules.chained(spark.createDataFrame(values, "rule_type string, tenant string, company string, value string"), spark.createDataFrame(held, SCHEMA)).collect()}
    assert {(kind, t, c, v): brute(v, t, c, kind, held) for kind, t, c, v in values} == {x: got.get(x, x[3]) for x in values}
    assert len(got) > 50


def test_no_rules_and_no_values(spark):
    none = spark.createDataFrame([], SCHEMA)
    values = spark.createDataFrame([("supplier_alias", "T1", "A", "Alpha")], "rule_type string, tenant string, company string, value string")
    assert rules.chained(values, none).isEmpty()
    assert rules.chained(values.limit(0), spark.createDataFrame([(1, "T1", None, "supplier_alias", "f", "Alpha", "Beta", True)], SCHEMA)).isEmpty()


def test_a_scope_of_very_many_rules(spark):
    """100,000 rules of one scope: a chain of 30,000, one pattern that 35,000 rules share, and 35,000 by themselves."""
    n, step = 100_000, 30_000
    made = spark.range(n).selectExpr(
        "id", "'T' AS tenant", "'C' AS company", "'supplier_alias' AS rule_type", "'supplier_name' AS field_name",
        f"CASE WHEN id < {step} THEN concat('c', id) WHEN id % 2 = 0 THEN 'Hot Ltd' ELSE concat('s', id) END AS source_pattern",
        f"CASE WHEN id < {step} THEN concat('c', id + 1) WHEN id % 2 = 0 THEN concat('HOT ', id) ELSE concat('t', id) END AS target_value", "true AS active",
    )
    values = spark.createDataFrame([("supplier_alias", "T", "C", v) for v in ("c0", "C 7", "c7", "hot", "s30001", "c29999", "none")], "rule_type string, tenant string, company string, value string")
    began = time.time()
    got = {r["value"]: r["result"] for r in rules.chained(values, made).collect()}
    assert got == {"c0": "c30000", "c7": "c30000", "hot": f"HOT {step}", "s30001": "t30001", "c29999": "c30000"}
    assert time.time() - began < 90


def test_successors_in_one_pass(spark):
    held = spark.createDataFrame([("x", "T", True, "C", k, s, t, t) for k, (s, t) in enumerate([("a", "b"), ("b", "a"), ("a", "a"), ("b", ""), ("a", "b")])], "rule_type string, tenant string, own boolean, scope string, id long, src string, next string, target_value string")
    found = rule_graph.successors(held)
    assert {(r["id"], r["to"]) for r in found.collect()} == {(0, 1), (1, 2), (2, 4)}
    assert {(r["id"], r["to"]) for r in rule_graph.ends(found).collect()} == {(0, 4), (1, 4), (2, 4)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
