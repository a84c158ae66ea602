"""Many patterns in text against looking for each."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import patterns, resolution


def texts(r, n):
    words = ["red", "bull", "Olive", "oil", "evian", "a", "é", "日本", "xx"]
    return [None, "", "RED BULL", "red  bull", *(" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(n))]


@pytest.mark.parametrize("limit", [patterns.LIMIT, 10])
def test_first_alias_in_order(spark, limit):
    r = random.Random(4)
    said = texts(r, 80)
    aliases = [(k, r.choice(["red", "bull", "red bull", "oil", "olive oil", "VIAN", "é", "本", "xx xx", "", None, "a"]), f"L{k}") for k in random.Random(9).sample(range(100), 40)]
    rows = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(said)], "id long, words string, label string")
    got = {x["id"]: x["label"] for x in patterns.labelled(rows, F.col("words"), spark.createDataFrame(aliases, "ord long, alias string, label string"), limit=limit).collect()}
    want = {k: next((label for _, a, label in sorted(aliases) if a and t and a.lower() in t.lower()), None) for k, t in enumerate(said)}
    assert got == want


def test_first_alias_within_scopes(spark):
    r = random.Random(6)
    said = [(r.choice(["A", "B", "none"]), t) for t in texts(r, 120)]
    listed = [(r.choice("AB"), k, r.choice(["red", "bull", "oil", "é", "本", "", None, "xx"]), f"L{k}") for k in range(30)]
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(said)] * 2, "id long, s string, words string")
    found = patterns.labelled_within(rows, "words", spark.createDataFrame(listed, "s string, ord long, alias string, label string"), ["s"], most=7)
    assert found.count() == 2 * len(said)
    for x in found.collect():
        s, t = said[x["id"]]
        assert x["label"] == next((label for scope, _, a, label in sorted(listed, key=lambda y: y[1]) if scope == s and a and t and a.lower() in t.lower()), None)


def test_a_hundred_thousand_aliases(spark):
    listed = spark.range(100_000).select(F.col("id").alias("ord"), F.concat(F.lit("brand "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("alias"), F.col("id").cast("string").alias("label"))
    rows = spark.createDataFrame([("some Brand 000777 and brand 000042",), ("brand 1",), ("x" * 5000 + " brand 099999",)], "words string")
    began = time.time()
    found = patterns.labelled(rows, F.col("words"), listed)
    assert [x["label"] for x in found.orderBy("words").collect()] == [None, "42", "99999"] and time.time() - began < 60
    few = patterns.labelled(rows, F.col("words"), listed.limit(2))
    size = lambda df: df._jdf.queryExecution().analyzed().toString().count("\n")
    assert size(found) <= size(few)


def test_brands_keep_their_order(spark):
    rows = spark.createDataFrame([("Sprite and HEINEKEN",), ("winston",), ("Fresh produce, evian",)], "words string")
    assert [x["label"] for x in patterns.labelled(rows, F.col("words"), patterns.brands(spark)).orderBy("words").collect()] == ["Beverages", "Alcohol", None]
    assert [x["category"] for x in resolution.taxonomy(spark.createDataFrame([("red bull",), (None,)], "description string"), [("one", ["bull"]), ("two", ["red bull"])]).orderBy("description").collect()] == [None, "one"]


def test_reference_files(spark, tmp_path):
    from ledgerloom.operators import accounts
    from ledgerloom.sources import reference

    (tmp_path / "s.yaml").write_text("suppliers:\n  - canonical: Acme Works\n    vat_number: MT 12\n    aliases: [acme, 7]\n    nominal_hint: Metal\n  - vat_number: none\n  - canonical: Beta\n    date_locale: mdy\n")
    (tmp_path / "t.yaml").write_text("categories:\n  Drinks:\n    nominal_hint: Beverages\n    entries:\n      - brand: Fizz\n        aliases: [fizz, fizz cola]\n  Tools:\n    entries:\n      - brand: Saw\n        aliases: [saw]\n      - brand: None at all\n")
    listed = reference.suppliers(spark, str(tmp_path / "s.yaml"))
    assert [tuple(x) for x in listed.orderBy("ord").collect()] == [(0, "Acme Works", "MT 12", ["acme", "7"], "dmy", "Metal", []), (1, "Beta", "", [], "mdy", "", [])]
    named = accounts.normalised_suppliers(spark.createDataFrame([("ACME", None), ("x", "mt12")], "raw string, vat string"), listed)
    assert {x["raw"]: x["canonical"] for x in named.collect()} == {"ACME": "Acme Works", "x": "Acme Works"}
    goods = reference.taxonomy(spark, str(tmp_path / "t.yaml"))
    assert [(x["alias"], x["label"], x["category"]) for x in goods.orderBy("ord").collect()] == [("fizz cola", "Beverages", "Drinks"), ("fizz", "Beverages", "Drinks"), ("saw", "Tools", "Tools")]
    rows = spark.createDataFrame([("a SAW and Fizz",), ("none",)], "words string")
    assert [x["label"] for x in patterns.labelled(rows, F.col("words"), goods).orderBy("words").collect()] == ["Beverages", None]
    assert reference.suppliers(spark, str(tmp_path / "none.yaml")).isEmpty() and reference.taxonomy(spark, str(tmp_path / "none.yaml")).isEmpty()
