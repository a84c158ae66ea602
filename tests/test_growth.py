"""Work that grows with the tables: what many rows share is looked up once, and makes no pairs."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators import accounts, deposits, edit_log, pages, regions, resolution, rule_graph, rules
from ledgerloom.plans import record_catalogue

HINTS = "id long, tenant string, field_name string, page_no int, supplier_id long, supplier_name_snapshot string, active boolean, x double, y double, w double, h double"


def _row(spark, n):
    return spark.range(n).selectExpr("id AS row_id", "id AS file_id", "'T' AS tenant", "'C' AS company", "1 AS page_no", "'Acme Ltd' AS supplier_name", "CAST(NULL AS STRING) AS review_fields", "'' AS invoice_number", "DATE '2026-01-01' AS invoice_date", "5 AS net_amount", "'1' AS vat_amount", "'7' AS total_amount", "'N1' AS nominal_account_code", "'some text' AS description")


def _hints(spark, n):
    return spark.createDataFrame([(k, "T", "invoice_number", 1, None, "ACME", True, 0.0, 0.5 * (k % 2), 1.0, 0.25) for k in range(n)], HINTS)


def test_the_newest_region_stands_for_all(spark):
    rows, known = _row(spark, 200), spark.createDataFrame([], "id long, tenant string, company string, supplier_name string")
    assert accounts.hints_met(rows, _hints(spark, 300), known).count() == 200
    assert {x["hint_id"] for x in accounts.hints_for(rows, _hints(spark, 300), known).collect()} == {299}


def test_regions_in_one_place_are_read_once(spark):
    rows, known, hints = _row(spark, 200), spark.createDataFrame([], "id long, tenant string, company string, supplier_name string"), _hints(spark, 300)
    assert accounts.hints_met(rows, hints, known, place=regions.PLACE).count() == 400
    words = rows.selectExpr("file_id", "page_no", "1 AS line_no", "concat('INV-', file_id) AS word", "0.1D AS x0", "IF(file_id % 2 = 0, 0.1D, 0.6D) AS y0", "0.2D AS x1", "IF(file_id % 2 = 0, 0.12D, 0.62D) AS y1")
    got = {x["row_id"]: x["invoice_number"] for x in regions.replayed(rows, hints, known, words).collect()}
    assert got == {k: f"INV-{k}" for k in range(200)}


def test_headers_of_the_same_words_are_matched_once(spark):
    headers = spark.range(1000).selectExpr("id", "'alpha beta gamma delta' AS header")
    patterns = spark.createDataFrame([(f"S{k}", ["alpha", "beta", "gamma", f"word{k}"]) for k in range(100)], "supplier_name string, keywords array<string>")
    found = resolution.match_patterns(headers, patterns)
    assert "keys=[id" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1000 and {(x["supplier_name"], x["n"]) for x in found.distinct().collect()} == {("S0", 3)}


def test_masters_of_one_number_make_no_pairs(spark):
    """20,000 suppliers and as many masters have one VAT number; all pairs would be 400 million."""
    n = 20_000
    rows = spark.range(n).selectExpr("'T' AS tenant", "'C' AS company", "concat('a', id) AS supplier_name", "'mt 1' AS supplier_vat")
    masters = spark.range(n).selectExpr("'T' AS tenant", "'C' AS company", "id AS ord", "concat('zz', id) AS canonical", "'MT1' AS vat_number", "id > 6 AS is_active")
    began = time.time()
    found = accounts.match_suppliers(rows, masters)
    assert found.count() == n and [tuple(x) for x in found.select("ord", "tier").distinct().collect()] == [(7, 0)]
    assert time.time() - began < 60


def test_rules_of_one_identity_make_no_pairs(spark):
    """20,000 rules are the same but for their ids; all pairs would be 400 million."""
    n = 20_000
    held = spark.range(n).selectExpr("id", "'T' AS tenant", "'supplier_alias' AS rule_type", "'supplier_name' AS field_name", "IF(id = 5, 'own', 'acme') AS source_pattern", "'Acme' AS target_value")
    began = time.time()
    found = rules.clashes(held, held.select("id", F.lit(None).cast("string").alias("source_pattern"), F.when(F.col("id") == 6, "New").alias("target_value")))
    assert sorted(x["id"] for x in found.where("not clashes").collect()) == [5, 6] and found.count() == n
    assert time.time() - began < 60


def test_stored_rules_are_not_broadcast(spark):
    held = spark.range(2000).selectExpr("'supplier_alias' AS rule_type", "'T' AS tenant", "true AS own", "'C' AS scope", "id", "concat('c', id) AS src", "concat('c', id + 1) AS next", "concat('C', id + 1) AS target_value")
    found = rule_graph.resolved(rule_graph.stored(held, "rules"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {x["result"] for x in found.collect()} == {"C2000"}


def test_edits_after_the_day_are_not_folded(spark):
    """The rows are stored once, and only edits up to the asked one go through the fold."""
    d = "/root/testdata/sf0.001"
    every = record_catalogue._logged(spark, d)[2]
    some = record_catalogue._logged(spark, d, 4)[2]
    assert "row_number" not in some._jdf.queryExecution().optimizedPlan().toString()
    assert some.exceptAll(every.where("seq <= 4")).isEmpty() and some.count() == every.where("seq <= 4").count() > 0


def test_the_rest_of_a_head_is_read_only_where_its_first_lines_leave_it_open(spark, monkeypatch):
    """Looking at a head in steps finds the names that looking at all of it finds; topics are words, not patterns (drink holds ink)."""
    heads = ["Blue Harbour Ltd\nOther Trading Ltd", "plain name\nACME FOODS LTD", "x1\ny2\n12\n13\n14\n15\n16\nACME LTD", "Bill to:\nCasa Ltd\n1\n2\n3\nZeta Services", "Zeta\nHarbour Ltd\nTel: +35621123456", "Acme Ltd\nAcme Ltd Trading\nTel: +35621123456", "", "Total"]
    given = spark.createDataFrame([(h + "\n1 soft drink crate 12.00",) for h in heads], "page_text string")
    stepped = pages.extract(given)
    plan = stepped._jdf.queryExecution().optimizedPlan().toString()
    assert "soft drink|" not in plan and all(f"<= -{most})" in plan or f"> -{most})" in plan for _, most in pages.STEPS[:-1])
    found = {x["page_text"]: x["supplier_name"] for x in stepped.collect()}
    monkeypatch.setattr(pages, "STEPS", [(pages.HEADER, 0)])
    assert found == {x["page_text"]: x["supplier_name"] for x in pages.with_supplier(given).collect()}
    assert {x["description"] for x in stepped.collect()} == {"office supplies and stationery"}


def test_amounts_are_read_once(spark):
    """A raw amount, and the shape of a labelled one, is one search each, however often what it finds is named."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    given = spark.createDataFrame([("EUR 1.234,56",), ("12,50",), ("-",), (None,)], "x string")
    read = given.select("x", money.parse_amount(F.col("x")).alias("v"))
    assert plan(read).count("regexp_replace(") == 1 and [str(r["v"]) for r in read.collect()] == ["1234.56", "12.50", "None", "None"]
    assert "RLIKE(x, " not in plan(pages.with_structured_totals(given, "x")) and "contains" in plan(pages.with_structured_totals(given, "x")).lower()


def test_lines_far_from_a_deposit_label_are_not_looked_at(spark):
    text = "\n".join([f"item {k} 5.00" for k in range(30)] + ["BCRS deposit", "7.20", "Total 40.00"])
    given = spark.createDataFrame([(text,), (text.replace("BCRS deposit", "other"),)], "totals_raw string").selectExpr("totals_raw", "CAST(NULL AS STRING) AS page_text_raw", "CAST(10 AS DECIMAL(14,2)) AS net_amount", "CAST(1.80 AS DECIMAL(14,2)) AS vat_amount", "CAST(19 AS DECIMAL(14,2)) AS total_amount")
    found = deposits.with_deposit(given)
    assert "AS __marked" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(str(r["deposit"]) for r in found.collect()) == ["7.20", "None"]


def test_the_log_of_edits_is_read_and_sorted_once(spark):
    """Rows meet their edits by hash, so that only the fold sorts the log; the log comes from one reading of the rows."""
    sf = "/root/testdata/sf0.001"
    plan = record_catalogue.edit_history(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and plan.count("Union") == 2  # those of the lists
    rows = record_catalogue.made(spark, sf, record_catalogue._UNIQUE).cache()
    one = spark.sql(record_catalogue._LOG, u=rows)
    eight = spark.sql(f"WITH u AS (SELECT * FROM {{u}}) {record_catalogue._SEQ}", u=rows)
    assert one.dtypes == eight.dtypes and one.exceptAll(eight).isEmpty() and eight.exceptAll(one).isEmpty()


def test_values_are_read_as_casts_read_them(spark):
    """What is kept from a cast, as it would throw and catch an exception, is null after it too."""
    numbers = ["1e3", " 7.1 ", "+5", "-.5", "5.", ".", "", "-", "+", "e", "1e", "1e+2", "1E-2", "1e+", "٣", "٣.٥", "1_0", "NaN", "Infinity", "0x10", "5f", "5d", "\t5\n", " 5", "5\u0085", "\x015\x7f", "999999999999.99", "9999999999999", "1e400", "12,5", "1 2", "--5", "1.2.3", "9" * 50_000 + "x", "5.555"]
    dates = ["1999-02-03", "1999-2-3", "1999-02-30", "2000-02-29", "+12345-01-01", "12345-01-01", "-1999-01-01", " 1999-02-03", "1999-02-03 ", "1999-02-03x", "x1999-02-03", "0000-01-01", "٠٠٠١-٠١-٠١", "line", "99-01-01"]
    given = spark.createDataFrame([(x,) for x in [*numbers, *dates, None]], "raw string")
    raw = F.col("raw")
    asked = {"net_amount": raw.try_cast("decimal(14,2)").cast("string"), "invoice_date": F.try_to_date(raw, "yyyy-MM-dd").cast("string"), "description": raw}
    for field, want in asked.items():
        assert [tuple(x) for x in given.select(raw, edit_log._read(F.lit(field), raw), want).collect() if x[1] != x[2]] == []
    assert given.where(edit_log._read(F.lit("net_amount"), raw).isNotNull()).count() > 8 and given.where(edit_log._read(F.lit("invoice_date"), raw).isNotNull()).count() > 1
    sure = given.where(~raw.rlike(edit_log.NUMBER)).select("raw").collect()
    assert {"line", "1999-02-03", "5f"} <= {x["raw"] for x in sure}


def test_partitions_grow_with_the_rows_that_edits_meet_by_hash(spark, monkeypatch):
    """A hash table does not spill: a task hashes no more rows than are set, the fold is the same, and where nobody knows how many rows there
    are nothing must be hashed."""
    sf = "/root/testdata/sf0.001"
    columns = ["row_id", "field", "seq", "action", "old_value", "new_value", "cell", "outcome"]
    want = record_catalogue.edit_history(spark, sf)
    monkeypatch.setattr(edit_log, "HASHED", 300, raising=False)
    found = record_catalogue.edit_history(spark, sf).withColumn("part", F.spark_partition_id()).cache()
    sizes = [x["n"] for x in found.groupBy("part").agg(F.countDistinct("row_id").alias("n")).collect()]
    assert max(sizes) < 400 and len(sizes) > 4
    assert found.select(columns).exceptAll(want).isEmpty() and found.count() == want.count() > 0
    rows, fixes = record_catalogue._inputs(spark, sf)
    log, known, codes = (record_catalogue.made(spark, sf, x) for x in (f"SELECT *, 0L AS seq, 'edit' AS action FROM ({record_catalogue._CHANGES})", record_catalogue._SUPPLIERS, record_catalogue._CODES))
    done = edit_log.folded(rows, fixes, log, known, codes)
    assert "ShuffledHashJoin" not in done._jdf.queryExecution().executedPlan().toString()
    assert done.exceptAll(edit_log.folded(rows, fixes, log, known, codes, rows.count())).isEmpty()


def test_rows_of_a_day_meet_their_edits_in_partitions_that_grow(spark, monkeypatch):
    """The edits are made where their rows are: the log is not moved, and a task has no more rows than are set."""
    sf = "/root/testdata/sf0.001"
    want = record_catalogue.rows_as_of(spark, sf)
    monkeypatch.setattr(edit_log, "HASHED", 300, raising=False)
    done = record_catalogue._logged(spark, sf, 4)[2]
    sizes = [x["n"] for x in done.groupBy(F.spark_partition_id().alias("part")).agg(F.countDistinct("row_id").alias("n")).collect()]
    assert max(sizes) < 400 and len(sizes) > 4
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(row_id") > plan.index("Generate explode")
    found = record_catalogue.rows_as_of(spark, sf)
    assert found.exceptAll(want).isEmpty() and found.count() == want.count() > 0
