from __future__ import annotations

import datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.functions import dates, fields, money, text
from ledgerloom.operators import deposits, pages, resolution, review, state, validation
from ledgerloom.plans import catalogue, page_catalogue, record_catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x != x:
        return "NULL"
    if isinstance(x, bool | str):
        return str(x)
    if isinstance(x, datetime.datetime):
        return str(x.date())
    return str(x) if isinstance(x, datetime.date) else f"{float(x):.9g}"


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


ORACLE_SQL = catalogue.ORACLE_SQL | page_catalogue.ORACLE_SQL | record_catalogue.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    ours = __spark_entry__.queries()[name](spark, SF)
    theirs = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, theirs.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_parse_amount(spark):
    given = {"€ 1,234.50": "1234.50", "1.234,56": "1234.56", "12,50": "12.50", "USD 7": "7.00", "abc": None, "": None}
    found = spark.createDataFrame([(k,) for k in given], "x string").select("x", money.parse_amount(F.col("x"))).collect()
    assert {a: None if b is None else str(b) for a, b in found} == given


@pytest.mark.parametrize(("raw", "date", "ambiguous"), [("2026-02-05", "2026-02-05", False), ("05/02/2026", "2026-02-05", True), ("31.01.26", "2026-01-31", False), ("31/02/2026", None, False), ("01/13/2026", "2026-01-13", False), ("4-4-71", "1971-04-04", False), ("5 February 2026", "2026-02-05", False), ("05-feb-26", "2026-02-05", False), ("31 Feb 2026", None, False), ("", None, False), (None, None, False)])
def test_parse_date(spark, raw, date, ambiguous):
    p = spark.createDataFrame([(raw,)], "x string").select(dates.parse_date(F.col("x")).alias("p")).first()["p"]
    assert (None if p["normalized"] is None else str(p["normalized"]), p["ambiguous"]) == (date, ambiguous)


@pytest.mark.parametrize(("net", "vat", "total", "status"), [("100", "23", "123", "ok"), ("100", "23", "123.05", "ok"), ("100", "0", "100", "ok"), ("100", "23", "124", "ok_with_deposit"), ("200", "46", "246.20", "ok_with_deposit"), ("100", "23", "423.01", "totals_mismatch"), ("100", "23", "120", "ok_with_discount"), (None, None, None, "subtotal_not_found")])
def test_validate(spark, net, vat, total, status):
    given = tuple(None if x is None else Decimal(x) for x in (net, vat, total))
    row = validation.validate(spark.createDataFrame([given], "net_amount decimal(14,2), vat_amount decimal(14,2), total_amount decimal(14,2)")).first()
    assert row["status"] == status
    assert (status == "ok") == (row["reasons"] == []) or status == "ok_with_discount"


def test_review_decision(spark):
    given = [(1, ["low_confidence", "no_supplier", "no_amount", "low_confidence:x"]), (2, ["page_quality_low"]), (3, ["vat_missing"]), (4, []), (5, ["what_is_this"])]
    found = {r["id"]: r for r in review.decide(spark.createDataFrame(given, "id int, reasons array<string>")).collect()}
    assert found[1]["review_reasons"] == ["no_supplier", "no_amount", "low_confidence"] and found[1]["validation_status"] == "review_incomplete"
    assert found[1]["review_fields"] == ["supplier_name", "total_amount", "confidence_score"] and found[1]["review_required"]
    assert (found[2]["auto_approved"], found[2]["review_priority"]) == (True, "low")
    assert (found[3]["validation_status"], found[3]["auto_approved"]) == ("ok_warned", False)
    assert (found[4]["validation_status"], found[4]["review_priority"], found[4]["auto_approved"]) == ("ok", None, False)
    assert found[5]["review_priority"] == "low"


def test_overlay_null_is_no_correction(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, code string")
    fixes = spark.createDataFrame([(1, "A", None)], "id int, name string, code string")
    assert sorted(map(tuple, state.overlay(base, fixes, ["id"], ["name", "code"]).collect())) == [(1, "A", "x", True), (2, "b", "y", False)]


def test_patterns_need_three_words_and_half(spark):
    patterns = spark.createDataFrame([("s", ["alpha", "bravo", "charlie", "delta"])], "supplier_name string, keywords array<string>")
    headers = spark.createDataFrame([(1, "Alpha bravo CHARLIE"), (2, "alpha bravo")], "id int, header string")
    assert [tuple(r) for r in resolution.match_patterns(headers, patterns).collect()] == [(1, "s", 3)]


def test_texts(spark):
    row = spark.createDataFrame([(" a\t\tb\0c\n\n\n\nd ", "Acme (Malta) Co. Ltd", "a|b, c", "a, b")], "t string, n string, f string, g string").select(text.clean_text(F.col("t")), text.supplier_key(F.col("n")), text.split_fields(F.col("f")), text.split_fields(F.col("g"))).first()
    assert tuple(row) == ("a b c\n\nd", "acme malta", ["a", "b, c"], ["a", "b"])


@pytest.mark.parametrize(
    ("totals", "net", "vat", "total", "deposit"),
    [
        ("Net 132.00\nVAT 23.76\nBCRS 14.40\nTotal 170.16", "132.00", "23.76", "170.16", "14.40"),
        ("Total excl VAT 61.80\nVAT 11.12\nBCRS 7.20\nTotal incl VAT & BCRS 80.12", "61.80", "11.12", "80.12", "7.20"),
        ("Total Net 77.52\nVAT 10.40\nBCRS Refundable Deposit 10.80\nInvoice Total 98.72", "77.52", "10.40", "98.72", "10.80"),
        ("Deposit Summary\nDeposits 9.60\nDeposit 9.60\nInvoice Total 109.60", "100.00", None, "109.60", "9.60"),
        ("Net 100.00\nVAT 18% 18.00\nTotal 118.00", "100.00", "18.00", "118.00", None),
        ("Net 100.00\nVAT 7.20\nBCRS 7.20\nTotal 107.20", "100.00", "7.20", "107.20", None),
        ("Qty Description deposit 2.40", None, None, None, None),
        ("", None, None, None, None), (None, None, None, None, None),
    ],
)
def test_deposit(spark, totals, net, vat, total, deposit):
    rows = spark.createDataFrame([(totals, None, net, vat, total)], "totals_raw string, page_text_raw string, net_amount string, vat_amount string, total_amount string").withColumns({c: F.col(c).cast("decimal(14,2)") for c in ("net_amount", "vat_amount", "total_amount")})
    assert deposits.with_deposit(rows).first()["deposit"] == (None if deposit is None else Decimal(deposit))


def test_structured_page(spark):
    page = "Tax Analysis\nVAT 18%   18.00\nTotal   118.00\nInvoice Summary\nGross Value   130.00\nInvoice Total: 127.60\nDeposit Summary\nDeposits   9.60"
    given = spark.createDataFrame([(1, page), (2, page.replace("127.60", "190.00")), (3, "Total 5.00"), (4, None), (5, "")], "id int, page_text string")
    found = {r["id"]: r["structured"] and [str(x) for x in r["structured"]] for r in pages.with_structured_totals(given).collect()}
    assert found == {1: ["100.00", "18.00", "127.60", "9.60"], 2: None, 3: None, 4: None, 5: None}


def test_supplier(spark):
    given = {
        "Apple Cores\nFOODS\nTel: 21345678\nInvoice No 77": "Apple Cores FOODS",  # two short lines make one name
        "NAAR LTD\nAccount Name: NAAR LTD\nBig Valley Catering Supplies\nTel: 21345678": "Big Valley Catering Supplies",  # the buyer never
        "Bill to:\nSome Buyer Ltd\n1 Road\nTown\nX\nRed Barn Trading\nMT1234567": "Red Barn Trading",
        "Invoice\nTotal 5.00": None, "": None,
    }
    found = pages.with_supplier(spark.createDataFrame([(k,) for k in given], "page_text string")).collect()
    assert {r["page_text"]: r["supplier_name"] for r in found} == given


def test_pages_without_text(spark):
    given = spark.createDataFrame([(1, None), (2, ""), (3, "Total Nonsense")], "id int, page_text string")
    found = pages.extract(given).collect()
    assert [(r["supplier_name"], r["invoice_number"], r["total_amount"], r["description"]) for r in found] == [(None, None, None, pages.NO_TOPIC)] * 3
    assert pages.line_rows(pages.extract(given)).count() == 3
    assert pages.extract(given.where("false")).count() == 0


def test_amounts(spark):
    found = spark.sql("SELECT 'a 1.234,56 b 12,50 c 7.20 d 1,000.00' AS x").select(fields.amounts(F.col("x")).alias("v")).first()["v"]
    assert [str(v) for v in found] == ["1234.56", "1250.00", "7.20", "1000.00"]
