"""Suppliers, accounts, rules, edits and pages: cases that the whole-table queries do not meet."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import accounts, analytics, edits, listing, matching, merging, review, rules, state
from ledgerloom.sources import exports, uploads


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_names_meet_on_any_part(spark):
    names = [("a",), ("ab",), ("acme",), ("the acme works",), ("",), ("zeta",)]
    masters = [("acme",), ("acmebank",), ("b",), ("",), ("acme works",)]
    found = matching.within(spark.createDataFrame(names, "a string"), spark.createDataFrame(masters, "b string"), [])
    assert {tuple(r) for r in found.collect()} == {(a, b) for a, in names for b, in masters if a and b and a in b}


def test_words_meet_on_rare_ones(spark):
    import itertools

    words = ["north", "south", "trade", "wine", "fish"]
    sets = [list(c) for n in (1, 2, 3, 4) for c in itertools.combinations(words, n)]
    rows = [(str(k), s) for k, s in enumerate(sets)]
    for least in (0.5, 0.6, 1.0):
        found = matching.sharing(spark.createDataFrame(rows, "a string, wa array<string>"), spark.createDataFrame(rows, "b string, wb array<string>"), [], least)
        want = {(a, b) for a, x in rows for b, y in rows if len({*x} & {*y}) / max(len(x), len(y)) >= least}
        assert {(r["a"], r["b"]) for r in found.collect()} == want


def test_review_without_reasons(spark):
    rows = spark.createDataFrame([(1, []), (2, None), (3, ["page_quality_low"]), (4, ["no_amount", "no_supplier"]), (5, ["new_kind", "page_quality_low", "new_kind:2"])], "id int, reasons array<string>")
    found = {r["id"]: r for r in review.decide(rows).collect()}
    assert [(found[k]["validation_status"], found[k]["review_priority"], found[k]["auto_approved"]) for k in range(1, 6)] == [("ok", None, False), ("ok", None, False), ("ok", "low", True), ("review_incomplete", "high", False), ("ok", "low", False)]
    assert found[4]["review_reasons"] == ["no_amount", "no_supplier"] and found[4]["review_fields"] == ["total_amount", "supplier_name"]
    assert found[5]["review_reasons"] == ["page_quality_low", "new_kind"]


def test_rules_keep_to_their_field_and_tenant(spark):
    schema = "id long, tenant string, company string, rule_type string, field_name string, source_pattern string, target_value string, active boolean"
    held = [(1, "T", None, "supplier_alias", "supplier_name", "Acme Ltd", "Borg", True), (2, "T", "C", "supplier_alias", "supplier_name", "borg", "Calleja", True), (3, "U", None, "supplier_alias", "supplier_name", "Calleja", "Wrong", True), (4, "T", None, "remap_field_value", "invoice_number", "Calleja", "INV-1", True), (5, "T", None, "text_correction", "description", "Calleja", "Right", True), (6, "T", None, "supplier_alias", "supplier_name", "Acme", "Off", False)]
    rows = [("T", "C", "ACME", None, None, "calleja", None, False, Decimal("0.90")), ("T", "D", "Acme Ltd", None, "7", "calleja", "description", False, None), ("T", None, None, "x", None, None, None, False, None)]
    columns = "tenant string, company string, supplier_name string, nominal_account_code string, invoice_number string, description string, review_fields string, review_required boolean, confidence_score decimal(5,2)"
    found = [(r["supplier_name"], r["invoice_number"], r["description"]) for r in rules.replay(spark.createDataFrame(rows, columns), spark.createDataFrame(held, schema)).collect()]
    # The company's own rule follows the global one; a trusted description stays; a region's stored example is never written.
    assert sorted(found, key=str) == sorted([("Calleja", None, "calleja"), ("Borg", "7", "calleja"), (None, None, None)], key=str)


def test_transforms_leave_what_they_cannot_read(spark):
    for rule, given, want in [("number_format", "12 pcs", "12 pcs"), ("number_format", "12345678.5", "12345678.5"), ("number_format", "12", "12.0"), ("date_format:%d/%m/%Y", "2024-03-05", "05/03/2024"), ("date_format:%Y", "31/12/2023", "2023"), ("date_format:%m", "12/31/2023", "12"), ("date_format:%d", "soon", "soon"), ("date_format:%d", None, None), ("what", "x", "x")]:
        assert one(spark, state.transformed(F.col("x"), rule), given) == want, rule
    assert one(spark, state.transformed(F.col("x"), "date_format:%d %b %y"), datetime.date(2024, 3, 5), "date") == "05 Mar 24"


def test_suppliers_as_read(spark):
    for given, want in {"5\nJ.Sultana\nBeverages": "J.Sultana Beverages", "jbl\nJoseph Borg Ltd.": "Joseph Borg Ltd.", "Br Supply Co. Br Supply Co": "Br Supply Co", "": "", "5 A": None, None: None}.items():
        assert one(spark, merging.read_supplier(F.col("x")), given) == want
    assert one(spark, text.clean_supplier(F.col("x")), "| 3 Acme@ Ltd. 12\n") == "Acme Ltd"
    assert one(spark, text.core_words(F.col("x")), "The Acme Co of Malta Foods") == ["acme", "foods"]


def test_numbers_in_heads(spark):
    for page, want in {"Invoice No.: A-17": "A-17", "Invoice Number\n\n12345": "12345", "VAT Number MT12345678": None, "Ref: see\nDate\n12": None, "Invoice no 2024\nTotal 5": None, "Doc No 77/B": "77/B", None: None, "\n" * 45 + "Invoice No 12": None, "Tel number 99123456": None}.items():
        assert one(spark, merging.invoice_number(F.col("x")), page) == want, page


def test_edits(spark):
    rows = spark.createDataFrame([(1, "T", "C", "in_review", "Acme", Decimal("10.00")), (2, "T", "C", "exported", "Acme", None), (3, "T", "X", None, "Acme", None)], "row_id long, tenant string, company string, status string, supplier_name string, net_amount decimal(14,2)")
    none = spark.createDataFrame([], "row_id long, supplier_name string, net_amount decimal(14,2), reviewed_fields string")
    asked = spark.createDataFrame([(1, "supplier_name", "Nobody"), (1, "net_amount", "10"), (1, "id", "5"), (2, "net_amount", "1"), (3, "supplier_name", "Anybody"), (9, "net_amount", "1"), (1, "tenant", "U")], "row_id long, field string, value string")
    known, codes = spark.createDataFrame([("T", "C", "Acme")], "tenant string, company string, supplier_name string"), spark.createDataFrame([], "tenant string, company string, account_code string")
    done = edits.checked(rows, none, asked, known, codes)
    found = {(r["row_id"], r["field"]): r["outcome"] for r in done.collect()}
    assert found[1, "supplier_name"] == "rejected: not in the master list" and found[1, "net_amount"] == "unchanged" and found[2, "net_amount"] == "rejected: exported" and found[9, "net_amount"] == "ignored" and found[1, "id"] == "ignored"
    assert found[3, "supplier_name"] == "applied"  # no list is kept there, and no status is as good as scanned
    fixed = edits.corrected(none, done)
    assert [(r["row_id"], r["supplier_name"]) for r in fixed.collect()] == [(3, "Anybody")]
    left, seen = edits.reverted(fixed, spark.createDataFrame([(3, "supplier_name"), (3, "net_amount")], "row_id long, field string"))
    assert left.first()["supplier_name"] is None and [(r["field_name"], r["old_value"]) for r in seen.collect()] == [("supplier_name", "Anybody")]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"text")
    (tmp_path / "c.pdf").write_bytes(b"%PDF" + b"0" * 100)
    found = {r["file_name"]: r["status"] for r in uploads.pdf_files(spark, str(tmp_path), 50).collect()}
    assert found == {"a.pdf": "accepted", "b.pdf": "rejected: no PDF", "c.pdf": "rejected: too large"}
    needs, kept = uploads.better_text()
    pages = spark.createDataFrame([("x" * 80, "y" * 99), ("short", "longer one"), ("short", None), (None, "z")], "native_text string, ocr_text string")
    assert [tuple(r) for r in pages.select(needs.alias("n"), kept.alias("k")).collect()] == [(False, "x" * 80), (True, "longer one"), (True, "short"), (True, "z")]


def test_small_ones(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Old"), (2, "Old")], "row_id long, supplier_name string")
    assert {r["row_id"]: r["supplier_name"] for r in accounts.prefilled(rows, spark.createDataFrame([(2, "New", 3)], "id long, supplier_name string, n long")).collect()} == {1: "Old", 2: "New"}
    assert one(spark, text.json_block(F.col("x")), 'so: {"a": {"b": 1}} ok') == '{"a": {"b": 1}}' and one(spark, text.json_block(F.col("x")), "none") == "none"
    assert one(spark, text.cell(F.col("x"), "boolean"), True, "boolean") == "Yes"
    taken = listing.taken(spark.createDataFrame([("Acme",)], "code string"), spark.createDataFrame([(" ACME",), ("b",)], "code string"), "code")
    assert {r["code"]: r["taken"] for r in taken.collect()} == {" ACME": True, "b": False}
    progress = analytics.batch_progress(spark.createDataFrame([(1, 3), (2, None), (3, 9)], "batch_id long, page_count int"), spark.createDataFrame([(1, "partial", 5), (1, "failed", None), (3, "processed", 8)], "batch_id long, status string, page_count int"))
    assert {r["batch_id"]: (r["processed_files"], r["failed_files"], r["percent"]) for r in progress.collect()} == {1: (1, 1, 60), 2: (0, 0, 0), 3: (1, 0, 100)}
    held = analytics.capacity(spark.createDataFrame([("T",), ("U",)], "tenant string"), files=spark.createDataFrame([("T", 1_572_864)], "tenant string, file_size_bytes long"))
    assert {r["tenant"]: (r["files"], r["storage_mb"]) for r in held.collect()} == {"T": (1, 1.5), "U": (0, 0.0)}
    sheet = spark.createDataFrame([("s", True, Decimal("1.00"))], "supplier_name string, review_required boolean, net_amount decimal(14,2)").withColumns({"source_filename": F.lit("f"), "vat_amount": F.col("net_amount"), "total_amount": F.col("net_amount"), "confidence_score": F.lit(None).cast("double")})
    paths = exports.write(sheet, str(tmp_path), 3, template=[{"column_order": 1, "column_heading": "who", "column_type": "mapped", "source_field": "supplier_name"}])
    assert spark.read.parquet(paths["template"]).first()["who"] == "s"
    event = exports.export_event(spark.createDataFrame([], "batch_id long, version long, row_count long"), 7, 3, sheet)
    assert [tuple(r) for r in event.collect()] == [(7, 3, 1)]
