from __future__ import annotations

import datetime

from ledgerloom.operators import state
from ledgerloom.sources import exports, masters
from ledgerloom.streaming import ingest


def test_master_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes('﻿Vendor_Name,Posting-Account,Other\r\n" Acme ""Ltd""",S1,x\r\n,S2,y\r\nBeta,s1,z\r\n'.encode())
    found = masters.read_csv(spark, str(tmp_path / "s.csv"), masters.SUPPLIER)
    assert [tuple(r)[:3] for r in found.orderBy("ord").collect()] == [("S1", 'Acme "Ltd"', ""), ("S2", "", ""), ("s1", "Beta", "")]
    dim = spark.createDataFrame([("S1", "Old"), ("S9", "Kept")], "code string, name string")
    staged = found.selectExpr("supplier_account_code AS code", "supplier_name AS name", "ord")
    assert sorted(tuple(r) for r in state.upsert(dim, staged, "code", "ord").collect()) == [("S1", 'Acme "Ltd"', "updated"), ("S9", "Kept", "kept")]


def test_export_columns():
    assert exports.export_columns(["id", "extra", "total_amount", "page_no"]) == ["page_no", "total_amount", "extra"]


def test_export_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a.pdf", 1, "10.00", None, True), ("", 2, None, "0.5", False)], "source_filename string, page_no int, total_amount string, confidence_score string, review_required boolean")
    rows = rows.selectExpr("*", "CAST(NULL AS DECIMAL(14,2)) AS net_amount", "CAST(NULL AS DECIMAL(14,2)) AS vat_amount").selectExpr("* EXCEPT (total_amount, confidence_score)", "CAST(total_amount AS DECIMAL(14,2)) AS total_amount", "CAST(confidence_score AS DECIMAL(5,2)) AS confidence_score")
    paths = exports.write(rows, str(tmp_path), 2)
    assert spark.read.parquet(paths["invoices"]).count() == 2 and spark.read.parquet(paths["needs_review"]).count() == 1
    one = spark.read.parquet(paths["summary"]).first()
    assert (one["uploaded_files"], one["total_rows"], one["sum_total_amount"], one["avg_confidence"], one["distinct_source_files"]) == ("a.pdf", 2, 10.0, 0.25, 1)


def test_pages_as_they_arrive(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    at = datetime.datetime(2026, 1, 1)
    put = lambda rows: spark.createDataFrame(rows, ingest.PAGE).write.mode("append").parquet(source)
    for rows in ([(1, 1, "Invoice No: 771\nTotal: 5.00", at), (2, 1, None, at)], [(1, 1, "Invoice No: 771\nTotal: 5.00", at), (3, 1, "Invoice No: 772\nTotal: 6.00", at)]):
        put(rows)
        ingest.extract_to(ingest.page_stream(spark, source), target, checkpoint).awaitTermination(120)
    found = spark.read.parquet(target)
    assert sorted((r["file_id"], r["invoice_number"], str(r["total_amount"])) for r in found.collect()) == [(1, "771", "5.00"), (2, None, "None"), (3, "772", "6.00")]
