"""The fact's layout and the workbooks: plans, and what is read back."""

from __future__ import annotations

import random
import uuid
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import exports, facts, workbook

MAIN = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def read_back(path):
    """{sheet name: lines of values}, numbers as floats, missing cells as None."""
    with zipfile.ZipFile(path) as pack:
        assert pack.testzip() is None
        names = [x.get("name") for x in ElementTree.fromstring(pack.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", MAIN)]
        for part in ("[Content_Types].xml", "_rels/.rels", "xl/_rels/workbook.xml.rels"):
            ElementTree.fromstring(pack.read(part))
        out = {}
        for k, name in enumerate(names, 1):
            out[name] = []
            for row in ElementTree.fromstring(pack.read(f"xl/worksheets/sheet{k}.xml")).iterfind("m:sheetData/m:row", MAIN):
                cells = {}
                for c in row.iterfind("m:c", MAIN):
                    at = c.get("r").rstrip("0123456789")
                    assert c.get("r")[len(at) :] == row.get("r")
                    cells[at] = float(c.find("m:v", MAIN).text) if c.get("t") is None else "".join(c.itertext())
                out[name].append([cells.get(workbook.letters(j)) for j in range(max((k for k in range(60) if workbook.letters(k) in cells), default=-1) + 1)])
        return out


def test_letters_of_columns():
    assert [workbook.letters(k) for k in (0, 25, 26, 27, 701, 702)] == ["A", "Z", "AA", "AB", "ZZ", "AAA"]


def test_workbooks_read_back_equal(spark, tmp_path):
    r = random.Random(1)
    said = ["plain", "a < b & \"c\"", "  spaces ", "line\nend", "é 日本 🙂", "", None, "bell\x07", "x" * 40_000]
    rows = [(r.choice("ABC"), k, r.choice(said), r.choice([None, 1.5, -2.25, float("inf")]), r.choice([True, False, None])) for k in range(60)]
    one = spark.createDataFrame(rows, "batch string, id long, words string, amount double, flag boolean").repartition(5)
    workbook.write(spark, {"All rows": one, "Only/A?": one.where("batch = 'A'"), "Sums": one.groupBy("batch").agg(F.count("*").alias("n"))}, str(tmp_path), "batch", ["id"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["A.xlsx", "B.xlsx", "C.xlsx"]
    clean = lambda t: None if t is None else t.replace("\x07", "")[:32_767]
    for b in "ABC":
        book = read_back(tmp_path / f"{b}.xlsx")
        assert list(book) == ["All rows", "Only_A_", "Sums"]
        want = [[float(k), clean(t), a if a != float("inf") else None, {True: "Yes", False: "No", None: None}[f]] for x, k, t, a, f in rows if x == b]
        got = [x + [None] * (4 - len(x)) for x in book["All rows"][1:]]
        assert got == want and book["All rows"][0] == ["id", "words", "amount", "flag"]
        assert book["Sums"] == [["n"], [float(len(want))]] and len(book["Only_A_"]) == (len(want) + 1 if b == "A" else 1)


def test_full_sheets_go_on_in_another(spark, tmp_path):
    rows = spark.range(25).select(F.lit("one").alias("b"), "id")
    workbook.write(spark, {"S" * 40: rows, "T": rows.limit(0)}, str(tmp_path), "b", ["id"], most=11)
    book = read_back(tmp_path / "one.xlsx")
    assert [len(x) for x in book.values()] == [11, 11, 6, 1] and len({x.lower() for x in book}) == 4 and max(map(len, book)) <= 31
    assert [x[0] for y in list(book.values())[:3] for x in y[1:]] == list(range(25))


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    fails = F.udf(lambda k: 1 // (k - 37), "long")
    rows = spark.range(60).select((F.col("id") % 4).alias("b"), fails("id").alias("x"), "id")
    with pytest.raises(Exception, match="ZeroDivisionError|division"):
        workbook.write(spark, {"S": rows}, str(tmp_path), "b", ["id"])
    assert not list(tmp_path.iterdir())


def test_rerun_replaces_workbooks(spark, tmp_path):
    for n in (3, 5):
        workbook.write(spark, {"S": spark.range(n).select(F.lit("x").alias("b"), "id")}, str(tmp_path), "b")
    assert [len(read_back(p)["S"]) for p in tmp_path.iterdir()] == [6]


def test_export_workbooks(spark, tmp_path):
    rows = spark.createDataFrame([("B1", "a.pdf", 1, "Acme", "10.00", "0.90", True), ("B1", "b.pdf", 1, "Beta", "5.00", None, False), ("B2", "a.pdf", 2, None, None, "0.50", False)], "batch string, source_filename string, page_no int, supplier_name string, total_amount string, confidence_score string, review_required boolean")
    rows = rows.withColumns({"total_amount": F.col("total_amount").cast("decimal(14,2)"), "confidence_score": F.col("confidence_score").cast("decimal(5,2)"), "net_amount": F.lit(None).cast("decimal(14,2)"), "vat_amount": F.lit(None).cast("decimal(14,2)")})
    where = exports.write_workbooks(rows, str(tmp_path), 3, "batch")
    assert where.endswith("version=3")
    one, two = (read_back(f"{where}/{b}.xlsx") for b in ("B1", "B2"))
    assert list(one) == ["Invoices", "Needs Review", "Summary", "Evidence"] and len(one["Invoices"]) == 3 and len(one["Needs Review"]) == 2 and len(two["Needs Review"]) == 1
    head = one["Summary"][0]
    assert dict(zip(head, one["Summary"][1]))["uploaded_files"] == "a.pdf, b.pdf" and dict(zip(head, two["Summary"][1]))["total_rows"] == 1.0
    paths = exports.write(rows, str(tmp_path / "p"), 1, by=["batch"])
    assert {x["batch"]: x["uploaded_files"] for x in spark.read.parquet(paths["summary"]).collect()} == {"B1": "a.pdf, b.pdf", "B2": "a.pdf"}


def test_fact_is_pruned_by_scope(spark):
    rows = spark.range(4000).selectExpr("concat('T', id % 3) AS tenant", "concat('C', id % 7) AS company", "id % 50 AS batch_id", "CAST(id AS DECIMAL(14,2)) AS total_amount")
    name = facts.store(rows)
    table = spark.table(name)
    assert sorted(map(tuple, table.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    scopes = spark.createDataFrame([("T1", "C1", 1), ("T1", "C4", 1), ("T2", "C0", 9)], "tenant string, company string, k int").where("k < 5")
    found = facts.scoped(spark, name, scopes)
    assert found.count() == rows.where("tenant = 'T1' and company in ('C1', 'C4')").count()
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    fixed = table.where("tenant = 'T1' and company = 'C1'")
    assert "PartitionFilters: [isnotnull(tenant" in fixed._jdf.queryExecution().executedPlan().toString()
    by_batch = fixed.groupBy("batch_id").agg(F.sum("total_amount").alias("s"))
    assert "Exchange" not in by_batch._jdf.queryExecution().executedPlan().toString() and by_batch.count() == 50
    facts.replace(rows.where("tenant = 'T1' and company = 'C1'").withColumn("total_amount", F.lit(1).cast("decimal(14,2)")), name)
    assert fixed.agg(F.sum("total_amount")).first()[0] == rows.where("tenant = 'T1' and company = 'C1'").count()
    assert spark.table(name).count() == 4000
    spark.sql(f"DROP TABLE {name}")
    assert uuid.UUID(name.removeprefix("invoice_rows_"))


def test_uploads_cost_four_bytes(spark, tmp_path):
    import hashlib

    from ledgerloom.sources import uploads

    for name, head, size in (("big.pdf", b"%PDF", 3 << 30), ("other.bin", b"PK\x03\x04", 3 << 30), ("small.pdf", b"%PDF-1.7 text", 13), ("empty.pdf", b"", 0), (".part", b"%PDF", 4)):
        with (tmp_path / name).open("wb") as out:
            out.write(head)
            out.truncate(size)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "huge.pdf").open("wb").truncate(5 << 30)
    found = {r["file_name"]: (r["length"], r["status"], r["sha256"]) for r in uploads.pdf_files(spark, str(tmp_path), 4 << 30).collect()}
    assert found == {"big.pdf": (3 << 30, "accepted", None), "other.bin": (3 << 30, "rejected: no PDF", None), "small.pdf": (13, "accepted", None), "empty.pdf": (0, "rejected: no PDF", None), "huge.pdf": (5 << 30, "rejected: too large", None)}
    one = uploads.pdf_files(spark, str(tmp_path), 100, digest=True).where("sha256 is not null").collect()
    assert [(r["file_name"], r["sha256"]) for r in one] == [("small.pdf", hashlib.sha256(b"%PDF-1.7 text").hexdigest())]
    assert uploads.pdf_files(spark, str(tmp_path / "sub"), 10).count() == 1
