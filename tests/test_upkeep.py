"""Listings in pages, commands over master data and regions, against doing them one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import edits, listing, master_data, regions, resolution


def test_listings_in_pages(spark):
    r = random.Random(8)
    data = [(k, r.choice([None, 1, 2, 3]), r.choice([None, "a", "b"])) for k in range(130)]
    rows = spark.createDataFrame(data, "id long, n int, s string").repartition(5)
    order = [("n", "desc"), ("s", "asc"), ("id", "desc")]
    want = sorted(data, key=lambda x: (x[1] is None, -(x[1] or 0), x[2] is not None, x[2] or "", -x[0]))
    got = {x["id"]: x["page"] for x in listing.numbered(rows, order, 20).collect()}
    assert got == {x[0]: k // 20 for k, x in enumerate(want)}
    seen, last = [], None
    while page := [x.asDict() for x in listing.following(rows, order, last, 20).collect()]:
        seen += page
        last = page[-1]
    assert [x["id"] for x in seen] == [x[0] for x in want]
    assert "Window" not in listing.following(rows, order, last, 20)._jdf.queryExecution().executedPlan().toString()
    assert listing.numbered(rows.limit(0), order).isEmpty() and listing.following(rows.limit(0), order).isEmpty()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_commands_that_want_the_same_keys(spark, seed):
    r = random.Random(seed)
    held = [(f"n{k}", f"c{k}") for k in range(0, 9, 4)]
    asked = [(k, r.choice([f"N{r.randint(0, 30)}", f" n{r.randint(0, 30)} ", ""]), r.choice([None, f"c{r.randint(0, 30)}"])) for k in range(80)]
    norm = lambda x: (x or "").strip().lower()
    names, codes, want = {norm(x) for x, _ in held}, {norm(x) for _, x in held}, {}
    old = names | set(), codes | set()
    for k, n, c in asked:
        if norm(n) and norm(n) in old[0] or norm(c) and norm(c) in old[1]:
            want[k] = "taken"
        elif norm(n) and norm(n) in names or norm(c) and norm(c) in codes:
            want[k] = "taken in the batch"
        else:
            want[k] = "admitted"
            names |= {norm(n)} - {""}
            codes |= {norm(c)} - {""}
    found = master_data.admitted(spark.createDataFrame(asked, "seq long, name string, code string"), [master_data.key_of("name"), master_data.key_of("code")], spark.createDataFrame(held, "name string, code string"))
    assert {x["seq"]: x["outcome"] for x in found.collect()} == want


def test_users_with_links(spark):
    asked = spark.createDataFrame([(1, "A@x.y", "admin", ["1", "2"]), (2, "a@x.y ", "admin", ["1"]), (3, "b@x.y", "king", ["1"]), (4, "c@x.y", "admin", ["1", "9"]), (5, "d@x.y", None, None), (6, " ", "admin", []), (7, "old@x.y", "admin", ["2", "2"])], "seq long, email string, role string, tenants array<string>")
    table = spark.createDataFrame([("OLD@x.y", "admin")], "email string, role string")
    told, after = master_data.created(table, asked, [master_data.key_of("email")], ("email",), {"role": ["admin", "user"]}, "tenants", spark.createDataFrame([("1",), ("2",)], "id string"))
    assert {x["seq"]: x["outcome"].split(":")[0] for x in told.collect()} == {1: "admitted", 2: "taken in the batch", 3: "rejected", 4: "rejected", 5: "admitted", 6: "rejected", 7: "taken"}
    assert sorted(str(x["email"]) for x in after.collect()) == ["A@x.y", "OLD@x.y", "d@x.y"]
    both = master_data.mirrored(spark.createDataFrame([("a", ""), (None, "b"), (" ", None), ("c", "d")], "supplier_account_code string, posting_account string"))
    assert [tuple(x) for x in both.collect()] == [("a", "a"), ("b", "b"), (None, None), ("c", "d")]


def test_words_in_rectangles(spark):
    r = random.Random(5)
    words = [(f, p, r.randint(1, 5), f"w{k}", x, y, x + 0.03, y + 0.01) for k in range(300) for f, p, x, y in [(r.randint(1, 2), r.randint(1, 2), r.random(), r.random())]]
    asked = [(k, r.randint(1, 3), r.randint(1, 2), *(r.random() for _ in range(4))) for k in range(60)] + [(90, 1, 1, 0.0, 0.0, 1.0, 1.0), (91, 1, 1, None, 0.0, 1.0, 1.0), (92, 1, 1, 0.5, 0.5, 0.0, 0.0)]
    found = regions.region_text(spark.createDataFrame(asked, "region_id long, file_id int, page_no int, x double, y double, w double, h double"), spark.createDataFrame(words, "file_id int, page_no int, line_no int, word string, x0 double, y0 double, x1 double, y1 double"))
    got = {x["region_id"]: x["read_text"] for x in found.collect()}
    for k, f, p, x, y, w, h in asked:
        inside = sorted((line, x0, word) for a, b, line, word, x0, y0, x1, y1 in words if (a, b) == (f, p) and x is not None and x <= (x0 + x1) / 2 <= x + w and y <= (y0 + y1) / 2 <= y + h)
        assert got[k] == (" ".join(t[2] for t in inside) or None)


def test_rules_wanted_by_remaps(spark):
    rows = spark.createDataFrame([(1, "T", "C", "Acme Ltd"), (2, "T", "C", None)], "row_id long, tenant string, company string, supplier_name string")
    done = spark.createDataFrame([(1, "description", "x y", "applied"), (1, "invoice_number", "7", "unchanged"), (1, "invoice_date", None, "no text"), (2, "description", "z", "applied")], "row_id long, field string, read_text string, outcome string")
    assert sorted((x["field_name"], x["source_pattern"], x["target_value"], x["rule_type"]) for x in regions.wanted_rules(rows, done).collect()) == [("description", "acme", "x y", "remap_field_value"), ("invoice_number", "acme", "7", "remap_field_value")]
    assert [x["field_name"] for x in regions.audit(done.withColumns({"old_value": F.lit(None), "new_value": F.col("read_text")})).collect()] == ["description", "description"]


def test_patterns_of_inactive_suppliers(spark):
    headers = spark.createDataFrame([(1, "alpha beta gamma delta")], "id long, header string")
    patterns = spark.createDataFrame([("Old", ["alpha", "beta", "gamma", "delta"], False), ("New", ["alpha", "beta", "gamma", "other"], True)], "supplier_name string, keywords array<string>, is_active boolean")
    assert resolution.match_patterns(headers, patterns).first()["supplier_name"] == "New"


def test_rows_made_by_a_manual_split(spark):
    rows = spark.createDataFrame([(5, "T", "Beer", "10.00", "0.00", "12.00", "azure", "high", "total_amount", True)], "row_id long, tenant string, description string, net_amount string, vat_amount string, total_amount string, method_used string, review_priority string, review_fields string, review_required boolean")
    rows = rows.withColumns({c: F.col(c).cast("decimal(14,2)") for c in ("net_amount", "vat_amount", "total_amount")})
    fixes = spark.createDataFrame([], "row_id long, total_amount decimal(14,2), reviewed_fields string")
    done = edits.split_applied(rows, fixes, spark.createDataFrame([(5, 1.5)], "row_id long, amount double"))
    made, kept = done["made"].first(), done["rows"].first()
    assert (made["row_id"], made["method_used"], made["validation_status"], made["line_items_raw"], made["review_priority"], made["review_fields"], made["description"]) == (6, "azure+bcrs_manual", "manual", "BCRS surcharge", None, None, "Beer - BCRS")
    assert (str(kept["total_amount"]), kept["review_required"], kept["review_priority"]) == ("10.50", False, None)
    assert [(x["row_id"], str(x["total_amount"]), x["reviewed_fields"]) for x in done["corrections"].collect()] == [(5, "10.50", "total_amount")]
    assert {(x["row_id"], x["action"]) for x in done["audit"].collect()} == {(5, "bcrs_split_source"), (6, "bcrs_split_created")}
