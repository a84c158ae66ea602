"""Best masters from posting lists against comparing everything, and ordered edits."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from ledgerloom.operators import accounts, edit_log, matching


def brute(names, masters, least, contained):
    """names: [(scope, name, key, words)], masters: [(scope, ord, key, words)]."""
    out = {}
    for scope, name, a, wa in names:
        best = None
        for s, ord_, b, wb in masters:
            if s != scope:
                continue
            score = contained if a and b and (a in b or b in a) else len(set(wa) & set(wb)) / max(len(wa), len(wb)) if wa and wb else 0
            if score >= least and (best is None or (-score, ord_) < best):
                best = (-score, ord_)
        if best:
            out[scope, name] = (best[1], -best[0])
    return out


def test_best_masters(spark):
    r = random.Random(2)
    vocab = ["hotel", "malta", "st", "a", "blue", "lagoon", "bay", "caterers", "foods", "wine", "and", "co", "x"]
    name = lambda: " ".join(r.sample(vocab, r.choice([0, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9])))
    drop = {"and", "a"}
    row = lambda s, k, n: (s, k, n, sorted(set(n.split()) - drop))
    names = [row(r.choice("AB"), f"n{k} {n}", n) for k, n in enumerate(name() for _ in range(250))]
    masters = [row(r.choice("AB"), k, name()) for k in range(200)]
    for least, contained in ((0.5, 0.85), (0.0001, 2.0), (0.7, 0.85)):
        found = matching.best_match(spark.createDataFrame(names, "s string, name string, k string, w array<string>"), spark.createDataFrame(masters, "s string, ord long, k string, w array<string>"), ["s"], "k", "w", least, contained)
        got = {(x["s"], x["name"]): (x["ord"], x["score"]) for x in found.collect()}
        want = brute(names, masters, least, contained)
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_a_word_that_all_names_have_makes_no_pairs(spark):
    """20,000 names of two words and as many masters share one word; all pairs would be 400 million."""
    n = 20_000
    made = lambda tag: spark.range(n).select(F.lit("T").alias("tenant"), F.col("id").alias("ord"), F.concat(F.lit(f"hotel {tag}"), F.conv("id", 10, 26)).alias("name"))
    split = lambda df: df.withColumns({"key": F.lower("name"), "words": F.split(F.lower("name"), " ")})
    began = time.time()
    found = matching.best_match(split(made("p")).select("tenant", "name", "key", "words"), split(made("q")), ["tenant"], "key", "words")
    assert {(x["ord"], x["score"]) for x in found.select("ord", "score").distinct().collect()} == {(0, 0.5)} and found.count() == n
    assert time.time() - began < 90


ROWS = "tenant string, company string, supplier_name string, supplier_vat string, supplier_posting_account string, nominal_account_code string, description string, line_items_raw string"


def test_history_of_suppliers_without_a_master(spark):
    """An unmatched supplier with three rows on 5000 gets 5000; one that the list renames, the history of its new name."""
    rows = spark.createDataFrame([("T", "C", "Unknown Traders", None, None, None, "things", None), ("T", "C", "Farsons Brew", None, None, None, "things", None), ("T", "C", "Nobody", None, None, None, "things", None), ("T", "C", None, None, None, None, None, None)], ROWS)
    masters = spark.createDataFrame([("T", "C", 1, "Other Ltd", None, True, "P", "Q", None)], "tenant string, company string, ord long, canonical string, vat_number string, is_active boolean, account_code string, posting_account string, default_nominal string")
    chart = spark.createDataFrame([("T", "C", 1, "9999", "Sundry", True, True), ("T", "C", 2, "4000", "Beer purchases", False, True)], "tenant string, company string, ord long, code string, name string, is_default boolean, is_active boolean")
    history = spark.createDataFrame([("T", "C", "Unknown Traders", "5000")] * 3 + [("T", "C", "Simonds Farsons", "6000")] * 2, "tenant string, company string, supplier_name string, nominal_account_code string")
    listed = lambda hint: spark.createDataFrame([(1, "Simonds Farsons", None, ["farsons"], hint)], "ord long, canonical string, vat_number string, aliases array<string>, nominal_hint string")
    got = lambda hint: {x["supplier_name"]: (x["nominal_account_code"], x["method"]) for x in accounts.suggest(rows, masters, chart, history, [], listed(hint)).collect()}
    assert got("") == {"Unknown Traders": ("5000", "historical_similarity"), "Simonds Farsons": ("6000", "historical_similarity"), "Nobody": ("9999", "default"), None: ("9999", "default")}
    assert got("beer")["Simonds Farsons"] == ("4000", "supplier_rule")


def test_amounts_of_zero_are_blank_for_hints(spark):
    row = spark.createDataFrame([(1, "T", "C", 1, "Acme Ltd", None, "INV-1", 5, "0", "7", "text")], "row_id long, tenant string, company string, page_no int, supplier_name string, review_fields string, invoice_number string, net_amount int, vat_amount string, total_amount string, description string").selectExpr("*", "DATE '2026-01-01' AS invoice_date", "'N1' AS nominal_account_code")
    hints = spark.createDataFrame([(k, "T", f, 1, None, "ACME", True) for k, f in enumerate(["vat_amount", "vat_amount", "net_amount", "invoice_date"])], "id long, tenant string, field_name string, page_no int, supplier_id long, supplier_name_snapshot string, active boolean")
    known = spark.createDataFrame([], "id long, tenant string, company string, supplier_name string")
    assert [tuple(x) for x in accounts.hints_for(row, hints, known).collect()] == [(1, "vat_amount", 1)]


def test_edits_in_order(spark):
    rows = spark.createDataFrame([(1, "T", "C", "in_review", "Own", None), (2, "T", "C", "exported", "Own", None)], "row_id long, tenant string, company string, status string, supplier_name string, description string")
    none = spark.createDataFrame([], "row_id long, supplier_name string, description string")
    told = [(1, "supplier_name", "Own", "edit"), (1, "supplier_name", None, "revert"), (1, "supplier_name", "A", "edit"), (1, "supplier_name", "A", "edit"), (1, "supplier_name", "Own", "edit"), (1, "supplier_name", "X", "edit"), (1, "supplier_name", None, "revert"), (1, "supplier_name", "", "edit"), (2, "supplier_name", "A", "edit"), (1, "secret", "A", "edit"), (7, "supplier_name", "A", "edit"), (1, "description", "", "edit")]
    log = spark.createDataFrame([(k, *x) for k, x in enumerate(told)], "seq long, row_id long, field string, value string, action string")
    masters = spark.createDataFrame([("T", "C", "A"), ("T", "C", "Own")], "tenant string, company string, supplier_name string")
    done = edit_log.folded(rows, none, log, masters, spark.createDataFrame([], "tenant string, company string, account_code string")).orderBy("seq")
    got = [(x["outcome"].split(":")[0], x["old_value"], x["new_value"], x["cell"]) for x in done.collect()]
    assert got == [
        ("unchanged", "Own", "Own", None), ("unchanged", None, None, None), ("applied", "Own", "A", "A"), ("unchanged", "A", "A", "A"), ("applied", "A", "Own", "Own"), ("rejected", "Own", "X", "Own"), ("applied", "Own", None, None),
        ("applied", "Own", None, None), ("rejected", "Own", "A", None), ("ignored", None, "A", None), ("ignored", None, "A", None), ("unchanged", None, None, None),
    ]
    assert [edit_log.as_of(none, done, n).where("row_id = 1").first()["supplier_name"] for n in (0, 2, 5, 11)] == [None, "A", "Own", None]
    assert [x["seq"] for x in edit_log.audit(done).orderBy("seq").collect()] == [2, 4, 6, 7]
    assert edit_log.folded(rows, none, log.limit(0), masters, masters.select("tenant", "company", F.col("supplier_name").alias("account_code"))).isEmpty()
