"""Bottle deposits on invoices: the amount that a deposit label on the page names, told from totals and VAT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fields
from ledgerloom.operators.pages import summary_lines

# Deposit labels, VAT in a label's surroundings, lines that are totals alone, and the points that candidates get.
LABEL = r"\b(?:bcrs(?:\s+refundable)?(?:\s+deposit)?|refundable\s+deposit|deposit)\b"
CONFIRMS = r"\b(bcrs(\s+refundable)?(\s+deposit)?|refundable\s+deposit|deposit\s+summary|returnable(\s+deposit)?|deposit)\b"
VAT_NEAR = r"\b(vat(\s+[0-9]+\s*%)?(\s+amount|\s+total|\s+amt)?|tax(\s+amount|\s+total|\s+amt)?|v\.?a\.?t\.?|value\s+added\s+tax)\b"
ONLY_TOTALS = r"(?i)^\s*(sub\s*total|net\s*amount|net|v\.?a\.?t\.?|tax|invoice\s*total|grand\s*total|total\s*(due|amount|eur|incl|net)?|amount\s*due|balance\s*due)\s*[:\-]?\s*[€$£]?[0-9.,]+\s*$"
DIRECT = [(r"\bbcrs(?:\s+refundable)?(?:\s+deposit)?\b", 18), (r"\brefundable\s+deposit\b", 16), (r"\bdeposit\b", 12)]
GAP = r"[^0-9\n€-]{0,24}(?:€\s*)?(-?[0-9]+[.,][0-9]{2})"
LEAST, FITS, NEAR_VAT, WINDOW = 20, "0.06", "0.02", 40
MONEY = "decimal(14,2)"


def _points(**when: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, n).otherwise(0) for c, n in when.values()])


def with_deposit(rows: DataFrame) -> DataFrame:
    """rows (totals_raw, page_text_raw, net_amount, vat_amount, total_amount) with `deposit`, null where no label confirms one.

    Every amount behind, on or beside a line with a deposit label is a candidate; labels, context and a sum that comes out
    give points. The most points win, then the smaller amount; below 20 there is none. The VAT amount is never a deposit.
    The context of a plain label is its line and the two beside it, 40 characters each way.
    """
    own = [c for c in rows.columns if c != "deposit"]
    none = F.array().cast(f"array<struct<less:int,v:{MONEY}>>")
    near = F.lit(FITS).cast(MONEY)
    given = lambda name: F.when(F.col(name) > 0, F.col(name).cast(MONEY))
    has = lambda x, word: F.contains(x, F.lit(word))

    # What has none of these words has no label; only lines that have one, and those beside them, are looked at.
    names = lambda low: has(low, "bcrs") | has(low, "deposit") | has(low, "returnable")

    def look(x: Column) -> Column:
        low = F.lower(x)
        return F.struct(
            x.alias("line"), low.alias("low"), low.rlike(LABEL).alias("label"), fields.is_summary(x).alias("summary"), fields.is_item(x).alias("item"), fields.is_vat(x).alias("vat"), fields.is_total(x).alias("total"),
            fields.amounts(x).alias("values"), fields.amounts(F.regexp_extract(x, "(?i)" + LABEL + "(.*)$", 1)).alias("after"),
        )

    df = rows.withColumns({"__net": given("net_amount"), "__vat": given("vat_amount"), "__total": given("total_amount"), "__lines": F.when(names(F.lower(F.concat_ws("\n", "totals_raw", "page_text_raw"))), summary_lines(F.col("totals_raw"), F.col("page_text_raw"))).otherwise(F.array().cast("array<string>"))})
    df = df.withColumn("__marked", F.transform("__lines", lambda x: F.struct(x.alias("line"), names(F.lower(x)).alias("named"))))
    near_name = lambda i: F.exists(F.slice("__marked", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), lambda m: m["named"])
    df = df.withColumn("__f", F.transform("__marked", lambda m, i: F.when(near_name(i), look(m["line"]))))
    # Each line beside the ones before and after it; lines without a label anywhere near give nothing and are dropped.
    beside = F.filter(F.transform("__f", lambda f, i: F.struct(F.get("__f", i - 1).alias("prev"), f.alias("own"), F.get("__f", i + 1).alias("next"))), lambda t: t["own"]["label"] | t["own"]["low"].rlike(CONFIRMS))
    df = df.withColumn("__near", beside)
    fits = lambda v: F.coalesce(F.abs(F.col("__net") + F.col("__vat") + v - F.col("__total")) <= near, F.lit(False))
    scored = lambda values, score: F.transform(F.coalesce(values, F.array().cast(f"array<{MONEY}>")), lambda v: F.struct((-score(v)).cast("int").alias("less"), v.alias("v")))
    yes = lambda x: F.coalesce(x, F.lit(False))

    def candidates(t: Column) -> Column:
        f, prev, after = t["own"], t["prev"], t["next"]
        low = f["low"]
        around = F.concat_ws(" ", prev["low"], low, after["low"])
        bcrs, refundable, deposit = has(low, "bcrs"), has(low, "refundable"), has(low, "deposit")
        plain = deposit & ~bcrs & ~refundable
        told = has(around, "bcrs") | has(around, "summary")
        sums_up = lambda n: yes(n["summary"] & ~n["item"] & ~n["vat"])
        context = (told | ~around.rlike(VAT_NEAR)) & (f["summary"] | told | sums_up(prev) | sums_up(after))
        usable = f["label"] & ~(f["item"] & ~f["summary"]) & ~f["total"] & ~f["vat"] & (~plain | context)
        behind = lambda v: 22 + _points(a=(bcrs, 10), b=(refundable, 5), c=(deposit, 6), d=(has(low, "surcharge"), 5), e=(f["summary"], 4), f=(fits(v), 12))
        same = lambda v: 12 + _points(a=(bcrs, 8), b=(deposit, 4), c=(f["summary"], 4), d=(fits(v), 10))
        side = lambda n: scored(F.when(yes(~(n["item"] & ~n["summary"]) & ~n["vat"] & ~n["total"]), n["values"]), lambda v: 8 + _points(a=(bcrs, 8), b=(refundable, 3), c=(deposit, 4), d=(n["summary"] | f["summary"], 4), e=(fits(v), 10)))
        by_line = F.when(usable, F.concat(scored(F.slice(f["after"], 1, 2), behind), scored(f["values"], same), side(prev), side(after))).otherwise(none)
        # A label directly before an amount counts by itself, a plain one only in the right surroundings.
        span = F.concat(F.right(F.concat_ws("\n", prev["low"], F.regexp_extract(low, r"^(.*?)\bdeposit\b", 1)), F.lit(WINDOW)), F.lit("deposit"), F.left(F.concat_ws("\n", F.regexp_extract(low, r"\bdeposit\b(.*)$", 1), after["low"]), F.lit(WINDOW + 30)))
        known = span.rlike("bcrs|summary|refundable") | (has(span, "total") & ~span.rlike(VAT_NEAR)) | f["summary"]
        direct = []
        for k, (label, base) in enumerate(DIRECT):
            found = F.transform(F.regexp_extract_all(low, F.lit(label + GAP), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast(MONEY))
            fine = ~f["total"] & ~f["vat"] & (known if k == 2 else F.lit(True))
            all_known = F.col("__net").isNotNull() & F.col("__vat").isNotNull() & F.col("__total").isNotNull()
            direct.append(scored(F.when(fine, found), lambda v, base=base, all_known=all_known: base + F.when(fits(v), 12).when(all_known & (v > 0) & (v < F.col("__total")), 2).otherwise(0)))
        return F.concat(by_line, *direct)

    df = df.withColumn("__c", F.flatten(F.transform("__near", candidates)))
    fine = F.filter("__c", lambda c: (c["v"] > 0) & ~yes(F.abs(c["v"] - F.col("__vat")) < F.lit(NEAR_VAT).cast(MONEY)))
    df = df.withColumn("__best", F.array_min(fine))
    valued = lambda n: yes(F.size(n["values"]) > 0) & ~yes(n["vat"])
    confirmed = F.exists("__near", lambda t: t["own"]["low"].rlike(CONFIRMS) & ~t["own"]["vat"] & ~t["own"]["line"].rlike(ONLY_TOTALS) & ((F.size(t["own"]["values"]) > 0) | valued(t["prev"]) | valued(t["next"])))
    return df.select(*own, F.when(confirmed & (F.col("__best.less") <= -LEAST), F.col("__best.v")).alias("deposit"))


def split_found(rows: DataFrame) -> DataFrame:
    """rows (description and amounts), each with a deposit that its page names followed by a row of its own for it
    (row_kind: original or deposit). The original's total becomes net and VAT where that is less, a null one counting as 0."""
    has = F.coalesce(F.col("deposit") > 0, F.lit(False))
    zero = F.lit(0).cast(MONEY)
    parts = (F.coalesce("net_amount", zero) + F.coalesce("vat_amount", zero)).cast(MONEY)
    left = F.when(has & (parts >= 0) & (parts < F.coalesce("total_amount", zero)), parts).otherwise(F.col("total_amount"))
    bare = F.trim(F.coalesce("description", F.lit("")))
    title = F.when(bare == "", "BCRS surcharge").when(F.contains(F.lower(bare), F.lit("bcrs")), bare).otherwise(F.concat(bare, F.lit(" - BCRS")))
    amounts = lambda net, vat, total: [net.cast(MONEY).alias("net_amount"), vat.cast(MONEY).alias("vat_amount"), total.cast(MONEY).alias("total_amount")]
    own = F.struct(F.lit("original").alias("row_kind"), F.col("description").alias("description"), *amounts(F.col("net_amount"), F.col("vat_amount"), left))
    new = F.struct(F.lit("deposit").alias("row_kind"), title.alias("description"), *amounts(F.col("deposit"), zero, F.col("deposit")))
    out = with_deposit(rows).withColumn("__x", F.explode(F.when(has, F.array(own, new)).otherwise(F.array(own))))
    names = ["description", "net_amount", "vat_amount", "total_amount"]
    return out.select(*[F.col(f"__x.{c}") if c in names else F.col(c) for c in rows.columns if c != "deposit"], "__x.row_kind")
