"""Two readings of a page made one: fields found by rules, and fields that a model gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fields, text

#: From this confidence on a model's free reading of the supplier replaces one found by rules.
SURE = 0.85
#: Descriptions that say nothing.
EMPTY_TITLES = ["", "Invoice extraction", "Invoice goods or services"]
#: Fields that only a model gives.
EXTRA = ["due_date", "supplier_address", "supplier_vat", "customer_name", "customer_address", "customer_vat", "document_type", "extraction_source"]


def read_supplier(name: Column) -> Column:
    """A supplier's name as read from a page, without what reading put before it, a doubled initial, or a second copy of
    the whole name after a full stop. Null where fewer than two characters are left; a blank stays."""
    flat = F.regexp_replace(F.regexp_replace(name, "[\n\r]", " "), "^[^A-Z]+(?=[A-Z])", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(flat, r"^([A-Z])\s+(?=\1\S)", ""), r"\s+", " "))
    norm = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    begins = lambda x, y: F.startswith(x, F.substring(y, F.lit(1), F.greatest(F.lit(4), F.floor(F.length(y) / 2).cast("int"))))

    def once(x: Column) -> Column:
        a, b = x["a"], x["b"]
        twice = (F.length(x["bare"]) > 8) & x["two"] & (F.length(a) >= 4) & (F.length(b) >= 4) & (begins(a, b) | begins(b, a))
        return F.when(twice, F.when(F.length(x["first"]) >= F.length(x["rest"]), x["first"]).otherwise(x["rest"])).otherwise(x["bare"])

    def halves(x: Column) -> Column:
        at = F.locate(". ", x)
        first, rest = F.trim(F.substring(x, F.lit(1), at - 1)), F.trim(F.substring(x, at + 2, F.length(x)))
        return text.bound(F.struct(x.alias("bare"), (at > 0).alias("two"), first.alias("first"), rest.alias("rest"), norm(first).alias("a"), norm(rest).alias("b")), once)

    return F.when(name == "", name).otherwise(text.bound(text.bound(bare, halves), lambda x: F.when(F.length(x) >= 2, x)))


def names_buyer(name: Column, buyer_words: Column) -> Column:
    """Whether the name holds one of the buyer's own words as a whole word, in any case."""
    words = F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.upper)
    return F.arrays_overlap(words, buyer_words)


def merged(rows: DataFrame, rule: str = "rule", model: str = "model", buyer: str = "buyer") -> DataFrame:
    """rows with `merged`, a struct: the fields of the struct `rule` with what the struct `model` adds.

    A model with dedicated fields (extraction_source azure_di) replaces amounts and supplier; others fill gaps, and replace
    a plausible supplier only from a confidence of `SURE` on. A supplier that names the buyer is none. rule and model:
    supplier_name, invoice_number, invoice_date, net_amount, vat_amount, total_amount, currency, tax_code, description;
    model also supplier_confidence and `EXTRA`. A null model changes nothing.
    """
    r, m = F.col(rule), F.col(model)
    dedicated = F.coalesce(m["extraction_source"] == "azure_di", F.lit(False))
    words = fields.account_words(F.col(buyer))
    own = lambda x: F.when(~names_buyer(x, words), x)
    ours, theirs = own(F.nullif(r["supplier_name"], F.lit(""))), own(F.nullif(m["supplier_name"], F.lit("")))
    staged = rows.withColumns({"__ours": ours, "__theirs": theirs})  # columns of their own, as all that follows names them often
    ours, theirs = F.col("__ours"), F.col("__theirs")
    plausible = F.coalesce(~fields.suspicious_supplier(ours), F.lit(False))
    takes = theirs.isNotNull() & ~fields.suspicious_supplier(theirs) & (dedicated | ~plausible | F.coalesce(m["supplier_confidence"] >= SURE, F.lit(False)))
    amount = lambda c: F.when(dedicated, F.coalesce(m[c], r[c])).otherwise(F.coalesce(r[c], m[c])).alias(c)
    blank = lambda c: F.nullif(r[c], F.lit(""))
    number = F.when(fields.suspicious_number(r["invoice_number"]), F.coalesce(F.nullif(m["invoice_number"], F.lit("")), r["invoice_number"])).otherwise(r["invoice_number"])
    title = F.when(F.coalesce(r["description"], F.lit("")).isin(EMPTY_TITLES), F.coalesce(F.nullif(m["description"], F.lit("")), r["description"])).otherwise(r["description"])
    one = F.struct(
        fields.company_case(F.col("__read")).alias("supplier_name"), number.alias("invoice_number"), F.coalesce(r["invoice_date"], m["invoice_date"]).alias("invoice_date"), *[amount(c) for c in ("net_amount", "vat_amount", "total_amount")],
        F.coalesce(blank("currency"), m["currency"]).alias("currency"), F.coalesce(blank("tax_code"), m["tax_code"]).alias("tax_code"), title.alias("description"), *[m[c].alias(c) for c in EXTRA],
    )
    plain = F.struct(*[r[c].alias(c) for c in ("supplier_name", "invoice_number", "invoice_date", "net_amount", "vat_amount", "total_amount", "currency", "tax_code", "description")], *[m[c].alias(c) for c in EXTRA])
    read = staged.withColumn("__read", read_supplier(F.when(takes, theirs).otherwise(ours)))
    return read.withColumn("merged", F.when(m.isNull(), plain).otherwise(one)).select(*rows.columns, "merged")


def recovered_vat(net: Column, vat: Column, total: Column, line_taxes: Column, net_confidence: Column, total_confidence: Column) -> Column:
    """The VAT where none was read: the sum of the lines' taxes above zero, from a cent on; else what total is above net, if
    that is between 1 and 40 % of net and both were read with a confidence of one half."""
    taxes = F.aggregate(F.filter(line_taxes, lambda t: t > 0), F.lit(0).cast("decimal(24,4)"), lambda a, t: (a + t).cast("decimal(24,4)"))
    implied = F.round(total - net, 2)
    fine = (implied > 0.01) & (net > 0) & (implied >= net * F.lit("0.01").cast("decimal(4,2)")) & (implied <= net * F.lit("0.40").cast("decimal(4,2)")) & (net_confidence >= 0.5) & (total_confidence >= 0.5)
    return F.coalesce(vat, F.when(taxes >= 0.01, F.round(taxes, 2)), F.when(fine, implied)).cast("decimal(14,2)")


# --- the invoice number, looked for a second time ---------------------------------------------------------------------

#: What stands before a number, what makes a line or token none, and where the next field begins.
LABEL = r"\b(?:invoice\s*(?:no\.?|number|#|nr\.?)|doc(?:ument)?\s*(?:no\.?|number|nr\.?)|ref(?:erence)?\s*(?:no\.?|number)?|number)\s*[.:\-]?"
REJECT = r"(?i)(?:\b(?:vat|tax)\s*(?:no\.?|number|reg\.?|registration)[\s:.]*|\b(?:MT|GB|EU)\d{8,}|\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b|\b(?:tel|fax|phone|mob)\b|\b(?:customer|client|route|sales\s*rep|rep)\b)"
NEXT_FIELD = r"(?i)\b(date|vat|tax|customer|name|address|total|amount)\b"
#: Lines of a page that are its head.
HEAD_LINES = 40


def invoice_number(page: Column) -> Column:
    """The first token that may be an invoice number after a label in a page's head: on the label's line, else on the next
    two, up to where another field begins. Null where there is none."""

    def tokens(line: Column) -> Column:
        runs = F.regexp_extract_all(line, F.lit(r"(?i)[A-Z0-9][A-Z0-9/\-_.]*+"), F.lit(0))
        return F.filter(runs, lambda t: t.rlike(r"^.[^0-9]*[0-9]") & F.length(t).between(2, 30) & ~t.rlike(r"^(?:19|20)[0-9]{2}$") & ~t.rlike(REJECT))

    head = F.slice(F.split(F.coalesce(page, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), 1, HEAD_LINES)

    def after(line: Column, i: Column, lines: Column) -> Column:
        labelled = line.rlike(f"(?i){LABEL}") & ~F.regexp_extract(line, f"(?i)^(.*?){LABEL}", 1).rlike(REJECT)
        same = F.get(tokens(F.regexp_extract(line, f"(?i)^.*?{LABEL}(.*)$", 1)), 0)
        below = lambda k: F.trim(F.coalesce(F.get(lines, i + k), F.lit("")))
        stops = lambda x: x.rlike(NEXT_FIELD)
        found = lambda x: F.when(~stops(x), F.get(tokens(x), 0))
        return F.when(labelled, F.coalesce(same, found(below(1)), F.when(~stops(below(1)), found(below(2)))))

    each = F.transform(F.array(head), lambda lines: F.get(F.array_compact(F.transform(lines, lambda line, i: after(line, i, lines))), 0))
    return F.get(each, 0)
