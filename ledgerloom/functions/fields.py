"""Is this a supplier, an invoice number, a totals line? Predicates over extracted fields and the lines of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

# What the fields of an invoice look like, and what only looks like them.
NOT_A_NUMBER = ["to", "from", "date", "invoice", "invoice no", "invoice number", "page", "details", "copy", "original", "number", "no", "ref", "reference", "involce", "invoce", "invoiice"]
NOT_A_SUPPLIER = ["invoice", "tax invoice", "invoice number", "invoice no", "date", "customer", "bill to", "ship to", "total", "subtotal", "amount due", "balance due", "vat", "tax", "page", "description"]
SUPPLIER_NEVER = r"invoice|\b(date|page|total|subtotal|amount due|balance due|vat|tax|iban|swift|bic|email|tel|phone|customer|bill to|ship to)\b|\bwww\.|\bhttp"
#: By first letters, as every place of a line is tried: invoice, inv, iban, tax, total, tel, vat, date, page, phone, customer, bill to, balance due,
#: bic, ship to, swift, amount due, email, www., http. Of these inv, date and page are whole words.
LINE_NEVER = r"i(?:nv(?:oice|(?<=\binv)\b)|ban)|t(?:ax|otal|el)|vat|date(?<=\bdate)\b|p(?:hone|age(?<=\bpage)\b)|customer|b(?:ill to|alance due|ic)|s(?:hip to|wift)|amount due|email|www\.|http"
ADDRESS = r"(?i)\b(street|road|ave(nue)?|floor|suite|building|industrial\s+park|triq|district)\b|\bzone\s+[0-9]|^[0-9]+[,/\s]|\b[A-Z]{2,3}\s?[0-9]{4,}\b"
TRADE = r"(?i)\b(shop|store|market|imports?|exports?|foods?|supplies|ltd|limited|brothers?|group|corp|company|services|trading|fish|wine|spirits|meats?)\b"
CONTACT = r"(?i)(tel|fax|phone)\s*[:+]?\s*[+(]?[0-9]{5,}|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\bvat\s+(no\.?|number|reg[.\s]?no\.?)\s*[:-]?\s*[A-Z]{2}[0-9]|\bvat\s*no\s*[:-]?\s*[A-Z]{2}[0-9]|\bvat\s*reg(\.|\s+)no\s*[:-]?\s*[A-Z]|MT[0-9]{6,}|IE[0-9]{6,}[A-Z]|\bBCRS\b|\bEXO\s+[0-9]{4}"
CUSTOMER = r"(?i)^\s*(((bill|invoice|sold|ship|delivery|deliver)\s+to|attention|customer|client)\s*[:-]?|to\s*:)\s*$|(bill|invoice|sold|ship)\s+to\s*[:-]|client\s+details|client\s+code\s*[:-]|cashier\s*[:-]"
SUMMARY_LINE = r"\b(total|subtotal|gross|net|vat|tax|summary|amount due|total due|invoice summary|tax summary|deposit summary)\b"
ITEM_LINE = r"\b(qty|quantity|unit|uom|barcode|item|description|pcs|price|w/sale|retail|consumer|code|stock|salesperson|order no|delivery note)\b"
VAT_LINE = r"(^|\s)(v\.?a\.?t\.?(\s+[0-9]+\s*%)?(\s+amount|\s+total|\s+amt)?|tax(\s+amount|\s+total|\s+amt)?|value\s+added\s+tax)(\s*[%:-]|\s+[0-9]|\s*$)"
TOTAL_LINE = r"^(total|grand\s+total|invoice\s+total|amount\s+due|balance\s+due)"
AMOUNTS = ["net_amount", "vat_amount", "total_amount"]
COMPANY_WORDS = ["LTD", "LIMITED", "PLC", "LLC", "INC", "CO", "CORP", "COMPANY", "THE", "AND", "OF", "FOR", "A", "PRIVATE", "PUBLIC", "GROUP"]
SUFFIXES = {
    "ltd": "Ltd", "limited": "Limited", "plc": "PLC", "llp": "LLP", "llc": "LLC", "inc": "Inc", "bv": "B.V.", "b.v.": "B.V.", "nv": "N.V.", "n.v.": "N.V.", "gmbh": "GmbH", "ag": "AG",
    "sa": "SA", "sas": "SAS", "sl": "SL", "spa": "SpA", "oy": "Oy", "ab": "AB", "pty": "Pty", "pty.": "Pty.",
}
CONNECTORS = ["and", "or", "of", "for", "the", "a", "an", "in", "on", "at", "by", "to", "with", "from", "&"]
#: An amount with two decimals, dots or commas between thousands.
MONEY_TOKEN = r"(?<![0-9])([0-9]{1,3}([.,][0-9]{3})*[.,][0-9]{2}|[0-9]+[.,][0-9]{2})(?![0-9])"


def _letters(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^A-Za-z]+", ""))


def _digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]+", ""))


def suspicious_number(value: Column) -> Column:
    """No invoice number: a label, fewer than three characters, or letters alone. Null is suspicious."""
    low = F.lower(F.trim(value))
    return F.coalesce(low.isin(NOT_A_NUMBER) | (F.length(low) < 3) | low.rlike(r"^[a-z\s]+$"), F.lit(True))


def suspicious_supplier(value: Column) -> Column:
    """No supplier: a label or a text that holds one, fewer than two letters, or no fewer digits than letters."""
    name = F.trim(value)
    low = F.lower(name)
    return F.coalesce(low.isin(NOT_A_SUPPLIER) | (_letters(name) < 2) | (_digits(name) >= _letters(name)) | low.rlike(SUPPLIER_NEVER), F.lit(True))


def no_supplier_line(line: Column) -> Column:
    """A line that cannot be a supplier's name: too short or long, a label, or more digits than letters."""
    low = F.lower(F.trim(line))
    return ~F.length(low).between(3, 90) | low.rlike(LINE_NEVER) | (_digits(low) > _letters(low))


def plausible_company(line: Column) -> Column:
    """A line that may be a company's name and no address; one or two short words must name a trade."""
    name = F.trim(line)
    short = (F.size(F.split(name, r"\s+")) <= 2) & (F.length(name) <= 18)
    return (F.length(name) >= 4) & ~no_supplier_line(name) & ~suspicious_supplier(name) & ~name.rlike(ADDRESS) & (~short | name.rlike(TRADE))


def eligible(field: str, value: Column, review_fields: Column, review_required: Column, confidence: Column) -> Column:
    """May a rule overwrite this field: it is blank, named for review, in an unsure row, or looks wrong."""
    text = F.trim(value.cast("string"))
    unsure = review_required & (confidence.isNull() | (confidence < 0.55))
    may = F.coalesce(text == "", F.lit(True)) | F.coalesce(F.array_contains(T.split_fields(review_fields), field), F.lit(False)) | F.coalesce(unsure, F.lit(False))
    if field == "invoice_number":
        return may | suspicious_number(text)
    return may | (F.length(text) < 3) if field == "supplier_name" else may


def appropriate(field: str, value: Column) -> Column:
    """May this value be written to the field: an invoice reference is no supplier's name. Blank is none."""
    text = F.trim(value)
    filled = F.coalesce(F.length(value) > 0, F.lit(False))
    if field != "supplier_name":
        return filled
    one_word = ~F.contains(text, F.lit(" "))
    reference = one_word & (((F.length(text) <= 15) & (_digits(text) > 0.4 * F.length(text))) | text.rlike(r"(?i)^[A-Z0-9/-]{2,15}$"))
    return filled & ~F.coalesce(reference, F.lit(False))


def suspect(field: str, value: Column) -> Column:
    """A value that is plainly wrong: blank, a name or description below three characters, an amount that is no number."""
    text = F.trim(value)
    wrong = text == ""
    if field in ("supplier_name", "description"):
        wrong = wrong | (F.length(text) < 3)
    if field in AMOUNTS:
        wrong = wrong | F.replace(text, F.lit(","), F.lit(".")).try_cast("double").isNull()
    return F.coalesce(wrong & value.isNotNull(), F.lit(False))


def is_summary(line: Column) -> Column:
    return F.lower(line).rlike(SUMMARY_LINE)


def is_item(line: Column) -> Column:
    return F.lower(line).rlike(ITEM_LINE)


def is_vat(line: Column) -> Column:
    return F.lower(F.trim(line)).rlike(VAT_LINE)


def is_total(line: Column) -> Column:
    """A line that opens with a total: its value is the invoice's, whatever else it names."""
    return F.lower(F.trim(line)).rlike(TOTAL_LINE)


def amounts(line: Column) -> Column:
    """All amounts of a text, in order. A comma groups unless dots group before it: `12,50` is 1250.00."""
    european = r"^[0-9]{1,3}(\.[0-9]{3})+,[0-9]{2}$"
    plain = lambda x: F.when(x.rlike(european), F.translate(x, ",.", ".")).otherwise(F.replace(x, F.lit(","), F.lit("")))
    found = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(MONEY_TOKEN), F.lit(1))
    return F.array_compact(F.transform(found, lambda x: plain(x).try_cast("decimal(14,2)")))


def first_amount(value: Column, number: bool = False) -> Column:
    """The first amount of a text; of a number itself, with two decimals, if it is above zero."""
    if number:
        return F.when(value > 0, F.round(value, 2).cast("decimal(14,2)"))
    return F.try_element_at(amounts(value), F.lit(1))


def account_words(company: Column) -> Column:
    """The words of the buyer's name, in capitals, that tell it from others."""
    words = F.transform(F.regexp_extract_all(F.coalesce(company, F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)), F.upper)
    return F.array_except(words, F.array(*map(F.lit, COMPANY_WORDS)))


def company_case(name: Column) -> Column:
    """A name all in capitals or all in small letters in title case, with legal forms as they are written; others stay."""
    bare = F.trim(name)
    letters = F.regexp_replace(bare, r"[^\p{L}]", "")
    one_case = (letters != "") & ((letters == F.upper(letters)) | (letters == F.lower(letters)))
    forms = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])

    def word(w: Column, i: Column) -> Column:
        low = F.rtrim(F.lower(w), F.lit("."))
        small = (i > 0) & low.isin(CONNECTORS)
        return F.coalesce(F.try_element_at(forms, low), F.when(small, F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))))

    return F.when(one_case, F.array_join(F.transform(F.split(bare, r"\s+"), word), " ")).otherwise(bare)


def sheet_name(name: Column) -> Column:
    """A name that a worksheet may bear: 31 characters, no signs that sheets forbid."""
    safe = F.trim(F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\\/*?:\[\]]", "_"), 1, 31))
    return F.when(safe == "", "Export").otherwise(safe)


def extraction_status(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "complete").when(confidence >= 0.50, "partial").otherwise("review_required")
