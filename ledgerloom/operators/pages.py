"""From the text of a page to the fields of an invoice. Pages stay one row each: lines are arrays, and every step is one
more column, so that no shuffle is needed and nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, fields, money, text

MONEY = "decimal(14,2)"
CURRENCY = r"(?:EUR|GBP|USD|€|£|\$)?"
NUMBER = r"\s*([0-9.,]+)"
#: How invoices label their fields, the most telling labels first.
INVOICE_NUMBER = [
    r"invoice\s*(?:no\.?|number|#|nr\.?)\s*[.:\-]*\s*([A-Z0-9][A-Z0-9/\-_]*[0-9][A-Z0-9/\-_]*)",
    r"invoice\s*(?:no\.?|number|#|nr\.?)\s*[.:\-]*\s*([0-9][A-Z0-9/\-_]*)",
    r"\bINV[.\-_]?([0-9][A-Z0-9/\-_]*)",
    r"\bdocument\s*(?:no\.?|number|nr\.?)\s*[.:\-]*\s*([A-Z0-9/\-_]*[0-9][A-Z0-9/\-_]*)",
    r"\binv(?:oice|oiice|oice)?\s*[.:\-]+\s*([A-Z0-9/\-_]*[0-9][A-Z0-9/\-_]*)",
]
INVOICE_DATE = [r"invoice\s*date\s*[:\-]?\s*([0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4})", r"\bdate\s*[:\-]?\s*([0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4})"]
NET = [r"(?:sub[\s\-]?total|net[\s\-]?amount|amount\s+excl(?:uding)?\.?\s*(?:vat|tax)?|excl(?:uding)?\.?\s*(?:vat|tax)|net\s+total|taxable[\s\-]?amount|amount\s+before\s+(?:vat|tax))\s*[:\-]?\s*", r"(?:nett)\s*[:\-]?\s*"]
VAT = [r"v\.?a\.?t\.?\s*(?:@\s*[0-9]{1,2}\s*%\s*)?[:\-]?\s*", r"(?:value\s+added\s+tax|vat\s+amount|tax\s+amount)\s*[:\-]?\s*", r"(?:iva|gst)\s*[:\-]?\s*", r"^\s*tax\s*[:\-]?\s*"]
TOTAL = [r"(?:amount due|balance due|grand total|total due|total amount|invoice total|total incl\.?\s*(?:vat|tax)?)\s*[:\-]?\s*", r"(?:total\s+to\s+pay|total\s+payable|amount\s+to\s+pay|amount\s+payable|total\s+inc(?:l(?:uding)?)?\.?\s*(?:vat|tax)?)\s*[:\-]?\s*", r"total\s*[:\-]?\s*", r"\bamount\s*[:\-]\s*"]
NO_ITEM = r"invoice\s*(no|number)|\b(date|vat|tax|total|subtotal|amount due|balance due|iban|bic|page|customer|supplier|address|email|phone|qty|quantity|unit price|discount)\b"
TOPICS = {
    "fuel and related vehicle consumables": ["fuel", "diesel", "petrol", "unleaded", "lubricant"],
    "office supplies and stationery": ["paper", "stationery", "toner", "ink", "folder", "pen", "notebook"],
    "cleaning supplies and hygiene products": ["detergent", "cleaner", "soap", "bleach", "sanitiser", "tissue"],
    "food and beverage supplies": [
        "food", "catering", "beverage", "drink", "snack", "bread", "meat", "poultry", "chicken", "beef", "pork", "fish", "seafood", "dairy", "cheese", "butter", "milk", "cream", "yoghurt", "eggs", "whisky", "whiskey", "vodka", "gin", "rum", "wine", "beer",
        "spirits", "alcohol", "champagne", "prosecco", "brandy", "liqueur", "scotch", "bourbon", "lager", "cider", "coffee", "tea", "juice", "water", "soft drink", "energy drink", "ice cream", "frozen", "chilled", "deli", "produce",
    ],
    "vehicle parts and maintenance items": ["filter", "brake", "tyre", "battery", "engine", "service kit"],
    "electrical supplies and components": ["cable", "socket", "switch", "lamp", "electrical", "fuse"],
    "building materials and hardware items": ["cement", "paint", "screw", "bolt", "hardware", "tool"],
    "printing and marketing materials": ["print", "printing", "flyer", "poster", "banner", "brochure"],
    "software, subscriptions, or digital services": ["subscription", "software", "license", "hosting", "domain"],
    "professional or business services": ["service", "consulting", "labour", "maintenance", "support"],
}
NO_TOPIC = "Invoice goods or services"
LONE_WORDS = ["only", "the", "a", "an", "our", "your", "my", "its", "their", "new", "old", "best", "fresh", "pure", "just", "top", "pro", "by", "at", "in", "on", "for", "and", "or", "of", "with"]
NEXT_IS_ADDRESS = r"(?i)\b(street|road|ave(nue)?|floor|suite|triq|district)\b|\bzone\s+[0-9]|^[0-9]+[,/\s]|\b[A-Z]{2,3}\s?[0-9]{4,}\b"
NAME_SIGNS = r"^[A-Za-z0-9 &().,\-'/]+$"
CORPORATE = r"(?i)\b(ltd|limited|plc|llc|inc|co\.?|company|services|trading|holdings|group|foods?|supplies|distribution|imports?|exports?|catering|enterprises?|corp|brothers?|sisters?|partners?|associates?)\b"
#: Lines that can head a page, lines a customer's block takes, and lines to look back from a contact.
HEADER, CUSTOMER_BLOCK, BACK, CONTACTS = 18, 5, 9, 4
#: How many lines of a head to look at in turn, and the most points that a name below them can have: a name with as many wins
#: whatever follows. So the whole head is read only where its first lines leave it open.
STEPS = [(1, 14), (6, 10), (HEADER, 0)]


def first_match(found: Column, patterns: list[str]) -> Column:
    """What the first of the patterns that matches has in its group, at its first match."""
    return F.coalesce(*[text.bound(F.trim(F.regexp_extract(found, "(?im)" + p, 1)), lambda x: F.when(x != "", x)) for p in patterns])


def filled_lines(found: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(found, F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x != "")


def item_lines(lines: Column, most: int = 25) -> Column:
    """Lines that may be items: two words or more, with an amount or over 20 characters, no header or total; each once."""
    item = lambda x: (F.length(x) >= 6) & ((F.length(x) > 20) | x.rlike("[0-9][.,][0-9]{2}")) & x.rlike("(?s)[A-Za-z]{3}.*[^A-Za-z][A-Za-z]{3}") & ~F.lower(x).rlike(NO_ITEM)
    return F.slice(F.array_distinct(F.filter(lines, item)), 1, most)


def description(items: Column) -> Column:
    """The first topic one of whose words the items hold, else the first of three lines that is more than figures."""

    def named(low: Column) -> Column:
        topic = F.when(F.size(items) == 0, NO_TOPIC)
        for label, words in TOPICS.items():
            topic = topic.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), label)
        return topic

    readable = F.filter(F.transform(F.slice(items, 1, 3), lambda x: F.regexp_replace(x, r"\s{2,}", " ")), lambda x: ~x.rlike(r"^[0-9\s.,€£$%]+$") & (F.length(x) > 4))
    topic = text.bound(F.lower(F.array_join(items, "\n")), named)
    return F.coalesce(topic, text.first_words(F.coalesce(F.try_element_at(readable, F.lit(1)), F.array_join(F.slice(items, 1, 2), " "))))


# --- supplier ----------------------------------------------------------------------------------------------------


def _customer_words(found: Column, account: Column) -> Column:
    """Words in capitals that name the buyer: those given, and those after `Account` in the text."""
    short = F.transform(F.regexp_extract_all(found, F.lit(r"\bAccount\s+([A-Z][A-Za-z0-9]+)"), F.lit(1)), F.upper)
    named = F.regexp_extract_all(found, F.lit(r"(?i)\bAccount\s+Name\s*[:\-]\s*([A-Z][A-Za-z0-9 ]+)"), F.lit(1))
    long = F.filter(F.flatten(F.transform(named, lambda x: F.split(F.upper(F.trim(x)), r"\s+"))), lambda w: F.length(w) >= 4)
    return F.array_union(account, F.array_union(short, long))


def with_supplier(pages: DataFrame, page_text: str = "page_text", account: Column | None = None) -> DataFrame:
    """pages with supplier_name. A name in the page's head scores by its place and looks; the company above a line of
    contact data wins over it unless it scores 12 or more, and of two that agree the longer counts. What names the buyer
    (account: an array of words in capitals) and what follows a customer's label is never the supplier."""
    own = pages.columns
    account = F.array().cast("array<string>") if account is None else account
    df = pages.withColumn("__lines", filled_lines(F.col(page_text))).withColumn("__buyer", _customer_words(F.coalesce(page_text, F.lit("")), account))
    words = lambda x, n: F.transform(F.regexp_extract_all(x, F.lit(f"[A-Za-z]{{{n},}}"), F.lit(0)), F.upper)
    buyer = lambda x: (F.size("__buyer") > 0) & F.arrays_overlap(words(x, 4), F.col("__buyer"))
    within = lambda i: F.exists(F.slice(F.col("__labels"), F.greatest(i - CUSTOMER_BLOCK + 2, F.lit(1)), F.least(i + 1, F.lit(CUSTOMER_BLOCK))), lambda x: x)
    part = lambda x, i: (F.length(x) <= 20) & ~fields.no_supplier_line(x) & x.rlike(NAME_SIGNS) & ~within(i)
    flags = lambda x, i: F.struct(x.alias("line"), within(i).alias("customer"), part(x, i).alias("part"), (~F.lower(x).isin(LONE_WORDS)).alias("opens"), (~x.rlike(NEXT_IS_ADDRESS)).alias("goes_on"))

    # Two short lines make one name, from the top on; a line that was joined to the one before it joins no other.
    def joins(i: Column) -> Column:
        here, after = F.get("__flags", i), F.get("__flags", i + 1)
        return F.coalesce(here["part"] & here["opens"] & after["part"] & after["goes_on"], F.lit(False))

    start = F.struct(F.lit(False).alias("taken"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, i: Column) -> Column:
        return F.when(acc["taken"], F.struct(F.lit(False).alias("taken"), acc["at"].alias("at"))).otherwise(F.struct(F.get("__joins", i).alias("taken"), F.array_append(acc["at"], i).alias("at")))

    joined = lambda i: F.struct(i.alias("pos"), F.when(F.get("__joins", i), F.concat_ws(" ", F.get("__head", i), F.get("__head", i + 1))).otherwise(F.get("__head", i)).alias("name"), F.get("__flags", i)["customer"].alias("customer"))

    def score(x: Column) -> Column:
        pos, name = x["pos"], x["name"]
        points = lambda when, n: F.when(when, n).otherwise(0)
        place = F.when(pos == 0, 8).when(pos <= 2, 4).when(pos <= 5, 2).otherwise(0)
        looks = points(name.rlike(r"^[A-Z0-9 &().,\-'/]{4,}$"), 3) + points(name.rlike(CORPORATE), 2) + points(F.length(name).between(4, 60), 2) + points(~fields.suspicious_supplier(name), 3)
        return F.struct((-(place + looks)).alias("less"), pos.alias("pos"), name.alias("name"))

    none, below = F.array().cast("array<string>"), None
    for most, limit in STEPS:
        head = F.slice("__lines", 1, min(most + 1, HEADER))  # a name may go on in the line below
        df = df.withColumn("__head", head if below is None else F.when(F.coalesce(F.col("__best.less") > -below, F.lit(True)), head).otherwise(none))
        df = df.withColumn("__labels", F.transform("__head", lambda x: x.rlike(fields.CUSTOMER)))
        df = df.withColumn("__flags", F.transform("__head", flags))
        df = df.withColumn("__joins", F.transform("__flags", lambda _, i: joins(i)))
        places = F.when(F.size("__head") > 0, F.sequence(F.lit(0), F.least(F.size("__head"), F.lit(most)) - 1)).otherwise(F.array().cast("array<int>"))
        df = df.withColumn("__at", F.aggregate(places, start, step)["at"])
        df = df.withColumn("__names", F.filter(F.transform("__at", joined), lambda x: ~x["customer"] & ~fields.no_supplier_line(x["name"]) & ~buyer(x["name"])))
        found = F.array_min(F.transform("__names", score))
        df = df.withColumn("__best", found if below is None else F.coalesce(found, "__best"))
        below = limit

    # The nearest line above contact data that may be a company, from the first four such lines that has one. Where the best
    # name has 12 points, only a longer line that agrees with it could change the outcome.
    held = F.lit(None).cast("string")
    company = lambda at, x: F.when(at.isNotNull(), at).when(fields.plausible_company(x) & ~buyer(x), x)
    above = lambda i: F.aggregate(F.reverse(F.slice("__lines", F.greatest(i - BACK + 1, F.lit(1)), F.least(i, F.lit(BACK)))), held, company)
    agrees = lambda x, y: F.contains(F.upper(x), F.upper(y)) | F.contains(F.upper(y), F.upper(x))
    open_ = F.coalesce(F.col("__best.less") > -12, F.lit(True)) | F.exists("__lines", lambda x: (F.length(x) > F.length("__best.name")) & agrees(x, F.col("__best.name")))
    seen = lambda n, at: F.struct(n.alias("n"), at.alias("at"))
    contact = lambda a, i: F.when(a["at"].isNotNull() | (a["n"] >= CONTACTS), a).when(F.get("__lines", i).rlike(fields.CONTACT), seen(a["n"] + 1, above(i))).otherwise(a)
    places = F.when(open_ & (F.size("__lines") > 0), F.sequence(F.lit(0), F.size("__lines") - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__anchor", F.aggregate(places, seen(F.lit(0), held), contact)["at"])
    best, anchor = F.col("__best.name"), F.col("__anchor")
    longer = F.when(F.length(best) >= F.length(anchor), best).otherwise(anchor)
    chosen = F.when(anchor.isNull(), best).when(best.isNull(), anchor).when(agrees(best, anchor), longer).when(F.col("__best.less") <= -12, best).otherwise(anchor)
    return df.select(*[F.col(c) for c in own if c != "supplier_name"], F.substring(chosen, 1, 200).alias("supplier_name"))


# --- totals ------------------------------------------------------------------------------------------------------


def with_structured_totals(pages: DataFrame, page_text: str = "page_text") -> DataFrame:
    """pages with `structured`: net_amount, vat_amount, total_amount and deposit_candidate from blocks headed Tax Analysis,
    Invoice Summary and Deposit Summary; null where there is no such block or where its amounts do not add up."""
    own = pages.columns
    heading = r"(?i)^(tax\s+analysis|invoice\s+summary|deposit\s+summary)\s*$"
    low = F.lower(F.coalesce(page_text, F.lit("")))
    named = F.contains(low, F.lit("analysis")) | F.contains(low, F.lit("summary"))  # other pages have no block
    df = pages.withColumn("__l", F.when(named, F.transform(F.split(page_text, r"\R"), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>")))

    def row(x: Column) -> Column:
        shapes = [r"^(.+?)\s{2,}([+-]?[0-9][0-9,. ]*[0-9]|[0-9]+\.[0-9]{2})\s*$", r"^(.+?)\s*[:\-]\s*([+-]?[0-9][0-9,. ]*[0-9]|[0-9]+\.[0-9]{2})\s*$", r"^(.+?)\s+([+-]?[0-9]+\.[0-9]{2})\s*$"]
        shaped = lambda p: text.bound(F.regexp_extract(x, p, 2), lambda v: F.when(v != "", F.struct(F.regexp_extract(x, p, 1).alias("label"), v.alias("v"))))
        return text.bound(F.coalesce(*map(shaped, shapes)), lambda r: F.struct(F.lower(F.trim(r["label"])).alias("label"), F.regexp_replace(r["v"], "[€£$, ]", "").try_cast(MONEY).alias("v")))

    place = lambda p: F.array_position(F.transform("__l", lambda x: x.rlike(p)), True)
    df = df.withColumn("__heads", F.transform("__l", lambda x: x.rlike(heading)))
    df = df.withColumns({"__tax_at": place(r"(?i)tax\s+analysis"), "__inv_at": place(r"(?i)invoice\s+summary"), "__dep_at": place(r"(?i)deposits?\s*summary\s*$")})

    def block(at: str) -> Column:
        """Labelled amounts below a heading, up to the next within 30 lines, else for 20."""
        start = F.col(at).cast("int")
        following = F.array_position(F.slice("__heads", start + 1, 29), True).cast("int")
        length = F.when(following > 0, following - 1).otherwise(19)
        return F.when(start > 0, F.filter(F.transform(F.slice("__l", start + 1, length), row), lambda r: r["v"].isNotNull() & r["label"].isNotNull())).otherwise(F.array().cast(f"array<struct<label:string,v:{MONEY}>>"))

    df = df.withColumns({"__tax": block("__tax_at"), "__inv": block("__inv_at"), "__dep": block("__dep_at")})
    last = lambda rows, keep: F.try_element_at(F.filter(rows, keep), F.lit(-1))["v"]
    df = df.withColumns(
        {
            "__t": last("__tax", lambda r: F.contains(r["label"], F.lit("total")) & ~r["label"].rlike("vat|tax") & (r["v"] > 0)),
            "__v": last("__tax", lambda r: r["label"].rlike(r"vat|tax amount|tax total|v\.a\.t")),
            "__n": F.array_max(F.transform(F.filter("__tax", lambda r: r["label"].rlike("net|sub total|subtotal|gross value|excl")), lambda r: r["v"])),
            "__total": last("__inv", lambda r: ~r["label"].rlike("gross *value|total *discount|less *return|less *disc|deposits?") & r["label"].rlike("invoice total|sub total|subtotal|total payable|amount due|balance due|net payable")),
            "__deposit": F.try_element_at(F.filter("__dep", lambda r: (r["v"] > 0) & r["label"].rlike("deposit|bcrs|total|returnable")), F.lit(1))["v"],
        }
    )
    derived = F.col("__t") - F.col("__v")
    net = F.when(derived.isNotNull(), F.when(derived > 0, derived)).otherwise(F.when(F.col("__v").isNotNull(), F.col("__n"))).cast(MONEY)
    df = df.withColumn("__net", net).withColumn("__vat", F.when(F.col("__net").isNotNull(), F.col("__v")))
    close = F.lit("0.10").cast(MONEY)
    off = F.col("__net") + F.col("__vat") - F.col("__total")
    fits = (F.abs(off) <= close) | F.coalesce(F.abs(off + F.col("__deposit")) <= close, F.lit(False))
    checked = (F.col("__net") != 0) & (F.col("__vat") != 0) & (F.col("__total") != 0)
    parts = {"net_amount": "__net", "vat_amount": "__vat", "total_amount": "__total", "deposit_candidate": "__deposit"}
    found = F.coalesce(*parts.values()).isNotNull() & F.coalesce(~checked | fits, F.lit(True))
    structured = F.when(found, F.struct(*[F.col(c).alias(name) for name, c in parts.items()]))
    return df.select(*[c for c in own if c != "structured"], structured.alias("structured"))


def summary_lines(totals: Column, page: Column) -> Column:
    """Lines where totals stand: the totals block, the page's lower half and its last 20 lines; each once."""
    lines = filled_lines(page)
    half = F.slice(lines, F.floor(F.size(lines) / 2).cast("int") + 1, F.greatest(F.size(lines), F.lit(1)))
    tail = F.slice(lines, F.greatest(F.size(lines) - 19, F.lit(1)), 20)
    return F.array_distinct(F.transform(F.concat(filled_lines(totals), half, tail), lambda x: F.regexp_replace(x, r"\s+", " ")))


# --- pages -------------------------------------------------------------------------------------------------------


def extract(pages: DataFrame, account: Column | None = None) -> DataFrame:
    """pages (with page_text) with the fields that labels on the page give: supplier_name, invoice_number, invoice_date,
    net_amount, vat_amount, total_amount, currency, items (array) and description; structured totals override labels.
    A null text is empty and gives nulls and the default description."""
    own = [c for c in pages.columns if c != "page_text"]
    found = F.coalesce("page_text", F.lit(""))
    labelled = lambda labels: first_match(found, [x + CURRENCY + NUMBER for x in labels])
    df = with_structured_totals(with_supplier(pages, account=account))
    df = df.withColumn("items", item_lines(filled_lines(found)))
    # Raw texts are columns of their own, so that the parsers, which look at them many times, do not search again.
    df = df.withColumns({"__no": first_match(found, INVOICE_NUMBER), "__date": first_match(found, INVOICE_DATE), "__net": labelled(NET), "__vat": labelled(VAT), "__total": labelled(TOTAL)})
    better = lambda name, raw: F.coalesce(F.col("structured")[name], money.parse_amount(F.col(raw))).alias(name)
    return df.select(
        *own, "page_text", "supplier_name", F.when(~fields.suspicious_number(F.col("__no")), F.col("__no")).alias("invoice_number"), dates.parse_date(F.col("__date"))["normalized"].alias("invoice_date"),
        better("net_amount", "__net"), better("vat_amount", "__vat"), better("total_amount", "__total"), F.col("structured.deposit_candidate").alias("deposit_candidate"), text.currency(found).alias("currency"), "items", description(F.col("items")).alias("description"),
    )


def total_from_net(rows: DataFrame) -> DataFrame:
    """A row with net but neither total nor VAT has its net as total."""
    untaxed = F.col("total_amount").isNull() & F.col("vat_amount").isNull()
    return rows.withColumn("total_amount", F.when(untaxed, F.col("net_amount")).otherwise(F.col("total_amount")))


def evidence(rows: DataFrame) -> DataFrame:
    """rows with header_raw (12 lines), totals_raw (the last 10) and page_text_raw (20,000 characters)."""
    lines = F.split(F.coalesce("page_text", F.lit("")), r"\R")
    return rows.withColumns({"header_raw": F.array_join(F.slice(lines, 1, 12), "\n"), "totals_raw": F.array_join(F.slice(lines, F.greatest(F.size(lines) - 9, F.lit(1)), 10), "\n"), "page_text_raw": F.substring("page_text", 1, 20_000)})


def line_rows(pages: DataFrame, tolerance: str = "0.05") -> DataFrame:
    """A row for each item of a page (line_no from 1), with its last amount as net and total and no VAT; a page without
    items keeps its one row. Lines whose sum misses the page's total by more than the tolerance all ask for review."""
    own = [c for c in pages.columns if c not in ("items", "description", "net_amount", "vat_amount", "total_amount")]
    last = lambda x: F.try_element_at(F.regexp_extract_all(x, F.lit(fields.MONEY_TOKEN), F.lit(1)), F.lit(-1))
    tokens = F.transform("items", lambda x: F.struct(x.alias("line"), last(x).alias("token")))
    df = pages.withColumn("__i", F.transform(tokens, lambda x: F.struct(x["line"].alias("line"), money.parse_amount(x["token"]).alias("v"))))
    df = df.withColumn("__sum", F.aggregate("__i", F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + F.coalesce(x["v"], F.lit(0).cast(MONEY))).cast("decimal(18,2)")))
    off = F.exists("__i", lambda x: x["v"].isNotNull()) & (F.abs(F.col("__sum") - F.col("total_amount")) > F.lit(tolerance).cast(MONEY))
    df = df.withColumn("mismatch", F.coalesce(off, F.lit(False)))
    rows = df.select("*", F.posexplode_outer("__i").alias("__k", "__x"))
    v = F.col("__x.v")
    return rows.select(
        *own, (F.col("__k") + 1).alias("line_no"), F.coalesce(text.first_words(F.col("__x.line")), F.col("description")).alias("description"), F.coalesce(v, F.col("net_amount")).alias("net_amount"),
        F.when(v.isNotNull(), F.lit(0).cast(MONEY)).otherwise(F.col("vat_amount")).alias("vat_amount"), F.coalesce(v, F.col("total_amount")).alias("total_amount"), "mismatch",
    )


def structured_rows(pages: DataFrame, tolerance: str = "0.10") -> DataFrame:
    """A row for each entry of a page's `structured` items (array of description, quantity, unit_price, net_amount,
    tax_amount), line_no from 1: the item's net and tax as the row's, where it has a net. All rows of a page whose items
    miss its total by more than the tolerance ask for review (mismatch). A page without items keeps its one row."""
    own = [c for c in pages.columns if c not in ("structured", "description", "line_items_raw", "net_amount", "vat_amount", "total_amount")]
    zero = F.lit(0).cast(MONEY)
    total = F.aggregate(F.coalesce("structured", F.array()), F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + F.coalesce(x["net_amount"], zero)).cast("decimal(18,2)"))
    off = (F.size("structured") > 0) & (F.abs(total - F.col("total_amount")) > F.lit(tolerance).cast(MONEY))
    rows = pages.withColumn("mismatch", F.coalesce(off, F.lit(False))).select("*", F.posexplode_outer("structured").alias("__k", "__x"))
    x, some = F.col("__x"), F.col("__k").isNotNull()
    title = F.coalesce(F.nullif(text.first_words(F.trim(F.coalesce(x["description"], F.lit("")))), F.lit("")), F.nullif("description", F.lit("")), F.lit("Invoice line"))
    shown = lambda name, sign: F.when(x[name].isNotNull(), F.concat(F.lit(sign), x[name].cast("string")))
    raw = F.concat_ws("  ", title, shown("quantity", "Qty: "), shown("unit_price", "@ "), shown("net_amount", "= "))
    net, vat = x["net_amount"], F.coalesce(x["tax_amount"], zero)
    has = some & net.isNotNull()
    pick = lambda then, c: F.when(has, then).otherwise(F.col(c)).cast(MONEY).alias(c)
    return rows.select(
        *own, (F.col("__k") + 1).alias("line_no"), F.when(some, title).otherwise(F.col("description")).alias("description"), F.when(some, raw).otherwise(F.col("line_items_raw")).alias("line_items_raw"),
        pick(net, "net_amount"), pick(vat, "vat_amount"), pick(net + vat, "total_amount"), "mismatch",
    )
