"""Personal data: patterns for what identifies by itself, and corpus statistics for the words that give it away.

Everything is DataFrame and SQL functions. Four kinds of protected entities are found by patterns. Then the words near
them are weighed: how often a word stands near one entity, or near entities of a kind, against how often it stands
anywhere, is the pointwise mutual information between word and entity, or kind; as a share of the entity's or kind's own
information it says how far the word discloses it, and the largest share counts. Words above a threshold are generalised,
words above a higher one removed, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_or_empty, written

#: Kinds in their order, with what a text must hold before the pattern is tried. The patterns are written so that Java
#: neither recurses nor backtracks over long runs; each finds the same matches as the plain one beside it.
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?=\.[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # [0-9]([ -]?[0-9])+
    "card": (r"[0-9][ -]?[0-9]", r"[0-9](?:(?![ -](?![0-9]))[0-9 -])*+"),
    # \+[0-9][ ().0-9-]+[0-9]
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: Characters before and after an entity in which a word counts as near it.
NEAR = 48
WORD = r"\p{L}{2,}"
#: Places away from entities that every word is taken to have besides its own, so that a few places tell less than many.
SMOOTH = 1.0
#: Bits of the filter that leaves most words out before those that disclose are joined.
BITS = 22
#: Shares of the information from which a word is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.9, 0.99

SPANS = "array<struct<kind:string,start:int,end:int>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for a row."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each value, all values before it joined, beginning with zero. Values are taken in runs of about the root of
    their number, first the runs as wholes and then each within itself, as a list that grows is copied at every step."""

    def steps(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def within(v: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(v, k * n + 1, n))
        return let(parts, lambda p: F.flatten(F.zip_with(p, steps(F.transform(p, lambda x: F.aggregate(x, zero, join)), zero), steps)))

    return let(values, within)


def located(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, found) of the matches of pattern in text, in characters, end exclusive."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("s"))

    def places(p: Column) -> Column:
        sizes = F.transform(p["m"], lambda m, k: F.length(F.get(p["s"], k)) + F.length(m))
        before = running(sizes, F.lit(0), lambda a, x: a + x)

        def one(at: Column, k: Column) -> Column:
            first = at + F.length(F.get(p["s"], k))
            return F.struct(first.alias("start"), (first + F.length(F.get(p["m"], k))).alias("end"), F.get(p["m"], k).alias("found"))

        return F.transform(before, one)

    return let(parts, places)


#: Characters of a page. A place in a text is sought in its page, not from the text's beginning.
PAGE = 4096


def pages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}+"), F.lit(0))


def stretch(of: Column, first: Column, last: Column) -> Column:
    """The characters from first to last of a text, given its pages; from the end of the text on there are none."""
    page = lambda at: F.floor(at / PAGE).cast("int")
    own = lambda k: F.coalesce(F.get(of, k), F.lit(""))
    one = F.substring(own(page(first)), first % PAGE + 1, last - first)
    between = F.array_join(F.slice(of, page(first) + 2, F.greatest(page(last) - page(first) - 1, F.lit(0))), "")
    many = F.concat(F.substring(own(page(first)), first % PAGE + 1, F.lit(PAGE)), between, F.substring(own(page(last)), F.lit(1), last % PAGE))
    return F.when(last <= first, "").when(page(first) == page(last), one).otherwise(many)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _holds(kind: str, found: Column) -> Column:
    """Whether a match is an entity of its kind."""
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (F.lpad(q, 3, "0") <= "255")))
    if kind == "card":
        return let(_digits(found), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end) of the entities in text: by kind as listed, then by start."""
    none = F.array().cast(SPANS)

    def of(kind: str) -> Column:
        needs, pattern = KINDS[kind]
        good = F.filter(located(text, pattern), lambda x: _holds(kind, x["found"]))
        return F.when(F.contains(text, F.lit("@")) if kind == "email" else text.rlike(needs), F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).otherwise(none)

    return F.concat(*map(of, KINDS))


def near_words(text: Column, spans: Column, near: int = NEAR) -> Column:
    """Array of (kind, entity, word, start, end): the words, lower-case, wholly inside the `near` characters before or
    after a span, with their places in text; entity is a hash of the span's own text."""

    def around(s: Column, of: Column) -> Column:
        first = F.greatest(s["start"] - near - 1, F.lit(0))
        before, after = stretch(of, first, s["start"]), stretch(of, s["end"], s["end"] + near + 1)
        whole_before = F.filter(located(before, WORD), lambda w: (w["start"] > 0) | (first == 0))
        whole_after = F.filter(located(after, WORD), lambda w: (w["end"] <= near) & (w["start"] > 0))
        entity = F.xxhash64(stretch(of, s["start"], s["end"]))
        one = lambda w, at: F.struct(s["kind"].alias("kind"), entity.alias("entity"), F.lower(w["found"]).alias("word"), (w["start"] + at).alias("start"), (w["end"] + at).alias("end"))
        return F.concat(F.transform(whole_before, lambda w: one(w, first)), F.transform(whole_after, lambda w: one(w, s["end"])))

    return let(pages(text), lambda of: F.flatten(F.transform(spans, lambda s: around(s, of))))


def row_key() -> Column:
    """Two hashes of a row's doc_id and text, so that no two rows meet by chance."""
    return F.struct(F.xxhash64("doc_id", text_or_empty()).alias("a"), F.xxhash64(F.lit(1), text_or_empty(), "doc_id").alias("b"))


def disclosing(near: DataFrame, docs: DataFrame, smooth: float = SMOOTH, generalise: float = GENERALISE) -> DataFrame:
    """(word, disclosure) of the words that disclose an entity or a kind. near: kind, entity, word, one row for each
    place; docs: all texts, over which words are counted."""
    words = F.explode(F.transform(F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0)), F.lower))
    seen = written(near.groupBy("word", "kind", "entity").agg(F.count("*").alias("n_near")), "near")
    # Tables of their own, so that the joins' sides are plain exchanges, which Spark splits where a key is hot.
    counts = written(docs.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n").alias("total"))  # one row
    of_entity = written(seen.groupBy("kind", "entity").agg(F.sum("n_near").alias("of")), "entities")
    of_kind = F.broadcast(of_entity.groupBy("kind").agg(F.sum("of").alias("of")))  # one row for each kind
    entities = seen.join(of_entity, ["kind", "entity"]).select("word", "n_near", "of")
    kinds = seen.groupBy("word", "kind").agg(F.sum("n_near").alias("n_near")).join(of_kind, "kind").select("word", "n_near", "of")
    known = written(entities.unionByName(kinds), "known").join(counts, "word").join(F.broadcast(total), F.lit(True))
    known = known.withColumn("p", F.col("of") / F.col("total")).withColumn("share", F.least(F.lit(1.0), F.col("n_near") / (F.col("n") + smooth)))
    known = known.withColumn("disclosure", F.when(F.col("p") < 1, F.log2(F.col("share") / F.col("p")) / -F.log2("p")))
    return known.where(F.col("disclosure") >= generalise).groupBy("word").agg(F.max("disclosure").alias("disclosure"))


def filter_of(hashes: DataFrame, bits: int = BITS) -> DataFrame:
    """One row with `bits`, an array of 2**bits bits as longs: those at the hashes `h` are set."""
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    held = [0] * (1 << bits - 6)
    for r in hashes.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("int").alias("at")).agg(F.bit_or(one).alias("own")).toLocalIterator():  # 65,536 rows at most
        held[r["at"]] = r["own"]
    return hashes.sparkSession.createDataFrame([(held,)], "bits array<long>")


def likely(rows: DataFrame, h: Column, hashes: DataFrame) -> DataFrame:
    """The rows whose hash h is among the hashes `h`, and a few more: what a join with them needs to see. The filter has a
    fixed size; where there are too many hashes for it, all rows stay."""
    columns = rows.columns
    slot = F.col("__slot")
    some = F.call_function("bit_get", F.get(F.col("bits"), (slot / 64).cast("int")), (slot % 64).cast("int")) == 1
    return rows.withColumn("__slot", h.bitwiseAND(F.lit((1 << BITS) - 1))).join(F.broadcast(filter_of(hashes)), F.lit(True)).where(some).select(*columns)


def term_spans(found: DataFrame, docs: DataFrame, near: int = NEAR, smooth: float = SMOOTH, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(key, terms): for each row key with any, the places of its disclosing words as kind `term`, or `drop` where they
    are to be removed, by kind and start. found: key and near (the array of near_words) of the rows with entities;
    docs: all rows, in each of which the words are looked for."""
    around = found.select("key", F.explode("near").alias("w")).select("w.*")
    told = written(disclosing(around, docs, smooth, generalise), "told")
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))))
    texts = docs.select(row_key().alias("key"), text_or_empty().alias("text"))
    forms = likely(texts.select("key", word.alias("form")), F.xxhash64(F.lower("form")), told.select(F.xxhash64("word").alias("h"))).select("key", F.lower("form").alias("word"), "form")
    forms = written(forms, "forms").join(told, "word").groupBy("key").agg(F.collect_set(F.struct("form", "disclosure")).alias("forms"))
    every = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.col("forms.form"), "|"), F.lit(r")(?!\p{L})"))
    known = written(forms, "told-in")
    # Few texts have such words, so the others are kept from the join, which may move its texts.
    told_in = likely(texts, F.col("key.a"), known.select(F.col("key.a").alias("h"))).join(known, "key").withColumn("of", F.map_from_entries("forms")).withColumn("pattern", every)
    kind = lambda x: F.when(F.col("of")[x["found"]] >= remove, "drop").otherwise("term")
    places = F.transform(located(F.col("text"), F.col("pattern")), lambda x: F.struct(F.when(F.col("of")[x["found"]] >= remove, 1).otherwise(0).alias("o"), x["start"].alias("start"), x["end"].alias("end"), kind(x).alias("kind")))
    return told_in.select("key", F.transform(F.array_sort(places), lambda x: F.struct(x["kind"].alias("kind"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))).cast(SPANS).alias("terms")).dropDuplicates(["key"])


def find(docs: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, key, spans, terms) for every row of docs: the base spans, and the places of disclosing words.

    A null text is empty; rows that repeat have the same result each; rows with a null doc_id take part; an empty table
    gives no rows; other columns are ignored, whatever their names. key is made of hashes of doc_id and text. Time grows
    with the length of a text, and with its matches to the power of 1.5.
    """
    own = docs.select("doc_id", "text")
    spans = own.select("doc_id", row_key().alias("key"), text_or_empty().alias("text")).withColumn("spans", base_spans(F.col("text")))
    found = written(spans.select("doc_id", "key", "spans", F.when(F.size("spans") > 0, near_words(F.col("text"), F.col("spans"), int(limits.get("near", NEAR)))).alias("near")), "personal")
    terms = term_spans(found.where("near is not null"), own, **limits)
    outside = F.filter("terms", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return found.select("doc_id", "key", "spans").join(terms, "key", "left").select("doc_id", "key", "spans", F.coalesce(outside, F.array().cast(SPANS)).alias("terms"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms for every row of docs."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs).select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.concat("spans", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def replaced(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets, `drop` by nothing; of spans that overlap, the first to start
    names what is put in their place."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def made(own: Column) -> Column:
        s, of, before = own["s"], own["of"], own["before"]
        first = F.filter(F.zip_with(s, before, lambda x, at: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), at.alias("at"))), lambda x: x["start"] >= x["at"])
        mark = lambda x: F.when(x["kind"] == "drop", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        parts = F.transform(first, lambda x: F.concat(stretch(of, x["at"], x["start"]), mark(x)))
        return F.concat(F.array_join(parts, ""), stretch(of, F.array_max(F.transform(s, lambda x: x["end"])), F.size(of) * PAGE))

    reach = lambda s: running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
    return let(order, lambda s: let(F.struct(s.alias("s"), pages(text).alias("of"), reach(s).alias("before")), made))


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """docs with entities and disclosing words taken out of text; all rows stay, columns as they were, null texts null."""
    terms = find(docs, **limits).where("size(terms) > 0").select(F.col("key").alias("__of"), F.col("terms").alias("__terms")).dropDuplicates(["__of"])
    spanned = docs.withColumn("__spans", base_spans(text_or_empty())).withColumn("__key", row_key()).join(terms, F.col("__key") == F.col("__of"), "left")
    every = F.concat("__spans", F.coalesce("__terms", F.array().cast(SPANS)))
    return spanned.withColumn("text", F.when(F.size(every) > 0, replaced(F.col("text"), every)).otherwise(F.col("text"))).select(*docs.columns)
