"""Suppliers and accounts: which master row a name or a text belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import matching, patterns
from ledgerloom.shared import observed

#: Distinct sets of words whose patterns are counted in one task.
SETS = 20_000


def exact_match(names: DataFrame, masters: DataFrame) -> DataFrame:
    """names (name, vat) with the master (ord, canonical, vat) of the same VAT number, else of the same name in any case;
    of several the one with the smallest ord."""
    own = names.select("name", "vat").distinct()
    by_vat = own.join(masters.select("ord", "canonical", text.vat_key(F.col("vat")).alias("k")), text.vat_key(F.col("vat")) == F.col("k")).select("name", "vat", F.struct(F.lit(0).alias("tier"), "ord", "canonical").alias("m"))
    by_name = own.join(masters.select("ord", "canonical", F.lower("canonical").alias("k")), F.lower("name") == F.col("k")).select("name", "vat", F.struct(F.lit(1).alias("tier"), "ord", "canonical").alias("m"))
    best = by_vat.unionByName(by_name).groupBy("name", "vat").agg(F.min("m").alias("m")).withColumnsRenamed({"name": "__n", "vat": "__v"})
    joined = own.join(best, F.col("name").eqNullSafe(F.col("__n")) & F.col("vat").eqNullSafe(F.col("__v")), "left")
    return joined.select("name", "vat", "m.canonical", "m.tier")


def overlap_match(names: DataFrame, masters: DataFrame, least: float = 0.5) -> DataFrame:
    """Each distinct name with the master that shares the largest share of its words, if at least `least`; ties to the
    smaller ord. Candidates meet on a rare shared word, so a frequent one pairs nothing by itself."""
    own = names.select("name").distinct().select(F.col("name").alias("a"), text.key_words(F.col("name")).alias("wa"))
    known = masters.select("ord", "canonical", text.key_words(F.col("canonical")).alias("wb"))
    pairs = matching.sharing(own, known.select(F.col("canonical").alias("b"), "wb").distinct(), [], least)
    best = pairs.join(known.select("ord", F.col("canonical").alias("b")), "b").groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", F.col("b").alias("canonical"), "score")).alias("m"))
    return best.select(F.col("a").alias("name"), "m.canonical", "m.score")


def learn_patterns(headers: DataFrame, most: int = 60) -> DataFrame:
    """For each supplier the alphabetically first `most` keywords of its headers, and how many headers there were."""
    words = headers.select("supplier_name", F.explode(text.keywords(F.col("header"))).alias("w")).distinct()
    ranked = words.withColumn("n", F.row_number().over(Window.partitionBy("supplier_name").orderBy("w"))).where(F.col("n") <= most)
    keys = ranked.groupBy("supplier_name").agg(F.array_sort(F.collect_list("w")).alias("keywords"))
    hits = headers.groupBy("supplier_name").agg(F.count("*").alias("hit_count"))
    return hits.join(keys, "supplier_name", "left")


#: Words of headers that tell no supplier.
HEADER_WORDS = [
    "the", "and", "of", "for", "a", "an", "in", "on", "at", "to", "by", "is", "are", "was", "with", "from", "that", "this", "ltd", "limited", "plc", "invoice", "date", "page", "number", "vat", "tax", "total", "amount",
    "description", "quantity", "price", "unit", "subtotal", "balance", "ref", "your", "our", "due", "paid", "name", "address", "account",
]


def merged_patterns(stored: DataFrame, headers: DataFrame, seen: str, most: int = 60, least: int = 3) -> DataFrame:
    """stored (supplier_name, keywords: array, hit_count, last_seen: date) after new headers (supplier_name, header): the
    alphabetically first `most` words of both, a hit for each header with at least `least` words, and the day `seen`.
    Keeping the first words of a union is the same in whatever order headers come."""
    words = headers.select("supplier_name", text.keywords(F.col("header"), HEADER_WORDS).alias("w")).where(F.size("w") >= least)
    hits = words.groupBy("supplier_name").agg(F.count("*").alias("__hits"))
    every = words.select("supplier_name", F.explode("w").alias("w")).unionByName(stored.join(hits.select("supplier_name"), "supplier_name", "left_semi").select("supplier_name", F.explode("keywords").alias("w"))).distinct()
    ranked = every.withColumn("n", F.row_number().over(Window.partitionBy("supplier_name").orderBy("w"))).where(F.col("n") <= most)
    fresh = ranked.groupBy("supplier_name").agg(F.array_sort(F.collect_list("w")).alias("__keywords")).join(hits, "supplier_name")
    joined = stored.join(fresh, "supplier_name", "full")
    return joined.select("supplier_name", F.coalesce("__keywords", "keywords").alias("keywords"), (F.coalesce("hit_count", F.lit(0)) + F.coalesce("__hits", F.lit(0))).alias("hit_count"), F.when(F.col("__hits").isNotNull(), F.lit(seen).cast("date")).otherwise(F.col("last_seen")).alias("last_seen"))


def match_patterns(headers: DataFrame, patterns: DataFrame, shared: int = 3, share: float = 0.5) -> DataFrame:
    """Each header (id, header) with the supplier whose pattern it covers best: at least `shared` words and `share` of it. Where
    patterns have is_active, those of suppliers that are not take no part."""
    patterns = patterns.where("is_active") if "is_active" in patterns.columns else patterns
    own = headers.select("id", F.array_sort(text.keywords(F.col("header"))).alias("set"))
    # Headers of the same words are matched once, and so many of the sets in one task that its counts stay small.
    sets, seen = observed(own.select("set").where(F.size("set") >= shared).distinct(), "keyword-sets", n=F.count("*"))
    dealt = sets.repartition(max(1, -(-seen["n"] // SETS)), "set")
    known = patterns.select("supplier_name", F.size("keywords").alias("size"), F.explode("keywords").alias("w"))
    counts = dealt.select("set", F.explode("set").alias("w")).join(known, "w").groupBy("set", "supplier_name").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    fine = counts.where((F.col("n") >= shared) & (F.col("n") >= F.col("size") * share))
    best = fine.groupBy("set").agg(F.min(F.struct((-F.col("n") / F.col("size")).alias("s"), "supplier_name", "n")).alias("m"))
    return own.join(best, "set").select("id", "m.supplier_name", "m.n")


def taxonomy(rows: DataFrame, entries: DataFrame | list[tuple[str, list[str]]]) -> DataFrame:
    """rows with `category`: that of the first entry one of whose aliases the text holds, categories in order and longer
    aliases first. entries: (ord, alias, label), or a list of categories and aliases."""
    listed = entries if isinstance(entries, DataFrame) else patterns.entries(rows.sparkSession, entries)
    return patterns.labelled(rows, F.coalesce("description", F.lit("")), listed, "category")
