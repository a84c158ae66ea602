"""Many patterns in text: which of an ordered list of aliases does a text hold?

The aliases build an Aho-Corasick automaton, through which a text runs once however many aliases there are. Of those that
it holds the first in order counts. The plan is the same for one alias and for a million.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.shared import observed, stored

#: Bytes of aliases in one automaton. More go in several passes, so that a task holds no more than one.
LIMIT = 32 << 20
#: Rows of a scope that meet its aliases in one task.
ROWS = 20_000

# Brands and goods, and the kind of account that each belongs to. The first in order counts.
BRANDS = [
    ("rothmans", "Tobacco"), ("pall mall", "Tobacco"), ("du maurier", "Tobacco"), ("lucky strike", "Tobacco"), ("benson & hedges", "Tobacco"), ("benson and hedges", "Tobacco"), ("marlboro", "Tobacco"), ("dunhill", "Tobacco"),
    ("parliament", "Tobacco"), ("chesterfield", "Tobacco"), ("winston cigarette", "Tobacco"), ("camel cigarette", "Tobacco"), ("royals cigarette", "Tobacco"),
    ("heineken", "Alcohol"), ("carlsberg", "Alcohol"), ("amstel", "Alcohol"), ("corona beer", "Alcohol"), ("guinness", "Alcohol"), ("peroni", "Alcohol"), ("cisk", "Alcohol"), ("hopleaf", "Alcohol"), ("jack daniel", "Alcohol"),
    ("johnnie walker", "Alcohol"), ("absolut vodka", "Alcohol"), ("baileys", "Alcohol"),
    ("coca cola", "Beverages"), ("coke zero", "Beverages"), ("pepsi cola", "Beverages"), ("fanta", "Beverages"), ("sprite", "Beverages"), ("ribena", "Beverages"), ("monster energy", "Beverages"), ("red bull", "Beverages"),
    ("lucozade", "Beverages"), ("7up", "Beverages"), ("kinnie", "Beverages"), ("san pellegrino", "Beverages"), ("acqua panna", "Beverages"), ("evian", "Beverages"),
    ("bigilla", "Food"), ("baguette", "Food"), ("ftira", "Food"), ("olive oil", "Food"), ("catering supplies", "Food"), ("fresh seafood", "Food"), ("fresh produce", "Food"),
]

_built: dict[str, object] = {}


def automaton(pairs: Iterable[tuple[str, int]], name: str | None = None):  # noqa: ANN201
    """The automaton of (alias, ord), where an alias has its least ord; a worker keeps the last one that has a name."""
    import ahocorasick

    if name in _built:
        return _built[name]
    made = ahocorasick.Automaton()
    for alias, ord_ in pairs:
        known = made.get(alias, None)
        made.add_word(alias, ord_ if known is None else min(known, ord_))
    made.make_automaton()
    if name is not None:
        _built.clear()
        _built[name] = made
    return made


def first_in(found: object, text: str | None) -> int | None:
    return min((ord_ for _, ord_ in found.iter(text)), default=None) if text and len(found) else None


def entries(spark: SparkSession, listed: list[tuple[str, list[str]]]) -> DataFrame:
    """(ord, alias, label) of a list of (label, aliases): labels in order, and longer aliases first."""
    pairs = [(alias, label) for label, aliases in listed for alias in sorted(aliases, key=len, reverse=True)]
    return spark.createDataFrame([(k, *x) for k, x in enumerate(pairs)], "ord long, alias string, label string")


def brands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *x) for k, x in enumerate(BRANDS)], "ord long, alias string, label string")


def labelled(rows: DataFrame, text: Column, listed: DataFrame, name: str = "label", limit: int = LIMIT) -> DataFrame:
    """rows with the label of the first of listed (ord, alias, label) that the text holds, in any case; null where it holds
    none, or is null. ord is unique; a blank or null alias is none; all rows stay, repeated ones too."""
    own = listed.where("alias <> ''").select("ord", F.lower("alias").alias("alias"))
    aliases, size = observed(own, "aliases", bytes=F.sum(F.octet_length("alias")))
    blocks = max(1, -(-(size["bytes"] or 0) // limit))
    out = rows.withColumn("__text", F.lower(text)).withColumn("__first", F.lit(None).cast("long"))
    for block in range(blocks):
        mine = aliases.where(F.pmod(F.xxhash64("alias"), F.lit(blocks)) == block)
        known = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.select("alias", "ord").collect()])  # about `limit` bytes
        out = out.withColumn("__first", F.least("__first", _finder(known)("__text")))
        if blocks > 1:
            out = stored(out, "labelled")
            known.unpersist()
    names = listed.select(F.col("ord").alias("__first"), F.col("label").alias("__label"))
    return out.join(names, "__first", "left").select(*[F.col(c) for c in rows.columns if c != name], F.col("__label").alias(name))


def _finder(known):  # noqa: ANN001, ANN202
    name = uuid.uuid4().hex

    @F.pandas_udf("long")
    def find(text: pd.Series) -> pd.Series:
        found = automaton(known.value, name)
        return pd.Series([first_in(found, t) for t in text], dtype="Int64")

    return find


def labelled_within(rows: DataFrame, text: str, listed: DataFrame, scope: list[str], name: str = "label", most: int = ROWS) -> DataFrame:
    """As `labelled`, for the column `text`, where every scope has a list of its own: listed (scope, ord, alias, label). The
    distinct texts of a scope are dealt to groups of about `most`, each of which meets the scope's list, which is to fit a
    task; rows of a scope without a list have no label."""
    texts = rows.where(F.col(text) != "").select(*scope, F.col(text).alias("__text")).distinct()
    counts = texts.groupBy(*scope).agg(F.ceil(F.count("*") / most).cast("int").alias("__parts"))
    dealt = texts.join(counts, scope).select(*scope, F.pmod(F.xxhash64("__text"), F.col("__parts")).cast("int").alias("__part"), "__text", F.lower("__text").alias("__low"))
    own = listed.where("alias <> ''").join(counts, scope).select(*scope, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), "ord", F.lower("alias").alias("alias"), "label")
    schema = T.StructType([*(dealt.schema[c] for c in (*scope, "__text")), T.StructField("__label", T.StringType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        orders = right.column("ord").to_pylist()
        found, labels = automaton(zip(right.column("alias").to_pylist(), orders)), dict(zip(orders, right.column("label").to_pylist()))
        told = [labels.get(first_in(found, t)) for t in left.column("__low").to_pylist()]
        return left.select([*scope, "__text"]).append_column("__label", pa.array(told, pa.string()))

    keys = [*scope, "__part"]
    met = dealt.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(run, schema).where("__label is not null")
    out = rows.withColumn("__text", F.col(text)).join(met, [*scope, "__text"], "left")
    return out.select(*[F.col(c) for c in rows.columns if c != name], F.col("__label").alias(name))
