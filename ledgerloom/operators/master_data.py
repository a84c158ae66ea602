"""Master data by commands: which of a set of new rows may be added, given the table and each other.

Commands count in the order of their seq. One is admitted if no row of the table has one of its keys, and no admitted
command before it has. A rejected command takes no key, so which ones are admitted follows from all before; it is found
in rounds over all commands at once: of those still open, the first for each of its keys is admitted, and those that
share a key with an admitted one are rejected. Every round settles at least the first open command of every key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.shared import dropped, observed, stored


def key_of(*columns: str) -> Column:
    """A key over columns, in any case and without blanks at the ends; null, and so no key, if the last one is blank."""
    plain = [F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns]
    return F.when(plain[-1] != "", F.to_json(F.struct(*[x.alias(f"k{n}") for n, x in enumerate(plain)])))


def admitted(commands: DataFrame, keys: list[Column], table: DataFrame) -> DataFrame:
    """commands (seq, ...) with outcome: admitted, `taken` by a row of the table, or `taken in the batch` by a command before it.
    keys: over columns that table has too; a null key is none."""
    named = lambda df: F.explode(F.array_compact(F.array(*[F.when(k.isNotNull(), F.concat(F.lit(f"{n}:"), k)) for n, k in enumerate(keys)])))  # noqa: E731, ARG005
    every = stored(commands.select("seq", named(commands).alias("key")), "keys")
    held = table.select(named(table).alias("key")).distinct()
    taken = stored(every.join(held, "key", "left_semi").select("seq").distinct(), "taken")
    open_ = every.join(taken, "seq", "left_anti")
    wins: list[DataFrame] = []
    while True:
        first = open_.groupBy("key").agg(F.min("seq").alias("first"))
        ranked = open_.join(first, "key").groupBy("seq").agg(F.min(F.col("seq") == F.col("first")).alias("wins"))
        won, seen = observed(ranked.where("wins").select("seq"), "admitted", n=F.count("seq"))
        if not seen["n"]:
            break
        wins.append(won)
        gone = open_.join(won, "seq", "left_semi").select("key").distinct()
        lost = open_.join(gone, "key", "left_semi").select("seq").distinct()
        after = stored(open_.join(lost, "seq", "left_anti"), "open")
        if hasattr(open_, "stored_at"):
            dropped(open_)
        open_ = after
    unkeyed = commands.select("seq").join(every.select("seq").distinct(), "seq", "left_anti")
    good = reduce(DataFrame.unionByName, [*wins, unkeyed]).withColumn("__good", F.lit(True))
    told = commands.join(good, "seq", "left").join(taken.withColumn("__taken", F.lit(True)), "seq", "left")
    outcome = F.when(F.col("__good"), "admitted").when(F.col("__taken"), "taken").otherwise("taken in the batch")
    return told.select(*commands.columns, outcome.alias("outcome"))


def linked(commands: DataFrame, links: str, table: DataFrame, key: str) -> DataFrame:
    """commands (seq, links: array) with `linked`: whether the table has every one of the links, by their number."""
    wanted = commands.select("seq", F.explode(F.array_distinct(links)).alias("__link"))
    found = wanted.join(table.select(F.col(key).alias("__link")).distinct(), "__link").groupBy("seq").agg(F.count("*").alias("__n"))
    return commands.join(found, "seq", "left").select(*commands.columns, (F.coalesce("__n", F.lit(0)) == F.size(F.array_distinct(F.coalesce(links, F.array().cast("array<string>"))))).alias("linked"))


def mirrored(rows: DataFrame, a: str = "supplier_account_code", b: str = "posting_account") -> DataFrame:
    """rows whose two account codes stand in for each other where one is blank."""
    full = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return rows.withColumns({a: F.coalesce(full(a), full(b)), b: F.coalesce(full(b), full(a))})


def created(table: DataFrame, commands: DataFrame, keys: list[Column], required: tuple[str, ...] = (), enums: dict[str, list[str]] | None = None, links: str | None = None, link_table: DataFrame | None = None, link_key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(outcomes, table) after commands to add rows: rejected where a required field is blank, a field has a value that it may
    not have, or a link leads nowhere; else as `admitted` says. Rejected commands take no key."""
    bar = F.lit(None).cast("string")
    for field, values in reversed((enums or {}).items()):
        bar = F.when(F.col(field).isNotNull() & ~F.col(field).isin(values), f"rejected: {field} has no such value").otherwise(bar)
    for field in reversed(required):
        bar = F.when(F.coalesce(F.trim(F.col(field)), F.lit("")) == "", f"rejected: {field} is blank").otherwise(bar)
    judged = commands.withColumn("__bar", bar)
    if links is not None and link_table is not None:
        judged = linked(judged, links, link_table, link_key).withColumn("__bar", F.coalesce("__bar", F.when(~F.col("linked"), f"rejected: {links} lead nowhere"))).drop("linked")
    judged = stored(judged, "commands")
    told = admitted(judged.where("__bar is null").drop("__bar"), keys, table).unionByName(judged.where("__bar is not null").withColumnRenamed("__bar", "outcome"))
    kinds = dict(table.dtypes)
    have = [F.col(c).cast(kinds[c]).alias(c) if c in commands.columns else F.lit(None).cast(kinds[c]).alias(c) for c in table.columns]
    return told, table.unionByName(told.where("outcome = 'admitted'").select(*have))
