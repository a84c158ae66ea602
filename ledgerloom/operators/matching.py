"""Names to master names: containment and shared words as equi-joins that keep every pair they should.

Neither compares all pairs, and neither drops a frequent word or piece. Where all pairs are asked for, a pair meets on the
rarest thing it must share. Where only the best master of a name is, names meet posting lists: for every set of words that
masters share, and every number of words of a master, the least `ord`; so a word that half of all names have costs a row
for each name, and no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.shared import observed

#: Names of more words meet by their rarest words: their sets of words would be too many.
SHORT = 6
#: The score of a name that holds the other one, and the least share of words that counts.
CONTAINED, LEAST = 0.85, 0.5


def _pieces(name: Column, n: int) -> Column:
    """All stretches of n characters of a name, once each."""
    cut = F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(name, i, F.lit(n)))
    return F.when(F.length(name) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def within(inner: DataFrame, outer: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, a, b): every a of inner (scope, a) that is a part of a b of outer (scope, b), character by character.

    A part's rarest stretch of three characters (or itself, if shorter) must be in the whole, so they meet on that one.
    """
    parts = outer.where("b <> ''").select(*scope, "b", F.explode(F.concat(*[_pieces(F.col("b"), n) for n in (1, 2, 3)])).alias("piece"))
    often = parts.groupBy(*scope, "piece").agg(F.count("*").alias("n"))
    own = F.when(F.length("a") >= 3, _pieces(F.col("a"), 3)).otherwise(F.array("a"))
    keys = inner.where("a <> ''").select(*scope, "a", F.explode(own).alias("piece")).join(often, [*scope, "piece"], "left")
    rarest = keys.groupBy(*scope, "a").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("k")).where("k.n > 0").select(*scope, "a", F.col("k.piece").alias("piece"))
    return rarest.join(parts, [*scope, "piece"]).where(F.contains("b", F.col("a"))).select(*scope, "a", "b")


def sharing(left: DataFrame, right: DataFrame, scope: list[str], least: float = LEAST) -> DataFrame:
    """(scope, a, b, score) of the pairs of left (scope, a, wa) and right (scope, b, wb) that share at least `least` of the
    words of the one with more; wa and wb are distinct words.

    With words in the order of their frequency, such a pair shares one among the rarest n - ceil(least * n) + 1 of the n
    words of either, so only these are joined.
    """
    often = right.select(*scope, F.explode("wb").alias("w")).groupBy(*scope, "w").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, key: str, words: str) -> DataFrame:
        ranked = rows.select(*scope, key, words, F.explode(words).alias("w")).join(often, [*scope, "w"], "left")
        order = ranked.groupBy(*scope, key, words).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("o"))
        head = F.size(words) - F.ceil(F.size(words) * least).cast("int") + 1
        return order.select(*scope, key, words, F.explode(F.slice("o", 1, head)).alias("x")).select(*scope, key, words, F.col("x.w").alias("w"))

    met = rarest(left, "a", "wa").join(rarest(right, "b", "wb"), [*scope, "w"]).select(*scope, "a", "b", "wa", "wb").distinct()
    score = F.size(F.array_intersect("wa", "wb")) / F.greatest(F.size("wa"), F.size("wb"))
    return met.select(*scope, "a", "b", score.alias("score")).where(F.col("score") >= least)


def fuzzy(names: DataFrame, masters: DataFrame, scope: list[str], key: str, words: str, least: float = LEAST, contained: float = CONTAINED) -> DataFrame:
    """(scope, name, ord, score) of every pair of names (scope, name) and masters (scope, ord, and the columns `key`, `words`
    that names have too) by the better rule: containment of the keys either way scores `contained`, else shared words."""
    keys = names.select(*scope, F.col(key).alias("k")).distinct()
    theirs = masters.select(*scope, F.col(key).alias("k")).distinct()
    one = within(keys.withColumnRenamed("k", "a"), theirs.withColumnRenamed("k", "b"), scope)
    two = within(theirs.withColumnRenamed("k", "a"), keys.withColumnRenamed("k", "b"), scope).select(*scope, F.col("b").alias("a"), F.col("a").alias("b"))
    held = one.unionByName(two).distinct().select(*scope, "a", "b", F.lit(contained).alias("score"))
    own = lambda rows, k, w: rows.select(*scope, F.col(key).alias(k), F.col(words).alias(w)).distinct()
    shared = sharing(own(names, "a", "wa"), own(masters, "b", "wb"), scope, least).join(held, [*scope, "a", "b"], "left_anti")
    pairs = held.unionByName(shared)
    left = names.select(*scope, "name", F.col(key).alias("a")).distinct()
    right = masters.select(*scope, "ord", F.col(key).alias("b"))
    return left.join(pairs, [*scope, "a"]).join(right, [*scope, "b"]).select(*scope, "name", "ord", "score")


def _subsets(words: Column, least: float) -> Column:
    """All sets of a name's sorted words that hold at least the share `least` of them, joined by spaces, with their sizes."""
    grown = F.aggregate(words, F.array(F.array().cast("array<string>")), lambda made, w: F.concat(made, F.transform(made, lambda s: F.concat(s, F.array(w)))))
    large = F.filter(grown, lambda s: (F.size(s) > 0) & (F.size(s) >= F.size(words) * least))
    return F.transform(large, lambda s: F.struct(F.array_join(s, " ").alias("set"), F.size(s).alias("k")))


def posted(names: DataFrame, masters: DataFrame, scope: list[str], least: float = LEAST) -> DataFrame:
    """(scope, wa, ord, score) of the best master for each distinct set of words: names (scope, wa) and masters (scope, wb,
    ord), sorted words, at most `SHORT`. Sets that are equal are left out.

    The words that two names share are a set of either, so a master is found under that set at its true score, and under
    smaller ones below it; of masters of one size under one set the one with the least ord is enough.
    """
    lists = masters.select(*scope, F.size("wb").alias("nb"), "ord", F.explode(_subsets(F.col("wb"), least)).alias("x")).groupBy(*scope, "nb", F.col("x.set").alias("set")).agg(F.min("ord").alias("ord"))
    asked = names.distinct().select(*scope, "wa", F.explode(_subsets(F.col("wa"), least)).alias("x")).select(*scope, "wa", F.col("x.set").alias("set"), F.col("x.k").alias("k"))
    met = asked.join(lists, [*scope, "set"]).withColumn("score", F.col("k") / F.greatest(F.size("wa"), F.col("nb"))).where((F.col("score") >= least) & (F.col("score") < 1))
    return best(met, [*scope, "wa"])


def best_match(names: DataFrame, masters: DataFrame, scope: list[str], key: str, words: str, least: float = LEAST, contained: float = CONTAINED) -> DataFrame:
    """(scope, name, ord, score): what `best` picks from `fuzzy`, without listing pairs that only share frequent words.
    contained is above (SHORT - 1) / SHORT, so that a pair with containment never scores more by its words, but where these
    are equal."""
    own, most = observed(names.select(*scope, "name", F.col(key).alias("a"), F.array_sort(F.col(words)).alias("wa")).distinct(), "names", words=F.max(F.size("wa")))
    known, theirs_most = observed(masters.select(*scope, "ord", F.col(key).alias("b"), F.array_sort(F.col(words)).alias("wb")), "masters", words=F.max(F.size("wb")))
    keys, theirs = own.select(*scope, "a").distinct(), known.groupBy(*scope, "b").agg(F.min("ord").alias("ord"))
    inside = within(keys, theirs.select(*scope, "b"), scope)
    outside = within(theirs.select(*scope, F.col("b").alias("a")), keys.select(*scope, F.col("a").alias("b")), scope).select(*scope, F.col("b").alias("a"), F.col("a").alias("b"))
    held = inside.unionByName(outside).join(theirs, [*scope, "b"]).groupBy(*scope, "a").agg(F.min("ord").alias("ord")).select(*scope, "a", "ord", F.lit(float(contained)).alias("score"))
    some = lambda rows, w: rows.where((F.size(w) > 0) & (F.size(w) <= SHORT))
    many = lambda rows, w: rows.where(F.size(w) > SHORT)
    a, b = own.select(*scope, "a", "wa").distinct(), known.groupBy(*scope, "b", "wb").agg(F.min("ord").alias("ord"))
    by_set = some(a, "wa").join(posted(some(a, "wa").select(*scope, "wa"), some(b, "wb").select(*scope, "wb", "ord"), scope, least), [*scope, "wa"]).select(*scope, "a", "ord", "score")
    apart = ~F.contains("a", F.col("b")) & ~F.contains("b", F.col("a")) | (F.col("a") == "") | (F.col("b") == "")
    equal = some(a, "wa").join(some(b, "wb").withColumnRenamed("wb", "wa"), [*scope, "wa"]).where(apart).select(*scope, "a", "ord", F.lit(1.0).alias("score"))
    found = held.unionByName(by_set).unionByName(equal)
    for x, y, longest in ((many(a, "wa"), b, most), (some(a, "wa"), many(b, "wb"), theirs_most)):
        if (longest["words"] or 0) > SHORT:
            found = found.unionByName(sharing(x, y.drop("ord"), scope, least).where(apart).join(theirs, [*scope, "b"]).select(*scope, "a", "ord", "score"))
    found = best(found, [*scope, "a"])
    return own.select(*scope, "name", "a").distinct().join(found, [*scope, "a"]).select(*scope, "name", "ord", "score")


def best(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of the pairs of each key the one with the highest score, ties to the smaller ord."""
    return pairs.groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("less"), "ord", "score")).alias("m")).select(*by, "m.ord", "m.score")
