"""Source divergence audit over deduplicated count columns.

How a source's words differ from those of the other sources of its language is a sum over all terms. Most terms are
rare, and many have the same counts in the same sources, so terms are grouped by their sparse vector of counts by
source. Every pair of sources is evaluated once for each distinct vector and multiplied by the number of its terms; the
original terms come back only to be ranked. All arithmetic is in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import in_blocks, text_or_empty, written

LEAST_DOCS = 30
SMOOTH = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
#: Distinct vectors of a block, sources of a tile, and cells of the dense matrix that a task holds at once.
BLOCK, TILE, CELLS = 4096, 128, 1 << 22
#: Counts that a task holds before it hands them on, and bytes of a text that are cut at once.
HELD, PIECE = 400_000, 1 << 20

#: A-Z to lower case; all but letters and what lies beyond ASCII to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_GROUP = ("lang", "source")


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch of about `PIECE` bytes after the other."""
    folded, first = text.translate(FOLD), 0
    while first < len(folded):
        last = folded.find(b" ", first + PIECE)
        last = len(folded) if last < 0 else last
        yield folded[first:last].split()
        first = last


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it, added up in each task first."""

    def made(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            for k in range(0, len(terms), 1 << 16):
                own = terms[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[t] for t in own], pa.int64()), pa.array([d[t] for t in own], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in in_blocks(batches, "text"):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in pieces(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                d.update(seen)
                size += len(n) - before
                if size > HELD:
                    yield from made(held)
                    held, size = {}, 0
        yield from made(held)

    rows = docs.select(*(text_or_empty(c).alias(c) for c in _GROUP), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * n / total), 0 < n <= total, by long division in steps of three digits: exact up to totals of 9e15."""
    whole, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return whole + 1


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, v, at, n_sources): every group that occurs; total is N + SMOOTH * V, at its place among its
    language's sources."""
    there = docs.select(*(text_or_empty(c).alias(c) for c in _GROUP)).distinct()
    sizes = kept.select("lang", F.explode("vector").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n_all"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    by_source = Window.partitionBy("lang").orderBy("source")
    found = there.join(sizes, list(_GROUP), "left").join(terms, "lang", "left").na.fill(0, ["n_all", "v"])
    return found.select(*_GROUP, (F.col("n_all") + SMOOTH * F.col("v")).alias("total"), "v", (F.row_number().over(by_source) - 1).alias("at"), F.count("*").over(Window.partitionBy("lang")).alias("n_sources"))


def tile_sums(vectors: pa.Table, sources: pa.Table, tile: int, size: int, cells: int = CELLS) -> pa.Table:
    """(lang, a, b, value): for each source a of a tile and each source b after it, the sum of abs(p - q) over the terms of
    the vectors (lang, vector: array of (source, n), terms: how many terms have it)."""
    order = np.argsort(sources.column("at").to_numpy())
    names = sources.column("source").take(pa.array(order)).to_pylist()
    total = np.maximum(sources.column("total").to_numpy()[order], 1)
    first, last = tile * size, min((tile + 1) * size, len(names))
    own = range(first, last)
    sums = [np.zeros(len(names) - a - 1, np.int64) for a in own]
    place = {name: k for k, name in enumerate(names)}
    step = max(1, cells // len(names))
    for k in range(0, vectors.num_rows, step):
        part = vectors.slice(k, step).combine_chunks()
        lists = part.column("vector").combine_chunks()
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        n = np.zeros((len(lists), len(names)), np.int64)
        n[row, [place[x] for x in flat.field("source").to_pylist()]] = flat.field("n").to_numpy()
        p, times = share(n + SMOOTH, total), part.column("terms").to_numpy()
        for a, held in zip(own, sums):
            held += times @ np.abs(p[:, a + 1 :] - p[:, a : a + 1])
    a = np.repeat(np.arange(first, last), [len(x) for x in sums])
    b = np.concatenate([np.arange(x + 1, len(names)) for x in own] or [np.zeros(0, np.int64)])
    lang = sources.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array([names[k] for k in a], pa.string()), "b": pa.array([names[k] for k in b], pa.string()), "value": pa.array(np.concatenate(sums or [np.zeros(0, np.int64)]), pa.int64())})


def pairs(vectors: DataFrame, groups: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language: the sum of abs(p - q) over all terms.

    Distinct vectors (lang, vector, terms) are dealt to blocks by their hash; each block meets its language's sources, in
    tiles, so that no task holds more than a block and the sums of a tile.
    """
    sizes = vectors.groupBy("lang").agg(F.count("*").alias("n"))
    blocks = groups.join(sizes, "lang", "left").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / block)).cast("int")).withColumn("tiles", F.ceil(F.col("n_sources") / tile).cast("int"))
    # A small table, whose size Spark knows, so that the vectors of a language need not meet in one task for it.
    blocks = written(blocks.select("lang", "source", "total", "at", "blocks", "tiles"), "blocks")
    one = blocks.where("at = 0").select("lang", "blocks", "tiles")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = vectors.join(one, "lang").withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int")).select("lang", "block", upto("tiles").alias("tile"), "vector", "terms")
    there = blocks.select("lang", "source", "total", "at", "tiles", upto("blocks").alias("block")).select("lang", "block", upto("tiles").alias("tile"), "source", "total", "at")

    def evaluate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return tile_sums(left, right, key[2].as_py(), tile)

    keys = ("lang", "block", "tile")
    sums = dealt.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(evaluate, "lang string, a string, b string, value long")
    added = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return added.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")


def terms(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value) of each group's `top` terms that it uses more than its language does. Terms with equal
    vectors have equal values, so the `top` least terms of each vector, in order of bytes, are enough."""
    upper = Window.partitionBy("lang", "vector").orderBy("term")
    listed = kept.withColumn("k", F.row_number().over(upper)).where(F.col("k") <= top).select("lang", "term", "vector", F.aggregate("vector", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("in_lang"), F.explode("vector").alias("x"))
    whole = groups.groupBy("lang").agg((F.sum(F.col("total") - SMOOTH * F.col("v")) + SMOOTH * F.max("v")).alias("whole"))
    p = lambda n, total: F.expr(f"1 + (CAST({n} + {SMOOTH} AS DECIMAL(20,0)) * {UNIT}BD) DIV CAST({total} AS DECIMAL(20,0))")
    valued = listed.select("lang", F.col("x.source").alias("source"), F.col("term").alias("item"), F.col("x.n").alias("n"), "in_lang").join(groups.select("lang", "source", "total"), ["lang", "source"]).join(whole, "lang").withColumn("value", p("n", "total") - p("in_lang", "whole"))
    return valued.where("value > 0").select("lang", "source", "item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and by which terms
    it departs most from its language.

    Terms are runs of letters, A-Z in lower case; a language keeps those in at least `least_docs` of its rows. A term's
    share p in a group is 1 + floor(10^9 * (n + 5) / (N + 5 * V)). Part `pair`: the sum of abs(p - q) over the kept terms
    for every other source; part `term`: the `top` terms with the greatest p - q > 0, q the language's share. Ranks go by
    value, then by the item's bytes. A null text, lang or source is empty; rows that repeat count each; a text of any
    length is read in stretches; a language without kept terms has pairs of value 0; an empty table gives no rows; other
    columns are ignored.
    """
    held = counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    kept = written(held.where(F.col("docs") >= least_docs).select("lang", "term", "vector"), "kept-terms")
    groups = written(groups_of(docs, kept), "groups")
    vectors = kept.groupBy("lang", "vector").agg(F.count("*").alias("terms"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    return pairs(vectors, groups).select(*columns("pair")).unionByName(terms(kept, groups, top).select(*columns("term")).where(F.col("rank") <= top))
