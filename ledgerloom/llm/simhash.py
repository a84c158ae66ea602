"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint is the majority of the XXH64 values (seed 42) of its four-word shingles, bit by bit.
Distinct fingerprints are grouped into tiles by their population count. Two fingerprints that differ in at most r
bits have population counts that differ by at most r, so only tile pairs within r are compared: numpy exclusive-or
and bit counts over the whole tile pair, without sampling or caps. From each tile pair a spanning forest leaves the
task, not the pairs, so a large group of near copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, in_blocks, text_or_empty, written

WORDS = 4
RADIUS = 4
#: Fingerprints in a tile; a tile pair holds two such arrays of 8 bytes each.
TILE = 32_768


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text; 0 where it has no words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), 42)]
    else:
        line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
        ends = list(accumulate((len(t) + 1 for t in tokens), initial=0))
        hashes = [digest(line[a : b - 1], 42) for a, b in zip(ends, ends[words:])]
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(values), 65_536):
        part = values[k : k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) for every row of docs; a null text counts as empty. fp is the signed 64-bit value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text"):
            made = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made)], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, each node's smallest member of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if np.array_equal(label[a], low) and np.array_equal(label[b], low):
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped


def near(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of x and y within radius, as positions in x followed by y.

    Both are grouped by the population count of their low halves: with d the difference of the whole counts, that of
    the low halves must lie within (d - radius) / 2 and (d + radius) / 2, so other groups are skipped.
    """
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    half = np.uint64(0xFFFFFFFF)
    low_x, low_y = np.bitwise_count(x & half).astype(np.int64), np.bitwise_count(y & half).astype(np.int64)
    by_x, by_y = np.argsort(low_x, kind="stable"), np.argsort(low_y, kind="stable")
    x, y, low_x, low_y = x[by_x], y[by_y], low_x[by_x], low_y[by_y]
    d = int(np.bitwise_count(x[0])) - int(np.bitwise_count(y[0]))
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    held, n = 0, len(x) + len(y)
    for low in np.unique(low_x):
        first, last = np.searchsorted(low_x, [low, low + 1])
        left = np.searchsorted(low_y, low - (d + radius) // 2)
        right = np.searchsorted(low_y, low - -((radius - d) // 2), side="right")
        cols = y[left:right]
        if not len(cols):
            continue
        step = max(1, 262_144 // len(cols))
        for k in range(first, last, step):
            hit = np.bitwise_count(x[k : min(k + step, last), None] ^ cols[None, :]) <= radius
            if same:
                i, j = np.nonzero(hit)
                keep = by_x[i + k] < by_y[j + left]
                i, j = i[keep], j[keep]
            elif hit.any():
                i, j = np.nonzero(hit)
            else:
                continue
            if len(i):
                found_a.append(by_x[i + k])
                found_b.append(by_y[j + left] + (0 if same else len(x)))
                held += len(i)
            if held > 1_000_000:
                label = forest(n, np.concatenate(found_a), np.concatenate(found_b))
                ends = np.nonzero(label != np.arange(n))[0]
                found_a, found_b, held = [ends], [label[ends]], len(ends)
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = forest(n, np.concatenate(found_a), np.concatenate(found_b))
    ends = np.nonzero(label != np.arange(n))[0]
    return ends, label[ends]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """A spanning forest (a, b) of the pairs of distinct fingerprints `fp` that differ in at most `radius` bits."""
    counted = nodes.select("fp", F.bit_count("fp").alias("pop"))
    sizes = {r["pop"]: r["n"] for r in counted.groupBy("pop").agg(F.count("*").alias("n")).collect()}  # at most 65 rows
    parts = {p: -(-n // tile) for p, n in sizes.items()}
    if not parts:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    names = sorted((p, k) for p, n in parts.items() for k in range(n))
    first = F.create_map(*[F.lit(x) for p in parts for x in (p, names.index((p, 0)))])
    among = F.create_map(*[F.lit(x) for p in parts for x in (p, parts[p])])
    tiles = counted.withColumn("tile", first[F.col("pop")] + F.pmod(F.xxhash64("fp"), among[F.col("pop")]).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        values = np.sort(table.column("fp").to_numpy())
        return pa.table({"tile": table.column("tile").slice(0, 1), "pop": table.column("pop").slice(0, 1), "fps": pa.array([values.tobytes()], pa.binary())})

    packed = written(tiles.groupBy("tile").applyInArrow(pack, "tile int, pop int, fps binary"), "tiles")
    # A tile's partners are the tiles whose counts lie within the radius; the rows dealt are tiles, not fingerprints.
    reach = F.create_map(*[F.lit(x) for p in parts for x in (p, first_of(names, p - radius))])
    end = F.create_map(*[F.lit(x) for p in parts for x in (p, first_of(names, p + radius + 1))])
    partner = F.explode(F.sequence(reach[F.col("pop")], end[F.col("pop")] - 1))
    dealt = packed.select("tile", "fps", partner.alias("other")).select(F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "fps")

    def compare(table: pa.Table) -> pa.Table:
        held = {t: np.frombuffer(f, np.int64).view(np.uint64) for t, f in zip(table.column("tile").to_pylist(), table.column("fps").to_pylist())}
        x, y = held[table.column("x")[0].as_py()], held[table.column("y")[0].as_py()]
        same = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        a, b = near(x, y, radius, same)
        every = (x if same else np.concatenate([x, y])).view(np.int64)
        return pa.table({"a": pa.array(every[a], pa.int64()), "b": pa.array(every[b], pa.int64())})

    return dealt.groupBy("x", "y").applyInArrow(compare, "a long, b long")


def first_of(names: list[tuple[int, int]], pop: int) -> int:
    """The number of tiles whose population count is below `pop`."""
    return sum(p < pop for p, _ in names)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, group) for every row of docs; group names the component itself.

    component_id is the smallest doc_id that can be reached over links, the row's own included; rows with a null
    doc_id take part but name no component. Null and empty texts have fingerprint zero and link like any other;
    repeated rows share a component; an empty table gives no rows; further columns are ignored.
    """
    prints = written(fingerprints(docs), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    linked = written(components(links(nodes, radius, tile)).join(nodes.withColumnRenamed("fp", "node"), "node"), "linked")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(least, "root").select(F.col("node").alias("fp"), "component_id", "root")
    # A root is the hash of one of its fingerprints, so that of a fingerprint by itself is no other group's.
    ids = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("root", F.xxhash64("fp")).alias("group"))
    return prints.join(ids, "fp").select("doc_id", "text_hash", "fp", "component_id", "group")


def deduplicate(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id, of several the one whose text has
    the smallest hash. Unlike texts under one doc_id are in groups of their own and stay. Rows with a null doc_id can't be
    named by a group and stay; null and empty texts are copies of each other; an empty table stays empty. All columns of
    docs are returned, whatever their names.
    """
    found = near_duplicates(docs.where("doc_id is not null"), radius, tile)
    rows = found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    stays = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    # Only what goes, and what repeats as a whole, is matched with the texts; most rows are neither.
    going = written(rows.join(first, "group").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), stays.alias("__stays"), "n").where("not __stays or n > 1"), "going")
    keyed = docs.withColumn("__hash", F.xxhash64(text_or_empty()))
    same = (F.col("doc_id") == F.col("__id")) & (F.col("__hash") == F.col("__text"))
    kept = keyed.join(going, same, "left_anti").select(*docs.columns)
    repeated = going.where("__stays")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__hash"]).select(*docs.columns))
