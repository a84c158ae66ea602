"""Exact top-k by inner product: tiled matrix products, partial selection in each tile, and merging in two levels.

Vectors are packed into tiles of a fixed number of rows. Every query tile meets every shard tile in a group of its own,
so a task holds one matrix of each and their product in strips; what leaves it are k rows for each query. Each shard
tile is sent once for each query tile, so tiles are large and their components narrow.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

K = 5
SCALE = 256
#: Rows in a tile, and the components that one may have: longer vectors have fewer rows in a tile.
TILE, COMPONENTS = 16_384, 4 << 20
#: First-level lists of a query before its last merge.
FAN = 8
LONG = 2**63 - 1


def quantised(vector: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(vector.astype(np.float64) * scale)


def pack(rows: DataFrame, size: int, scale: int = SCALE) -> DataFrame:
    """(tile, dim, n, ids, kind, comps): tiles of at most `size` vectors of one length; ids are little-endian 64-bit integers,
    components the narrowest integers that hold all of a tile, or doubles, as kind says. Rows with a null id, a null vector,
    or null or non-finite components take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def out(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, comps = np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])
            count[dim] = 0
            most = np.abs(comps).max(initial=0)
            kind = next((k for k, top in (("<i1", 127), ("<i2", 2**15 - 1), ("<i4", 2**31 - 1)) if most <= top), "<f8")
            return pa.RecordBatch.from_pydict({"tile": [uuid.uuid4().hex], "dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "kind": [kind], "comps": [comps.astype(kind).tobytes()]})

        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
            ends = np.cumsum(lengths := np.diff(column.offsets.to_numpy()))
            for dim in np.unique(lengths):
                room = max(1, min(size, COMPONENTS // max(1, int(dim))))
                for first in range(0, len(own := np.nonzero(lengths == dim)[0]), room):
                    at = own[first : first + room]
                    comps = quantised(flat[(ends[at] - dim)[:, None] + np.arange(dim)], scale)
                    fine = np.isfinite(comps).all(axis=1)
                    held.setdefault(int(dim), []).append((ids[at][fine], comps[fine]))
                    count[int(dim)] = count.get(int(dim), 0) + int(fine.sum())
                    if count[int(dim)] >= room:
                        yield out(int(dim))
        for dim in list(held):
            if count[dim]:
                yield out(dim)

    rows = rows.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "tile string, dim int, n int, ids binary, kind string, comps binary")


def tile_top(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query position, id, score) of each query in a shard, ties to smaller ids; rows with the query's id are left out."""
    order = np.argsort(ids, kind="stable")
    shard, ids = shard[order], ids[order]
    most = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * max(1, shard.shape[1])
    exact = most < 2**53  # then every sum of products is an integer that a double holds
    left = queries if exact else np.array([[int(x) for x in r] for r in queries], dtype=object).reshape(queries.shape)
    right = shard if exact else np.array([[int(x) for x in r] for r in shard], dtype=object).reshape(shard.shape)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (4 << 20) // max(1, len(ids)))
    for first in range(0, len(queries), step):
        scores = left[first : first + step] @ right.T
        if not exact:
            scores = scores.reshape(-1, len(ids)) if shard.shape[1] else np.zeros((len(scores), len(ids)), dtype=object)
        for i, row in enumerate(scores):
            own = np.nonzero(ids != query_ids[first + i])[0] if query_ids[first + i] in ids[max(0, (p := np.searchsorted(ids, query_ids[first + i]))) : p + 1] else None
            row, names = (row, ids) if own is None else (row[own], ids[own])
            if len(row) > k and exact:
                least = np.partition(row, len(row) - k)[len(row) - k]
                near = np.nonzero(row >= least)[0]
                row, names = row[near], names[near]
            best = sorted(range(len(row)), key=lambda j: (-row[j], names[j]))[:k] if len(row) <= 64 or not exact else np.lexsort((names, -row))[:k]
            best = np.array(best, dtype=np.int64)
            found.append((np.full(len(best), first + i), names[best], np.array([max(-LONG - 1, min(LONG, int(x))) for x in row[best]], dtype=np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k highest integer inner products with rows of rows.

    Both have vec_id and embedding. Components become floor(scale * x). Ties go to the smaller vec_id; rows with the
    query's own vec_id are no candidates; only vectors of equal length meet; repeated rows count one by one. Rows with a
    null id, a null vector, or null or non-finite components take no part; empty tables give no rows; other columns are
    ignored. Scores beyond a long are shown as the nearest long.
    """
    asked = written(pack(queries, TILE, scale), "queries")
    shards = written(pack(rows, TILE, scale), "shards")
    # The rows dealt are tiles: each goes once to each tile of the other side, with a group for each pair.
    left = asked.select("dim", F.col("tile").alias("q")).join(shards.select("dim", F.col("tile").alias("s")), "dim")
    pairs = written(left.select("q", "s"), "pairs")
    dealt = pairs.join(asked.withColumnRenamed("tile", "q"), "q").withColumn("side", F.lit(0)).unionByName(pairs.join(shards.withColumnRenamed("tile", "s"), "s").withColumn("side", F.lit(1)))

    def best(table: pa.Table) -> pa.Table:
        columns = (table.column(x).to_pylist() for x in ("side", "dim", "n", "ids", "kind", "comps"))
        held = {side: (np.frombuffer(i, np.int64), np.frombuffer(c, kind).astype(np.float64).reshape(n, dim)) for side, dim, n, i, kind, c in zip(*columns)}
        (qids, q), (ids, s) = held[0], held[1]
        at, names, scores = tile_top(q, qids, s, ids, k)
        return pa.table({"q": pa.array([table.column("q")[0].as_py()] * len(at), pa.string()), "at": pa.array(at, pa.int32()), "slot": pa.array(np.full(len(at), int(table.column("s")[0].as_py(), 16) % FAN), pa.int32()), "query_id": qids[at], "vec_id": names, "score": scores})

    lists = dealt.groupBy("q", "s").applyInArrow(best, "q string, at int, slot int, query_id long, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]
    for by in (["q", "at", "slot"], ["q", "at"]):
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
