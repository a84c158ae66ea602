"""Prefix tries of conversations.

A conversation is the path of its turns' digests. Equal paths are made one first, with the number of conversations on
them, the least of their ids and the digest of all. Distinct paths are dealt to buckets by a hash of their first turn;
`applyInPandas` builds the tries of a bucket as dictionaries with pointers and sums them up in an iterative postorder.
A first turn with more turns below it than a task should hold is a node by itself: its paths are dealt again by
their next turn, as often as needed, and its sums are made from those of its children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, written

#: Turns of distinct paths that a task builds tries of at once.
TURNS = 1_000_000
#: Conversations in a row on the way to their common digest.
CHUNK = 4096
_DIGEST = 16
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NOBODY = hashlib.sha256(b"").hexdigest()


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return F.crc32(conv_id.cast("string")) % 6


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, lengths) of every rebuilt conversation: path has 16 bytes for each turn, a digest of role and text,
    and lengths the code points of the texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).alias("length")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))  # a conversation, without its texts
    base = F.col("conv_id") - F.col("conv_id") % 100
    given = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("ts", 1, 5).alias("given"))
    h = heads(F.col("conv_id")).cast("int")
    rest = F.slice("ts", h + 1, F.greatest(F.size("ts") - h, F.lit(0)))
    rebuilt = own.withColumn("base", base).join(given, "base", "left").select("conv_id", F.concat(F.coalesce(F.slice("given", F.lit(1), h), F.slice("ts", 1, 0)), rest).alias("ts"))
    joined = F.unhex(F.array_join(F.transform("ts", lambda t: F.hex(t["digest"])), ""))
    return rebuilt.select("conv_id", joined.alias("path"), F.col("ts.length").alias("lengths"))


def distinct_paths(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, path, lengths, n, ends): each path once, its least conversation, how many have it and the digest of their
    ids in order. Ids are sorted over all partitions and joined in rows of `CHUNK`, so that a path that very many
    conversations share is never held as a whole."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or k % CHUNK == 0), len(keys)]
            rows = [(keys[a], ids[a], b - a, ",".join(map(str, ids[a:b]))) for a, b in zip(cuts, cuts[1:]) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "first", "n", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        first = n = 0
        state = hashlib.sha256()
        made = lambda: pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "n", "ends"])
        for batch in batches:
            for k, start, count, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k == key:
                    state.update(b",")
                    n += count
                else:
                    if key is not None:
                        yield made()
                    key, first, n, state = k, start, count, hashlib.sha256()
                state.update(ids.encode())
        if key is not None:
            yield made()

    keyed = rebuilt.select(F.unhex(F.md5("path")).alias("key"), "conv_id")
    joined = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(chunks, "key binary, first long, n long, ids string")
    found = joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "conv_id long, n long, ends string")
    return rebuilt.join(found, "conv_id")


def tries(rows: pd.DataFrame, level: int) -> pd.DataFrame:
    """The nodes from depth `level` on of the paths in rows, in a trie for each prefix of `level` turns. top names that
    prefix, for the trie's first node; parent is null there."""
    children: list[dict[bytes, int]] = []
    parent: list[int] = []
    depth: list[int] = []
    own: list[int] = []  # code points of the node's text
    members: list[int] = []
    least: list[int] = []
    ends: list[str] = []
    tops: dict[bytes, int] = {}

    def node(above: int, at: int, length: int) -> int:
        for column, x in ((children, {}), (parent, above), (depth, at), (own, length), (members, 0), (least, 2**63 - 1), (ends, _NOBODY)):
            column.append(x)
        return len(parent) - 1

    for conv_id, path, lengths, n, sha in zip(rows["conv_id"].tolist(), rows["path"], rows["lengths"], rows["n"].tolist(), rows["ends"]):
        path = bytes(path)
        k = tops.get(top := path[: level * _DIGEST])
        if k is None:
            k = tops[top] = node(-1, level, int(lengths[level - 1]))
        members[k] += n
        least[k] = min(least[k], conv_id)
        for d in range(level, len(path) // _DIGEST):
            step = path[d * _DIGEST : (d + 1) * _DIGEST]
            below = children[k].get(step)
            if below is None:
                below = children[k][step] = node(k, d + 1, int(lengths[d]))
            k = below
            members[k] += n
            least[k] = min(least[k], conv_id)
        ends[k] = sha
    leaves, saved = [0] * len(parent), [0] * len(parent)
    for first in tops.values():
        stack = [(first, iter(children[first].values()))]
        while stack:
            k, left = stack[-1]
            if (below := next(left, None)) is not None:
                stack.append((below, iter(children[below].values())))
                continue
            stack.pop()
            leaves[k] = leaves[k] or 1
            saved[k] += (members[k] - 1) * own[k]
            if parent[k] >= 0:
                leaves[parent[k]] += leaves[k]
                saved[parent[k]] += saved[k]
    names: list[bytes | None] = [None] * len(parent)
    for top, k in tops.items():
        names[k] = top
    above = pd.array([least[p] if p >= 0 else None for p in parent], dtype="Int64")
    return pd.DataFrame({"top": names, "conv_id": least, "depth": depth, "parent_conv_id": above, "n_convs": members, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})


def _builder(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return tries(rows, level)

    return build


def prefix(level: int) -> Column:
    return F.substring("path", 1, level * _DIGEST)


def trie(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations: conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is rebuilt from the first turns of that of its hundred and its own turns after as many. Turns go by
    turn, null first, and ties by the digest of role and text; rows that repeat are turns of their own; a null role or
    text is empty; rows without a conv_id belong to no conversation; an empty table has no root and gives no rows; other
    columns are ignored. A text of any length is a digest and a number here; a conversation is one row of 20 bytes for
    each of its turns. No task builds tries over more than about `turns` turns of distinct paths, or over one path.
    """
    spark = conversations.sparkSession
    every = written(distinct_paths(paths(conversations)), "paths")
    parts: list[DataFrame] = []  # nodes by level, of tries that fitted
    spines: list[DataFrame] = [_spine(every, 0)]  # nodes that did not, the root first
    left, level = every.where(F.octet_length("path") > 0), 1
    while True:
        sizes = written(left.groupBy(prefix(level).alias("key")).agg(F.sum(F.size("lengths") - (level - 1)).alias("size"), F.count("*").alias("n")), "sizes")
        large = sizes.where((F.col("size") > turns) & (F.col("n") > 1))
        small = left.join(large.withColumnRenamed("key", "large"), prefix(level) == F.col("large"), "left_anti")
        total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        buckets = max(1, -(-total // turns), min(total // 1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = small.groupBy(F.pmod(F.xxhash64(prefix(level)), F.lit(buckets)).alias("bucket"))
        parts.append(written(dealt.applyInPandas(_builder(level), f"top binary, {_NODE}"), "tries"))
        if large.isEmpty():
            break
        left = written(left.join(large.select(F.col("key").alias("large")), prefix(level) == F.col("large"), "left_semi"), "large")
        spines.append(_spine(left, level))
        left, level = left.where(F.octet_length("path") > level * _DIGEST), level + 1
        discard(sizes)
    return _joined(parts, spines)


def _spine(rows: DataFrame, level: int) -> DataFrame:
    """(key, length, conv_id, n_convs, ends) of the prefixes of `level` turns that rows have."""
    ended = F.octet_length("path") == level * _DIGEST
    length = F.max(F.element_at("lengths", level)) if level else F.lit(0)
    return written(rows.groupBy(prefix(level).alias("key")).agg(length.alias("length"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(ended, F.col("ends"))).alias("ends")), "spine")


def _joined(parts: list[DataFrame], spines: list[DataFrame]) -> DataFrame:
    """All nodes: those of the parts, and the spines from the deepest on, whose children are the tops one level below."""
    columns = [c.split()[0] for c in _NODE.split(", ")]
    found, below = [], None
    for level in range(len(spines) - 1, -1, -1):
        spine, nodes = spines[level], parts[level]
        up = lambda df: df.withColumn("up", F.substring("top", 1, level * _DIGEST))  # noqa: B023, E731
        tops = up(nodes.where("top is not null"))
        if below is not None:
            tops = tops.unionByName(up(below))
        sums = tops.groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        known = spine.select("key", F.col("conv_id").alias("above"))
        found += [nodes.where("top is null").select(*columns), tops.join(known, tops["up"] == known["key"]).select("conv_id", "depth", F.col("above").alias("parent_conv_id"), *columns[3:])]
        none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        below = spine.join(sums, spine["key"] == sums["up"], "left").select(
            F.col("key").alias("top"), "conv_id", F.lit(level).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", none("n_children").alias("n_children"),
            F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), (none("saved_tokens") + (F.col("n_convs") - 1) * F.col("length")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NOBODY)).alias("ends_sha256"),
        )
        below = written(below, "spine-sums")
    return reduce(DataFrame.unionByName, [*found, below.select(*columns)])
