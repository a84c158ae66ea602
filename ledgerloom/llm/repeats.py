"""Repeated passages by sparse suffix arrays.

Of every document only the suffixes at content-selected positions are kept: a word position is kept where the hash of
the `GRAM` words from it is the least among `SPARSE` positions in a row. Suffixes are sorted by the hash of their first
`KEY` words and each is compared with its neighbours; one that equals neither goes. A passage of `PASSAGE` words that
stands in two places has a kept suffix within its first `SPARSE` words in both, and these two share its key. So every
match is extended to the left, by up to `SPARSE` - 1 words, and to the right until `PASSAGE` words are full: all the
stretches of that length around a shared suffix are sorted again, by their hash and place, and compared with their
neighbours. One that equals a neighbour is repeated; the first place of each holds it, every other one is a later copy.
What overlaps in a document is then made one span. So a word is reported if and only if it lies in `PASSAGE` words that
stand elsewhere too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import in_blocks, text_or_empty, written
from ledgerloom.llm.decontaminate import FOLD, cut

PASSAGE = 50
SPARSE = 16
GRAM = 4
KEY = PASSAGE - SPARSE + 1
#: Fixed odd multipliers of the rolling hashes, and their inverses modulo 2**64.
_BYTE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE_INVERSE, _WORD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64)), np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 2**64))
_FOLD = np.frombuffer(FOLD, np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return powers(int(base), 1 << max(16, int(n).bit_length()))[:n]


def rolling(values: np.ndarray, base: np.uint64, inverse: np.uint64, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of values[first:last] for each pair, the same for equal stretches wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return mix((sums[last] - sums[first]) * _powers(inverse, len(values) + 1)[first] + np.uint64(1))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the documents whose bytes lie end to end in data, and the number of words in each."""
    folded = _FOLD[data]
    inside = folded != 32
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    starts_of = np.concatenate([[0], ends[:-1]])
    before[starts_of[starts_of < len(before)]] = False
    first = np.nonzero(inside & ~before)[0]
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[ends[ends > 0] - 1] = False
    last = np.nonzero(inside & ~after)[0] + 1
    counts = np.diff(np.searchsorted(first, np.concatenate([[0], ends])))
    return rolling(_TABLE[folded], _BYTE, _BYTE_INVERSE, first, last), counts


def sliding(x: np.ndarray, n: int) -> np.ndarray:
    """The least of x[i : i + n] for each i, fewer at the end."""
    out, size = x.copy(), 1
    while size < n:
        step = min(size, n - size)
        if step < len(out):
            out[:-step] = np.minimum(out[:-step], out[step:])
        size += step
    return out


def kept(words: np.ndarray, counts: np.ndarray, key: int, sparse: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept suffixes among all words, and their keys."""
    begin = np.cumsum(counts) - counts
    room = np.repeat(begin + counts, counts) - np.arange(len(words))  # words from here to the end of the document
    gram = np.full(len(words), np.iinfo(np.uint64).max)
    at = np.nonzero(room >= key)[0]
    if not len(at):
        return at, np.zeros(0, np.uint64)
    gram[at] = rolling(words, _WORD, _WORD_INVERSE, at, at + GRAM) >> np.uint64(1)
    least = np.where(room >= key + sparse - 1, sliding(gram, sparse), np.uint64(0))  # of whole windows only
    # A position is kept where a window that holds it has its value as the least: the greatest least over those windows.
    back = ~sliding(~least[::-1], sparse)[::-1]
    at = at[gram[at] == back[at]]
    return at, rolling(words, _WORD, _WORD_INVERSE, at, at + key)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def identity() -> dict[str, Column]:
    """What names a row: its doc_id (null ones last) and a hash of its text. Few rows share a doc_id, so that half of the
    hash does but where it is null."""
    text = F.xxhash64(text_or_empty())
    return {"name": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "doc": F.when(F.col("doc_id").isNull(), text).otherwise(text.bitwiseAND(F.lit(2**32 - 1)))}


def suffixes(docs: DataFrame, key: int, sparse: int) -> DataFrame:
    """(name, doc, doc_id, n_words, positions, keys) for every row of docs (text, name, doc, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text"):
            words, counts = word_hashes(*_bytes(batch.column(0)))
            at, keys = kept(words, counts, key, sparse)
            ends = np.cumsum(counts)
            cuts = pa.array(np.concatenate([[0], np.searchsorted(at, ends)]), pa.int32())
            places = (at - (ends - counts)[np.searchsorted(ends, at, side="right")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (1, 2, 3)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(places)), pa.ListArray.from_arrays(cuts, pa.array(keys.view(np.int64)))], names=["name", "doc", "doc_id", "n_words", "positions", "keys"])

    return docs.mapInArrow(run, "name long, doc long, doc_id long, n_words long, positions array<int>, keys array<long>")


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def shared(rows: DataFrame) -> DataFrame:
    """(who, at) of the rows (key, who, at) whose key another row has: sorted over all partitions, each compared with its
    neighbours. The first and the last of a partition stay, too: their neighbours are elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        like = True  # whether the row held back is like the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            key, who, at = _columns(batch) if held is None else map(np.concatenate, zip(held, _columns(batch)))
            same = key[1:] == key[:-1]
            stay = np.concatenate([[like], same[:-1]]) | same if len(same) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(who[:-1][stay]), pa.array(at[:-1][stay])], names=["who", "at"])
            held, like = [x[-1:] for x in (key, who, at)], bool(same[-1]) if len(same) else like
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[2])], names=["who", "at"])

    order = ("key", "who", "at")
    return rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "who long, at int")


def stretches(sites: DataFrame, passage: int, sparse: int) -> DataFrame:
    """(hash, name, doc, at): every run of `passage` words that begins at one of the sites (text, name, doc, sites: array
    of places), or less than `sparse` words before it, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text"):
            words, counts = word_hashes(*_bytes(batch.column(0)))
            begin = np.cumsum(counts) - counts
            places = batch.column(3)
            of = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            at = places.flatten().to_numpy().astype(np.int64)
            first, last = begin[of] + np.maximum(at - sparse + 1, 0), begin[of] + np.minimum(at, counts[of] - passage)
            fits = last >= first
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, first[fits], 1)
            np.add.at(depth, last[fits] + 1, -1)
            found = np.nonzero(np.cumsum(depth) > 0)[0]
            row = np.searchsorted(begin + counts, found, side="right")
            hashes = rolling(words, _WORD, _WORD_INVERSE, found, found + passage) if len(found) else np.zeros(0, np.uint64)
            for a in range(0, len(found), 1 << 16):
                own = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[own].view(np.int64)), batch.column(1).take(pa.array(row[own])), batch.column(2).take(pa.array(row[own])), pa.array((found - begin[row])[own].astype(np.int32))], names=["hash", "name", "doc", "at"])

    return sites.mapInArrow(run, "hash long, name long, doc long, at int")


def holdings(rows: DataFrame, passage: int) -> tuple[DataFrame, dict[int, tuple[int, int, int]]]:
    """(name, doc, at, floor, hash) of the rows (hash, name, doc, at) whose hash another row has. floor is -1 where the row is
    the first with its hash; else the least word of a copy: 0, or where the first ends if that is in the same document.

    Rows are sorted by hash and place over all partitions and compared with their neighbours. Where equal rows may lie on
    both sides of a partition's edge they are left open, with their hash, which is null for others. The second result has
    the first place (name, doc, at) of the open hashes that are repeated, from what all partitions have at their edges:
    the open rows, and the first of the rows that are last in each.
    """
    names = ["name", "doc", "at", "floor", "hash", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        group, owner, size, opening = None, (0, 0, 0), 0, True  # of the row last seen, in a partition's first group or not

        def made(name: np.ndarray, doc: np.ndarray, at: np.ndarray, floor: np.ndarray, key: np.ndarray, is_open: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(doc), pa.array(at), pa.array(floor, pa.int32()), pa.array(key, mask=~is_open), pa.array(n, pa.int32())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, name, doc, at = _columns(batch) if held is None else map(np.concatenate, zip(held, _columns(batch)))
            fresh = np.concatenate([[group is None or held is None], key[1:] != key[:-1]])
            if held is not None:
                fresh[0] = size == 1
            last = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))  # the first of each row's group here, or -1
            o_name, o_doc, o_at = (np.where(last >= 0, x[np.maximum(last, 0)], y) for x, y in zip((name, doc, at), owner))
            is_first = opening & (np.cumsum(fresh[1:]) == 0) if len(key) > 1 else np.zeros(0, bool)
            is_open = np.concatenate([[opening], is_first]).astype(bool)
            alone = np.concatenate([fresh[:-1] & fresh[1:], [False]])
            own = fresh | ((name == o_name) & (doc == o_doc) & (at == o_at))
            floor = np.where(own, -1, np.where((name == o_name) & (doc == o_doc), o_at + passage, 0))
            out = (is_open | ~alone)[:-1]
            yield made(*(x[:-1][out] for x in (name, doc, at, floor, key, is_open, np.ones(len(key), np.int32))))
            n = len(key) - 1 - int(last[-1]) + 1 if last[-1] >= 0 else size + len(key) - 1
            held, group, owner, size, opening = [x[-1:] for x in (key, name, doc, at)], key[-1], (o_name[-1], o_doc[-1], o_at[-1]), n, bool(is_open[-1])
            final = floor[-1:], own[-1:]
        if held is not None:
            key, name, doc, at = held
            lone = opening or size == 1
            yield made(name, doc, at, final[0], key, np.array([lone]), np.array([1], np.int32))
            if not lone:  # the first of the last group, as a note
                yield made(*(np.array([x], t) for x, t in zip(owner, (np.int64, np.int64, np.int32))), np.array([-2]), key, np.array([True]), np.array([size], np.int32))

    order = ("hash", "name", "doc", "at")
    found = written(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "name long, doc long, at int, floor int, hash long, n int"), "holdings", True)
    edges = found.where("hash is not null")
    # At most two hashes of each partition, so few that they go to every task as one table.
    firsts = edges.groupBy("hash").agg(F.sum("n").alias("all"), F.min(F.struct("name", "doc", "at")).alias("o")).where("all > 1")
    return found.where("floor > -2").select("name", "doc", "at", "floor", "hash"), {r["hash"]: tuple(r["o"]) for r in firsts.collect()}


_SPANS = "array<struct<start:int,end:int,later:boolean>>"


def spans_of(at: np.ndarray, floor: np.ndarray, passage: int) -> list[tuple[int, int, bool]]:
    """(start, end, later) of the words that repeated stretches cover, by start; copies take words from first holdings."""
    if not len(at):
        return []
    depth = np.zeros((2, int(at.max()) + passage + 1), np.int32)
    later = floor >= 0
    for row, first, last in ((0, at, at + passage), (1, np.maximum(at, floor)[later], at[later] + passage)):
        np.add.at(depth[row], first, 1)
        np.add.at(depth[row], last, -1)
    kind = (np.cumsum(depth, axis=1) > 0).sum(axis=0)
    edges = np.concatenate([[0], np.nonzero(np.diff(kind))[0] + 1, [len(kind)]])
    return [(int(a), int(b), bool(kind[a] == 2)) for a, b in zip(edges, edges[1:]) if kind[a]]


def spans(held: DataFrame, firsts: dict[int, tuple[int, int, int]], passage: int) -> DataFrame:
    """(name, doc, spans) of the rows and firsts that `holdings` gives."""
    known = held.sparkSession.sparkContext.broadcast(firsts)  # two for each partition at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("later", pa.bool_())]))
        for batch in batches:
            cuts = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            flat = batch.column(2).flatten()
            at, floor, key = flat.field(0).to_numpy(), flat.field(1).to_numpy().copy(), flat.field(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            repeated = np.ones(len(at), bool)
            for k in np.nonzero(key.is_valid().to_numpy(zero_copy_only=False))[0].tolist():
                first = known.value.get(key[k].as_py())
                repeated[k] = first is not None
                if first:
                    here = first[:2] == (batch.column(0)[row[k]].as_py(), batch.column(1)[row[k]].as_py())
                    floor[k] = -1 if here and first[2] == at[k] else first[2] + passage if here else 0
            out = [[dict(zip(("start", "end", "later"), s)) for s in spans_of(at[a:b][repeated[a:b]], floor[a:b][repeated[a:b]], passage)] for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["name", "doc", "spans"])

    return held.groupBy("name", "doc").agg(F.collect_list(F.struct("at", "floor", "hash")).alias("of")).mapInArrow(run, f"name long, doc long, spans {_SPANS}")


def passages(docs: DataFrame, passage: int = PASSAGE, sparse: int = SPARSE) -> DataFrame:
    """(doc_id, n_words, name, doc, spans) for every row of docs; name and doc are its `identity`.

    spans: array of (start, end, later), in words and by start, of the passages of at least `passage` words that stand
    in another place too, of this row or another; they don't overlap. later: whether an earlier place holds it, so that
    it can be cut here; places are ordered by doc_id, nulls last, then position. Where a copy and a first holding
    overlap, the words are the copy's, and what is left of the holding may be shorter than a passage; a copy that
    overlaps its own source begins `passage` words after the source does. A row that is repeated as a whole counts as
    another one, but as no earlier one. Words are runs of letters and digits, A-Z in lower case; a null text has none;
    shorter texts have no passage; an empty table gives no rows; other columns are ignored.
    """
    names = identity()
    own = docs.select(text_or_empty().cast("binary").alias("text"), *(x.alias(n) for n, x in names.items()), F.col("doc_id").cast("long").alias("doc_id"))
    found = written(suffixes(own, passage - sparse + 1, sparse), "suffixes", True)
    # Rows that share a doc_id share their sites: too many are no harm, as stretches are compared again.
    who = F.coalesce("doc_id", "doc").alias("who")
    rows = found.select(who, F.explode(F.arrays_zip("keys", "positions")).alias("x")).select(F.col("x.keys").alias("key"), "who", F.col("x.positions").alias("at"))
    sites = shared(rows).groupBy("who").agg(F.collect_set("at").alias("sites"))
    near = own.withColumn("who", who).join(sites, "who").select("text", "name", "doc", "sites")
    repeated = spans(*holdings(stretches(near, passage, sparse), passage), passage)
    return found.select("doc_id", "n_words", "name", "doc").join(repeated, ["name", "doc"], "left").select("doc_id", "n_words", "name", "doc", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def repeated(docs: DataFrame, passage: int = PASSAGE, sparse: int = SPARSE) -> DataFrame:
    """A row for every row of docs, as `passages` finds them: doc_id, n_words, n_repeated (words in repeated passages),
    n_passages, and passages, start:end:later comma-joined."""
    count = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    one = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), F.when(s["later"], "1").otherwise("0")))
    return passages(docs, passage, sparse).select("doc_id", "n_words", count.alias("n_repeated"), F.size("spans").cast("long").alias("n_passages"), F.array_join(one, ",").alias("passages"))


def remove(docs: DataFrame, passage: int = PASSAGE, sparse: int = SPARSE) -> DataFrame:
    """docs without the later copies of repeated passages, as `passages` finds them: all rows stay, repeated ones and those
    without a doc_id too, columns as they were whatever their names, null texts null; an empty table stays empty."""
    found = passages(docs, passage, sparse).select(F.col("name").alias("__of"), F.col("doc").alias("__of_doc"), F.filter("spans", lambda s: s["later"]).alias("__spans")).where("size(__spans) > 0").dropDuplicates(["__of", "__of_doc"])

    @F.pandas_udf("string")
    def without(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if a is None else cut(t, list(zip(a, b))) for t, a, b in zip(text, starts, ends)], dtype=object)

    names = identity()
    joined = docs.withColumn("__name", names["name"]).withColumn("__doc", names["doc"]).join(found, (F.col("__name") == F.col("__of")) & (F.col("__doc") == F.col("__of_doc")), "left")
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(without("text", F.col("__spans.start"), F.col("__spans.end")))).select(*docs.columns)
