"""Repeated substrings by fixed-block anchors.

Every document gives non-overlapping blocks of `ANCHOR` words from its beginning, the reference blocks, and every run of
`ANCHOR` words anywhere, the rolling windows that probe them. A passage of `WINDOW` words holds a whole reference block
of its own document wherever it begins, as 2 * ANCHOR - 1 <= WINDOW, so if it stands elsewhere too that block is hit
there. Hit blocks are extended to the left and to the right to all windows of `WINDOW` words around them; equal windows
meet by their hash, and all but the earliest of them are later copies. What these cover, run by run, is a maximal exact
repeat.

Blocks and windows travel in packed rows, one for each block of text and share of the hash range. A block of text sends
each hash once and settles what repeats within it by itself, so a passage that a third of all documents hold costs a
place for each block of text, not for each document, and never a pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import in_blocks, text_or_empty, written
from ledgerloom.llm.repeats import _BYTE, _BYTE_INVERSE, _TABLE, _WORD, _WORD_INVERSE, _bytes, identity, rolling

WINDOW = 20
ANCHOR = 10
#: Bytes of text for each share of the hash range, and the shares beyond which these grow instead; windows for each share.
SHARE, MOST_SHARES, WINDOWS = 16 << 20, 400_000, 2_000_000
#: Bytes whose words are hashed or cut at once.
PIECE = 4 << 20
_SPACE = np.array([k == 32 or 9 <= k <= 13 for k in range(256)])
_GAP = re.compile(rb"[ \t-\r]")
_NO = np.zeros(0, np.int64)


def _hashed(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.concatenate([[0], ends[:-1]])
    before[starts[starts < len(data)]] = False
    after[ends[ends > 0] - 1] = False
    first, last = np.nonzero(inside & ~before)[0], np.nonzero(inside & ~after)[0] + 1
    return rolling(_TABLE[data], _BYTE, _BYTE_INVERSE, first, last), np.diff(np.searchsorted(first, np.concatenate([[0], ends])))


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, end to end, and the number of words in each; a long text a piece after the other."""
    data, ends = _bytes(texts)
    if len(ends) != 1 or len(data) <= PIECE:
        return _hashed(data, ends)
    parts, first = [], 0
    while first < len(data):
        last, step = len(data), PIECE
        while first + step < len(data):
            gaps = np.nonzero(_SPACE[data[first + step // 2 : first + step]])[0]
            if len(gaps):
                last = first + step // 2 + int(gaps[-1]) + 1
                break
            step *= 2
        parts.append(_hashed(data[first:last], np.array([last - first]))[0])
        first = last
    words = np.concatenate(parts)
    return words, np.array([len(words)])


def stretches(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, about `piece` bytes after the other."""
    first = 0
    while first < len(text):
        gap = _GAP.search(text, first + piece)
        last = gap.start() if gap else len(text)
        yield text[first:last].split()
        first = last


def _shares(hashes: np.ndarray, shares: int) -> np.ndarray:
    """Which share of the hash range each hash lies in; it grows with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def _u32(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed rows, and the row of each."""
    parts = [np.frombuffer(x or b"", kind) for x in column.to_pylist()]
    return np.concatenate(parts or [np.zeros(0, kind)]), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


_PROBES = "part long, block long, refs binary, ordinals binary, others binary, names array<long>, docs array<long>, sizes array<int>"


def probes(docs: DataFrame, shares: int, limit: int, window: int, anchor: int) -> DataFrame:
    """Packed rows for docs (text, name, doc). For each block of text and share: refs, the hashes of reference blocks that
    the block of text has once, with their ordinals in it, and others, all other hashes. And one row with the documents
    of the block of text: names, docs, how many reference blocks each has, and the ordinals of those that repeat in it."""
    names = [c.split()[0] for c in _PROBES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(in_blocks(batches, "text", limit), task):
            words, counts = hashed(batch.column(0))
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(words)) - (np.cumsum(counts) - counts)[row]
            room = counts[row] - place
            at = np.nonzero((counts[row] >= window) & (room >= anchor))[0]
            if not len(at):
                continue
            is_ref = (place[at] % anchor == 0) & (room[at] > window - anchor)  # a window fits around it
            ordinal = np.cumsum(is_ref) - 1
            grams = rolling(words, _WORD, _WORD_INVERSE, at, at + anchor)
            order = np.argsort(grams, kind="stable")
            grams, is_ref, ordinal = grams[order], is_ref[order], ordinal[order]
            first = np.nonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))[0]
            size = np.diff(np.concatenate([first, [len(grams)]]))
            local = ordinal[is_ref & np.repeat(size > 1, size)]
            alone = is_ref[first] & (size == 1)
            value, share = grams[first], _shares(grams[first], shares)
            refs, ordinals, others = value[alone], ordinal[first][alone], value[~alone]
            there = np.unique(share)
            a, b = (np.searchsorted(share[m], [there, there + 1]) for m in (alone, ~alone))
            rows = [(p, number, _u32(refs[i:j]), _u32(ordinals[i:j]), _u32(others[k:n]), None, None, None) for p, i, j, k, n in zip(there.tolist(), *a, *b)]
            sizes = np.where(counts >= window, (counts - (window - anchor) - 1) // anchor + 1, 0)
            rows.append((number % shares, number, None, _u32(local), None, batch.column(1), batch.column(2), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return docs.mapInArrow(run, _PROBES)


def _hit(table: pa.Table) -> pa.Table:
    """The ordinals of a share's reference blocks that another row has, too; rows with documents pass through."""
    refs, row = _joined(table.column("refs"), "<u4")
    ordinals, of = _joined(table.column("ordinals"), "<u4")
    lists = np.array([x is not None for x in table.column("names").to_pylist()])
    ordinals = ordinals[~lists[of]] if len(of) else ordinals
    others = np.unique(_joined(table.column("others"), "<u4")[0])
    value, back, times = np.unique(refs, return_inverse=True, return_counts=True)
    near = np.searchsorted(others, value)
    known = (times > 1) | (np.concatenate([others, [0]])[near] == value) & (near < len(others))
    hits = known[back]
    edges, own = np.searchsorted(row[hits], np.arange(len(lists) + 1)), ordinals[hits]
    found = [p if is_list else _u32(own[a:b]) for a, b, is_list, p in zip(edges, edges[1:], lists.tolist(), table.column("ordinals").to_pylist())]
    keep = np.array([bool(x) or y for x, y in zip(found, lists.tolist())], bool)
    out = pa.table({"block": table.column("block"), "hits": pa.array(found, pa.binary()), "names": table.column("names"), "docs": table.column("docs"), "sizes": table.column("sizes")})
    return out.filter(pa.array(keep))


def _by_document(anchor: int):
    def run(table: pa.Table) -> pa.Table:
        k = next(k for k, x in enumerate(table.column("names").to_pylist()) if x is not None)
        sizes = np.array(table.column("sizes")[k].as_py(), np.int64)
        ordinals = np.unique(_joined(table.column("hits"), "<u4")[0]).astype(np.int64)
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, ordinals, side="right")
        refs = (ordinals - (ends - sizes)[doc]) * anchor
        own, first = np.unique(doc, return_index=True)
        pick = lambda c: pa.array(np.array(table.column(c)[k].as_py(), np.int64)[own], pa.int64())
        return pa.table({"name": pick("names"), "doc": pick("docs"), "refs": pa.ListArray.from_arrays(pa.array(np.append(first, len(refs)), pa.int32()), pa.array(refs, pa.int32()))})

    return run


def shared_blocks(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(name, doc, refs): the places of the reference blocks of docs (text, name, doc) that a rolling window elsewhere hits.
    Places of 32-bit hashes within a share: a few more than there are, which the windows' hashes settle."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = max(1, min(-(-total // SHARE), MOST_SHARES))
    limit = max(PIECE, total // shares // 4)
    found = probes(docs, shares, limit, window, anchor).groupBy("part").applyInArrow(_hit, "block long, hits binary, names array<long>, docs array<long>, sizes array<int>")
    blocks = written(found, "hit-blocks", True)
    return blocks.groupBy("block").applyInArrow(_by_document(anchor), "name long, doc long, refs array<int>")


_PLACES = "part long, names array<long>, docs array<long>, sizes array<int>, at binary, h1 binary, h2 binary"


def windows(near: DataFrame, shares: int, window: int, anchor: int) -> DataFrame:
    """Packed rows for near (text, name, doc, doc_id, refs): for each block of text and share the first place there of each
    window of words around a reference block, by document and with two hashes; and without hashes the other places, which
    are later copies whatever else there is."""
    names = [c.split()[0] for c in _PLACES.split(", ")]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]

    def packed(part: int, name: np.ndarray, doc: np.ndarray, row: np.ndarray, s: np.ndarray, h1: bytes | None, h2: bytes | None) -> tuple:
        first = np.nonzero(np.concatenate([[True], row[1:] != row[:-1]]))[0]
        return part, name[row[first]], doc[row[first]], np.diff(np.append(first, len(row))), s.astype("<i4").tobytes(), h1, h2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(in_blocks(batches, "text", PIECE)):
            name, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            order = np.lexsort((doc, name))
            batch, name, doc = batch.take(pa.array(order)), name[order], doc[order]
            words, counts = hashed(batch.column(0))
            lists = batch.column(4)
            of, a = np.repeat(np.arange(len(counts)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)
            first, last = np.maximum(a - anchor + 1, 0), np.minimum(a, counts[of] - window)
            n = np.maximum(last - first + 1, 0)
            if not n.sum():
                continue
            s = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row = np.repeat(of, n)
            at = (np.cumsum(counts) - counts)[row] + s
            h1, h2 = rolling(words, _WORD, _WORD_INVERSE, at, at + window), rolling(words, _BYTE, _BYTE_INVERSE, at, at + window) >> np.uint64(32)
            order = np.lexsort((h2, h1))  # stable: equal windows stay in the order of places
            fresh = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
            own = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
            same = (name[row[own]] == name[row[order]]) & (doc[row[own]] == doc[row[order]]) & (s[own] == s[order])
            later = np.sort(order[~same])
            ahead = np.sort(order[fresh])
            share = _shares(h1[ahead], shares)
            ahead, share = ahead[by := np.argsort(share, kind="stable")], share[by]
            there = np.unique(share)
            rows = [packed(p, name, doc, row[x := ahead[i:j]], s[x], h1[x].astype("<u8").tobytes(), _u32(h2[x])) for p, i, j in zip(there.tolist(), *np.searchsorted(share, [there, there + 1]))]
            if len(later):
                rows.append(packed(number % shares, name, doc, row[later], s[later], None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return near.select("text", "name", "doc", "doc_id", "refs").mapInArrow(run, _PLACES)


def _later(table: pa.Table) -> pa.Table:
    """(name, doc, at): the places of a share's windows that are not the earliest of their kind."""
    at, row = _joined(table.column("at"), "<i4")
    sizes = np.array([x for y in table.column("sizes").to_pylist() for x in y], np.int64)
    name, doc = (np.repeat(np.array([x for y in table.column(c).to_pylist() for x in y], np.int64), sizes) for c in ("names", "docs"))
    known = np.array([x is None for x in table.column("h1").to_pylist()])[row]
    h1, h2 = (_joined(table.column(c), kind)[0] for c, kind in (("h1", "<u8"), ("h2", "<u4")))
    free = np.nonzero(~known)[0]
    order = np.lexsort((at[free], doc[free], name[free], h2, h1))
    if len(order):
        fresh = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        own, x = free[order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]], free[order]
        known[x] = (name[own] != name[x]) | (doc[own] != doc[x]) | (at[own] != at[x])
    found = np.nonzero(known)[0]
    found = found[np.lexsort((at[found], doc[found], name[found]))]
    name, doc, packed = name[found], doc[found], at[found].astype("<i4").tobytes()
    first = np.nonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]))[0] if len(found) else _NO
    ends = np.append(first[1:], len(found)) if len(first) else _NO
    return pa.table({"name": pa.array(name[first], pa.int64()), "doc": pa.array(doc[first], pa.int64()), "at": pa.array([packed[4 * i : 4 * j] for i, j in zip(first.tolist(), ends.tolist())], pa.binary())})


def own_rows(docs: DataFrame) -> DataFrame:
    return docs.select(text_or_empty().cast("binary").alias("text"), *(x.alias(n) for n, x in identity().items()), F.col("doc_id").cast("long").alias("doc_id"))


def later_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(name, doc, at): for each row of docs that has later copies, by its `identity`, the first words of those windows of
    `window` words that begin earlier too: an array of packed little-endian 32-bit integers."""
    if 2 * anchor - 1 > window:
        raise ValueError("a window must hold a whole reference block wherever it begins")
    own = own_rows(docs)
    refs = written(shared_blocks(own, window, anchor), "hit-references", True)
    total = refs.agg(F.sum(F.size("refs"))).first()[0] or 0
    shares = max(1, -(-total * anchor // WINDOWS))
    # Rows that repeat as a whole have the same places, which are none of each other's copies.
    near = own.join(refs, ["name", "doc"])
    found = windows(near, shares, window, anchor).groupBy("part").applyInArrow(_later, "name long, doc long, at binary")
    return found.groupBy("name", "doc").agg(F.collect_list("at").alias("at"))


def covered(at: list[bytes], n_words: int, window: int) -> np.ndarray:
    """Which words lie in a window that begins at one of the packed places."""
    depth = np.zeros(n_words + 1, np.int32)
    for x in at:
        places = np.frombuffer(x, "<i4")
        np.add.at(depth, places, 1)
        np.add.at(depth, places + window, -1)
    return np.cumsum(depth[:-1]) > 0


def kept_words(text: bytes, at: list[bytes] | None, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """For each stretch of the text: how many words it has, and those that stay."""
    gone = covered(at, sum(map(len, stretches(text))), window).tolist() if at else None
    first = 0
    for words in stretches(text):
        yield len(words), words if gone is None else [w for w, x in zip(words, gone[first : first + len(words)]) if not x]
        first += len(words)


def reduced(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs.

    A word is removed where it lies in `window` words whose sequence begins earlier, too: in a row with a smaller doc_id
    (null ones last, and of one doc_id by a hash of the text), or further ahead in the same text; what is removed is judged
    on the texts as they are. Words are runs without white space, unchanged; a null text has none; a text with fewer than
    `window` words keeps all. Rows that are equal in doc_id and text are one document: they lose the same words, and none
    to each other. A text of any length is read in pieces; an empty table gives no rows; other columns are ignored.
    """
    later = later_windows(docs, window, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text"):
            out = []
            for doc_id, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                digest, n, stay, apart = hashlib.sha256(), 0, 0, b""
                for count, words in kept_words(text.as_py(), at, window):
                    n, stay = n + count, stay + len(words)
                    if words:
                        digest.update(apart + b" ".join(words))
                        apart = b" "
                out.append((doc_id, n, n - stay, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return own_rows(docs).join(later, ["name", "doc"], "left").select("doc_id", "text", "at").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs without the words that `reduced` removes: all rows stay, columns as they were whatever their names. Where words
    go the others are joined by single spaces; other texts, null ones too, are unchanged."""
    later = later_windows(docs, window, anchor)

    @F.pandas_udf("string")
    def without(text: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([t if a is None else b" ".join(w for _, words in kept_words(t.encode(), list(a), window) for w in words).decode() for t, a in zip(text, at)], dtype=object)

    rows = docs.select(F.struct(*docs.columns).alias("row"), *(x.alias(n) for n, x in identity().items())).join(later, ["name", "doc"], "left")
    text = F.when(F.col("at").isNull(), F.col("row.text")).otherwise(without("row.text", "at"))
    return rows.withColumn("text", text).select(*("text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
