"""Packing documents into token windows by non-negative least squares.

Documents are cut into full windows and a rest shorter than one. The lengths of the rests form a histogram of at most
`window` - 1 bins, whatever the data. Combinations of few lengths that fill a window exactly are enumerated, their
repeat counts solved against the histogram by non-negative least squares and rounded down to what the bins hold. What
they leave is cut into pieces of power-of-two lengths, which fill windows greedily, longest first, without a gap. A
piece finds its place from its length and its rank among pieces of that length, so no token is shuffled to place it.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import give_back, in_blocks, text_or_empty, written

WINDOW = 1024
END = 0
VOCABULARY = "byte_bpe_50k.json"
#: The characters of units whose ids a worker remembers at most, and those of a unit that is worth it; the bytes of texts that
#: it encodes at once.
REMEMBERED, SHORT, AT_ONCE = 600_000, 64, 1 << 20
#: The pattern by which byte-level BPE splits text before it merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that is neither a space nor a line end.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in
    order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Texts to their ids as little-endian 32-bit integers. The ids of each unit between splits are remembered. The
    units of a block that are not yet known are encoded as one text, by a second library that is given the same
    vocabulary and merges faster, if the vocabulary's merges rank as its ids do; else, and for texts with unusual white
    space, by the tokenizer itself."""

    def __init__(self, path: str) -> None:
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [x.content for x in added.values()]
        model = json.loads(self.tokenizer.to_str())["model"]
        ranked = [model["vocab"].get("".join(x if isinstance(x, list) else x.split(" "))) for x in model["merges"]]
        own = byte_of()
        ranks = {bytes(own[c] for c in token): k for token, k in model["vocab"].items() if k not in added}
        self.faster = ranked == sorted(ranked) and Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(model["vocab"].values()) + 1, bool)
        for token, k in ranks.items():
            self.begins[k] = token[0] in b" \n"
        self.known: dict[str, bytes] = {}
        self.size = 0

    def units(self, text: str) -> list[str] | None:
        """text cut at its single spaces and before its line ends, where the pattern always splits; a unit that doesn't
        begin with a line end has lost the space before it. None where spaces of other kinds or runs of them need the
        pattern itself."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text[:1] == " " or text[-1:] in (" ", "\n"):
            return None
        if _OTHER_SPACE(text) or any(x in text for x in self.special):
            return None
        return f"\n{text}".replace("\n", " \n")[1:].split(" ")

    def learn(self, units: list[str]) -> None:
        """Line ends and spaces stand only at the beginning of a unit, so they tell where the ids of each begin."""
        for lines in (True, False):
            own = [x for x in units if (x[0] == "\n") == lines and x != "\n"]
            for first in range(0, len(own), 8192):
                part = own[first : first + 8192]
                text = "".join(part) if lines else " " + " ".join(part)
                ids = np.array(self.faster.encode_ordinary(text) if self.faster else self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
                cuts = [*(np.nonzero(self.begins[ids])[0] * 4).tolist(), len(ids) * 4]
                self.known.update(zip(part, map(ids.tobytes().__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        self.known["\n"] = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of all texts, as a list: a generator that its reader leaves before its end would never forget a unit."""
        cut = [self.units(t) for t in texts]
        if self.size >= REMEMBERED:
            self.known.clear()
            self.size = 0
        new: set[str] = set()
        for units in cut:
            new.update(units or ())
        fresh = [x for x in new if x not in self.known]
        self.learn(fresh)
        out = []
        for text, units in zip(texts, cut):
            if units is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
            else:
                out.append(b"".join(map(self.known.__getitem__, units))[4:])  # without the line end put before the text
        for x in fresh:  # a long unit, such as a text without blanks, is not met again
            if len(x) > SHORT:
                del self.known[x]
            else:
                self.size += len(x)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop this process's encoders. A function of the module: the tables that a task's own function names go with it as copies."""
    _encoders.clear()


def binary(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def crcs(ids: bytes) -> list[int]:
    """The checksums of the power-of-two pieces that ids is cut into where no combination takes it whole."""
    out, first = [], 0
    for n in binary(len(ids) // 4):
        out.append(zlib.crc32(ids[first * 4 : (first + n) * 4]))
        first += n
    return out


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, doc_tokens, crc, crcs, ids, chunk, rank): every document's full windows and its rest.

    chunk names a block of rows by its place in the table, so that equal tables in equal files are packed alike; rank counts
    the pieces of one length in it from 0; ids is null unless asked for.
    """
    path = vocabulary or default_vocabulary()
    names = ("doc_id", "start", "length", "doc_tokens", "crc", "crcs", "ids", "rank", "chunk")
    types = (*(pa.int64(),) * 5, pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([END], dtype="<u4").tobytes()
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(in_blocks(batches, "text", AT_ONCE)):
            chunk, rank = task + number, [0] * (window + 1)
            out: list[list] = [[] for _ in names]
            texts = batch.column(1).cast(pa.string()).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                ids += end
                total = len(ids) // 4
                for first in range(0, total, window):
                    part = ids[first * 4 : (first + window) * 4]
                    n = len(part) // 4
                    for column, x in zip(out, (doc_id, first, n, total, zlib.crc32(part), crcs(part) if n < window else None, part if with_ids else None, rank[n], chunk)):
                        column.append(x)
                    rank[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)
        forget()  # made anew in about half a second; kept, it would stay in every worker while other stages run
        del encode
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, crc long, crcs array<long>, ids binary, rank long, chunk long")


def combinations(window: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Up to four lengths that fill a window: all pairs, multiples of one length, and for each length x the triples
    and quadruples x, x, y and x, y, y and x, x, x, y and x, x, y, y, of lengths that are present."""
    have = set(np.nonzero(present)[0].tolist()) - {0}
    found = {(window,)} if window in have else set()
    for x in have:
        for a, b in ((1, 1), (2, 1), (3, 1), (2, 2)):
            y, rest = divmod(window - a * x, b)
            if not rest and y in have:
                found.add(tuple(sorted([x] * a + [y] * b)))
        near = (window - x) // 2
        for y in range(max(1, near - 8), near):
            if y in have and window - x - y in have:
                found.add(tuple(sorted((x, y, window - x - y))))
    return sorted(found)


def non_negative_least_squares(combos: list[tuple[int, ...]], histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that makes the bins which combos use, x times over, close to the histogram: coordinate descent over a
    sparse matrix with at most four entries in a column."""
    columns = [np.unique(c, return_counts=True) for c in combos]
    x, rest = np.zeros(len(combos)), histogram.astype(float).copy()
    for _ in range(steps):
        moved = 0.0
        for j, (bins, times) in enumerate(columns):
            step = max(-x[j], float(times @ rest[bins]) / float(times @ times))
            if step:
                x[j] += step
                rest[bins] -= step * times
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    return x


def repeats(combos: list[tuple[int, ...]], x: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """x rounded down, and less where the bins don't hold as much: the largest counts are served first."""
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        bins, times = np.unique(combos[j], return_counts=True)
        if (n := min(int(x[j] + 1e-9), int((left[bins] // times).min()))) > 0:
            left[bins] -= n * times
            out.append((combos[j], n))
    return out


def layout(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, list[int]]], int]:
    """Where the pieces of each length go.

    Slots (length, first rank, end rank, times, first sequence, offset): rank r from first on is the (r - first) % times
    th of `times` such pieces in sequence first sequence + (r - first) // times. Tails (length, first rank, places): the
    ranks from first rank on are cut into powers of two; the ones of a size lie end to end, from the place given for it,
    in the token row that begins at the sequence returned last.
    """
    combos = combinations(window, histogram)
    chosen = repeats(combos, non_negative_least_squares(combos, histogram), histogram)
    used, slots, sequence = np.zeros(window + 1, np.int64), [], 0
    for combo, n in chosen:
        offset = 0
        for length, times in zip(*np.unique(combo, return_counts=True)):
            first = int(used[length])
            slots.append((int(length), first, first + int(times) * n, int(times), sequence, offset))
            used[length] += int(times) * n
            offset += int(length) * int(times)
        sequence += n
    left = {length: n for length in range(1, window + 1) if (n := int(histogram[length] - used[length]))}
    places: dict[int, dict[int, int]] = {length: {} for length in left}
    place = 0
    for size in binary(2 * window - 1):
        for length, n in left.items():
            if length & size:
                places[length][size] = place
                place += n * size
    return slots, [(length, int(used[length]), [places[length][x] for x in binary(length)]) for length in left], sequence


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary).

    Every token of every row of docs, its end id included, lies in one piece; pieces fill their sequence from offset 0
    without gaps, and all sequences but the last are full. window is a power of two. ids, little-endian 32-bit integers,
    is null unless asked for. A null text is empty and has the end id alone; repeated rows and rows with a null doc_id
    are packed like any other; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, window, vocabulary, with_ids), "pieces")
    counts = written(cut.groupBy("chunk", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r["length"]] = r["n"]
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = before.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("length", F.coalesce("before", F.lit(0)).alias("before")))).alias("befores"))  # at most `window` for each chunk
    ranked = cut.join(offsets, "chunk").withColumn("rank", F.col("rank") + F.col("befores")[F.col("length")])
    plan = spark.sparkContext.broadcast(layout(histogram, window))  # at most a few thousand combinations, whatever the data
    columns = ("doc_id", "start", "length", "doc_tokens", "rank", "crc", "crcs", "ids")
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, tails, last = plan.value
        of: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for length, *rest in sorted(slots):
            of.setdefault(length, []).append(tuple(rest))
        ends = {length: [x[1] for x in parts] for length, parts in of.items()}
        tail = {length: (first, places) for length, first, places in tails}
        for batch in batches:
            out: list[tuple] = []
            for doc_id, start, length, total, rank, crc, parts, ids in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if length in tail and rank >= tail[length][0]:
                    first, places = tail[length]
                    at = 0
                    for size, place, part in zip(binary(length), places, [crc] if parts is None else parts):
                        place += (rank - first) * size
                        out.append((doc_id, start + at, size, part, total, last + place // window, place % window, ids and ids[at * 4 : (at + size) * 4]))
                        at += size
                else:
                    first, _, times, sequence, offset = of[length][bisect_right(ends[length], rank)]
                    out.append((doc_id, start, length, crc, total, sequence + (rank - first) // times, offset + (rank - first) % times * length, ids))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (*(pa.int64(),) * 7, pa.binary()))], names=names)

    return ranked.select(*columns).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def packed(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """pack() without the ids themselves: a null text is empty, rows that repeat or share a doc_id are packed one by one, a
    text of any length is cut into windows, an empty table gives no rows, other columns are ignored."""
    return pack(docs, window, vocabulary).drop("ids")
