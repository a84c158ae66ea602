"""Language-model scores by online logistic context mixing.

A text is a sequence of classes, one for each word and one for its end. The most frequent words have classes of their
own; other words share classes by their first and last byte, apart for words of the dictionary (those that the training
texts hold twice or more) and new ones. Two models of the same build predict bits: one the classes, from the classes of
the up to three words before; one the bytes of new words, from up to five bytes before. A word of the dictionary costs,
besides its class, its share of that class. All chances add up to one, so a text's bits are those of a code for it.

The bits are the branches of a Huffman tree. Several predictors give the chance of each from what they have counted in a
hashed context. A mixer adds their stretched chances under weights that a gate chooses by how much the two longest
contexts have been seen; the weights are learnt online, over all training texts in mini-batches, each bit predicted as if
it had not been counted itself. An adaptive table refines the result.

What is gathered grows with the corpus: the dictionary with its exact counts is a table, never collected or broadcast.
The predictors' tables grow with the tokens up to 2**`MOST_BITS` slots, which bounds what is broadcast.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, give_back, partitions, text_or_empty, written

#: Classes: of one word each; shared by words of the dictionary; shared by new words; the end of a text.
HEADS, SHARED = 190, 32
KNOWN, NEW, END = HEADS, HEADS + SHARED, HEADS + 2 * SHARED
#: How often the training texts must hold a word of the dictionary.
TWICE = 2
#: Words before, and bytes before, that each predictor sees.
CLASS_ORDERS, BYTE_ORDERS = (0, 1, 2, 3), (1, 2, 3, 5)
#: The least and the most slots of a hashed table, as powers of two, and the tokens to a slot for classes (one new word for bytes).
LEAST_BITS, MOST_BITS, TOKENS_A_SLOT = 14, 22, 64
#: Gates; buckets of the refining table, for each gate; the mixer's step; what a count begins with.
GATES, BUCKETS, RATE, START = 16, 33, 0.1, 0.2
#: Gates of one of the two longest contexts.
GATED = 4
#: Bytes of text whose words are counted together; symbols whose bits are worked on together.
BLOCK, STEP = 24 << 20, 16_384
#: Symbols that are sorted together to be weighed.
TOGETHER = 1 << 21
#: Slots that are summed up together.
PART = 1 << 16
#: Steps of a weight when weights are added up as whole numbers, so that sums don't depend on their order.
FINE = 1 << 20
STOP = 256
#: What may stand before a symbol: none, or one of the classes, or of bytes, the stop and shared classes.
BEFORE = max(END + 2, STOP + SHARED + 2)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def shared_class(word: bytes) -> int:
    return zlib.crc32(word[:1] + word[-1:]) % SHARED


def _shared_class() -> Column:
    return (F.crc32(F.concat(F.substring("word", 1, 1), F.substring("word", -1, 1))) % SHARED).cast("int")


# --- words of blocks ---------------------------------------------------------------------------------------------


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary) end to end, and how many each text has."""
    large = pa.types.is_large_binary(texts.type)
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.large_string() if large else pa.string())))
    own = found.flatten()
    # A text that is empty, or begins or ends with white space, has empty words there.
    full = pc.not_equal(pc.binary_length(own), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.list_value_length(found).to_numpy())
    return own.filter(full).cast(pa.large_string()), np.diff(upto[ends], prepend=0)


def _packed(ids: np.ndarray) -> bytes:
    """Whole numbers below 2**32, their bytes of equal weight together, compressed."""
    return zstandard.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks, a row for each, with the block's distinct words and their counts in training rows.

    The block's texts are one sequence of places in `words`, text k having sizes[k] of them.
    """
    kind = "block long, doc_ids array<long>, held array<boolean>, bytes array<long>, sizes array<int>, sequence binary, words array<binary>, trained array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 24, 0
        waiting: list[pa.RecordBatch] = []
        size = 0

        def made() -> pa.RecordBatch:
            found, sizes = zip(*(words(own.column(2)) for own in waiting))
            numbers = pa.chunked_array(found).dictionary_encode().unify_dictionaries()
            del found
            sequence, sizes = np.concatenate([own.indices.to_numpy() for own in numbers.chunks]), np.concatenate(sizes)
            distinct = numbers.chunk(0).dictionary.cast(pa.large_binary()).cast(pa.binary())
            del numbers
            doc_ids, held, lengths = (pa.concat_arrays(own) for own in zip(*((b.column(0), b.column(1), pc.binary_length(b.column(2)).cast(pa.int64())) for b in waiting)))
            learns = np.repeat(~held.to_numpy(zero_copy_only=False), sizes)
            trained = np.bincount(sequence[learns], minlength=len(distinct)).astype(np.int64)
            one = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
            columns = [pa.array([part + n]), one(doc_ids), one(held), one(lengths), one(pa.array(sizes, pa.int32())), pa.array([_packed(sequence)], pa.binary()), one(distinct), one(pa.array(trained))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "held", "bytes", "sizes", "sequence", "words", "trained"])

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64))
            first = done = 0
            while first < batch.num_rows:
                # A block ends with the text that fills it.
                last = int(np.searchsorted(ends, BLOCK - size + done)) + 1
                waiting.append(batch.slice(first, last - first))
                size += int(ends[min(last, len(ends)) - 1]) - done
                first, done = last, int(ends[min(last, len(ends)) - 1])
                if size >= BLOCK:
                    yield made()
                    waiting, size, n = [], 0, n + 1
                    pa.default_memory_pool().release_unused()
        if waiting:
            yield made()
        waiting.clear()
        give_back()  # workers live on after their tasks

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, kind)


def numbered(held: DataFrame) -> DataFrame:
    """(block, at, word, c, lead) for every distinct word of every block: c is its count in all training rows, lead marks
    one row of each word. A word has a row for each block at most, so no word is hot."""
    rows = held.select("block", F.posexplode(F.arrays_zip("words", "trained"))).select("block", F.col("pos").alias("at"), F.col("col.words").alias("word"), F.col("col.trained").alias("trained"))
    same = Window.partitionBy("word")
    return rows.select("block", "at", "word", F.sum("trained").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("lead"))


# --- the bit models ----------------------------------------------------------------------------------------------


class Code:
    """A Huffman tree over the symbols of a histogram, every one with a count more: nodes and branches of their paths."""

    def __init__(self, histogram: np.ndarray) -> None:
        n = len(histogram)
        heap = [(int(x) + 1, s) for s, x in enumerate(histogram)]
        heapq.heapify(heap)
        above: dict[int, tuple[int, int]] = {}
        for node in range(n, 2 * n - 1):
            (a, s), (b, t) = heapq.heappop(heap), heapq.heappop(heap)
            above[s], above[t] = (node, 0), (node, 1)
            heapq.heappush(heap, (a + b, node))
        paths = []
        for s in range(n):
            path = []
            while s in above:
                s, branch = above[s]
                path.append((s - n, branch))
            paths.append(path[::-1])
        self.sizes = np.array([len(p) for p in paths])
        self.nodes = np.zeros((n, max(self.sizes)), np.int64)
        self.bits = np.zeros((n, max(self.sizes)), np.int64)
        for s, path in enumerate(paths):
            for k, (node, branch) in enumerate(path):
                self.nodes[s, k], self.bits[s, k] = node, branch
        # All paths end to end, and where each begins.
        on = np.arange(self.nodes.shape[1]) < self.sizes[:, None]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat_salts = _salts(self.nodes[on])
        # Branches are numbered by node and bit.
        self.branches = 2 * (n - 1)
        self.flat_branches = self.nodes[on] * 2 + self.bits[on]


def _salts(nodes: np.ndarray) -> np.ndarray:
    return nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Slots of hashes that have met their salts; h is worked on in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(64 - bits)
    return h.view(np.int64)


def _context(h: np.ndarray, order: int) -> np.ndarray:
    """The context of an order, from a hash of that many symbols before."""
    return _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(order + 1))


def _further(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    return h * np.uint64(0x9E3779B97F4A7C15) + before.astype(np.uint64) + np.uint64(1)


def near_slots(code: Code, order: int, bits: int) -> np.ndarray:
    """The slot of every node after every symbol, or none, that may stand before: an array (what stands before, nodes).
    Orders below 2 have no more contexts than that, so their slots are not hashed for each bit."""
    h = np.zeros(1, np.uint64) if order == 0 else _further(np.zeros(BEFORE, np.uint64), np.arange(BEFORE))
    return _slots(_context(h, order)[:, None] + _salts(np.arange(code.branches // 2)), bits)


class Bits:
    """The bits of symbols: of each symbol their number, of each bit its value and its branch, and the slots of its longer
    contexts."""

    def __init__(self, code: Code, bits: list[int], symbols: np.ndarray, before: np.ndarray, contexts: list[np.ndarray]) -> None:
        self.symbols, self.before = symbols, before
        self.n = code.sizes[symbols]
        self.ends = np.cumsum(self.n)
        step = np.arange(self.ends[-1] if len(symbols) else 0)
        step += np.repeat(code.first[symbols] - self.ends + self.n, self.n)
        self.branch = _take(code.flat_branches, step)
        self.bit = self.branch & 1
        self.after = np.repeat(before * code.branches, self.n)
        self.after += self.branch
        salt = _take(code.flat_salts, step)
        self.slots = []
        for context, b in zip(contexts, bits[len(bits) - len(contexts) :]):
            h = np.repeat(context, self.n)
            h += salt
            self.slots.append(_slots(h, b))


def _keys(symbols: np.ndarray, room: np.ndarray, depth: int, kind: type) -> np.ndarray:
    """Each symbol with what stands before it, as one number: the nearest first, none where room, the number of symbols
    before, is less, and the symbol itself last."""
    out = symbols.astype(kind)
    for back in range(1, min(depth, len(symbols) - 1) + 1):
        out[back:] |= np.where(room[back:] >= back, symbols[:-back] + 1, 0).astype(kind) << kind(_width(out) * (depth + 1 - back))
    return out


def _width(keys: np.ndarray) -> int:
    """The binary places of a symbol in keys: classes take 8, bytes with the stop and shared classes 9."""
    return 8 if keys.itemsize == 4 else 9


def class_keys(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys of texts of classes that lie end to end, text k having sizes[k] of them with the end."""
    room = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return _keys(classes, room, max(CLASS_ORDERS), np.uint32)


def byte_keys(spelt: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bytes of words, each after the key of its class and with a stop, and how many each word has but for the
    class."""
    lengths = np.fromiter(map(len, spelt), np.int64, len(spelt)) + 2
    ends = np.cumsum(lengths)
    symbols = np.full(int(ends[-1]) if len(spelt) else 0, STOP, np.int32)
    first = np.zeros(len(symbols), bool)
    first[ends - lengths] = True
    inner = ~first
    inner[ends - 1] = False
    symbols[inner] = np.frombuffer(b"".join(spelt), np.uint8)
    symbols[first] = [STOP + 1 + shared_class(w) for w in spelt]
    room = np.arange(len(symbols)) - np.repeat(ends - lengths, lengths)
    return _keys(symbols, room, max(BYTE_ORDERS), np.uint64), lengths - 1


def coded(code: Code, keys: np.ndarray) -> np.ndarray:
    """Keys of symbols that the code has; a word's class only stands before its bytes."""
    own = keys & keys.dtype.type((1 << _width(keys)) - 1)
    return keys[own < len(code.sizes)]


def bits_of(code: Code, orders: tuple[int, ...], bits: list[int], keys: np.ndarray) -> Bits:
    """The bits of keys; contexts are hashes of what stands before."""
    width, depth = _width(keys), max(orders)
    at = lambda back: (keys >> keys.dtype.type(width * (depth + 1 - back))) & keys.dtype.type((1 << width) - 1)
    nearest = at(1)
    h, contexts = _further(np.zeros(len(keys), np.uint64), nearest), []
    for back in range(2, depth + 1):
        h = _further(h, at(back))
        if back in orders:
            contexts.append(_context(h, back))
    return Bits(code, bits, at(depth + 1).astype(np.int64), nearest.astype(np.int64), contexts)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs. Equal and similar contexts meet, and with them the places of
    tables that they need."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


def stretch_of(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((np.maximum(ones, 0) + START) / (np.maximum(zeros, 0) + START)).astype(np.float32)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Predictors:
    """Stretched chances and gates of a model; with `without`, a bit is counted once less. Orders below 2 are laid out by
    branch, longer ones by slot, or slot and bit. The last two orders' gates stand in the last two of the 24 binary places
    of their stretched chances, so that one lookup gives both."""

    def __init__(self, model: Model, without: bool) -> None:
        self.without, self.first, self.near, self.far = without, 0 in model.orders, [], []
        for order, b, c in zip(model.orders, model.bits, model.counts):
            if order < 2:
                c = c[near_slots(model.code, order, b)]
            zeros, ones = c[..., 0], c[..., 1]
            by_bit = [stretch_of(ones, zeros - without), stretch_of(ones - without, zeros)] if without or order < 2 else [stretch_of(ones, zeros)]
            table = np.stack(by_bit, axis=-1)
            if order in model.orders[-2:]:
                level = np.searchsorted([1, 3, 15], np.maximum(c.sum(axis=1) - without, 0), side="right").astype(np.int32)
                table.view(np.int32)[:] = table.view(np.int32) & -GATED | level[:, None]
            (self.near if order < 2 else self.far).append(table.ravel())

    def inputs(self, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Inputs, a row for each predictor, and gates."""
        x = np.empty((len(self.near) + len(self.far), len(bits.bit)), np.float32)
        if self.first:
            _take(self.near[0], bits.branch, x[0])
        _take(self.near[-1], bits.after, x[len(self.near) - 1])
        for row, s, table in zip(x[len(self.near) :], bits.slots, self.far):
            _take(table, s * 2 + bits.bit if self.without else s, row)
        gates = x[-2:].view(np.int32) & GATED - 1
        gate = gates[0] * GATED
        gate += gates[1]
        return x, gate.astype(np.int64)


def _take(table: np.ndarray, at: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """table[at] for places that are all in the table, so that none need be checked."""
    return np.take(table, at, out=out, mode="clip")


def _chance(dot: np.ndarray) -> np.ndarray:
    """squash in place, for numbers within 14 of 0."""
    np.negative(dot, out=dot)
    np.exp(dot, out=dot)
    dot += 1
    return np.divide(1, dot, out=dot)


class Mixer:
    """Gated weights over the predictors and the table that refines their result."""

    def __init__(self, predictors: int, weights: np.ndarray | None = None, table: np.ndarray | None = None) -> None:
        self.weights = np.full((GATES, predictors), 0.3) if weights is None else weights
        centre = squash((np.arange(BUCKETS) - BUCKETS // 2) / 2)
        self.prior = np.stack([1 - centre, centre])[:, None, :] * 8.0  # what a bucket believes before it has seen a bit
        self.table = np.zeros((2, GATES, BUCKETS)) if table is None else table
        self.refined: np.ndarray | None = None

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        dot, own = np.zeros(len(gate), np.float32), np.empty(len(gate), np.float32)
        for row, weights in zip(x, self.weights.T.astype(np.float32)):
            _take(weights, gate, own)
            own *= row
            dot += own
        return np.clip(dot, -14, 14, out=dot)

    def bucket(self, dot: np.ndarray) -> np.ndarray:
        at = dot * 2
        np.rint(at, out=at)
        np.clip(at, -(BUCKETS // 2), BUCKETS // 2, out=at)
        at += BUCKETS // 2
        return at.astype(np.int64)

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Learns from bits and gives how many each gate has."""
        dot = self.mixed(x, gate)
        n = np.bincount(gate, minlength=GATES)
        at = bit * GATES
        at += gate
        at *= BUCKETS
        at += self.bucket(dot)
        self.table += np.bincount(at, minlength=self.table.size).reshape(self.table.shape)
        error = bit.astype(np.float32)
        error -= _chance(dot)
        step = np.stack([np.bincount(gate, weights=np.multiply(error, row, out=dot), minlength=GATES) for row in x], axis=1)
        self.weights += RATE * step / np.maximum(n, 1)[:, None]
        return n

    def chance(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The chance of a 1."""
        if self.refined is None:
            zero, one = self.table + self.prior
            self.refined = (one / (zero + one)).ravel().astype(np.float32)
        dot = self.mixed(x, gate)
        at = gate * BUCKETS
        at += self.bucket(dot)
        p = _chance(dot)
        p += _take(self.refined, at)
        p /= 2
        return np.clip(p, 1e-6, 1 - 1e-6, out=p)


class Model:
    """A code, the orders and sizes of its predictors' tables, what these have counted, and a mixer."""

    def __init__(self, code: Code, orders: tuple[int, ...], bits: list[int], counts: list[np.ndarray], learnt: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.code, self.orders, self.bits, self.counts, self.learnt = code, orders, bits, counts, learnt
        self._ready: tuple[Predictors, Mixer] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def ready(self, without: bool = False) -> tuple[Predictors, Mixer]:
        if self._ready is None or self._ready[0].without != without:
            self._ready = Predictors(self, without), Mixer(len(self.bits), *(self.learnt or ()))
        return self._ready

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """For each key of a symbol that the code has, the log10 of the symbol's chance."""
        keys = coded(self.code, keys)
        return np.concatenate([np.zeros(0), *(self._costs(keys[a : a + TOGETHER]) for a in range(0, len(keys), TOGETHER))])

    def _costs(self, keys: np.ndarray) -> np.ndarray:
        predictors, mixer = self.ready()
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.concatenate([np.ones(min(len(keys), 1), bool), ranked[1:] != ranked[:-1]])
        ranked = ranked[new]
        costs = np.empty(len(ranked))
        for a in range(0, len(ranked), STEP):
            bits = bits_of(self.code, self.orders, self.bits, ranked[a : a + STEP])
            p = mixer.chance(*predictors.inputs(bits))
            # Every symbol has a bit. Of a 0, 1 - p is the chance.
            p -= (1 - bits.bit).astype(np.float32)
            costs[a : a + STEP] = np.add.reduceat(np.log(np.abs(p, out=p), out=p).astype(np.float64), bits.ends - bits.n)
        costs /= np.log(10)
        out = np.empty(len(keys))
        out[order] = costs[np.cumsum(new) - 1]
        return out


def table_bits(slots: int, orders: tuple[int, ...]) -> list[int]:
    """Sizes of the tables: orders below 2 have few contexts; longer ones have `slots` within limits."""
    grown = min(max(slots.bit_length(), LEAST_BITS), MOST_BITS)
    return [min(12 + 5 * k, grown) if k < 2 else grown for k in orders]


def counted(blocks_of_keys: Iterator[np.ndarray], code: Code, orders: tuple[int, ...], bits: list[int]) -> list[np.ndarray]:
    """What each predictor has counted over all keys, by slot and bit."""
    held = [np.zeros(2 << b, np.float64) for b in bits]
    far = [table for table, order in zip(held, orders) if order >= 2]
    follows = np.zeros(BEFORE * len(code.sizes), np.float64)
    for keys in blocks_of_keys:
        keys, times = distinct(coded(code, keys))
        for a in range(0, len(keys), STEP):
            own = bits_of(code, orders, bits, keys[a : a + STEP])
            n = times[a : a + STEP].astype(np.float64)
            np.add.at(follows, own.before * len(code.sizes) + own.symbols, n)
            n = np.repeat(n, own.n)
            for table, s in zip(far, own.slots):
                s *= 2
                s += own.bit
                np.add.at(table, s, n)
    # Orders below 2 are counted by symbol and what stands before it; their bits follow from that.
    at = np.arange(BEFORE)[:, None] * code.branches + code.flat_branches
    after = np.bincount(at.ravel(), weights=np.repeat(follows.reshape(BEFORE, -1), code.sizes, axis=1).ravel(), minlength=BEFORE * code.branches).reshape(BEFORE, -1)
    for table, order, b in zip(held, orders, bits):
        if order < 2:
            own = after if order else after.sum(axis=0, keepdims=True)
            slots = near_slots(code, order, b)
            for bit in (0, 1):
                table[bit::2] += np.bincount(slots.ravel(), weights=own[:, bit::2].ravel(), minlength=len(table) // 2)
    return held


def count_bits(rows: DataFrame, keys, code: Code, orders: tuple[int, ...], bits: list[int]) -> list[np.ndarray]:  # noqa: ANN001
    """What each predictor has counted over all rows; keys: from a batch to arrays of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counted((own for batch in batches for own in keys(batch)), code, orders, bits)
        for k, table in enumerate(held):
            for part in range(0, len(table), PART):
                own = table[part : part + PART]
                at = np.nonzero(own)[0]
                if len(at):
                    data = zstandard.compress(np.diff(at, prepend=-1).astype("<u2").tobytes() + own[at].astype("<u8").tobytes(), 1)
                    yield pa.RecordBatch.from_pydict({"predictor": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([data], pa.binary())})
        held.clear()
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the rows of each part, which follow one another."""
        now, total = None, np.zeros(PART)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"predictor": pa.array([now[0]], pa.int32()), "part": pa.array([now[1]], pa.int32()), "n": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        for batch in batches:
            for k, part, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != (k, part):
                    if now:
                        yield made()
                    now, total = (k, part), np.zeros(PART)
                data = zstandard.decompress(data)
                n = len(data) // 10
                total[np.cumsum(np.frombuffer(data, "<u2", n).astype(np.int64)) - 1] += np.frombuffer(data, "<u8", n, 2 * n)
        if now:
            yield made()

    kind = "predictor int, part int, n binary"
    sums = rows.mapInArrow(run, kind).repartition(partitions(rows.sparkSession), "predictor", "part").sortWithinPartitions("predictor", "part").mapInArrow(add, kind)
    flat = [np.zeros(2 << b, np.float32) for b in bits]
    # At most 2 << MOST_BITS counts for each predictor, whatever the input, so they fit the driver and a broadcast.
    for r in sums.toLocalIterator():
        own = flat[r["predictor"]][r["part"] : r["part"] + PART]
        own[:] = np.frombuffer(r["n"], np.float32)[: len(own)]
    return [x.reshape(-1, 2) for x in flat]


def learn(rows: DataFrame, keys, model) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Weights and refining table, from one online pass over all keys of every partition: weights are averaged by what
    each partition has seen, tables added up, both as whole numbers. model: the broadcast model."""
    kind = "i int, j int, x decimal(38,0), n decimal(38,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        mixer, seen = Mixer(len(own.bits)), np.zeros(GATES, np.int64)
        predictors = own.ready(without=True)[0]
        for batch in batches:
            for whole in keys(batch):
                for a in range(0, len(whole), STEP):
                    # What is learnt from symbols together doesn't depend on their order, but for rounding.
                    bits = bits_of(own.code, own.orders, own.bits, np.sort(coded(own.code, whole[a : a + STEP])))
                    x, gate = predictors.inputs(bits)
                    seen += mixer.learn(x, gate, bits.bit)
        if seen.any():
            rows = [(-1 - k, g, Decimal(int(round(mixer.weights[g, k] * FINE)) * int(seen[g])), Decimal(int(seen[g]))) for g in range(GATES) for k in range(len(own.bits))]
            rows += [(b, j, Decimal(int(x)), Decimal(0)) for b in (0, 1) for j, x in enumerate(mixer.table[b].ravel()) if x]
            types = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["i", "j", "x", "n"])

    mixer = Mixer(len(model.value.bits))
    for r in rows.mapInArrow(run, kind).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():  # about a thousand rows at most
        if r["i"] >= 0:
            mixer.table[r["i"]].reshape(-1)[r["j"]] = float(r["x"])
        elif r["n"]:
            mixer.weights[r["j"], -1 - r["i"]] = float(r["x"] / r["n"] / FINE)
    return mixer.weights, mixer.table


def trained(rows: DataFrame, keys, histogram: np.ndarray, orders: tuple[int, ...], slots: int):  # noqa: ANN001, ANN201
    """The broadcast model of the keys of rows."""
    context = rows.sparkSession.sparkContext
    code, bits = Code(histogram), table_bits(slots, orders)
    model = Model(code, orders, bits, count_bits(rows, keys, code, orders, bits))
    sent = context.broadcast(model)
    model.learnt = learn(rows, keys, sent)
    sent.destroy()
    return context.broadcast(model)


def _class_batch(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for held, sizes, classes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
        sizes = sizes.values.to_numpy().astype(np.int64)
        learns = ~np.array(held, bool)
        own = np.frombuffer(zstandard.decompress(classes.as_py()), np.uint8).astype(np.int32)
        yield class_keys(own[np.repeat(learns, sizes)], sizes[learns])


def _byte_batch(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield byte_keys(batch.column(0).to_pylist())[0]


def byte_counts(rows: DataFrame) -> np.ndarray:
    """How often each byte and the stop stand in the words of rows (word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(257, np.int64)
        for batch in batches:
            n[:256] += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8), minlength=256)
            n[STOP] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257, dtype=np.int32)), pa.array(n)], names=["symbol", "n"])

    out = np.zeros(257, np.int64)
    for r in rows.mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():  # 257 rows
        out[r["symbol"]] = r["n"]
    return out


def _sums(costs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of costs that lie end to end, sizes of them, none of which is 0."""
    return np.add.reduceat(costs, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


# --- scores ------------------------------------------------------------------------------------------------------


class Fit:
    """The documents' blocks ready to be scored, the counts of the whole corpus, and the two models."""

    def __init__(self, docs: DataFrame) -> None:
        spark = docs.sparkSession
        held = written(blocks(docs), "blocks", True)
        known = written(numbered(held), "numbered", True)
        texts = held.select(F.explode("held").alias("held")).where("not held").count()
        top = known.where(f"lead and c >= {TWICE}").orderBy(F.desc("c"), "word").select("word", "c").limit(HEADS).collect()
        self.heads = {bytes(r["word"]): k for k, r in enumerate(top)}
        heads = F.broadcast(spark.createDataFrame([(w, k) for w, k in self.heads.items()], "head binary, rank int"))  # HEADS rows at most
        kind = F.coalesce("rank", F.when(F.col("c") >= TWICE, F.lit(KNOWN) + _shared_class()).otherwise(F.lit(NEW) + _shared_class()))
        found = known.join(heads, F.col("word") == F.col("head"), "left").withColumn("class", kind)
        # What each class has in the training texts: one row for each class.
        classes = found.where("lead and c > 0").groupBy("class").agg(F.count("*").alias("words"), F.sum("c").alias("n")).collect()
        self.histogram = np.zeros(END + 1, np.int64)
        for r in classes:
            self.histogram[r["class"]] = r["n"]
        self.histogram[END] = texts
        self.total, self.distinct = int(self.histogram.sum()), sum(r["words"] for r in classes) + (texts > 0)
        self.ready = written(self._joined(held, found), "ready", True)
        self.classes = trained(self.ready.select("held", "sizes", "classes"), _class_batch, self.histogram, CLASS_ORDERS, self.total // TOKENS_A_SLOT)
        once = known.where("lead and c = 1").select("word")
        self.bytes = trained(once, _byte_batch, byte_counts(once), BYTE_ORDERS, int(self.histogram[NEW:END].sum()))
        discard(held)  # what is read from here on is in `ready`
        discard(known)

    def _joined(self, held: DataFrame, found: DataFrame) -> DataFrame:
        """Blocks with the classes of their texts, each text's sums, and where it has new words."""
        total, distinct, texts, histogram = self.total, self.distinct, int(self.histogram[END]), self.histogram

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            n = right.num_rows
            at = right.column("at").to_numpy()
            c, kind, of = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            c[at], kind[at], of[at] = right.column("c").to_numpy(), right.column("class").to_numpy(), np.arange(n)
            ids, sizes = _unpacked(row["sequence"]), np.array(row["sizes"], np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda x: np.bincount(doc, weights=x[ids], minlength=len(sizes))
            base = add(np.log10((c + 1) / (total + distinct + 1))) + np.log10((texts + 1) / (total + distinct + 1))
            share = np.where((kind >= KNOWN) & (kind < NEW), np.log10(np.maximum(c, 1) / np.maximum(histogram[kind], 1)), 0.0)
            ends = np.cumsum(sizes + 1) - 1
            classes = np.full(len(ids) + len(sizes), END, np.uint8)
            inner = np.ones(len(classes), bool)
            inner[ends] = False
            classes[inner] = kind[ids]
            new = np.nonzero(kind[ids] >= NEW)[0]
            pairs, times = np.unique(doc[new] * max(n, 1) + ids[new], return_counts=True)
            which, place = np.unique(pairs % max(n, 1), return_inverse=True)
            one = lambda x, t: pa.array([x], pa.list_(t))
            return pa.table(
                {
                    "doc_ids": one(row["doc_ids"], pa.int64()), "held": one(row["held"], pa.bool_()), "bytes": one(row["bytes"], pa.int64()), "sizes": one(sizes + 1, pa.int32()),
                    "n_known": one(add((c > 0).astype(float)).astype(np.int64) + (texts > 0), pa.int64()), "base": one(base, pa.float64()), "shares": one(add(share), pa.float64()), "classes": pa.array([zstandard.compress(classes.tobytes(), 3)], pa.binary()),
                    "new_words": one(right.column("word").take(pa.array(of[which])).to_pylist(), pa.binary()), "new_docs": one(pairs // max(n, 1), pa.int32()), "new_places": one(place, pa.int32()), "new_times": one(times, pa.int32()),
                }
            )

        kind = "doc_ids array<long>, held array<boolean>, bytes array<long>, sizes array<int>, n_known array<long>, base array<double>, shares array<double>, classes binary, new_words array<binary>, new_docs array<int>, new_places array<int>, new_times array<int>"
        right = found.select(F.col("block").alias("of"), "at", "c", "class", F.when(F.col("class") >= NEW, F.col("word")).alias("word"))
        return held.select("block", "doc_ids", "held", "bytes", "sizes", "sequence").groupBy("block").cogroup(right.groupBy("of")).applyInArrow(run, kind)

    def scores(self) -> DataFrame:
        classes, spelling, total = self.classes, self.bytes, self.total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    sizes = np.array(row["sizes"], np.int64)
                    n = len(sizes)
                    own = np.frombuffer(zstandard.decompress(row["classes"]), np.uint8).astype(np.int32)
                    score = _sums(classes.value.costs(class_keys(own, sizes)), sizes) + np.array(row["shares"])
                    spelt, lengths = byte_keys(row["new_words"])
                    new = _sums(spelling.value.costs(spelt), lengths)
                    score += np.bincount(np.array(row["new_docs"], np.int64), weights=new[np.array(row["new_places"], np.int64)] * np.array(row["new_times"], np.int64), minlength=n)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(sizes), "n_known": pa.array(row["n_known"], pa.int64()),
                            "train_tokens": pa.array(np.full(n, total)), "base_score": pa.array(row["base"], pa.float64()), "score": pa.array(score), "bits_per_byte": pa.array(-score / np.log10(2) / np.maximum(np.array(row["bytes"]), 1)),
                        }
                    )
            give_back()

        return self.ready.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.

    Rows for whose doc_id crc32 modulo 7 is not 2 train the model, those without a doc_id too. A null text is empty and
    has the end alone; repeated rows count and score one by one; without training rows every chance is the starting one;
    an empty table gives no rows; other columns are ignored. A text is worked on in pieces, so a word may be of any
    length. Equal tables in equal files give equal scores in every run.
    """
    return Fit(docs).scores()
