"""Benchmark decontamination with a generalised suffix automaton.

The words of the test items build one automaton; each document streams its words through it and knows at every word
the longest piece of any item that ends there. A window is `window` consecutive item words (a shorter item is one
window as a whole); the words inside windows that occur are hit. Distinct items go to the tasks in blocks of a fixed
number of words, one pass over the documents for each block, so neither a task nor the driver holds them all. A pass but
the last leaves only the texts' hashes and spans where something is hit; texts are never written again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import in_blocks, written

WINDOW = 13
#: Item words in a block; the automaton of a block has at most twice as many states.
BLOCK_WORDS = 200_000
#: A document is contaminated from one hit word in so many.
SHARE = 20

#: A-Z to lower case; all but digits, letters and what lies beyond ASCII to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Automaton:
    """The generalised suffix automaton of items (id, words), with what each state ends."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, item in items:
            last = 0
            for w in item:
                last = self._extend(last, w)
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        #: The state that holds the last `window` words of a state's strings, 0 where they are shorter.
        self.tail = [0] * len(order)
        for s in order[1:]:
            up = self.link[s]
            self.tail[s] = self.tail[up] or (s if self.length[s] >= window else 0)
        self.names: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        for name, item in items:
            s = 0
            for n, w in enumerate(item, 1):
                s = self._step(s, n - 1, w)[0]
                if n >= window:
                    self.names.setdefault(self.tail[s], set()).update([name] if name is not None else [])
            if 0 < len(item) < window:
                known = next((x for n, x in self.short.setdefault(s, []) if n == len(item)), None)
                if known is None:
                    self.short[s].append((len(item), known := set()))
                known.update([name] if name is not None else [])
        #: All short items that end in a state's strings, those of the states above it too.
        self.ends: dict[int, list[tuple[int, set[str]]]] = {}
        if self.short:
            for s in order[1:]:
                if found := self.short.get(s, []) + self.ends.get(self.link[s], []):
                    self.ends[s] = found
        least = min((n for x in self.short.values() for n, _ in x), default=window)
        self.run = re.compile(rb"\x01{%d,}" % least)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def _step(self, s: int, n: int, w: bytes) -> tuple[int, int]:
        while (t := self.next[s].get(w)) is None:
            if not s:
                return 0, 0
            s = self.link[s]
            n = self.length[s]
        return t, n + 1

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit stretches of a text, as disjoint pairs of word positions (end exclusive), and the items that occur."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        seen: set[int] = set()
        window, step, tail, ends, next_ = self.window, self._step, self.tail, self.ends, self.next
        flags = bytes(map(next_[0].__contains__, text))  # only runs of words that items have can hold a window
        for run in self.run.finditer(flags):
            s = n = 0
            for i in range(run.start(), run.end()):
                t = next_[s].get(text[i])
                s, n = step(s, n, text[i]) if t is None else (t, n + 1)
                reach = 0
                if n >= window:
                    reach = window
                    if (a := tail[s]) not in seen:
                        seen.add(a)
                        names |= self.names.get(a, set())
                if s in ends:
                    for size, who in ends[s]:
                        if size <= n:
                            reach = max(reach, size)
                            names |= who
                if reach:
                    first = i + 1 - reach
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i + 1))
        return spans, names


_built: dict[str, Automaton] = {}


def _automaton(shared) -> Automaton:  # noqa: ANN001
    """One automaton for each broadcast and worker process."""
    items, window, key = shared.value
    if key not in _built:
        _built.clear()
        _built[key] = Automaton([(name, words(text)) for name, text in items], window)
    return _built[key]


def _blocks(items: DataFrame, block_words: int) -> list[DataFrame]:
    counted = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    counted = counted.distinct()
    size = counted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (4 * block_words)))
    return [counted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def match(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with __n_words, __spans (array of [start, end) in words) and __items (ids of the items that occur, sorted).

    items: item_id of any type and text. Null texts have no words; an item without an id hits words but is not named;
    rows of items that share an id count as one name; an empty docs or items table is fine; docs keep all their columns
    and rows, repeated ones too.
    """
    spans, names = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer")), T.ArrayType(T.StringType())
    *before, last = _blocks(items, block_words)
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    texts = docs.where("text is not null").select(key.alias("__key"), F.col("text").cast("binary").alias("__bytes"))
    found = [written(_scanned(texts, block, window, T.StructType().add("__key", T.StructType().add("a", "long").add("b", "long")).add("__n_words", "long").add("__spans", spans).add("__items", names), True), "hits") for block in before]
    state = docs.withColumn("__bytes", F.col("text").cast("binary"))
    if found:
        every = reduce(DataFrame.unionByName, found).groupBy("__key").agg(F.array_distinct(F.flatten(F.collect_list("__spans"))).alias("__old"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__named"))
        state = state.withColumn("__own", key).join(every, F.col("__own") == F.col("__key"), "left").drop("__own", "__key")
    out = T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()), T.StructField("__spans", spans), T.StructField("__items", names)])
    return _scanned(state, last, window, out, False)


def _scanned(rows: DataFrame, block: DataFrame, window: int, out: T.StructType, hit_only: bool) -> DataFrame:
    """rows (__bytes, and what out names) with what the items of a block hit, and __old and __named where they are there."""
    shared = rows.sparkSession.sparkContext.broadcast(([(r["item_id"], bytes(r["text"])) for r in block.collect()], window, uuid.uuid4().hex))  # at most about 4 * block_words bytes, or one item
    keep = [f.name for f in out.fields if f.name not in ("__n_words", "__spans", "__items")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared)
        for batch in in_blocks(batches, "__bytes"):
            held = batch.schema.get_field_index("__old") >= 0
            old = zip(batch.column("__old").to_pylist(), batch.column("__named").to_pylist()) if held else iter(())
            n, spans, names = [], [], []
            for text in batch.column("__bytes"):
                found = words(text.as_py())
                got, who = automaton.scan(found)
                before, named = next(old, (None, None))
                if before:
                    got = merged(got + [(x["start"], x["end"]) for x in before])
                n.append(len(found))
                spans.append([{"start": a, "end": b} for a, b in got])
                names.append(sorted(who | set(named or ())))
            made = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(names, pa.list_(pa.string()))]
            result = pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, "__n_words", "__spans", "__items"])
            yield result.filter(pa.array([bool(s) for s in spans])) if hit_only else result

    return rows.mapInArrow(run, out)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit() -> Column:
    return F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))


def contaminated(share: int = SHARE) -> Column:
    return (n_hit() > 0) & (n_hit() * share >= F.col("__n_words"))


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the words of spans and what lies between them."""
    if not spans or text is None:
        return text
    raw = text.encode("utf-8")
    at = [m.span() for m in _WORD.finditer(raw.translate(FOLD))]
    parts, end = [], 0
    for a, b in spans:
        parts.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*parts, raw[end:]]).decode("utf-8")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE, max_span: int | None = None) -> DataFrame:
    """docs without the contaminated ones; all others stay, repeated rows and null texts too, columns as they were.

    max_span: where given, hit stretches of more words are cut out of the texts that stay. Without it those texts,
    which are clean by the coverage rule, stay as they are.
    """
    kept = match(docs, items, window).where(~contaminated(share))
    if max_span is not None:

        @F.pandas_udf("string")
        def without(text, starts, ends):  # noqa: ANN001, ANN202
            return text.where(starts.map(len) == 0, [cut(t, list(zip(a, b))) for t, a, b in zip(text, starts, ends)])

        long = F.filter("__spans", lambda s: s["end"] - s["start"] > max_span)
        kept = kept.withColumn("text", without("text", F.transform(long, lambda s: s["start"]), F.transform(long, lambda s: s["end"])))
    return kept.select(*docs.columns)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """For every row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Null and empty texts have no words
    and are clean; repeated rows, and texts of any length, are looked at one by one as wholes; repeated items count once; an
    empty docs table gives no rows, an empty items table hits nothing; other columns are ignored, whatever their names."""
    found = match(docs.select("doc_id", "text"), items, window)
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), contaminated(share).alias("contaminated"),
    )
