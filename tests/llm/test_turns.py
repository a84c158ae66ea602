"""The conversation tries against a brute-force version, with and without repartitioning by later turns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ledgerloom.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, path string, n long, depth string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    base = lambda c: c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    built = {c: tuple(own.get(base(c), [])[: h[c]] + ts[h[c] :]) for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == path)))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), sum(1 for q in members if q and q[:-1] == path), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def make(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1, "clash") for x in rows], SCHEMA).repartition(3)


def corpus():
    r = random.Random(5)
    said = ["hi", "Hi", "", None, "日本 🙂", "long text of some words", "x" * 3000]
    rows = []
    for c in [*range(0, 60), 100, 105, 117, 250, -3, -100, -150, -201]:
        opening = [("user", "system prompt"), ("assistant", "ok")] if c % 3 else []
        told = opening + [(r.choice(["user", "assistant", None]), r.choice(said)) for _ in range(r.randint(0, 4))]
        rows += [(c, None if k == 0 and c % 4 == 0 else k, role, text) for k, (role, text) in enumerate(told)]
    rows += [(c, k, "user", "same") for c in range(300, 340) for k in range(4)]  # copies but for what they take from 300
    rows += [(7, 50 + k, "user", "a very long conversation") for k in range(150)]
    return [*rows, (None, 1, "user", "of nobody"), (301, 9, "user", ""), (301, 10, "user", "")]


def got(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


@pytest.mark.parametrize("size", [turns.TURNS, 12, 1])
def test_trie(spark, size):
    rows = corpus()
    found = turns.trie(make(spark, rows), size)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(found) == brute(rows)


def test_members_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(turns, "CHUNK", 3)
    rows = [(c, k, "user", "same") for c in range(0, 1000, 100) for k in range(2)]
    assert got(turns.trie(make(spark, rows))) == brute(rows)


def test_ties_have_an_order_of_their_own(spark):
    rows = [(0, 1, "user", "b"), (0, 1, "user", "a"), (100, 1, "user", "a"), (100, 1, "user", "b")]
    found = got(turns.trie(make(spark, rows)))
    assert found == got(turns.trie(make(spark, rows[::-1]))) and [x[3] for x in found] == [2, 2, 2]


def test_trie_of_nothing(spark):
    assert turns.trie(make(spark, corpus()).limit(0)).isEmpty()
    assert turns.trie(make(spark, [(None, 1, "user", "x")])).isEmpty()
