"""The divergence audit against a brute-force version."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term long, vector string, docs string"


def brute(rows, least, top):
    """rows: (text, lang, source)."""
    count, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", lang or "", s or "") for t, lang, s in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        groups = {s: {t: c[t] for t in kept} for (g, s), c in count.items() if g == lang}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in groups if x != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


def corpus():
    r = random.Random(11)
    vocab = ["alpha", "Beta", "beta2gamma", "délta", "the", "of", "ñu", "日本", "x_y", "ZETA"] + [f"rare{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(r.choices(vocab, k=r.randint(0, 12))), r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s0", "s1", "é", "", None])) for _ in range(300)]
    return [*rows, *rows[:40], (None, "en", "only null"), ("", "de", "s1"), ("12 34", "de", "s2"), (None, None, None), ("Lone word " * 30_000, "en", "long"), ("é" * 50_000, "fr", "s0")]


def make(spark, rows):
    return spark.createDataFrame([(k, *x, 1, "clash", None) for k, x in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize(("least", "top"), [(30, 50), (3, 4)])
def test_divergence(spark, least, top):
    rows = corpus()
    found = divergence.audit(make(spark, rows), least, top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, top)


def test_small_blocks_tiles_and_flushes_give_the_same(spark, monkeypatch):
    rows = corpus()
    kept = divergence.counts(make(spark, rows)).groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector")).cache()
    groups = divergence.groups_of(make(spark, rows), kept)
    vectors = kept.groupBy("lang", "vector").agg(F.count("*").alias("terms"))
    one, many = (sorted(map(tuple, divergence.pairs(vectors, groups, block, tile).collect())) for block, tile in ((4096, 128), (3, 2)))
    assert one == many and len(one) > 20
    wide = {tuple(x) for x in divergence.counts(make(spark, rows)).collect()}
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert {tuple(x) for x in divergence.counts(make(spark, rows)).collect()} == wide


def test_terms_of_equal_vectors_are_ranked_by_their_bytes(spark):
    rows = [(f"{'w' * (k % 7 + 1)}{chr(97 + k)}", "en", "s1") for k in range(26)] + [("common " * 9, "en", "s2")]
    got = {tuple(x) for x in divergence.audit(make(spark, rows), 1, 3).collect()}
    assert got == brute(rows, 1, 3)


def test_divergence_of_nothing(spark):
    assert divergence.audit(make(spark, corpus()).limit(0)).isEmpty()


def test_shares_of_very_large_counts():
    n, total = np.array([5, 3 * 10**12, 9 * 10**14]), 9 * 10**14 + 77
    assert divergence.share(n, total).tolist() == [1 + 10**9 * int(x) // total for x in n]
