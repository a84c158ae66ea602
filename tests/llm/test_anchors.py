"""Substring removal against a brute-force version."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import anchors

SCHEMA = "doc_id long, text string, lang string, name string, at string, refs long"


def brute(rows, window=20):
    """rows: (doc_id, text) -> the words that each keeps."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    places = [(d is None, d or 0) for d, _ in rows]
    first = {}
    for w, at in zip(words, places):
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            first[s] = min(first.get(s, (at, i)), (at, i))
    out = []
    for w, at in zip(words, places):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (at, i):
                gone.update(range(i, i + window))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return words, out


def corpus():
    r = random.Random(13)
    vocab = [f"w{k}" for k in range(3000)] + ["Word", "word", "é,", "naïve"]
    text = lambda n: r.choices(vocab, k=n)
    passage, other, line = text(64), text(33), text(20)
    rows = [text(r.randint(0, 80)) for _ in range(60)]
    for k in range(3, 60, 2):
        at = r.randint(0, len(rows[k]))
        own = r.choice([passage, other, line, passage[r.randint(0, 20) :], passage[: r.randint(19, 64)], passage + other, other + passage])
        rows[k] = rows[k][:at] + own + rows[k][at:]
    loop = text(7)
    rows += [loop * 12, rows[5], rows[5], rows[7][:40], ["the"] * 200, ["the"] * 45, passage + text(5) + passage, line, line[:19]]
    texts = [(k, " ".join(w)) for k, w in enumerate(rows)]
    texts += [(90, texts[5][1].replace(" ", "\n\t", 9)), (91, None), (92, ""), (93, " \n "), (94, "x" * 70_000), (95, " ".join(text(30_000))), (96, " ".join([*text(9000), *passage, *text(9000)]))]
    return texts


def make(spark, rows):
    return spark.createDataFrame([(*x, "en", "clash", "clash", 1) for x in rows], SCHEMA).repartition(5)


def check(spark, rows, **more):
    found = {r["doc_id"]: r for r in anchors.reduced(make(spark, rows), **more).collect()}
    for (doc_id, _), words, kept in zip(rows, *brute(rows, more.get("window", 20))):
        r = found[doc_id]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()), doc_id
    assert len(found) == len(rows)


def test_substrings(spark):
    check(spark, corpus())


@pytest.mark.parametrize(("window", "anchor"), [(20, 4), (25, 13), (1, 1), (7, 4)])
def test_other_lengths(spark, window, anchor):
    check(spark, [x for x in corpus() if x[0] not in (95, 96)], window=window, anchor=anchor)


def test_anchors_must_fit(spark):
    with pytest.raises(ValueError, match="whole reference block"):
        anchors.reduced(make(spark, corpus()), 20, 11)


def test_many_shares_and_small_pieces_give_the_same(spark, monkeypatch):
    for name, value in (("SHARE", 5000), ("PIECE", 900), ("WINDOWS", 40)):
        monkeypatch.setattr(anchors, name, value)
    check(spark, corpus())


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (1, a), (2, f"{b} x"), (None, a), (None, f"y {b} {a}"), (3, None)]
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in anchors.reduced(make(spark, rows)).collect()), key=str)
    assert found == sorted([(1, 30, 0), (1, 30, 0), (2, 31, 0), (3, 0, 0), (None, 30, 30), (None, 61, 60)], key=str)


def test_removal_keeps_rows_and_columns(spark):
    rows = corpus()
    docs = make(spark, [*rows, rows[0]]).withColumn("__at", F.lit(7))
    got = anchors.remove(docs)
    assert got.columns == docs.columns and got.count() == len(rows) + 1
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    for (doc_id, text), words, kept in zip(rows, *brute(rows)):
        assert texts[doc_id] == (text if len(kept) == len(words) else " ".join(kept))
    assert anchors.reduced(make(spark, rows).limit(0)).isEmpty() and anchors.remove(make(spark, rows).limit(0)).isEmpty()
    assert anchors.reduced(make(spark, [(1, None), (2, "")])).where("n_words > 0").isEmpty()


def test_words_of_a_long_text_in_pieces():
    text = ("é word\t" * 50_000).encode()
    assert [w for part in anchors.stretches(text, 1000) for w in part] == text.split()
