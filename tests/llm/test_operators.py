"""Each operator against a brute-force version, over texts with nulls, ties, repeated rows, clashing columns and none."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, licenses, lm_score, packing, pii, repeats, simhash, topk, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, spans string"


def make(spark, texts):
    return spark.createDataFrame([(k, t, "en" if k % 2 else "fr", "s", 0, "clash", "clash") if not isinstance(t, tuple) else (*t, "en", "s", 0, "clash", "clash") for k, t in enumerate(texts)], SCHEMA).repartition(3)


def corpus():
    r = random.Random(7)
    vocab = ["alpha", "Beta", "gamma,", "délta", "eps-ilon", "zeta9", "the", "of", "ñu"]
    texts = [" ".join(r.choices(vocab, k=r.randint(1, 90))) for _ in range(60)]
    passage = " ".join(f"word{k}" for k in range(70))
    return [*texts, f"{texts[0]} {passage} {texts[1]}", f"{texts[2]} {passage}", passage, texts[3], texts[3], None, "", "   \n", "a" * 30_000, ("x y " * 9000)]


def test_decontamination(spark):
    texts, items = corpus(), []
    items = [(1, " ".join(corpus()[0].split()[:20])), (2, "word3 WORD4 word5"), (3, None), (None, " ".join(f"word{k}" for k in range(20, 40))), (5, ""), (1, "the of the of")]
    found = {r["doc_id"]: r for r in decontaminate.contamination(make(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        words, hit, names = split(t), set(), set()
        for name, item in items:
            own = split(item)
            n = min(13, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == own[i : i + n]:
                        hit.update(range(j, j + n))
                        names.update([str(name)] if name is not None else [])
        r = found[k]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(words), len(hit), len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert r["contaminated"] == (bool(hit) and 20 * len(hit) >= len(words))
    kept = decontaminate.decontaminate(make(spark, texts), spark.createDataFrame(items, "item_id long, text string"), max_span=3)
    assert kept.columns == make(spark, texts).columns and kept.count() == sum(not r["contaminated"] for r in found.values())
    assert decontaminate.contamination(make(spark, texts), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").isEmpty()


def test_decontamination_with_repeats(spark):
    passage = " ".join(f"word{k}" for k in range(20))
    rows = [(1, passage), (1, passage), (2, f"clean {passage} " + "x " * 900), (None, passage), (4, None), (5, "")]
    docs = make(spark, rows).withColumn("n_hit", F.lit(7))  # a clashing name
    items = spark.createDataFrame([(9, passage), (9, passage), (8, passage), (7, "")], "item_id long, text string")
    found = Counter((r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(docs, items).collect())
    assert found == {(1, 20, 2, True): 2, (2, 20, 2, False): 1, (None, 20, 2, True): 1, (4, 0, 0, False): 1, (5, 0, 0, False): 1}
    assert sorted(str(r["doc_id"]) for r in decontaminate.decontaminate(docs, items).collect()) == ["2", "4", "5"]


def test_items_in_several_blocks_give_the_same(spark):
    docs, items = make(spark, corpus()), spark.createDataFrame([(k, t) for k, t in enumerate(corpus()[:30]) if t], "item_id long, text string")
    columns = ["doc_id", "__n_words", "__spans", "__items"]
    one, many = (sorted(map(str, decontaminate.match(docs, items, block_words=n).select(*columns).collect())) for n in (10**6, 200))
    assert one == many


def test_simhash(spark):
    texts = [t.replace("alpha", "beta", 1) if t and k % 3 == 0 else t for k, t in enumerate(corpus())] + corpus()[:20]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(make(spark, texts)).collect()}

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = [brute(t) for t in texts]
    assert [found[k]["fp"] & (2**64 - 1) for k in range(len(texts))] == prints
    label = list(range(len(texts)))
    for _ in label:
        for i in label:
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    assert [found[k]["component_id"] for k in range(len(texts))] == label
    assert sorted(r["doc_id"] for r in simhash.deduplicate(make(spark, texts)).collect()) == sorted(set(label))
    assert simhash.near_duplicates(make(spark, corpus()).limit(0)).isEmpty()


def test_near_copies_under_one_id(spark):
    a, b = ("alpha beta gamma delta epsilon " * 9, "one two three four five six seven " * 9)
    rows = [(1, a), (1, a), (1, b), (2, b), (3, a), (None, a), (None, None), (4, None), (5, "")]
    kept = simhash.deduplicate(make(spark, rows).withColumn("group", F.lit("clash")))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == {(1, a): 1, (1, b): 1, (None, a): 1, (None, None): 1, (4, None): 1}
    assert simhash.deduplicate(make(spark, rows).limit(0)).isEmpty()


def test_pii(spark):
    r = random.Random(3)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "12", "+1 (743) 555-3824", "+12", "+44 20 7946 0958.", " ", "é", "..", "-", "a@b.c..d@e.f.g", "%", "\n"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 12))) for _ in range(400)] + [None, "", "9" * 20_000, "a" * 20_000 + "@b.c", "1." * 10_000, "+1" * 5000, "a@" + "b." * 9000 + "c"]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p) < 4000 and int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    found = {x["doc_id"]: x for x in pii.personal(make(spark, texts)).collect()}
    for k, t in enumerate(texts):
        if t and len(t) > 15_000 and set(t) == {"a", "@", "b", ".", "c"} and t.startswith("aaa"):
            spans = [f"email:0:{len(t)}"]  # the plain pattern takes quadratic time on the others of its kind
        else:
            spans = [f"{kind}:{m.start()}:{m.end()}" for kind, (p, fine) in kinds.items() for m in ([] if t and set(t) == {"9"} else re.finditer(p, t or "")) if fine(m[0])]
        assert found[k]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), (t or "")[:80]
        assert found[k]["spans"].startswith(",".join(spans))
    clean = pii.sanitise(make(spark, texts))
    assert clean.columns == make(spark, texts).columns and clean.count() == len(texts)
    assert pii.personal(clean).where("n_email + n_ip + n_card > 0").count() == 0


def test_pii_in_time(spark):
    """Long texts full of matches, good and bad ones, take time in proportion, about."""
    numbers = " ".join(str(10**6 + k) for k in range(130_000))
    good = " ".join(f"u{k}@mail.example.com 10.0.{k % 250}.{k % 199}" for k in range(20_000))
    began = time.time()
    found = {r["doc_id"]: r for r in pii.personal(make(spark, [numbers, good, "é " * 300_000 + "a@b.cd"])).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(make(spark, [numbers, good])).collect()}
    assert time.time() - began < 120
    assert len(numbers) > 1_000_000 and found[0]["n_card"] == 0 and (found[1]["n_email"], found[1]["n_ip"]) == (20_000, 20_000)
    assert found[2]["spans"].startswith("email:600000:600006")
    spans = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"u\d+@mail\.example\.com", good)] + [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"10\.0\.\d+\.\d+", good)]
    assert found[1]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert clean[1] == " ".join(["[EMAIL] [IP]"] * 20_000)


def test_disclosing_words(spark):
    texts = [f"write to our secretariat at person{k}@mail.example.com about the meeting" for k in range(8)] + ["the meeting was about nothing much at all"] * 40
    found = pii.personal(make(spark, texts)).where("n_email = 1").collect()
    assert all("secretariat" in texts[r["doc_id"]][int(a) : int(b)] for r in found for kind, a, b in [next(s.split(":") for s in r["spans"].split(",") if s.startswith(("term", "drop")) and texts[r["doc_id"]][int(s.split(":")[1]) :].startswith("secretariat"))])
    assert "secretariat" not in pii.sanitise(make(spark, texts)).where("doc_id = 0").first()["text"]


def test_words_of_one_entity(spark):
    plain = ["the meeting was about nothing much at all and ended late"] * 300
    texts = ["ask Quillfeather or Ng or 山田 , jo@mail.example.com about it"] * 6 + ["Quillfeather came and Ng left with 山田 then", "quillfeathers are none"] + plain
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(make(spark, texts)).collect()}
    for k in range(7):
        assert not any(x in clean[k] for x in ("Quillfeather", "Ng", "山田"))
    assert clean[7] == texts[7] and clean[8] == texts[8]
    found = pii.personal(make(spark, texts)).where("doc_id = 6").first()
    assert {texts[6][int(a) : int(b)] for _, a, b in (s.split(":") for s in found["spans"].split(","))} >= {"Quillfeather", "Ng", "山田"} and found["n_email"] == 0


def test_top_k(spark):
    g = np.random.default_rng(5)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(g.normal(size=(300, 8)).astype(np.float32))] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (None, [1.0] * 8), (450, [1.0, 2.0]), (500, [1.0, 2.0]), (7, [0.5] * 8), (8, [1e18] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    found = defaultdict(list)
    for r in topk.top_k(df.where("vec_id % 50 = 0"), df).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    own = [(k, [int(np.floor(x * 256)) for x in v]) for k, v in rows if k is not None and v and all(x is not None and x == x for x in v)]
    for q, v in ((k, v) for k, v in own if k % 50 == 0):
        scores = sorted(((sum(a * b for a, b in zip(v, w)), k) for k, w in own if k != q and len(w) == len(v)), key=lambda x: (-x[0], x[1]))
        assert found[q] == [(k, max(-(2**63), min(2**63 - 1, s))) for s, k in scores[:5]]
    assert topk.top_k(df.limit(0), df).isEmpty()


def test_warc(spark):
    pages = [(1, "http://a/é b", "x" * 200, "c"), (2, "u", "y" * 99, "c"), (3, None, "x" * 200, "c"), (4, "u", "y" * 99, "c"), (5, "u", None, "c"), (None, "u", "x" * 200, "c"), (7, "u", "é" * 60 + "\r\n\r\nWARC/1.1", "c"), (7, "u", "é" * 60 + "\r\n\r\nWARC/1.1", "c"), (0, "u\r\nX: y", "z" * 3_000_000, "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string").repartition(2)
    found = warc.round_trip(df).collect()
    assert len(found) == len(pages)
    for page_id, url, html, _ in pages:
        body = (html or "").encode()
        first = min((p for p, _, h, _ in pages if h == html and p is not None), default=None) if len(body) >= 100 else page_id
        own = [r for r in found if r["page_id"] == page_id]
        assert all((r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest()) for r in own)
        assert all((r["record_type"], r["refers_to"]) == (("response", None) if first == page_id else ("revisit", first)) for r in own)
        assert all(bytes(r["payload"]) == body for r in own if r["record_type"] == "response")
    assert warc.page_records(df.limit(0)).isEmpty()


def test_packing(spark):
    texts = corpus() + ["it's  12\tb\n\n\nc ", "<|endoftext|> x", " lead", "trail\n", "日本 語"] + ["the of"] * 50
    encode = packing.encoder(packing.default_vocabulary()).tokenizer.encode
    ids = {k: [*encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    got = packing.pack(make(spark, texts), with_ids=True).collect()
    rows, places = defaultdict(list), defaultdict(list)
    for r in got:
        own = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert own == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["doc_tokens"] == len(ids[r["doc_id"]])
        rows[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, own in ids.items():
        at = 0
        for start, n in sorted(rows[k]):
            assert start == at
            at += n
        assert at == len(own)
    sizes = []
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes) <= 1024 and sum(s < 1024 for s in sizes) <= 1
    assert packing.packed(make(spark, texts).limit(0)).isEmpty()


def test_packing_repeats_and_forgets(spark):
    texts = ["字" * 3000 + str(k) for k in range(40)] + ["the of"] * 20
    texts += ["filler words of a text " * 30_000 + str(k) for k in range(9)]  # several blocks in a task, with pieces in each
    docs = make(spark, texts).coalesce(1).cache()
    one, two = (sorted(map(str, packing.packed(docs).collect())) for _ in range(2))
    assert one == two
    encode = packing.Encoder(packing.default_vocabulary())
    list(encode(texts))
    assert max(map(len, encode.known)) <= packing.SHORT and encode.size <= packing.REMEMBERED
    assert [bytes(x) for x in encode(["the of", texts[0]])] == [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ("the of", texts[0])]


def test_a_worker_forgets_what_it_encoded(spark):
    """A reader that stops at the last text, as a zip does, leaves no units unforgotten, and a task leaves no encoder behind."""
    encode = packing.Encoder(packing.default_vocabulary())
    for block in range(3):
        for _ in zip(range(20), encode([f"{'x' * 100}{block}{k} word{block}{k}" for k in range(20)])):
            pass
        assert max(map(len, encode.known)) <= packing.SHORT and encode.size == sum(map(len, encode.known)) - 1
    assert packing.pieces(make(spark, ["some words"] * 50).repartition(8)).count() == 50

    def left(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [len(sys.modules["ledgerloom.llm.packing"]._encoders) if "ledgerloom.llm.packing" in sys.modules else 0]})

    assert spark.range(0, 64, 1, 64).mapInArrow(left, "n long").agg(F.sum("n")).first()[0] == 0


def test_repeats(spark):
    texts = [t or "" for t in corpus()]
    r = random.Random(11)
    fresh = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    shared = [fresh(n) for n in (50, 60, 49, 200, 30)]
    texts += [f"{fresh(r.randint(0, 40))} {x} {fresh(r.randint(0, 40))}" for x in shared for _ in range(3)] + [fresh(300), fresh(20)]
    found = {x["doc"]: x for x in repeats.passages(make(spark, texts)).withColumn("doc", F.col("doc_id")).collect()}
    words = {k: repeats.FOLD and t.encode().translate(repeats.FOLD).split() for k, t in enumerate(texts)}
    count = Counter(tuple(own[i : i + 50]) for own in words.values() for i in range(len(own) - 49))  # places, in one row too
    for k, own in words.items():
        want = {j for i in range(len(own) - 49) if count[tuple(own[i : i + 50])] > 1 for j in range(i, i + 50)}
        got = {j for s in found[k]["spans"] for j in range(s["start"], s["end"])}
        assert want == got
        assert all(a["end"] <= b["start"] for a, b in zip(found[k]["spans"], found[k]["spans"][1:]))
    assert repeats.remove(make(spark, texts)).count() == len(texts)
    assert repeats.repeated(make(spark, texts).limit(0)).isEmpty()


def test_repeats_of_several_partners(spark):
    """Matches with different partners make no passage where none of them reaches its length; places follow doc_id."""
    r = random.Random(5)
    fresh = lambda n: [f"v{r.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        a = fresh(70)
        texts += [a, a[:45] + fresh(30), fresh(20) + a[28:]]
    for _ in range(6):  # two partners whose passages overlap, and one that repeats itself
        a = fresh(120)
        texts += [a, a[:70] + fresh(9), fresh(3) + a[50:], fresh(4) + a[10:70] + fresh(2) + a[15:80]]
    rows = [(None if k % 9 == 0 else k, " ".join(t)) for k, t in enumerate(texts)] + [(40, " ".join(texts[3])), (None, " ".join(texts[0])), (None, " ".join(texts[0]))]
    found = Counter((r["doc_id"], r["n_words"], str([(s["start"], s["end"]) for s in r["spans"]])) for r in repeats.passages(make(spark, rows)).collect())
    own = [t.split() for _, t in rows]
    count = Counter(tuple(w[i : i + 50]) for w in own for i in range(len(w) - 49))
    want = Counter()
    for (k, _), w in zip(rows, own):
        hit = {j for i in range(len(w) - 49) if count[tuple(w[i : i + 50])] > 1 for j in range(i, i + 50)}
        spans = []
        for j in sorted(hit):
            if spans and spans[-1][1] == j:
                spans[-1][1] = j + 1
            else:
                spans.append([j, j + 1])
        want[k, len(w), str(spans)] += 1
    merged = Counter()
    for (k, n, spans), times in found.items():
        joined = []
        for a, b in eval(spans):  # noqa: S307 - spans that meet, first holding and copy, are one here
            if joined and joined[-1][1] == a:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        merged[k, n, str(joined)] += times
    assert merged == want
    left = repeats.remove(make(spark, rows))
    kept = Counter(w for r in left.collect() for w in [tuple(r["text"].split()[i : i + 50]) for i in range(len(r["text"].split()) - 49)])
    whole = {tuple(texts[0][i : i + 50]) for i in range(21)}  # rows that repeat as wholes are no copies of each other
    assert left.count() == len(rows) and all(n == 1 for w, n in kept.items() if w not in whole)


def test_repeats_that_meet(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    texts = [a, f"{a} {b}", b, f"{c} x {a} y {c}", "x y " * 200, f"{b} {c} {a}"]
    found = {r["doc_id"]: r["passages"] for r in repeats.repeated(make(spark, texts)).collect()}
    assert found == {0: "0:60:0", 1: "0:60:1,60:120:0", 2: "0:60:1", 3: "0:60:0,61:121:1,122:182:1", 4: "0:50:0,50:400:1", 5: "0:180:1"}
    left = {r["doc_id"]: r["text"].split() for r in repeats.remove(make(spark, texts)).collect()}
    assert [left[k] for k in range(6)] == [a.split(), b.split(), [], [*c.split(), "x", "y"], ["x", "y"] * 25, []]
    texts = [a, f"{a} {b}", f"{a} {b}", c, f"new words {c}", f"new words {c}"]  # row 4 alone keeps the new words
    assert {r["doc_id"]: r["passages"] for r in repeats.repeated(make(spark, texts)).collect()} == {0: "0:60:0", 1: "0:60:1,60:120:0", 2: "0:120:1", 3: "0:60:0", 4: "0:2:0,2:62:1", 5: "0:62:1"}


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_id.languages(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 100")
    assert found.where("lang = lang_pred").count() >= 0.9 * found.count()
    odd = language_id.predict(make(spark, [None, "", "12 34", "le la"]), language_id.dictionaries(docs)).collect()
    assert Counter(r["__lang"] for r in odd)["und"] == 3 and all(0 <= r["__margin"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in language_id.languages(make(spark, ["a b", None]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identified(docs.limit(0)).isEmpty()


def test_language_of_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = language_id.dictionaries(docs)
    long = docs.where("lang = 'de' and n_chars > 500").first()["text"]
    rows = [(1, long * (1 + 2_000_000 // len(long))), (2, long), (2, long), (None, long), (5, "½ ² Ⅷ ① 12"), (6, "é"), (7, None)]
    clash = make(spark, rows).withColumns({"score": F.lit("x"), "rejected": F.lit("y"), "lang_pred": F.lit("z")})
    found = Counter((r["doc_id"], r["__lang"]) for r in language_id.predict(clash, known).collect())
    assert found[1, "de"] == 1 and found[2, "de"] == 2 and found[None, "de"] == 1 and found[5, "und"] == 1 and found[7, "und"] == 1 and found[6, "und"] == 0
    assert set(language_id.languages(clash).columns) == {"doc_id", "held_out", "lang_pred", "score", "rejected"} and language_id.languages(clash).count() == 7


def test_lm_score(spark):
    texts = corpus()
    found = {r["doc_id"]: r for r in lm_score.score(make(spark, texts)).collect()}
    tokens = {k: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for k, t in enumerate(texts)}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    c = Counter(w for k, own in tokens.items() if not held[k] for w in own)
    n, v = sum(c.values()), len(c)
    for k, own in tokens.items():
        r = found[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in own)) and r["score"] < 0
    assert lm_score.score(make(spark, texts).limit(0)).isEmpty()


def test_shared_folder(spark):
    from types import SimpleNamespace as Fake

    from ledgerloom.llm import common

    far = Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master="spark://far", applicationId="x"))
    with pytest.raises(ValueError):
        common.shared_dir(far)
    kept = common.written(spark.range(3), "kept")
    assert kept.count() == 3
    common.discard(kept)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(kept.written_to).count()


def test_lm_score_by_brute_force(spark):
    texts = corpus()[:40] + ["alpha Beta unseen9 zeta9", "once\x00only " + "z" * 3000] + corpus()[:20]
    fit = lm_score.Fit(make(spark, texts))
    found = {r["doc_id"]: r for r in fit.scores().collect()}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, t in enumerate(texts)}
    learns = {k for k in words if zlib.crc32(str(k).encode()) % 7 != 2}
    c = Counter(w.encode() for k in learns for w in words[k])
    heads = sorted((w for w in c if c[w] >= 2), key=lambda w: (-c[w], w))[: lm_score.HEADS]
    shared = lambda w: zlib.crc32(w[:1] + w[-1:]) % lm_score.SHARED
    kind = lambda w: heads.index(w) if w in heads else (lm_score.KNOWN if c[w] >= 2 else lm_score.NEW) + shared(w)
    mask = 2**64 - 1

    def mix(x):
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & mask
        return x ^ x >> 29

    def bits_of(model, orders, sequence, first):
        """(slots, bit) of every bit of the sequence from `first` on."""
        for i in range(first, len(sequence)):
            symbol, contexts = sequence[i], []
            for order in orders:
                h = 0
                for back in range(1, order + 1):
                    h = (h * 0x9E3779B97F4A7C15 + (sequence[i - back] + 1 if i >= back else 0) + 1) & mask
                contexts.append(mix((h * 0xC2B2AE3D27D4EB4F + order + 1) & mask))
            for node, bit in zip(model.code.nodes[symbol, : model.code.sizes[symbol]].tolist(), model.code.bits[symbol].tolist()):
                yield [mix((h + node * 0x9E3779B97F4A7C15) & mask) >> 64 - b for h, b in zip(contexts, model.bits)], bit

    def cost(model, counts, orders, sequence, first=0):
        weights, table = model.learnt
        total = 0.0
        for slots, bit in bits_of(model, orders, sequence, first):
            n = [(counts[j, s, 0], counts[j, s, 1]) for j, s in enumerate(slots)]
            level = [sum(a + b >= x for x in (1, 3, 15)) for a, b in n[-2:]]
            gate = level[0] * 4 + level[1]
            dot = max(-14, min(14, sum(w * np.log((b + 0.2) / (a + 0.2)) for w, (a, b) in zip(weights[gate], n))))
            squash = lambda x: 1 / (1 + np.exp(-x))
            bucket = max(-16, min(16, round(dot * 2)))
            zero, one = (table[x, gate, bucket + 16] + 8 * (squash(bucket / 2) if x else 1 - squash(bucket / 2)) for x in (0, 1))
            p = min(max((squash(dot) + one / (zero + one)) / 2, 1e-6), 1 - 1e-6)
            total += np.log10(p if bit else 1 - p)
        return total

    classes, spelling = fit.classes.value, fit.bytes.value
    sequence = lambda k: [*(kind(w.encode()) for w in words[k]), lm_score.END]
    letters = lambda w: [257 + shared(w), *w, 256]
    seen, spelt = Counter(), Counter()
    for k in learns:
        seen.update((j, s, bit) for slots, bit in bits_of(classes, lm_score.CLASS_ORDERS, sequence(k), 0) for j, s in enumerate(slots))
    for w in (w for w in c if c[w] == 1):
        spelt.update((j, s, bit) for slots, bit in bits_of(spelling, lm_score.BYTE_ORDERS, letters(w), 1) for j, s in enumerate(slots))
    of_class = Counter()
    for w, n in c.items():
        of_class[kind(w)] += n
    for k in range(len(texts)):
        want = cost(classes, seen, lm_score.CLASS_ORDERS, sequence(k))
        for w in (w.encode() for w in words[k]):
            if kind(w) >= lm_score.NEW:
                want += cost(spelling, spelt, lm_score.BYTE_ORDERS, letters(w), 1)
            elif kind(w) >= lm_score.KNOWN:
                want += np.log10(c[w] / of_class[kind(w)])
        assert found[k]["score"] == pytest.approx(want, rel=1e-3)
    again = {r["doc_id"]: r["score"] for r in lm_score.score(make(spark, texts)).collect()}
    assert again == {k: r["score"] for k, r in found.items()}


def test_lm_words():
    rng = np.random.default_rng(3)
    odd = [bytes(rng.choice(list(b"Az\x00\x09\x0a\x0b\x0c\x0d\x1c\x1f \x7f\xc2\xa0\xe9"), 30).tolist()) for _ in range(300)]
    texts = [b"", b" ", b"A", b" a\tB ", b"\xc3\x89a \xe2\x80\xa8b", *odd, b""]
    for kind in (pa.binary(), pa.large_binary()):
        own, sizes = lm_score.words(pa.array([b"x y", *texts], kind).slice(1))
        want = [t.lower().split() for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and own.cast(pa.large_binary()).to_pylist() == [w for ws in want for w in ws]


def test_lm_score_works_once_on_what_is_equal(monkeypatch):
    """A symbol after the same symbols is counted and weighed once, however often it stands in a block."""
    worked: list[int] = []
    bits_of = lm_score.bits_of
    monkeypatch.setattr(lm_score, "bits_of", lambda code, orders, bits, keys: worked.append(len(keys)) or bits_of(code, orders, bits, keys))
    text = np.arange(40) % 7
    code, orders = lm_score.Code(np.bincount(text, minlength=lm_score.END + 1)), lm_score.CLASS_ORDERS
    bits = lm_score.table_bits(0, orders)
    many, one = (lm_score.class_keys(np.tile(text, n), np.full(n, 40)) for n in (5000, 1))
    counts, single = (lm_score.counted(iter([keys]), code, orders, bits) for keys in (many, one))
    assert all((a == 5000 * b).all() for a, b in zip(counts, single)) and all(a.sum() == 5000 * code.sizes[text].sum() for a in counts)
    model = lm_score.Model(code, orders, bits, [c.reshape(-1, 2).astype(np.float32) for c in counts])
    costs = model.costs(many)
    assert (costs.reshape(5000, 40) == model.costs(one)).all() and (costs < 0).all()
    assert max(worked) <= 40
    spelt, lengths = lm_score.byte_keys([b"ab", b"", b"ab"])
    spelling = lm_score.Code(np.ones(257, np.int64))
    assert lengths.tolist() == [3, 1, 3] and len(lm_score.coded(spelling, spelt)) == 7 and len(lm_score.coded(spelling, lm_score.byte_keys([])[0])) == 0


def test_lm_score_extremes(spark):
    long = ["b" * 1_500_000, "the cat sat", "cat the sat", None, "the cat sat", "the cat sat"]
    found = {r["doc_id"]: r for r in lm_score.score(make(spark, long)).collect()}
    assert len(found) == 6 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in found.values())
    assert found[1]["score"] != found[2]["score"]  # order counts
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = lm_score.score(make(spark, [(k, "some words here") for k in held])).collect()  # nothing to learn from
    assert len(rows) == len(held) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in rows)
    every = lm_score.score(make(spark, ["a b", "a b", "c"]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(every) == 3 and all(not r["held_out"] for r in every)


def test_code_is_whole():
    code = lm_score.Code(np.arange(257))
    assert sum(2.0 ** -code.sizes) == 1 and len({tuple(zip(code.nodes[s, :n], code.bits[s, :n])) for s, n in enumerate(code.sizes)}) == 257


def test_licenses(spark):
    grant = licenses.SENTENCES["mit-grant"]
    texts = ["Some text.\nReleased under the MIT License.", f"{grant[:60]}\n{grant[60:]}\n\n{licenses.SENTENCES['mit-notice']} {licenses.SENTENCES['mit-warranty']}", "é no stop\nAll rights reserved.", None, "", "the license", "Licensed under the Apache License, Version 2.0.\nAll rights reserved."]
    found = {r["doc_id"]: r for r in licenses.scan(make(spark, texts)).collect()}
    assert [found[k]["licences"] for k in range(len(texts))] == ["MIT", "MIT", "Proprietary", "", "", "", "Apache-2.0,Proprietary"]
    name, a, b = found[2]["matches"].split(":")
    assert texts[2][int(a) : int(b)] == "All rights reserved."


def test_licences_in_full_texts(spark):
    wrap = lambda *names: "\n\n".join(textwrap.fill(licenses.SENTENCES[n], 70) for n in names)
    two = "Copyright (c) 2020, A Holder\nAll rights reserved.\n\n" + wrap("bsd-redistribution") + "\n\n1. " + textwrap.fill(licenses.SENTENCES["bsd-source"], 70) + "\n\n2. " + textwrap.fill(licenses.SENTENCES["bsd-binary"], 70)
    three = two + "\n\n3. " + wrap("bsd-endorse") + "\n\n" + wrap("bsd-warranty")
    gpl = "A program.\nCopyright (C) 2020 A Holder\n\n" + wrap("gpl-free", "gpl-hope") + "\n\nYou should have received a copy."
    long = "é filler text without any licence; none at all. " * 40_000
    texts = [two, three, gpl, long + "\n\n" + gpl + "\n\n" + long, wrap("mpl-subject", "mpl-obtain"), wrap("isc-grant", "isc-warranty"), "// SPDX-License-Identifier: Apache-2.0\nint x;", "All rights reserved.", "MIT License\n\n" + wrap("mit-grant", "mit-notice", "mit-warranty") + "\n\nAll rights reserved."]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, two), (None, gpl)]
    found = Counter((r["doc_id"], r["licences"]) for r in licenses.scan(make(spark, rows)).collect())
    want = ["BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "GPL-3.0-or-later", "MPL-2.0", "ISC", "Apache-2.0", "Proprietary", "MIT,Proprietary"]
    assert found == Counter([*enumerate(want), (0, "BSD-2-Clause"), (None, "GPL-3.0-or-later")])
    place = next(r["matches"] for r in licenses.scan(make(spark, rows)).collect() if r["doc_id"] == 3).split(":")
    assert texts[3][int(place[1]) :].startswith("This program is free software") and texts[3][: int(place[2])].endswith("PURPOSE.")
    assert licenses.scan(make(spark, rows).limit(0)).isEmpty()


def test_licence_sentences_and_rules(spark):
    wrap = lambda t: textwrap.fill(t, 70)
    names, texts = list(licenses.SENTENCES), []
    for name in names:
        t = licenses.SENTENCES[name]
        texts += [t, wrap(t), "Copyright (c) 2020 A Holder\n" + wrap(t), textwrap.indent(wrap(t), " * ")]
    found = {r["doc_id"]: r for r in licenses.scan(make(spark, texts)).collect()}
    assert [found[k]["sentence_ids"] for k in range(len(texts))] == [name for name in names for _ in range(4)]
    texts = []
    for _, sequence in licenses.RULES:
        own = [licenses.SENTENCES[x] for x in sequence]
        texts += [" ".join(own), "\n\n".join(map(wrap, own)), "\n".join(wrap(f"{k}. {t}") for k, t in enumerate(own)), "\n *\n".join(textwrap.indent(wrap(t), " * ") for t in own)]
    found = {r["doc_id"]: r for r in licenses.scan(make(spark, texts)).collect()}
    assert [found[k]["licences"] for k in range(len(texts))] == [name for name, _ in licenses.RULES for _ in range(4)]
    assert all(found[k]["matches"].count(":") == 2 for k in found)
