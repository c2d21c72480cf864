import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import order_minhash as o
from tidemark.llm.queries import op4_order_minhash


def test_query_as_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in op4_order_minhash(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        n = len(docs[d])
        edited = docs[d][: n - n // 3] + docs[nxt][: n // 3]
        assert got[d].n_chars == n and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, cut, other = brute(docs[d]), brute(edited), brute(docs[nxt])
        assert got[d].fingerprint == "".join(f"{v:08x}" for v in own) and got[d].edited_fingerprint == "".join(f"{v:08x}" for v in cut)
        assert got[d].near_edited == like(own, cut) and got[d].near_next == like(own, other)
    assert sum(r.near_edited for r in got.values()) > 3 * sum(r.near_next for r in got.values())


def test_order_and_edits_count(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = rng.sample(words, 300)
    edit = [w if rng.random() > 0.03 else "new" for w in base]
    halves = base[150:] + base[:150]
    texts = [" ".join(x) for x in (base, base, edit, halves, rng.sample(words, 300))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("s", o.signature(F.col("t")))
    a = frame.where("i = 0").select(F.col("s").alias("a"))
    like = {r.i: r.x for r in frame.crossJoin(a).select("i", o.likeness(F.col("s"), F.col("a")).alias("x")).collect()}
    assert like[1] == 1.0 and 0.5 < like[2] < 1 and like[2] > like[3] > 0.2 and like[4] < 0.1
    assert like[3] < 0.9  # same k-mers but for the seam, in another order


def chained(parts):
    """Spark's xxhash64 of several values: each hash is the seed of the next."""
    seed = 42
    for x in parts:
        raw = x.encode() if isinstance(x, str) else (x % 2**64).to_bytes(8, "little") if isinstance(x, int) else x
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def brute(text, k=2, l=2):
    """The slots of a text: tuples of the features next round the circle, in text order."""
    tokens = []
    for w in re.split("[\x20\x09-\x0d]+", text or ""):
        tokens += [chained(w[i : i + 8]) for i in range(len(w) - 7)] if len(w) > 32 else [chained([w])] if w else []
    grams = [chained(tokens[i : i + k]) for i in range(len(tokens) - k + 1)] if len(tokens) >= k else [chained(tokens)] if tokens else []
    seen, circle = {}, []
    for i, g in enumerate(grams):
        n = seen[g] = seen.get(g, -1) + 1
        circle.append((((g if n == 0 else chained([g, n.to_bytes(4, "little")])) >> 26), i))
    circle.sort(key=lambda x: ((x[0] + 2**37) % 2**38, x[1]))  # signed order: the upper half first
    out = []
    for slot in range(64 if circle else 0):
        start = next((j for j, (h, _) in enumerate(circle) if (h + 2**37) % 2**38 >= slot << 32), 0)
        taken = sorted((circle[(start + o) % len(circle)] for o in range(min(l, len(circle)))), key=lambda x: x[1])
        out.append(chained([h for h, _ in taken]) >> 32)
    return out


def like(a, b):
    return 1.0 if a == b else sum(x == y for x, y in zip(a, b, strict=False)) / 64


TEXTS = ["a b c a b c a b c", "x " * 100, "one", "one two", "", None, " \n ", "a b c d", "b c d a", "z" * 100, "q" * 33 + " \u00e9\u6771\u4eac" * 9, "abcdefgh" * 40, "w " * 30000]


def test_signature_as_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choices("the cat sat on a mat and ran off".split(), k=rng.randrange(60))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in frame.select("i", o.signature(F.col("t")).alias("s"), o.fingerprint(o.signature(F.col("t"))).alias("f")).collect():
        assert [v % 2**32 for v in r.s] == brute(texts[r.i]) and r.f == "".join(f"{v:08x}" for v in brute(texts[r.i])), texts[r.i]


def test_short_texts_keep_their_order_and_single_edits_count_little(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    words = [letters(6) for _ in range(150)]
    short, run = words[:40], letters(1000)
    pairs = {"halves": (" ".join(short), " ".join(short[20:] + short[:20])), "one of 1000": (" ".join(words), " ".join(words[:70] + ["q" + words[70][1:]] + words[71:])), "run": (run, run[:500] + "!" + run[501:]), "end": (run, run + "x")}
    frame = spark.createDataFrame([(k, *v) for k, v in pairs.items()], "k string, a string, b string")
    got = {r.k: r.x for r in frame.select("k", o.likeness(o.signature(F.col("a")), o.signature(F.col("b"))).alias("x")).collect()}
    assert got["halves"] < 0.7 and min(got["one of 1000"], got["run"], got["end"]) > 0.9, got


def test_edges(spark):
    frame = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, "abcdef ghi"), (5, "\u00e9\u6771\u4eac " * 40), (7, "same text"), (8, "same text")], "doc_id long, text string")
    got = o.with_edited(frame.withColumn("id", F.lit(1)).withColumn("sig", F.lit(1))).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 2, 5, 7, 8]
    none = next(r for r in got if r.doc_id is None)
    assert (none.n_chars, none.edited, none.near_edited, none.near_next) == (1, "a", 1.0, None)
    assert next(r.near_next for r in got if r.doc_id == 8) == 1.0
    assert o.with_edited(frame.limit(0)).count() == 0


def test_texts_travel_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = o.with_edited(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("ReusedExchange" in line and "text#" in line for line in plan.splitlines())
