import random
import re

import pytest

from tidemark.llm import near_dedup
from tidemark.llm.queries import op9_minhash_near_dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text, k):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(UP)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(docs, k, percent):
    sets = {d: sets_of(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, where = sorted(sets), {}
    for d in ids:
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    for a in ids:
        for b in {x for s in sets[a] for x in where[s] if x > a}:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def family(rng, base, n, most):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(most)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(2000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 200))) for _ in range(150)]
    texts += family(rng, " ".join(rng.choices(words, k=120)), 160, 9) + family(rng, " ".join(rng.choices(words, k=60)), 60, 6)
    passage = " ".join(rng.choices(words, k=60))
    texts += [passage + " " + " ".join(rng.choices(words, k=rng.randrange(10, 80))) for _ in range(80)]
    drift = rng.choices(words, k=100)
    for i in range(40):  # a chain: neighbours are linked, its ends are not
        drift = drift[3:] + rng.choices(words, k=3)
        texts.append(" ".join(drift))
    texts += ["", None, " \n\t", "one", "One", "two words", "two  WORDS", texts[3], texts[3].upper()]
    docs = [(i * 7 % 1000003, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_as_brute_force(spark, k, percent):
    docs = corpus(k)
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, doc int, u string").repartition(4)
    got = {r.doc_id: (r["__n_shingles"], r["__component"]) for r in near_dedup.mark(frame, k, percent).collect()}
    assert got == brute(docs, k, percent)


def test_small_blocks_and_tight_range(spark):
    docs = corpus(11)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r["__n_shingles"], r["__component"]) for r in near_dedup.mark(frame, 3, 85, tight=0.9, block=500).collect()}
    assert got == brute(docs, 3, 85)


def test_edges(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (7, "x y z"), (9, "x y z"), (9, "p q r"), (11, "p q r"), (12, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r["__component"] if r["__component"] is not None else -1) for r in near_dedup.mark(frame, 3, 85).collect())
    assert got == [(-1, -1), (3, 3), (3, 3), (5, 3), (7, 7), (9, 7), (9, 7), (11, 7), (12, 12)]
    assert near_dedup.mark(frame.limit(0), 3, 85).count() == 0


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, 3, 85)
    got = op9_minhash_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
