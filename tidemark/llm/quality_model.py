"""Quality classifier from weak labels: heuristic labellers vote, EM finds how far to trust them, a hashed linear scorer learns.

Every document gets the votes (good, bad, abstain) of LABELLERS. Documents are counted by vote pattern, 3 ** len(LABELLERS) at most, over
all of the corpus; expectation-maximisation on those counts estimates, for each labeller, how it votes on good and on bad
documents, and the posterior of each pattern. The posteriors of about `sample` documents, chosen by hash, are the soft labels of a
logistic regression on hashed n-grams of character classes.

Edge cases. Null or empty text: posterior and score 0, not kept. Texts of any length are read whole. Where all documents vote
alike, the posterior is the share of good votes. Repeated rows give repeated results and count in the statistics. Null ids
pass. Ties at the limit are kept. Empty input: empty output. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, let, whole
from .linear import Ftrl, Sample, code_points, ngrams, softmax

BITS, ORDERS, EXTRA = 13, (1, 2, 4), 5
SAMPLE = 4000
LIMIT = 0.5


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 2).otherwise(1)


def labellers(text: Column) -> dict[str, Column]:
    """A column of votes for each labeller: 0 bad, 1 abstain, 2 good."""
    n = F.char_length(text)
    share = lambda pattern: (n - F.char_length(F.regexp_replace(text, pattern, ""))) / F.greatest(n, F.lit(1))
    words = F.filter(F.split(F.btrim(text, F.lit(ASCII_SPACE)), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    again = let(words, lambda own: F.size(F.filter(own, lambda w, i: F.coalesce(w == F.get(own, i - 1), F.lit(False)))) / F.greatest(F.size(own), F.lit(1)))
    distinct = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    fresh = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    return {
        "length": _vote(F.size(words) < 50, F.size(words) >= 100),
        "symbols": _vote(share("[#*$%&|<>]+") > 0.03, share("[#*$%&|<>]+") < 0.005),
        "letters": _vote(share("[\\p{L}]+") < 0.72, share("[\\p{L}]+") > 0.78),
        "capitals": _vote(share("[\\p{Lu}]+") > 0.2, share("[\\p{Lu}]+") < 0.06),
        "marks": _vote(share("[!?]+") > 0.02, share("[!?]+") < 0.002),
        "variety": _vote(distinct < 0.2, distinct > 0.35),
        "repeats": _vote(again > 0.2, again < 0.05),
        "lines": _vote(fresh < 0.7, fresh > 0.95),
    }


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, accuracy table labeller x class x vote)."""
    good = np.clip(((patterns == 2).sum(1) + 0.5) / ((patterns != 1).sum(1) + 1), 0.02, 0.98)
    votes = np.eye(3)[patterns]  # pattern, labeller, vote
    for _ in range(rounds):
        of = np.stack([1 - good, good])  # class, pattern
        table = np.einsum("cp,p,plv->lcv", of, counts, votes) + 1
        table /= table.sum(2, keepdims=True)
        prior = np.clip((of * counts).sum(1) / max(1, counts.sum()), 0.01, 0.99)
        like = np.log(prior) + np.einsum("plv,lcv->pc", votes, np.log(table))
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -500, 500)))
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return good, table


CLASS = np.full(0x250, ord("a"), np.uint32)
for _c in range(0x250):
    _ch = chr(_c)
    CLASS[_c] = ord("A") if _ch.isupper() else ord("a") if _ch.isalpha() else ord("0") if _ch.isdigit() else _c


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = code_points(text)
    at, n = ngrams(np.where(codes < 0x250, CLASS[np.minimum(codes, 0x24F)], np.uint32(97)), ORDERS, BITS)
    x = np.sqrt(n / max(1, len(codes)))
    words = text.split()
    again = sum(map(eq, words, words[1:])) / max(1, len(words))
    extra = np.array([min(1.0, len(words) / 100), len(set(words)) / max(1, len(words)), 1.0 if len(words) < 50 else 0.0, again, float(again > 0.1)])
    return np.append(at, (1 << BITS) + np.arange(EXTRA)), np.append(x, extra)


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights (features + 1, classes bad and good) from docs (text)."""
    text = docs.select(whole(F.col("text")).alias("text"))
    names = list(labellers(F.col("text")))
    votes_of = lambda t: F.concat(*[v.cast("string") for v in labellers(t).values()])
    rows = sorted((r.votes, r.n) for r in text.select(votes_of(F.col("text")).alias("votes")).groupBy("votes").agg(F.count("*").alias("n")).collect())  # 3 ** labellers at most
    total = sum(n for _, n in rows)
    if not total:
        return np.zeros(((1 << BITS) + EXTRA + 1, 2))
    patterns = np.array([[int(c) for c in v] for v, _ in rows]).reshape(-1, len(names))
    good, _ = expectation_maximisation(patterns, np.array([n for _, n in rows], float))
    posterior = dict(zip((v for v, _ in rows), good.tolist(), strict=True))
    draw = F.xxhash64("text")  # the choice comes before the votes, which are dear; different texts alone are drawn, 2 * sample at most
    drawn = text.where(F.pmod(draw, F.lit(1 << 30)) < min(1.0, sample / total) * (1 << 30)).distinct().orderBy(draw).limit(2 * sample)
    picked = drawn.select("text", votes_of(F.col("text")).alias("votes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))], names=["votes", "at", "x"])

    table = picked.mapInArrow(run, "votes string, at array<int>, x array<float>").toArrow()
    belief = np.array([posterior[v] for v in table["votes"].to_pylist()])
    at, x = [a.values.to_numpy() for a in table["at"]], [a.values.to_numpy() for a in table["x"]]
    order = sorted(range(len(at)), key=lambda i: (belief[i], len(at[i]), x[i].tolist()))
    data = Sample([at[i] for i in order], [x[i] for i in order], np.stack([1 - belief, belief], 1)[order])
    return Ftrl(2, (1 << BITS) + EXTRA, alpha=0.5, l1=0.05, l2=0.05).fit(data, 4).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and kept (score >= limit)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = t.as_py()
                at, x = features(text or "")
                out.append(float(softmax(x @ w[at] + w[-1])[1]) if text else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array([s >= limit for s in out], pa.bool_())], names=["doc_id", "score", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, kept boolean")
