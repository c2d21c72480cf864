"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies count every learning document; weights are fitted on about `per_lang` different texts of each language, chosen by hash,
with follow-the-regularised-leader and an elastic net; a temperature is then calibrated on a fifth of them set aside. Languages
are taken to be a small closed set.

Edge cases. Null text or one without a letter: `und`, score 0. Nothing to learn from: `und` for all. Texts of any length are read
whole. Null languages are not learned from, null ids are (they are in no held-out fold). Repeated rows give repeated results.
Ties go to the language that sorts first. Empty input: empty output. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of
from .linear import Ftrl, Sample, code_points, ngrams, softmax

BITS, ORDERS = 14, (1, 2, 3)
PER_LANG = 800
MOST_LANGS = 64
"""Languages that a sample is bounded for; with more of them each gets its share of MOST_LANGS * per_lang texts."""
LETTER = np.array([chr(c).isalpha() for c in range(0x250)])


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of the lower-cased letters, words set apart by one space."""
    codes = code_points(text.lower())
    small = codes < 0x250
    is_letter = np.where(small, LETTER[np.where(small, codes, 0)], True)
    if not small.all():
        odd = np.unique(codes[~small])
        bad = odd[[not chr(c).isalpha() for c in odd]]
        is_letter &= ~np.isin(codes, bad)
    codes = np.where(is_letter, codes, 32)
    codes = np.append(np.uint32(32), codes)
    stays = (codes[1:] != 32) | (codes[:-1] != 32)
    return ngrams(np.append(codes[1:][stays], np.uint32(32)), ORDERS, BITS)


def scaled(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(1e-12, float(np.sqrt(x @ x)))


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.langs, self.weights, self.idf, self.temperature = langs, weights, idf, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        at, n = features(text)
        p = softmax((scaled(at, n, self.idf) @ self.weights[at] + self.weights[-1]) / self.temperature)
        return self.langs[int(p.argmax())], float(p.max())


def train(docs: DataFrame, per_lang: int = PER_LANG, seed: int = 1) -> Model:
    """A model of docs (text, lang), all of which may be learned from."""
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, held = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df[features(text.as_py())[0]] += 1
            held += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], held))], names=["at", "n"])

    counts = {r.at: r.n for r in docs.select("text").mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(-1, 0)
    df = np.zeros(1 << BITS)
    df[list(counts)] = list(counts.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1, 0)), idf, 1.0)
    per = min(per_lang, max(1, MOST_LANGS * per_lang // len(langs)))
    # Different texts alone are drawn, about `per` of each language; twice as many in all is the bound that no input exceeds.
    rate = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, per / sizes[x]))])
    draw = F.xxhash64("text", "lang")
    drawn = docs.where(F.pmod(draw, F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30))
    picked = drawn.groupBy("lang", "text").agg(F.lit(1).alias("one")).orderBy(draw).limit(2 * per * len(langs)).select("text", "lang")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))], names=["lang", "at", "n"])

    table = picked.mapInArrow(rows, "lang string, at array<int>, n array<int>").toArrow()
    own = [langs.index(x) for x in table["lang"].to_pylist()]
    at = [a.values.to_numpy() for a in table["at"]]
    first = sorted(range(len(own)), key=lambda i: (own[i], len(at[i]), at[i].tolist()))
    data = Sample([at[i] for i in first], [scaled(at[i], table["n"][i].values.to_numpy(), idf) for i in first], np.eye(len(langs))[[own[i] for i in first]])
    order = np.random.default_rng(seed).permutation(len(data))
    kept, aside = data.part(order[len(data) // 5 :]), data.part(order[: len(data) // 5])
    weights = Ftrl(len(langs), 1 << BITS, alpha=1.0, l1=0.02, l2=0.02).fit(kept, 3)
    logits = [x @ weights[a] + weights[-1] for a, x, _ in map(aside.__getitem__, range(len(aside)))]
    loss = lambda t: -sum(np.log(max(1e-12, float(softmax(v / t) @ y))) for v, y in zip(logits, aside.target, strict=True))
    return Model(langs, weights.astype(np.float32), idf, min(np.geomspace(0.05, 5, 40), key=loss) if len(aside) else 1.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def learning(docs: DataFrame) -> DataFrame:
    return docs.where(fold_of(F.col("doc_id"), 4) != 2)
