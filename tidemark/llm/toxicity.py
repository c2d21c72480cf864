"""Toxicity: a noisy-channel decoder restores disguised words, a linear scorer judges the restored text.

A character trigram model counts all documents. A word with digits or signs among its letters, letters three times over or
separators between single letters becomes a lattice of readings; Viterbi finds the likeliest under the model and the channel. The scorer is a
sparse logistic regression on hashed beginnings of words, fitted on about `per_class` labelled documents of each class, chosen by hash
(3 * `per_class` labels at the very most).

Edge cases. Null or empty text: the prior alone. Texts and words of any length are read whole. Labels that are null, or whose document
is held out, are not learned from; without labels of both classes every score is 0. Documents with several labels count with each. Repeated
rows give repeated results. Null ids have no label. Empty input: empty output. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import driver_gives_back, fold_of, tidy
from .linear import Ftrl, Sample, code_points

BITS = 18
PER_CLASS = 2500
# What a sign may stand for; "" for nothing, " " for a gap.
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
MASKED = "aeiou"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"  # only several masks in a row hide them
LONGEST = 8  # masks in a row that stand for a letter each; a longer line of them is a divider, read as one mask
GAPS = "._-*~ "
CHANNEL = {"sign": -1.0, "mask": -3.0, "drop": -7.0, "gap": -1.5, "fold": -2.0, "consonant": -4.0}
SIZE = 61  # classes of characters: gap, a-z, the Latin-1 letters, any other letter

_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = "".join(map(re.escape, READINGS))
_ENDS = "".join(re.escape(c) for c in READINGS if c not in "!+(€")  # at the end of a word those are punctuation
_EDGE = re.compile(r"^[\"'(\[{<.,;:!?#*%&|]+(?=\w)|(?:[#*%&]{2,}|[\"')\]}>.,;:?]+|!{2,})+$")
_DISGUISED = re.compile(rf"[^\W\d_](?:[{_SIGNS}]+|\*+)[^\W\d_]|[{_SIGNS}][^\W\d_]|[^\W\d_][{_ENDS}]+$|([^\W\d_])\1\1|(?:[^\W_][._\-*~ ]){{2}}[^\W_]")
_SPACED = re.compile(r"(?<!\S)(?:\S[ ._*-]){3,}\S(?!\S)")


def _class_table() -> np.ndarray:
    table = np.full(0x10000, SIZE - 1, np.int64)
    for c in range(0x10000):
        ch = chr(c).lower()
        if not ch.isalpha():
            table[c] = 0
        elif "a" <= ch[0] <= "z":
            table[c] = ord(ch[0]) - 96
        elif 0xDF <= ord(ch[0]) <= 0xFF:
            table[c] = 27 + ord(ch[0]) - 0xDF
    return table


_table: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    if not _table:
        _table.append(_class_table())
    return _table[0][np.minimum(code_points(text), 0xFFFF)]


def language_model(docs: DataFrame) -> np.ndarray:
    """ln P(c | a, b) as an array of SIZE ** 3, of the trigrams of all texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                c = np.r_[0, 0, classes(text.as_py() or ""), 0]
                tri = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
                if len(tri) > 50_000:
                    counts += np.bincount(tri, minlength=SIZE**3)
                else:
                    np.add.at(counts, tri, 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # SIZE ** 3 at most
    counts = np.full(SIZE**3, 0.01)
    counts[rows["at"].to_numpy()] += rows["n"].to_numpy()
    counts = counts.reshape(SIZE, SIZE, SIZE)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


class Decoder:
    def __init__(self, model: np.ndarray):
        self.model = model.tolist() if len(model) else []

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        out, i = [], 0
        while i < len(word):
            c, n = word[i], 1
            while i + n < len(word) and word[i + n] == c:
                n += 1
            if c.isalpha():
                out.append([(c * n, 0.0)] if n < 3 else [(c, 0.0), (c * 2, -0.5)])
            elif c in READINGS:
                once = CHANNEL["sign"] + (CHANNEL["fold"] if n == 2 else 0.0)
                twice = CHANNEL["sign"] - (0.5 if n > 2 else 0.0)
                out.append([(r, once) for r in READINGS[c]] + [(r * 2, twice) for r in READINGS[c] if n > 1] + [("", CHANNEL["drop"])])
            elif c == "*":
                more = [(v, CHANNEL["consonant"]) for v in CONSONANTS] if 1 < n <= LONGEST else []
                out.extend([[(v, CHANNEL["mask"]) for v in MASKED] + more + [("", CHANNEL["drop"])]] * (n if n <= LONGEST else 1))
            elif c in GAPS:
                out.append([("", 0.0), (" ", CHANNEL["gap"])])
            else:
                out.append([(" ", 0.0)])
            i += n
        return out

    def best(self, word: str) -> str:
        """The likeliest reading of a word, lower-cased."""
        if not self.model:
            return word
        states: dict[tuple[int, int], float] = {(0, 0): 0.0}
        back: list[dict] = []
        for options in [*self.lattice(word.lower()), [(" ", 0.0)]]:
            nxt: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple] = {}
            for (a, b), score in states.items():
                for string, cost in options:
                    x, y, s = a, b, score + cost
                    for k in classes(string).tolist() if string else ():
                        s += self.model[x][y][k]
                        x, y = y, k
                    if s > nxt.get((x, y), -1e300):
                        nxt[x, y], came[x, y] = s, ((a, b), string)
            states = nxt
            back.append(came)
        at, parts = max(states, key=states.__getitem__), []
        for came in reversed(back):
            at, string = came[at]
            parts.append(string)
        return "".join(reversed(parts))


def restored(word: str, decoder: Decoder) -> list[str]:
    """The letter runs of a word between white space, as read by the decoder if it looks disguised."""
    bare = _EDGE.sub("", word)
    if _DISGUISED.search(bare):
        bare = decoder.best(bare)
    return _WORD.findall(bare.lower())


def word_features(runs: list[str]) -> set[int]:
    out = set()
    for run in runs:
        out.add(zlib.crc32(f"{run}$".encode()) >> (32 - BITS))
        for n in range(3, min(9, len(run) + 1)):
            out.add(zlib.crc32(run[:n].encode()) >> (32 - BITS))
    return out


class Reader:
    """Features of texts; words are restored and hashed once, as long as they are among the `most` kept."""

    def __init__(self, decoder: Decoder, keep: frozenset[int] | None = None, most: int = 300_000):
        self.decoder, self.keep, self.most, self.known = decoder, keep, most, {}

    def __call__(self, text: str) -> dict[int, int]:
        """In how many of its different words the text has each feature."""
        words = set(text.split())
        words.update(m[0] for m in _SPACED.finditer(text))
        out: dict[int, int] = {}
        for word in words:
            found = self.known.get(word)
            if found is None:
                found = word_features(restored(word, self.decoder))
                found = tuple(found if self.keep is None else found & self.keep)
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[word] = found
            for f in found:
                out[f] = out.get(f, 0) + 1
        return out


class Model:
    def __init__(self, language: np.ndarray, weights: dict[int, float], bias: float | None):
        self.language, self.weights, self.bias = language, weights, bias

    def reader(self) -> Reader:
        return Reader(Decoder(self.language), frozenset(self.weights))

    def score(self, found: dict[int, int]) -> float:
        if self.bias is None:
            return 0.0
        return float(1 / (1 + np.exp(-max(-500, min(500, self.bias + sum(self.weights[f] * math.log1p(n) for f, n in found.items()))))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """labels (doc_id, toxic): rows that may be learned from."""
    language = language_model(docs)
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(language, {}, None)
    rate = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    draw = F.xxhash64("doc_id", "toxic")
    picked = labels.where(F.pmod(draw, F.lit(1 << 30)) < rate * (1 << 30)).orderBy(draw).limit(3 * per_class).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(language)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(Decoder(shared.value))
        for batch in batches:
            found = [sorted(read(t.as_py() or "").items()) for t in batch.column(0)]
            lists = [pa.array([[a for a, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[min(n, 127) for _, n in f] for f in found], pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *lists], names=["toxic", "at", "n"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    sample = own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")  # rows that share an id give one
    fitted = sample.mapInArrow(rows, "toxic int, at array<int>, n array<tinyint>").repartition(1).mapInArrow(fitting(sizes), "at int, odds double").toArrow()
    shared.unpersist()
    if not len(fitted):
        return Model(language, {}, None)
    weights = dict(zip(fitted["at"].to_pylist(), fitted["odds"].to_pylist(), strict=True))
    bias = weights.pop(-1)
    driver_gives_back(docs.sparkSession)
    return Model(language, weights, bias)


def fitting(sizes: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The scorer of all rows (toxic, at, n) of one task: the odds of each feature that counts, at -1 the bias; nothing without both classes.

    The sample, large beside the weights, so never comes to the driver. Its order does not matter.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("toxic", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int8()))]))
        toxic = table["toxic"].to_numpy()
        drawn = [int((toxic == k).sum()) for k in (0, 1)]
        if not all(drawn):
            return
        at = [a.values.to_numpy() for a in table["at"]]
        order = np.array(sorted(range(len(at)), key=lambda i: (toxic[i], at[i].astype(">i4").tobytes())))
        data = Sample([at[i] for i in order], [np.log1p(table["n"][int(i)].values.to_numpy()) for i in order], np.eye(2)[toxic[order]])
        del table, at
        w = Ftrl(2, 1 << BITS, alpha=0.3, l1=2.0, l2=0.1).fit(data, 8)
        odds = w[:, 1] - w[:, 0]
        prior = np.log(sizes[1] / sizes[0]) - np.log(drawn[1] / drawn[0])
        places = np.flatnonzero(odds[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[places, -1], pa.int32()), pa.array(np.r_[odds[places], odds[-1] + prior])], names=["at", "odds"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.reader()
        for batch in batches:
            scores = [shared.value.score(read(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs with a score below `limit`, all columns as they were."""
    shared, schema, at = docs.sparkSession.sparkContext.broadcast(model), docs.schema, docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.reader()
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(read(t.as_py() or "")) < limit for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, schema)


def learning(labels: DataFrame) -> DataFrame:
    return labels.where(fold_of(F.col("doc_id"), 5) != 0)
