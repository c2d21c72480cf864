"""Hashed features and a sparse linear model, shared by the classifiers."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def ngrams(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed n-grams of a code sequence, in blocks, so a long text takes no more memory than a short."""
    counts = np.zeros(1 << bits, np.int64)
    for low in range(0, len(codes), 1 << 20):
        c = codes[low : low + (1 << 20) + max(orders) - 1].astype(np.uint64)
        h = np.full(len(c), 7, np.uint64)
        for n in range(1, max(orders) + 1):
            if n > len(c):
                break
            h = h[: len(c) - n + 1] * MIX + c[n - 1 :]
            h ^= h >> np.uint64(31)
            if n in orders:
                counts += np.bincount((h[: 1 << 20] * MIX >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


class Sample:
    """Rows of (buckets, values, target) in three flat arrays, so a sample takes little memory and gives it back at once."""

    def __init__(self, at: list[np.ndarray], x: list[np.ndarray], target: np.ndarray):
        self.ends = np.cumsum([0, *map(len, at)])
        self.at = np.concatenate(at).astype(np.int32) if at else np.zeros(0, np.int32)
        self.x = np.concatenate(x).astype(np.float32) if x else np.zeros(0, np.float32)
        self.target = target

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = self.ends[i], self.ends[i + 1]
        return self.at[low:high], self.x[low:high], self.target[i]

    def part(self, rows: np.ndarray) -> Sample:
        own = [self[int(i)] for i in rows]
        return Sample([a for a, _, _ in own], [x for _, x, _ in own], self.target[rows])


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader with an elastic-net penalty; labels may be soft."""

    def __init__(self, classes: int, features: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, target: np.ndarray) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = x[:, None] * (softmax(x @ w) - target)[None, :]
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g

    def fit(self, rows: Sample, epochs: int = 3, seed: int = 1) -> np.ndarray:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.learn(*rows[i])
        return self.weights(slice(None))


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()
