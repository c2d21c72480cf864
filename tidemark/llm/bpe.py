"""Byte-level BPE encoding and decoding on padded numpy matrices.

Pieces of similar byte length share a matrix, a row each. In each round every row merges its leftmost pair of least rank; ranks
of new pairs come from a hashed table of pairs, the vacated column is compacted away, and finished rows leave the matrix.
A piece over the largest width is a matrix of one row. It would take as many rounds as it has bytes; so a round merges all its pairs
of least rank from the left, unless a pair that comes up on the way has that rank or a lower one: then the leftmost alone.

Edge cases. Null or empty text: no ids, decoded to nothing. Texts of any length are encoded whole, in blocks of pieces. Repeated
rows give repeated results. Empty input: empty output. Other columns pass through `encode_documents`; those whose names begin with
`bpe_`, as those it adds do, come out with `in_` before them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import apart
from .pieces import Cache, Splitter, encode_all

NONE = np.int32(2**31 - 1)
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of the merged token: open addressing with linear probing, looked up a vector at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, vals = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(rank)
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        left, value = np.array(keys, np.int64), np.array(vals, np.int32)
        at = self._slot(left)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = left[free]  # of several for one slot the last stays; the others go on
            own = self.keys[at] == left
            self.vals[at[own]] = value[own]
            left, value, at = left[~own], value[~own], (at[~own] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        key[(a < 0) | (b < 0)] = -2
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.vals[at], NONE)
        todo = np.flatnonzero((found != key) & (found != -1) & (key != -2))
        while len(todo):
            at_todo = at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at_todo]
            hit = found == key[todo]
            out[todo[hit]] = self.vals[at_todo[hit]]
            todo = todo[~hit & (found != -1)]
        return out


class Bpe:
    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers

        self.ranks = read_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.splitter = Splitter(pattern or public_tokenizers.PATTERN, self._same_piece)
        self.cache = Cache(self.encode_pieces)

    @staticmethod
    def _same_piece(two: str) -> bool:
        """Whether the library's own pattern engine keeps two characters together: then a vocabulary that can join them does."""
        import public_tokenizers
        import tiktoken

        raw = two.encode()
        small = {bytes([b]): b for b in range(256)} | {raw[:k]: 254 + k for k in range(2, len(raw) + 1)}
        return len(tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=small, special_tokens={}).encode_ordinary(two)) == 1

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        buckets: dict[int, list[int]] = {}
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for i, w in enumerate(np.searchsorted(WIDTHS, sizes).tolist()):
            whole = self.ranks.get(raw[i])
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif w == len(WIDTHS):
                out[i] = self._row(raw[i])
            elif raw[i]:
                buckets.setdefault(w, []).append(i)
        for w, rows in buckets.items():
            self._matrix(raw, np.array(rows), WIDTHS[w], out)
        return out

    def _matrix(self, raw: list[bytes], rows: np.ndarray, width: int, out: list[bytes]) -> None:
        size = np.fromiter((len(raw[i]) for i in rows), np.int64, len(rows))
        flat = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < size[:, None], self.of_byte[flat], np.int32(-1))
        rank = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            over = least == NONE
            if over.any():
                for i, row, n in zip(rows[over].tolist(), ids[over].astype("<u4"), size[over].tolist(), strict=True):
                    out[i] = row[:n].tobytes()
                rows, ids, rank, size, at, least = (x[~over] for x in (rows, ids, rank, size, at, least))
            if not len(rows):
                return
            here = np.arange(len(rows))
            n, w = ids.shape
            ids[here, at] = least
            stays = np.ones((n, w), bool)
            stays[here, at + 1] = False
            ids = ids[stays].reshape(n, w - 1)
            stays[here, at + 1] = True
            stays[here, at] = False
            rank = rank[stays[:, :-1]].reshape(n, w - 2)
            size = size - 1
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < w - 2)
            rank[left, at[left] - 1] = self.pairs(ids[left, at[left] - 1], ids[left, at[left]])
            rank[right, at[right]] = self.pairs(ids[right, at[right]], ids[right, at[right] + 1])

    def _row(self, raw: bytes) -> bytes:
        """The ids of one long piece."""
        ids = self.of_byte[np.frombuffer(raw, np.uint8)]
        rank = self.pairs(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            place = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], place, 0))
            at = at[(place - run) % 2 == 0]  # overlapping pairs: every other one, from the left
            merged = self._merge(ids, rank, at, least)
            if len(at) > 1:
                close = at[1:][np.diff(at) == 2]  # stands beside a merged pair for a while
                if merged[2] <= least or (len(close) and self.pairs(np.full(len(close), least), ids[close]).min() <= least):
                    merged = self._merge(ids, rank, at[:1], least)
            ids, rank, _ = merged
        return ids.astype("<u4").tobytes()

    def _merge(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray, token: int) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and ranks with `token` for the pairs at the given places, and the least rank of the pairs that are new."""
        ids = ids.copy()
        ids[at] = token
        ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
        at = at - np.arange(len(at))
        left, right = at[at > 0] - 1, at[at < len(rank)]
        for new in (left, right):
            rank[new] = self.pairs(ids[new], ids[new + 1])
        return ids, rank, min((rank[new].min() for new in (left, right) if len(new)), default=NONE)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        return encode_all(self.splitter, self.cache, texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One encoder for each Python process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids: bool = True) -> DataFrame:
    """docs with bpe_ids (binary, little-endian unsigned 32-bit; only if `ids`), bpe_n_tokens, bpe_ids_sha256, bpe_decoded_sha256."""
    docs = apart(docs, "bpe_")
    added = [T.StructField("bpe_n_tokens", T.LongType()), T.StructField("bpe_ids_sha256", T.StringType()), T.StructField("bpe_decoded_sha256", T.StringType())]
    added += [T.StructField("bpe_ids", T.BinaryType())] if ids else []
    kept = [f for f in docs.schema.fields if ids or f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for coded in bpe.encode_all(text.as_py() or "" for text in batch.column(text_col)):
                row = (len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(bpe.decode(coded)).hexdigest(), coded)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)][: len(added)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + made, names=[f.name for f in kept + added])

    return docs.mapInArrow(run, T.StructType(kept + added))
