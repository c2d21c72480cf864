"""Packing token sequences into bins: best fit decreasing, then a swap-based local search among underfull bins.

The search takes the emptiest bins first and moves a piece or two, or exchanges one for one, two for one, one for two or two for two,
with another underfull bin, whenever that increases the sum of squared fills; bins that run empty are gone. It sweeps over the
bins until no exchange gains. Pieces are dealt at random to groups of a bounded size, packed there; what lies in underfull bins is
dealt again to fewer groups, until one group held it or no fewer would do.

Edge cases. Null or empty text: the closing id alone. Texts of any length are cut, never dropped. Repeated rows are packed each on
their own. Ties: equal lengths are taken in the order they come. Null id: kept. Ids must be integers. Empty input: empty output. Other columns are
not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, staged, tidy
from .pieces import Cache, Splitter, encode_all

GROUP = 65_536
"""Pieces packed together in one task, on average."""


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.splitter = Splitter(public_tokenizers.PATTERN, lambda two: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(two)) == 1)
        self.cache = Cache(self.encode_pieces)
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token: a character for a byte
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. Words after a space are encoded many in one text, which splits before each space, and told apart by their bytes."""
        words, others = [], []
        for i, p in enumerate(pieces):
            (words if p[0] == " " and p[1:].isalpha() else others).append(i)
        if self.splitter.instead:
            odd = {i for i in words if pieces[i].translate(self.splitter.instead) != pieces[i]}
            words, others = [i for i in words if i not in odd], others + sorted(odd)
        out: list[bytes] = [b""] * len(pieces)
        runs = [words[k : k + 500] for k in range(0, len(words), 500)]
        for run, e in zip(runs, self._ids(["".join([pieces[i] for i in run]) for run in runs]), strict=True):
            e = np.asarray(e, "<u4")
            ends = np.cumsum([len(pieces[i].encode()) for i in run])
            at = np.searchsorted(done := np.cumsum(self.size[e]), ends)
            if at[-1] >= len(done) or (done[at] != ends).any():
                others += run
                continue
            raw, low = e.tobytes(), 0
            for i, high in zip(run, (4 * (at + 1)).tolist(), strict=True):
                out[i] = raw[low:high]
                low = high
        for i, e in zip(others, self._ids([pieces[i] for i in others]), strict=True):
            out[i] = e.tobytes()
        return out

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray | array]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4") if len(e) > 500 else array("I", e.ids)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text. A text that spells one of the vocabulary's added tokens goes to the library whole."""
        for spelled, run in groupby(texts, lambda t: any(a in t for a in self.added)):
            if spelled:
                yield from (np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in run)
            else:
                yield from encode_all(self.splitter, self.cache, run)


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, deal (random number) and, if `ids`, the ids as binary: a row for each piece."""
    end = np.array([end_id], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, row = Encoder(path), 0  # of this task alone
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc, coded in zip(batch.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                coded += end
                n = len(coded) // 4
                first = n % capacity or capacity
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    part = coded[4 * start : 4 * stop]
                    crc, row = zlib.crc32(part), row + 1
                    deal = zlib.crc32(row.to_bytes(8, "little"), crc)
                    for c, v in zip(out, (doc, piece, start, stop - start, crc, deal, part), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)][: 6 + ids], names=names[: 6 + ids])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long" + ", ids binary" * ids)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indexes: longest pieces first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


class _Underfull:
    """Underfull bins, found by room and by the length of one piece or the sum of two."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.at: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # room -> size of what it offers -> bins
        self.mask: dict[int, int] = defaultdict(int)

    def sizes(self, b: int) -> list[int]:
        return [0, *offers(self.bins[b], self.lengths)]  # 0: nothing in return, a move

    def add(self, b: int) -> None:
        if 0 < self.fill[b] < self.capacity:
            room = self.capacity - self.fill[b]
            for s in self.sizes(b):
                self.at[room][s].add(b)
                self.mask[room] |= 1 << s

    def remove(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room in self.at:
            for s in self.sizes(b):
                held = self.at[room][s]
                held.discard(b)
                if not held:
                    del self.at[room][s]
                    self.mask[room] &= ~(1 << s)
            if not self.at[room]:
                del self.at[room], self.mask[room]

    def partner(self, size: int, fill: int) -> tuple[int, int, int] | None:
        """(gain, bin, size it gives back): the exchange for `size` of a bin with that fill that moves the most and adds to the squares."""
        best = None
        for room, mask in self.mask.items():
            low = max(0, size - room)
            high = size - max(0, fill - (self.capacity - room))  # the gain must exceed what the donor is ahead
            found = (mask >> low) & ((1 << (high - low)) - 1) if high > low else 0
            if found:
                back = low + (found & -found).bit_length() - 1
                if best is None or size - back > best[0]:
                    best = (size - back, min(self.at[room][back]), back)
        return best


def offers(bin_: list[int], lengths: list[int]) -> list[int]:
    """The lengths of its pieces and of two of them together, each once; the sums are shifted bit sets, so many pieces cost little."""
    held: dict[int, int] = defaultdict(int)
    for i in bin_:
        held[lengths[i]] += 1
    ones = sum(1 << n for n in held)
    both = ones
    for n, times in held.items():
        both |= (ones if times > 1 else ones ^ (1 << n)) << n
    return [n for n in range(both.bit_length()) if both >> n & 1]


def _of_size(bin_: list[int], lengths: list[int], size: int) -> list[int]:
    """One piece, or else two, of that size together."""
    if not size:
        return []
    seen: dict[int, int] = {}
    two: list[int] = []
    for i in bin_:
        if lengths[i] == size:
            return [i]
        if not two and size - lengths[i] in seen:
            two = [i, seen[size - lengths[i]]]
        seen[lengths[i]] = i
    return two


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Fewer bins, or the same with a greater sum of squared fills; full bins stay as they are."""
    state = _Underfull(bins, lengths, capacity)
    open_ = [b for b in range(len(bins)) if 0 < state.fill[b] < capacity]
    for b in open_:
        state.add(b)
    gained = True
    while gained:  # every exchange adds to the sum of squares, so this ends
        gained = False
        for donor in sorted(open_, key=lambda b: (state.fill[b], b)):
            if not 0 < state.fill[donor] < capacity:
                continue
            state.remove(donor)
            while bins[donor]:
                found = [(p, s) for s in offers(bins[donor], lengths) if (p := state.partner(s, state.fill[donor]))]
                if not found:
                    break
                (gain, other, back), size = max(found)
                state.remove(other)
                give, take = _of_size(bins[donor], lengths, size), _of_size(bins[other], lengths, back)
                bins[donor] = [i for i in bins[donor] if i not in give] + take
                bins[other] = [i for i in bins[other] if i not in take] + give
                state.fill[donor] -= gain
                state.fill[other] += gain
                state.add(other)
                gained = True
            state.add(donor)
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pack_pieces(pieces: DataFrame, capacity: int = 1024, group: int = GROUP) -> DataFrame:
    """pieces (staged, with length and deal) with sequence_id and offset."""
    cols = [c for c in pieces.columns if c != "deal"]
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", sequence_id long, offset long, closed boolean, deal long"

    def packer(groups_before: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            lengths = rows["length"].tolist()
            bins = pack(lengths, capacity)
            order = np.array([i for b in bins for i in b])
            of_bin = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            size = rows["length"].to_numpy()[order]
            ends = size.cumsum()
            first = np.r_[True, of_bin[1:] != of_bin[:-1]]
            base = np.maximum.accumulate(np.where(first, ends - size, 0))
            full = np.bincount(of_bin, weights=size)[of_bin] == capacity
            return rows.iloc[order][cols].assign(sequence_id=-1 - ((groups_before + int(key[0])) * (1 << 28) + of_bin), offset=ends - size - base, closed=full, deal=rows["deal"].to_numpy()[order])

        return run

    done, todo, groups, round_, base = None, pieces, parts(pieces.count(), group), 0, 0
    while True:
        round_ += 1
        dealt = todo.withColumn("grp", F.pmod(F.xxhash64("deal", F.lit(round_)), F.lit(groups)))
        packed = staged(dealt.groupBy("grp").applyInPandas(packer(base), schema), "packed")
        left = packed.where(~F.col("closed"))
        fewer = parts(left.count(), group)
        if groups == 1 or fewer >= groups:
            return (packed if done is None else done.unionByName(packed)).drop("closed", "deal")
        done = packed.where("closed") if done is None else done.unionByName(packed.where("closed"))
        todo, groups, base = left.drop("sequence_id", "offset", "closed"), fewer, base + groups


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document."""
    pieces = staged(token_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    whole = pieces.where(F.col("length") == capacity).drop("deal").withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return pack_pieces(pieces.where(F.col("length") < capacity), capacity).unionByName(whole)
