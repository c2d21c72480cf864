"""Splitting text into the pieces a byte-level BPE encodes one by one, with a tokenizer library's own character classes.

`regex` and the libraries may know different Unicode versions. Each character beyond ASCII is put to the library once; where
the two differ, a stand-in of the library's class is matched in its place and the piece is cut from the true text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import regex

STAND_IN = {"L": "a", "N": "1", "S": "\t", "O": "."}
CLASSES = (("L", regex.compile(r"\p{L}")), ("N", regex.compile(r"\p{N}")), ("S", regex.compile(r"\s")))
BLOCK = 1 << 18
"""Pieces handled at once; bounds the memory that one long text takes."""


class Splitter:
    """pieces(text) for `pattern`; same_piece(s) says whether the library keeps the two characters of s in one piece."""

    def __init__(self, pattern: str, same_piece: Callable[[str], bool]):
        self.pattern, self.same_piece = regex.compile(pattern), same_piece
        self.seen: set[str] = set()
        self.instead: dict[int, str] = {}

    def _learn(self, text: str) -> None:
        for c in set(text) - self.seen:
            self.seen.add(c)
            if ord(c) > 127:
                theirs = "L" if self.same_piece("a" + c) else "N" if self.same_piece("1" + c) else "O" if self.same_piece("." + c) else "S"
                if theirs != next((k for k, p in CLASSES if p.match(c)), "O"):
                    self.instead[ord(c)] = STAND_IN[theirs]

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The pieces in order, at most BLOCK in a list."""
        shown = text
        if not text.isascii():
            self._learn(text)
            if self.instead:
                shown = text.translate(self.instead)
        if len(text) <= BLOCK:
            yield self.pattern.findall(text) if shown is text or shown == text else [text[slice(*m.span())] for m in self.pattern.finditer(shown)]
            return
        block: list[str] = []
        for m in self.pattern.finditer(shown):
            block.append(text[slice(*m.span())])
            if len(block) == BLOCK:
                yield block
                block = []
        yield block


class Cache(dict):
    """Pieces to packed ids; the later ones go when it holds `most`, so memory is bounded however many pieces there are."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 500_000):
        super().__init__()
        self.encode, self.most = encode, most

    def coded(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of each list of pieces; those not held are encoded together."""
        found = [list(map(self.get, pieces)) for pieces in texts]
        holes = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        new = list({pieces[i] for pieces, h in zip(texts, holes, strict=True) for i in h})
        if new:
            if len(self) + len(new) > self.most:
                early = list(islice(self.items(), self.most // 2))  # frequent pieces come early
                self.clear()
                self.update(early)
            self.update(zip(new, self.encode(new), strict=True))
            for pieces, h, f in zip(texts, holes, found, strict=True):
                for i in h:
                    f[i] = self[pieces[i]]
        return list(map(b"".join, found))


def encode_all(splitter: Splitter, cache: Cache, texts: Iterable[str]) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers; new pieces of neighbouring texts are encoded together."""
    waiting: list[list[str]] = []
    n = 0

    def flush() -> Iterator[bytes]:
        yield from cache.coded(waiting)
        waiting.clear()

    for text in texts:
        if len(text) > BLOCK:  # its blocks one after the other
            yield from flush()
            yield b"".join([ids for block in splitter.blocks(text) for ids in cache.coded([block])])
            n = 0
            continue
        waiting.append(next(splitter.blocks(text)) if text else [])
        n += len(waiting[-1])
        if n >= BLOCK or len(waiting) >= BLOCK:
            yield from flush()
            n = 0
    yield from flush()
