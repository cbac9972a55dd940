"""Vectorised text helpers shared by the operators: whole Arrow columns are cut into words with numpy.

Texts are handled as UTF-8 bytes. Null texts count as empty. Work goes on in chunks of about
``CHUNK`` bytes (a longer text is its own chunk), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _table() -> np.ndarray:
    """Byte map: digits and lower-case letters stay, A-Z are lowered, bytes from 0x80 stay, the rest is 0."""
    t = np.zeros(256, np.uint8)
    for c in range(256):
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            t[c] = c
        elif 65 <= c <= 90:
            t[c] = c + 32
    return t


WORD = _table()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse mod 2**64, at least n of each."""
    if "p" not in _powers or len(_powers["p"]) < n:
        n = max(n, CHUNK + 4096)
        inv = np.uint64(pow(int(_R), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers["p"] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _R)], dtype=np.uint64)
            _powers["i"] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inv)], dtype=np.uint64)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def byte_list(col: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x if x is not None else b"" for x in col.cast(kind).to_pylist()]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold about size bytes each."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of some texts, in order: ``hash`` (64 bits, of the lowered bytes), ``doc`` (index of the text), ``start``, ``end`` (bytes in ``buf``)."""

    __slots__ = ("_inv", "_sums", "buf", "doc", "end", "first", "hash", "start", "texts")

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.buf = WORD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[1:] = self.buf != 0
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.first = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        edges = np.searchsorted(self.start, self.first)
        counts = np.diff(np.r_[edges, len(self.start)])
        self.doc = np.repeat(np.arange(len(texts)), counts)
        p, inv = powers(len(self.buf))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(self.buf * p[: len(self.buf)], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * inv[self.start])
        self._sums, self._inv = sums, inv

    def stems(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of the first ``size`` bytes of each longer word; no stem has the hash of a word."""
        long = np.flatnonzero(self.end - self.start > size)
        start = self.start[long]
        with np.errstate(over="ignore"):
            return self.doc[long], mix((self._sums[start + size] - self._sums[start]) * self._inv[start], size)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.texts))


def distinct_terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each text's distinct words, sorted by doc, then hash."""
    order = np.lexsort((words.hash, words.doc))
    d, h = words.doc[order], words.hash[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[keep], h[keep]
