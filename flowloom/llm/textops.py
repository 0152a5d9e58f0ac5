"""Vectorised word access to Arrow text columns, shared by the text operators.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` (UTF-8
never uses those bytes inside a character), with ``A-Z`` lower-cased.  Words
are identified by a 64-bit polynomial hash that is read off one prefix sum over
the whole buffer, so no Python object is made per word.  Null texts count as
empty; a text of any length is processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: word bytes of the letters-only tokenizer: digits, a-z, and all of non-ASCII
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True

_pow_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow_cache.get("p")
    if have is None or len(have) < n:
        m = max(n, CHUNK_BYTES + 1)
        up, down = np.full(m, _P, U64), np.full(m, _P_INV, U64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if m > 8 * CHUNK_BYTES:  # a very long text: don't keep its tables
            return up, down
        _pow_cache["p"], _pow_cache["i"] = up, down
    return _pow_cache["p"], _pow_cache["i"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of the documents ``first .. first + n_docs`` of a batch."""

    first: int
    n_docs: int
    doc: np.ndarray  # index of each word's document, from 0 within the chunk
    hash: np.ndarray  # uint64
    bounds: np.ndarray  # n_docs + 1 offsets into doc / hash
    start: np.ndarray  # byte offsets into lower
    end: np.ndarray
    lower: np.ndarray  # lower-cased bytes of the chunk
    prefix: np.ndarray  # prefix sums of the polynomial hash

    def head_hash(self, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes of every word (of all of it, if shorter)."""
        _, inv = _powers(len(self.prefix))
        end = np.minimum(self.start + n, self.end)
        return mix64((self.prefix[end] - self.prefix[self.start]) * inv[self.start])


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def iter_words(col: pa.Array, letters_only: bool = False) -> Iterator[Words]:
    """Words of a text column in chunks of about ``CHUNK_BYTES``.

    ``letters_only`` splits at every ASCII byte that is no letter or digit, too.
    """
    data, offsets = text_buffers(col)
    for i, j in _chunks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        low = _LOWER[data[lo:hi]]
        n = hi - lo
        word = _ALNUM[low] if letters_only else ~_SPACE[low]
        edge = np.zeros(n + 1, bool)
        edge[offsets[i : j + 1] - lo] = True  # words never cross documents
        begins, ends = word.copy(), word.copy()
        if n:
            begins[1:] &= ~word[:-1] | edge[1:n]
            ends[:-1] &= ~word[1:] | edge[1:n]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, inv = _powers(n + 1)
        prefix = np.zeros(n + 1, U64)
        np.cumsum((low.astype(U64) + U64(1)) * up[:n], out=prefix[1:])
        h = mix64((prefix[end] - prefix[start]) * inv[start])
        bounds = np.searchsorted(start, offsets[i : j + 1] - lo)
        doc = np.repeat(np.arange(j - i), np.diff(bounds))
        yield Words(i, j - i, doc, h, bounds, start, end, low, prefix)


_ROT = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def _sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    acc = np.zeros(len(parts[0]), U64) + U64(len(parts))
    for p in parts:
        acc = (acc ^ p) * U64(_ROT[0])
        acc ^= acc >> U64(29)
    return mix64(acc)


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of the chunk.

    A document with fewer words than ``size`` has its whole sequence as its one
    shingle; one without words has the empty set.
    """
    n = len(w.hash)
    grams = _sequence_hash([w.hash[k : n - size + 1 + k] for k in range(size)]) if n >= size else np.zeros(0, U64)
    for d in range(w.n_docs):
        lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
        if hi - lo >= size:
            g = np.sort(grams[lo : hi - size + 1])
            keep = np.ones(len(g), bool)
            keep[1:] = g[1:] != g[:-1]
            yield g[keep]
        elif hi > lo:
            yield _sequence_hash([w.hash[k : k + 1] for k in range(lo, hi)])
        else:
            yield np.zeros(0, U64)


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Order-sensitive hash of two word hashes; ``salt`` tells feature kinds apart."""
    return mix64(a * U64(_ROT[1]) + (b ^ U64(salt)) * U64(_ROT[2]))
