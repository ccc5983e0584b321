"""Words and rolling word hashes of many texts at once, on numpy arrays of bytes.

Used inside Arrow map functions: Spark partitions and shuffles; this turns one slice of a batch into arrays.
A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; these are single bytes in UTF-8, so no
character is ever cut. A word is hashed to two halves of 64 seeded bits each, eight bytes at a time with a mixer
after each step (words of one length up to eight bytes never collide; long words are left to XXH3), and the hash of
a few words in a row is a polynomial of at most 13 terms over theirs, finished by the mixer. No polynomial runs
over bytes, so words whose bytes are arranged to cancel under one do nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_BASE = 0x5851F42D4C957F2D
#: Of each half: the seed, and what a step multiplies with.
_HALVES = ((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25), (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: Words of more bytes are hashed one by one.
_LONG = 64
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which close values become unlike."""
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 2**64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, U(base))
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def byte_hashes(data: bytes, start: np.ndarray, end: np.ndarray, half: int) -> np.ndarray:
    """One of two 64-bit hashes of each range of ``data``, which must end in seven further bytes."""
    seed, odd = map(U, _HALVES[half])
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = end - start
    out = mix(size.astype(U) * odd + seed)
    rest = slice(None)
    for at in range(0, _LONG, 8):
        if at:
            rest = np.flatnonzero((size > at) & (size <= _LONG))
            if not len(rest):
                break
        eight = eights[start[rest] + at] & _FIRST_BYTES[np.minimum(size[rest] - at, 8)]
        out[rest] = mix((out[rest] ^ eight) * odd)
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = xxhash.xxh3_128_digest(data[start[i] : end[i]], _HALVES[0][0])
        out[i] = int.from_bytes(digest[8 * half : 8 * half + 8], "little")
    return out


@dataclass
class Words:
    """The words of some texts: byte ranges in ``data`` and number of the text."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray  # words of text d are bounds[d]:bounds[d + 1]

    @cached_property
    def hash(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end, 0)

    def rolling(self, k: int, second: bool = False) -> np.ndarray:
        """A hash of words i..i+k-1 for each i; those that cross texts are for the caller to leave out.

        ``second``: from the other half of the words' hashes, to verify what the first proposes.
        """
        n = len(self.start)
        if n < k:
            return np.zeros(0, U)
        words = byte_hashes(self.data, self.start, self.end, 1) if second else self.hash
        up, down = _powers(n)
        sums = np.zeros(n + 1, U)
        np.cumsum(words * up, out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])

    def whole(self, k: int) -> np.ndarray:
        """Whether words i..i+k-1 lie in one text, for each i."""
        n = len(self.doc)
        return self.doc[: n - k + 1] == self.doc[k - 1 :] if n >= k else np.zeros(0, bool)

    def span(self, first: int, last: int) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.start[first:last].tolist(), self.end[first:last].tolist())]


def split(texts: list[bytes], lower: bool = False) -> Words:
    """The words of ``texts``; ``lower`` lower-cases A-Z alone."""
    data = b"\n".join(texts) + b"\n" * 8  # a word's last eight bytes can be read at once
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = _LOWER[raw]
        data = raw.tobytes()
    edge = np.diff(_SPACE[raw].view(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    bounds = np.searchsorted(start, starts)
    return Words(data, start, end, np.repeat(np.arange(len(texts)), np.diff(bounds)), bounds)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        if len(x) <= step:
            return x[:0]
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about ``most`` bytes of text each (a longer text stands alone); null is empty."""
    column = batch.column(text).cast(pa.binary())
    texts = [x or b"" for x in column.to_pylist()]
    at = 0
    while at < len(texts):
        size, to = len(texts[at]), at + 1
        while to < len(texts) and size + len(texts[to]) <= most:
            size, to = size + len(texts[to]), to + 1
        yield batch.slice(at, to - at), texts[at:to]
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs, bit for bit."""
    return x.view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
