"""Array kernels over Arrow string columns: words, their hashes, window hashes.

A word is a maximal run of ASCII letters, digits and bytes beyond ASCII; callers
lower-case on the JVM side first. Hashes are polynomials mod 2**64 over random
byte values, finished with a bijective mixer, so the cost is a few array passes
a byte and no Python object per document or word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
PIECE = 1 << 20
#: The same words for Spark and DuckDB expressions.
WORD_RE = r"[^\x00-/:-@\[-`{-\x7f]+"

IS_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_lo:_hi] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_P)) * IS_WORD


class _Tables(dict):
    """A cache that is empty again wherever it is sent."""

    def __reduce__(self):
        return type(self), ()


_tables = _Tables()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & (2**64 - 1), dtype=U)
        steps[0] = 1
        have = _tables[base] = np.multiply.accumulate(steps)
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 2**64)


class Texts:
    """Bytes and offsets of a string column; a null is an empty text."""

    def __init__(self, column: pa.Array):
        big = column.cast(pa.large_binary())
        if big.null_count:
            big = big.fill_null(b"")
        n = len(big)
        offsets = np.frombuffer(big.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * big.offset) if n else np.zeros(1, np.int64)
        body = big.buffers()[2]
        raw = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.data, self.offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def slices(self, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about max_bytes together; a longer one is alone."""
        lo = 0
        while lo < len(self):
            hi = int(np.searchsorted(self.offsets, self.offsets[lo] + max_bytes, "right")) - 1
            hi = min(max(hi, lo + 1), len(self))
            yield lo, hi
            lo = hi

    def words(self, lo: int, hi: int) -> Words:
        return Words(self.data[self.offsets[lo] : self.offsets[hi]], self.offsets[lo : hi + 1] - self.offsets[lo])


class Words:
    """starts, ends (bytes), hashes of the words; of[i]:of[i+1] are document i's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, hashes, a, n = [], [], [], 0, len(data)
        while a < n:
            b = self._cut(data, offsets, a, min(a + PIECE, n))
            s, e, h = self._piece(data[a:b], offsets[(offsets > a) & (offsets < b)] - a)
            starts.append(s + a)
            ends.append(e + a)
            hashes.append(h)
            a = b
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.data, self.starts, self.ends, self.hashes = data, join(starts, np.int64), join(ends, np.int64), join(hashes, U)
        self.of = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.of)

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> int:
        """The last place in (a, b] that splits no word, or the first one after b."""
        if b == len(data):
            return b
        k = int(np.searchsorted(offsets, b, "right")) - 1
        edge = int(offsets[k]) if k >= 0 else 0
        gaps = np.flatnonzero(~IS_WORD[data[max(a, b - 4096) : b]])
        if len(gaps):
            edge = max(edge, max(a, b - 4096) + int(gaps[-1]) + 1)
        if edge > a:
            return edge
        later = int(offsets[k + 1]) if k + 1 < len(offsets) else len(data)
        while b < later:
            gaps = np.flatnonzero(~IS_WORD[data[b : b + PIECE]])
            if len(gaps):
                return min(later, b + int(gaps[0]) + 1)
            b += PIECE
        return later

    @staticmethod
    def _piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        word = IS_WORD[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        if len(breaks):
            first[breaks] = word[breaks]
            last[breaks - 1] = word[breaks - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(n + 1, dtype=U)
        np.cumsum(_BYTE[data] * powers(_P, n), out=total[1:])
        h = (total[e] - total[s]) * powers(_inverse(_P), n)[s] if len(s) else np.zeros(0, U)
        return s, e, mix(h)

    def windows(self, size: int) -> np.ndarray:
        """A hash of words i..i+size-1 for each i; those across documents are there too."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, U)
        if size <= 4:
            out = np.zeros(n - size + 1, dtype=U)
            for j in range(size):
                out += self.hashes[j : n - size + 1 + j] * U(pow(_Q, j, 2**64))
            return mix(out)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum(self.hashes * powers(_Q, n), out=total[1:])
        return mix((total[size:] - total[:-size]) * powers(_inverse(_Q), n)[: n - size + 1])

    def window_owner(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of the windows inside one document, and the documents."""
        fits = np.maximum(self.counts - size + 1, 0)
        doc = np.repeat(np.arange(len(fits)), fits)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(fits) - fits, fits) + self.of[doc]
        return at, doc


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: hashing integers of one pattern is slow."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """min(x[i:i+size]) for each i, by doubling."""
    if len(x) < size:
        return x[:0]
    have, out = 1, x
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - size + 1], out[size - have : size - have + len(x) - size + 1])
