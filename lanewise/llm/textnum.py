"""Words and shingles as 64-bit hashes, computed over whole Arrow text buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  White space and A-Z are single bytes in
UTF-8, so no decoding is needed.  A word's hash is a polynomial over its bytes, taken from one prefix sum over the
buffer, then mixed; it depends on the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """Tables of powers that grow to the longest chunk seen; create one in each task."""

    def __init__(self):
        codes = np.arange(256)
        self.value = (codes + 1 + 32 * ((codes >= 65) & (codes <= 90))).astype(np.uint64)
        self.space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        self.power = self.inverse = np.ones(0, np.uint64)
        rng = np.random.Generator(np.random.PCG64(20177))
        self.coefficient = rng.integers(1, 1 << 63, SHINGLE_WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            n = 1 << max(16, (n - 1).bit_length())
            self.power, self.inverse = (
                np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]))
                for b in (np.uint64(_BASE), np.uint64(_INVERSE))
            )

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the first word of each text (one more entry than texts).

        data: the texts' bytes one after another.  starts: where each text begins, then the end.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
        self._powers(n + 1)
        solid = ~self.space[data]
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        before = np.empty(n, bool)
        before[0], before[1:] = True, ~solid[:-1]
        first = np.flatnonzero(solid & (before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, ~solid[1:]
        end = np.flatnonzero(solid & (after | edge[1:])) + 1
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.value[data] * self.power[:n], out=total[1:])
        hashed = (total[end] - total[first]) * self.inverse[first]
        return mix(hashed + (end - first).astype(np.uint64)), np.searchsorted(first, starts)

    def shingles(self, data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For each text, the hashes of its five-word shingles in order; of fewer words, one for the whole sequence."""
        words, at = self.words(data, starts)
        m, c = len(words), self.coefficient
        runs = np.zeros(max(0, m - SHINGLE_WORDS + 1), np.uint64)
        for k in range(SHINGLE_WORDS):
            runs += words[k : k + len(runs)] * c[k]
        runs = mix(runs)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= SHINGLE_WORDS:
                out.append(runs[a : b - SHINGLE_WORDS + 1])
            elif b > a:
                parts = np.append(words[a:b] * c[: b - a], c[SHINGLE_WORDS] * np.array([b - a], np.uint64))
                out.append(mix(parts.sum(keepdims=True, dtype=np.uint64)))
            else:
                out.append(runs[:0])
        return out


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) over a string array; a chunk has about `most` bytes, or one longer text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def one_permutation(ordered: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each of 2**bits bins over ascending distinct hashes: (values, filled).  A hash's top bits name its bin."""
    bins = (ordered >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])) if len(bins) else bins
    values, filled = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, bool)
    values[bins[first]], filled[bins[first]] = ordered[first], True
    return values, filled


class Densifier:
    """Optimal densification: an empty bin probes the others in a random order of its own, the same for every text,
    and borrows from the first that is filled.  Each empty bin so draws a filled one independently and uniformly."""

    def __init__(self, bits: int):
        n = 1 << bits
        rng = np.random.Generator(np.random.PCG64(7919 + bits))
        self.probe = np.argsort(rng.random((n, n), np.float32), axis=1).astype(np.int16)
        self.rank = np.empty_like(self.probe)
        np.put_along_axis(self.rank, self.probe, np.arange(n, dtype=np.int16)[None, :], axis=1)

    def fill(self, values: np.ndarray, filled: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(filled)
        if len(full) in (0, len(values)):
            return values
        empty = np.flatnonzero(~filled)
        out = values.copy()
        if len(full) * 8 < len(values):
            out[empty] = values[full[np.argmin(self.rank[np.ix_(empty, full)], axis=1)]]
            return out
        t = 0
        while len(empty):
            target = self.probe[empty, t]
            hit = filled[target]
            out[empty[hit]] = values[target[hit]]
            empty, t = empty[~hit], t + 1
        return out
