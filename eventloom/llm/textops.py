"""Vectorised text steps on Arrow batches: word and shingle hashes without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the hashes, and their seeds.
BASE = 0x9E3779B97F4A7C15
WORD_SEPARATORS = np.zeros(256, bool)
WORD_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BATCH_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, BATCH_BYTES + (1 << 16))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up, self.down


POWERS = Powers()


def batches(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about so many bytes: (index of the first, their bytes, offsets); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n, at = len(texts), texts.offset
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P and inverse powers: (P[e] - P[s]) * down[s] is a hash of data[s:e] that does not depend on s."""
    up, down = POWERS.upto(len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=p[1:])
    return p, down


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = WORD_SEPARATORS[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(~gap[1:-1] & (gap[:-2] | cut[:-1]))
    ends = np.flatnonzero(~gap[1:-1] & (gap[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, down = prefix_hash(data)
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, not yet distinct, and each text's offset in them.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    n, count = len(hashes), np.diff(first)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        rolled = rolled * np.uint64(BASE) + hashes[j : j + len(rolled)]
    sizes = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(first[:-1], sizes)
    out = np.zeros(offsets[-1], np.uint64)
    whole = np.repeat(count >= k, sizes)
    out[whole] = rolled[at[whole]]
    for i in np.flatnonzero((count > 0) & (count < k)):
        x = int(count[i])
        for h in hashes[first[i] : first[i + 1]].tolist():
            x = (x * BASE + h) & 0xFFFFFFFFFFFFFFFF
        out[offsets[i]] = x
    return mix(out), offsets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes, of words in lower case (A-Z only)."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    sh, at = shingles(word_hashes(data, starts, ends), first, k)
    return [np.unique(sh[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
