"""Word shingles of a batch of texts as 64-bit hashes, vectorised over the batch's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import worker_state

WORDS = 5
SLICE_BYTES = 1 << 20   # text taken at a time
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
# A fixed pseudo-random 64-bit value for every byte.
_BYTES = np.random.Generator(np.random.PCG64(12345)).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each (kept by the worker)."""
    kept = worker_state("shingles")
    if len(kept.get("p", ())) < n:
        for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 18), base, np.uint64)
            steps[0] = 1
            kept[key] = np.multiply.accumulate(steps)
    return kept["p"], kept["q"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than [\\x20\\x09-\\x0D]) of all texts, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # some whole words at a time: the sums take eight bytes per byte of text
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        a, b = int(starts[at]), int(ends[stop - 1])
        p, q = _power(b - a + 1)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[data[a:b]] * p[:b - a], out=sums[1:])
        s, e = starts[at:stop] - a, ends[at:stop] - a
        hashes[at:stop] = mix((sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64))
        at = stop
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return hashes, np.diff(np.concatenate(([0], upto)))


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles, the text of each, the number of shingles of each text, and two hashes of its word sequence.

    A shingle is ``words`` neighbouring words; a text with fewer words has one
    shingle, all its words, and a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    first = np.cumsum(counts) - counts
    # Window sums of position-weighted word hashes: the same trick as for bytes, one level up.
    p, q = _power(len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * p[:len(hashes)], out=sums[1:])
    n = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), n)
    begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    stop = np.minimum(begin + words, (first + counts)[owner])
    shingles = mix((sums[stop] - sums[begin]) * q[begin] + (stop - begin).astype(np.uint64))
    whole = (sums[first + counts] - sums[first]) * q[first] + counts.astype(np.uint64)
    other = np.zeros(len(texts), np.uint64)
    some = counts > 0
    if some.any():
        twice = mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)) * p[:len(hashes)]
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(twice)))
        other = (run[first + counts] - run[first]) * q[first]
    return shingles, owner, n, np.stack([mix(whole), mix(other)])


def counted(shingles: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs in order, as shingle, text and count."""
    order = np.lexsort((shingles, owner))
    s, w = shingles[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(new)
    return s[at], w[at], np.diff(np.append(at, len(s)))


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes."""
    if batch.num_rows:
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
