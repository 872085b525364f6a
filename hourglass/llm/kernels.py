"""Vectorised word hashing inside tasks: texts to 64-bit words and word windows.

Words are runs of bytes other than the six ASCII white-space characters, as
``bytes.split()`` cuts them. All results depend on the bytes alone, so every
executor and every retry computes the same values. Work is done in slices of
about a megabyte, so memory follows the slice, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64)."""
    x = x + _C1
    x = (x ^ (x >> _S30)) * _C2
    x = (x ^ (x >> _S27)) * _C3
    return x ^ (x >> _S31)


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An ordered pair of hashes as one."""
    return mix(left * _C3 + right)


def byte_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def _hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per run [start, end) of bytes: the sum of mixed (place, byte) pairs."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    at = np.repeat(starts, sizes) + place
    return mix(np.add.reduceat(mix((place.astype(np.uint64) << np.uint64(8)) | data[at].astype(np.uint64)), firsts))


def hash_words(data: bytes) -> np.ndarray:
    """The hash of every word of one byte string, in order."""
    whole = np.frombuffer(data, np.uint8)
    if len(whole) <= SLICE_BYTES:
        return _hash_runs(whole, *byte_words(whole))
    starts, ends = byte_words(whole)
    cuts = np.searchsorted(starts, np.arange(0, len(whole) + SLICE_BYTES, SLICE_BYTES))
    return np.concatenate([_hash_runs(whole, starts[a:b], ends[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes together, one text at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def hash_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end)."""
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    for a, b in slices([len(t) for t in texts]):
        joined = b" ".join(texts[a:b])
        hashes.append(hash_words(joined))
        data = np.frombuffer(joined, np.uint8)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        starts = byte_words(data)[0]
        counts[a + 1:b + 1] = np.diff(np.searchsorted(starts, offsets))
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.cumsum(counts)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` consecutive words, by doubling."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, out, done = words, 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, done = power[:n], size
            else:
                out, done = combine(out, power[done:done + n]), done + size
        if done == width:
            return out if width > 1 else mix(out)
        power = combine(power[:-size], power[size:])
        size *= 2


def text_windows(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows over the words of several texts laid end to end, those inside one text:
    (first word of each, its text)."""
    n = np.maximum(np.diff(starts) - width + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(starts[:-1], n), text
