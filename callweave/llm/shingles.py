"""Word shingle sets of documents as sorted 64-bit hashes, made for a whole batch at once."""

from __future__ import annotations

import numpy as np

MASK = 2**64 - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values. ``np.unique`` hashes them first, which takes longer for sets of this size."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


_rng = np.random.default_rng(20)
BYTE = _rng.integers(1, MASK, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, A-Z lower-cased, and the number of words of each text."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf = LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    gap = SPACE[buf]
    inside = ~gap
    starts = np.flatnonzero(inside & np.r_[True, gap[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(inside)
    firsts = np.searchsorted(at, starts)
    sizes = np.diff(np.r_[firsts, len(at)])
    place = np.arange(len(at)) - np.repeat(firsts, sizes)
    with np.errstate(over="ignore"):
        hashes = np.add.reduceat(BYTE[buf[at]] * _powers(int(sizes.max()))[place], firsts)
        hashes = _mixed(hashes + sizes.astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.diff(np.r_[0, np.searchsorted(starts, ends)])


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer than ``k`` words has its whole sequence as one shingle, a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    powers = _powers(k + 1, np.uint64(0xD6E8FEB86659FD93))
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for i in range(k):
            whole += hashes[i : i + len(whole)] * powers[i]
        whole = _mixed(whole)
        out = []
        for n, end in zip(counts.tolist(), ends.tolist()):
            if n >= k:
                out.append(distinct(whole[end - n : end - k + 1]))
            elif n:
                part = hashes[end - n : end]
                out.append(_mixed((part * powers[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], n: int, seed: int = 1) -> np.ndarray:
    """MinHash values (len(sets) x n, uint64) of sets that are not empty."""
    rng = np.random.default_rng(seed)
    flips = rng.integers(1, MASK, n, dtype=np.uint64)
    factors = rng.integers(1, MASK, n, dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(sets), n), np.uint64)
    if not sets:
        return out
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    with np.errstate(over="ignore"):
        for i in range(n):
            out[:, i] = np.minimum.reduceat((values ^ flips[i]) * factors[i], starts)
    return out


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    # A stable sort merges what is sorted already.
    values = np.sort(np.concatenate((a, b)), kind="stable")
    both = int(np.count_nonzero(values[1:] == values[:-1]))
    return both, len(a) + len(b) - both
