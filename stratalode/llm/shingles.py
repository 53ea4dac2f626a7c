"""Sets of hashed word shingles and their minwise tokens, by array operations over whole batches.

Words are runs of bytes other than space and U+0009 to U+000D, with A to Z in
lower case.  A text's set holds the 64-bit hashes of its distinct k-word
shingles; with fewer words the whole sequence counts as one; without words the
set is empty.
"""

from __future__ import annotations

import numpy as np

MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLY
    h = (h ^ (h >> np.uint64(29))) * STEP
    return h ^ (h >> np.uint64(32))


_codes = np.arange(256, dtype=np.uint8)
_codes[65:91] += 32
BYTE = mix(_codes.astype(np.uint64) + np.uint64(0x1234567)) | np.uint64(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BYTE[IS_SPACE] = 0
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """STEP ** 0 .. STEP ** (n - 1), modulo 2 ** 64."""
    global _powers
    while len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.r_[_powers, _powers * (_powers[-1] * STEP)]
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and how many each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    space = IS_SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    spans = np.diff(np.r_[starts, len(data)])
    inside = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    values = BYTE[data[starts[0] :]] * powers(int(spans.max()))[inside]
    hashes = mix(np.add.reduceat(values, starts - starts[0]))
    counts = np.diff(np.r_[0, np.searchsorted(starts, np.cumsum(sizes))])
    return hashes, counts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted set of each text."""
    words, counts = word_hashes(texts)
    grams = words[: max(0, len(words) - k + 1)].copy()
    for j in range(1, k):
        grams = grams * STEP + words[j : j + len(grams)]
    grams = mix(grams)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[at : at + n]:
                    h = h * STEP + w
            out.append(mix(np.array([h], dtype=np.uint64)))
        else:
            out.append(words[:0])
        at += n
    return out


def minwise(sets: list[np.ndarray], width: int, seed: int = 7) -> np.ndarray:
    """(sets, width) uint32: the leading bits of the least value of each of ``width`` hash functions."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, width, dtype=np.uint64)
    out = np.full((len(sets), width), 2**64 - 1, dtype=np.uint64)
    for i, s in enumerate(sets):
        for x in range(0, len(s), 2048):
            part = a[:, None] * s[None, x : x + 2048] + b[:, None]
            np.minimum(out[i], part.min(axis=1), out=out[i])
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def set_digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set, the same for equal sets in any order."""
    first = np.array([mix(s ^ MULTIPLY).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    second = np.array([mix(s + STEP).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return first, second
