"""Content-defined chunk boundaries (FastCDC), for whole buffers and streams.

A gear hash runs over the bytes and a chunk ends where its masked bits are 0.
Shifting pushes a byte out after 64 steps and the masks look at bits up to 49
only, so beyond 49 bytes the masked value depends on the place alone.  It is
computed for the whole buffer by doubling array sums; only the first bytes of
each scan, where the hash starts from 0, are stepped through.
"""

from __future__ import annotations

import numpy as np

# Sizes, masks and the seed of the gear table.
MIN, AVERAGE, MAX = 2_048, 8_192, 65_536
MASK_SHORT = 0x0003590703530000
MASK_LONG = 0x0000D90003530000
GEAR_SEED = 0x5A4F56415F464344
CHUNKER = "fastcdc-v1"
REACH = 50  # bytes that masked bits depend on
BITS = 2**64 - 1


def _splitmix(n: int) -> list[int]:
    out, state = [], GEAR_SEED
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & BITS
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & BITS
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & BITS
        out.append(z ^ (z >> 31))
    return out


GEAR = _splitmix(256)
GEAR_ARRAY = np.array(GEAR, dtype=np.uint64)


def boundaries(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of the chunks of ``data``; none for empty data."""
    n = len(data)
    if n <= MIN:
        return [(0, n)] if n else []
    h = GEAR_ARRAY[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < 64:
        h[width:] = h[width:] + (h[:-width] << np.uint64(width))
        width *= 2
    short = np.flatnonzero((h & np.uint64(MASK_SHORT)) == 0)
    long = np.flatnonzero((h & np.uint64(MASK_LONG)) == 0)
    out, start = [], 0
    while start < n:
        end = _cut(data, start, n, short, long)
        out.append((start, end - start))
        start = end
    return out


def _cut(data: bytes, start: int, n: int, short: np.ndarray, long: np.ndarray) -> int:
    if n - start <= MIN:
        return n
    limit, normal = min(n, start + MAX), min(n, start + AVERAGE)
    at = start + MIN
    fp = 0
    for i in range(at, min(at + REACH, limit)):
        fp = ((fp << 1) + GEAR[data[i]]) & BITS
        if not fp & (MASK_SHORT if i < normal else MASK_LONG):
            return i + 1
    at += REACH
    k = int(np.searchsorted(short, at))
    if k < len(short) and short[k] < normal:
        return int(short[k]) + 1
    k = int(np.searchsorted(long, max(at, normal)))
    return int(long[k]) + 1 if k < len(long) and long[k] < limit else limit


class StreamChunker:
    """The same boundaries for data that comes in pieces; holds at most one chunk's bytes and one write."""

    def __init__(self) -> None:
        self.held = bytearray()

    def write(self, data: bytes) -> list[bytes]:
        out = []
        view = memoryview(data)
        while len(view):
            room = MAX - len(self.held)
            self.held += view[:room]
            view = view[room:]
            if len(self.held) == MAX:
                out.append(self._take())
        return out

    def _take(self) -> bytes:
        length = boundaries(bytes(self.held))[0][1]
        chunk = bytes(self.held[:length])
        del self.held[:length]
        return chunk

    def finish(self) -> list[bytes]:
        out = []
        while self.held:
            out.append(self._take())
        return out
