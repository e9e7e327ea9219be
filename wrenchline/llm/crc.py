"""CRC-32 of words and word runs of a chunk, by numpy on whole arrays.

The checksum of a longer string follows from those of its parts: crc(a + b) = advance(crc(a), bytes of b) ^ crc(b), where
``advance`` is a linear map that depends on the number of bytes only and is kept as four tables of 256 entries.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Words up to so many bytes are summed byte by byte over all words at once, longer ones one by one.
LONGEST = 64


def _one_byte() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


ONE_BYTE = _one_byte()


def _through(table: np.ndarray, at: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    """Apply the linear map whose four tables lie at ``at`` in ``table``."""
    crc = crc.astype(np.int64)
    return (table[at + (crc & 255)] ^ table[at + 256 + ((crc >> 8) & 255)]
            ^ table[at + 512 + ((crc >> 16) & 255)] ^ table[at + 768 + (crc >> 24)])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables of ``advance`` by 0 to 63 bytes, and by 64, 128, 256, ... bytes, one after the other."""
    unit = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).reshape(-1)
    short = [unit]
    for _ in range(LONGEST):
        short.append(ONE_BYTE[short[-1] & 255] ^ (short[-1] >> 8))
    doubled = [short.pop()]
    for _ in range(40):
        doubled.append(_through(doubled[-1], 0, doubled[-1]))
    return np.concatenate(short), np.concatenate(doubled)


SHORT, DOUBLED = _tables()


def advance(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums as changed by ``n`` bytes that follow, before those bytes' own checksum is added."""
    out = _through(SHORT, (n & 63) << 10, crc)
    rest, step = n >> 6, 0
    long = np.flatnonzero(rest)
    while len(long):
        odd = long[(rest[long] & 1) == 1]
        out[odd] = _through(DOUBLED, step << 10, out[odd])
        rest[long] >>= 1
        long, step = long[rest[long] > 0], step + 1
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span of ``data``."""
    sizes = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    alive = np.flatnonzero((sizes > 0) & (sizes <= LONGEST))
    k = 0
    while len(alive):
        crc[alive] = ONE_BYTE[(crc[alive] ^ data[starts[alive] + k]) & 255] ^ (crc[alive] >> 8)
        k += 1
        alive = alive[sizes[alive] > k]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        crc[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes())
    return crc


def run_crcs(crcs: np.ndarray, sizes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For 1 to ``longest`` words: the CRC-32 of the run of that many words from each word on, joined by one space.

    Runs that cross the end of a text are included; the caller knows where texts end.
    """
    blank = np.full(len(crcs), zlib.crc32(b" "), np.uint32)
    led = advance(blank, sizes) ^ crcs  # a space and the word
    runs = [crcs]
    for k in range(1, longest):
        more = max(0, len(crcs) - k)
        runs.append(advance(runs[-1][:more], sizes[k:] + 1) ^ led[k:])
    return runs
