"""Words of Arrow text columns, found and hashed on the UTF-8 bytes with numpy.

Word classes here consist of ASCII separators only, so a byte decides alone whether it belongs to a word. A chunk
holds whole texts of about ``CHUNK_BYTES`` bytes, or one longer text, which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def constants(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt)) | U64(1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A value for each byte, A-Z as a-z.
BYTE_VALUES = constants(256, 7)[LOWER]

_BASE = 0x5851F42D4C957F2D
_kept: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE ** i`` and its inverse modulo 2**64, for i below ``n``; kept for usual lengths."""
    def table(base: int, length: int) -> np.ndarray:
        factors = np.full(length, base, U64)
        factors[0] = 1
        return np.cumprod(factors)

    bases, usual = (_BASE, pow(_BASE, -1, 1 << 64)), 2 * CHUNK_BYTES
    if n > usual:
        return table(bases[0], n), table(bases[1], n)
    if not _kept:
        _kept.extend(table(base, usual) for base in bases)
    return _kept[0][:n], _kept[1][:n]


def ascii_words(inside: str) -> np.ndarray:
    """Byte table: true for the ASCII characters of ``inside`` and for every byte of other characters."""
    table = np.zeros(256, bool)
    table[128:] = True
    table[[ord(c) for c in inside]] = True
    return table


#: Characters other than ASCII white space.
NOT_SPACE = ascii_words("".join(chr(c) for c in range(128) if c != 32 and not 9 <= c <= 13))
#: Letters, digits and everything beyond ASCII.
ALPHANUMERIC = ascii_words("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


@dataclass
class Chunk:
    """Texts ``first`` to ``last`` (exclusive) of a column: bytes of text i are ``data[offsets[i]:offsets[i+1]]``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column into chunks; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Chunk(first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a chunk: byte spans, 64-bit hashes, and the first word of each text (one more entry at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word of each text; words end at the ends of texts."""
    mask = inside[data]
    before = np.zeros(len(data), bool)
    before[1:] = mask[:-1]
    edges = offsets[:-1]
    edges = edges[edges < len(data)]
    before[edges] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = mask[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class SpanHashes:
    """Hash of any byte span (polynomial over the bytes, then mixed), by differences of one running sum."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(values[data] * up[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    return SpanHashes(data, values)(starts, ends)


def words(chunk: Chunk, inside: np.ndarray) -> Words:
    starts, ends, firsts = spans(chunk.data, chunk.offsets, inside)
    return Words(starts, ends, span_hashes(chunk.data, starts, ends), firsts)


def per_text(values: np.ndarray, firsts: np.ndarray, ufunc: np.ufunc = np.add, empty: float = 0) -> np.ndarray:
    """Reduce the values of each text; texts without any get ``empty``."""
    out = np.full(len(firsts) - 1, empty, values.dtype)
    full = np.flatnonzero(firsts[1:] > firsts[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, firsts[:-1][full])
    return out


def owners(firsts: np.ndarray) -> np.ndarray:
    """For each word the number of its text within the chunk."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
