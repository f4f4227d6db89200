"""Vectorised text helpers for Arrow batches (numpy only).

Texts arrive as Arrow string columns; the helpers work on their UTF-8 buffers
directly, so no Python string is made for a document.  A null text counts as
an empty one.  Words are maximal runs of bytes other than space and
``\\t \\n \\v \\f \\r``; these bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEGMENT = 1 << 20
#: Bytes of a word from which on it is hashed on its own.
LONG_WORD = 256
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters and digits: of ASCII those alone, and every byte of longer characters.
IS_ALNUM = np.zeros(256, dtype=bool)
IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    table = _powers.get(base)
    if table is None or len(table) <= n:
        size = max(n + 1, SEGMENT + 4096)
        factors = np.full(size, base, dtype=U64)
        factors[0] = 1
        table = np.multiply.accumulate(factors)
        if size <= SEGMENT + 4096:
            _powers[base] = table
    return table


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of data[:i]; H has one entry more than data."""
    terms = BYTE_VALUES[data]
    terms *= powers(_BASE, len(data))[: len(data)]
    out = np.empty(len(data) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hashes of the spans [start, end)."""
    h = prefix[end] - prefix[start]
    h *= powers(_BASE_INVERSE, len(prefix))[start]
    return mix(h ^ mix((end - start).astype(U64)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows in them."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=len(column) + 1, offset=column.offset * 8) if len(column) else np.zeros(1, np.int64)
    base, stop = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(buffers[2], dtype=np.uint8, count=stop - base, offset=base) if stop > base else np.zeros(0, np.uint8)
    return data, offsets - base


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole documents of about ``limit`` bytes."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): eight bytes at a time through ``mix``, all
    spans together; a span of more than ``LONG_WORD`` bytes through a digest."""
    size = end - start
    out = mix(size.astype(U64) + U64(_BASE))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes at each place
    long = size > LONG_WORD
    live = np.flatnonzero((size > 0) & ~long) if long.any() else np.flatnonzero(size > 0)
    done = 0
    while len(live):
        left = size[live] - done
        part = eight[start[live] + done]
        short = left < 8
        part[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
        out[live] = mix((out[live] ^ part) + U64(_BASE))
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(long):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: Row i has the words first[i] .. first[i + 1].
    first: np.ndarray


def words(column: pa.Array, lower: bool = True, table: np.ndarray = IS_WORD, head: int | None = None) -> Words:
    """Byte spans and 64-bit hashes of the words of each row; ``table`` says which
    bytes words are made of, ``head`` cuts words to so many bytes."""
    data, offsets = utf8(column)
    inside = table[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[:-1] = inside
    begins[1:-1] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    ends = np.zeros(len(data) + 1, dtype=bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0]
    ends[lasts] = inside[lasts - 1]
    start, end = np.flatnonzero(begins[:-1]), np.flatnonzero(ends)
    if head:
        end = np.minimum(end, start + head)
    hashes = word_hashes(LOWER[data] if lower else data, start, end)
    return Words(start, end, hashes, np.searchsorted(start, offsets))


def shingle_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one document; a shorter document
    gives one hash of its whole sequence, an empty one none."""
    if not len(w):
        return np.zeros(0, dtype=U64)
    n = min(n, len(w))
    h = mix(w[: len(w) - n + 1] + U64(n))
    for i in range(1, n):
        h = mix(h * U64(31) ^ w[i : len(w) - n + 1 + i])
    return h
