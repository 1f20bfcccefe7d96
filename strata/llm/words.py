"""Vectorised byte-level words and hashes for functions that run inside tasks.

Texts of an Arrow batch are taken as one byte buffer; words, word hashes and
k-gram hashes come from whole-array numpy operations, without a Python object
per word.  ``slices`` keeps the buffer of one step near a megabyte, so memory
depends on the longest single text, not on the partition.

Hashes are 64-bit (prefix sums of random byte values times powers of an odd
number, finished by a multiply-xorshift mix).  They stand for the strings:
two different strings of one corpus collide with probability 2**-64 each pair.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
M1, M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def release() -> None:
    """Give freed memory back: workers are kept between tasks, and so is what their allocators hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * M1
    x ^= x >> U(33)
    x *= M2
    x ^= x >> U(33)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, or of its inverse."""
    key = "inverse" if inverse else "power"
    have = _powers.get(key)
    if have is None or len(have) < n:
        b = pow(BASE, -1, 1 << 64) if inverse else BASE
        size = max(n, 1 << 16)
        x = np.full(size, U(b), np.uint64)
        x[0] = 1
        have = _powers[key] = np.cumprod(x, dtype=np.uint64)
    return have[:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """P with P[b] - P[a] = BASE**a * (polynomial of bytes a..b-1)."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buf] * powers(len(buf)), dtype=np.uint64, out=out[1:])
    return out


def range_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the bytes a..b-1, the same wherever they stand."""
    return mix((sums[b] - sums[a]) * powers(len(sums), inverse=True)[a] + (b - a).astype(np.uint64) * M2)


def as_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer and the texts' offsets in it; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, step: int = 1 << 20):
    """(first, past) runs of texts of about ``step`` bytes, one text at least."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + step, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def table_of(*kept: tuple[int, int]) -> np.ndarray:
    """Truth by byte, for inclusive byte ranges."""
    t = np.zeros(256, bool)
    for a, b in kept:
        t[a : b + 1] = True
    return t


# The two word alphabets, and A-Z to a-z.
NOT_BLANK = ~table_of((0x20, 0x20), (0x09, 0x0D))
ALNUM = ~table_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(buf: np.ndarray, offs: np.ndarray, alphabet: np.ndarray = NOT_BLANK):
    """Starts and ends (exclusive) of the words, and each text's first word's index."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = alphabet[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True  # a text's first byte; words never run across
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = h[:n] * M1
    for j in range(1, k):
        s ^= s >> U(29)
        s = (s + h[j : n + j]) * M2
    return mix(s + U(k))


def shingles(h: np.ndarray, woffs: np.ndarray, k: int):
    """(hash, text index) of each k-word shingle; with fewer words, of the whole sequence."""
    counts = np.diff(woffs)
    g = combine(h, k)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(g)]
    ok = np.arange(len(g)) + k <= woffs[1:][doc] if len(g) else np.zeros(0, bool)
    parts, docs = [g[ok]], [doc[ok]]
    for m in range(1, k):
        d = np.flatnonzero(counts == m)
        if len(d):
            parts.append(combine(h, m)[woffs[d]])
            docs.append(d)
    return np.concatenate(parts), np.concatenate(docs)
