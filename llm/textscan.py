"""Vectorised scanning of text columns: byte buffers, word boundaries, identifiers of words and windows.

Everything works on whole Arrow batches with numpy, so Python never loops over
characters or words.  Identifiers are 64-bit and the same in every process and on
every run.  A word's is made of its bytes, eight at a time, each eight mixed with
its place; a window's by doubling: that of 2q codes from those of the q codes at
both its offsets.  Neither is a polynomial, so no pattern of letters or words
makes two of them meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Space and the five control characters that separate words: \x20 and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that are no part of a word of letters and digits; bytes from 0x80 on are.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: spreads every input bit over the result."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_PAIR = ((U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)), (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)))


def pair(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """An identifier of two identifiers in order; lanes are independent of one another."""
    first, second = _PAIR[lane]
    x = a * first
    x += b
    y = x >> U64(32)
    x ^= y
    x *= second
    np.right_shift(x, U64(29), out=y)
    x ^= y
    return x


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number, zeros behind the end: an unaligned view of a copy."""
    held = np.zeros(len(raw) + 8, np.uint8)
    held[: len(raw)] = raw
    return np.ndarray((len(raw),), "<u8", held, strides=(1,))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row begins (one more entry at the end).  Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        wide = np.int32
    else:
        wide = np.int64
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def pieces(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut rows into consecutive runs of about `most` bytes; a longer row stands alone."""
    first, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def words(raw: np.ndarray, at: np.ndarray, apart: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each row's first word (one more at the end)."""
    inside = ~apart[raw]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    begins = at[:-1][at[:-1] < len(raw)]
    before[begins] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(raw):
        after[:-1] = inside[1:]
        after[-1] = False
        after[begins[begins > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at)


_SHORT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
_SIZE, _PLACE = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (not empty); lanes are independent of one another."""
    wide, size, factor = eights(raw), end - start, _PAIR[lane][0]
    out = mix((wide[start] & _SHORT[np.minimum(size, 8)]) * factor + size.astype(U64) * _SIZE)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8  # further eights
        begin = np.cumsum(more) - more
        nth = np.arange(1, int(more.sum()) + 1) - np.repeat(begin, more)
        at = np.repeat(start[long], more) + 8 * nth
        rest = (wide[at] & _SHORT[np.minimum(np.repeat(end[long], more) - at, 8)]) * factor + nth.astype(U64) * _PLACE
        out[long] = mix(out[long] * factor + np.add.reduceat(mix(rest), begin))
    return out


def windows(codes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """An identifier of every k consecutive codes, by doubling; position i covers codes i to i + k - 1."""
    n = len(codes)
    if n < k:
        return np.zeros(0, U64)
    held, size = codes, 1
    while size * 2 <= k:
        held = pair(held[:-size], held[size:], lane)
        size *= 2
    return held if size == k else pair(held[: n - k + 1], held[k - size : n - size + 1], lane)


def inside_rows(first: np.ndarray, k: int) -> np.ndarray:
    """Which k-code windows lie within one row: a mask over all window positions of the batch."""
    n = int(first[-1])
    ok = np.ones(max(n - k + 1, 0), bool)
    for back in range(1, k):
        cut = first[1:-1] - back
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok
