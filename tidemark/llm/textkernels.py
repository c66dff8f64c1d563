"""Vectorised text kernels on UTF-8 buffers: words, rolling hashes and shingles without Python strings.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. All hashes are
64-bit, depend on bytes only and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but ASCII letters and digits and non-ASCII characters, for words without punctuation.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    PUNCTUATION[_a:_b] = False


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is much faster here than NumPy's hash table."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length n+1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``limit`` bytes each, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and the index of each row's first word (length n+1); ``breaks`` flags separating bytes."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~breaks[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span after lower-casing A-Z; equal spans at any place hash alike.

    Every eight bytes are mixed by themselves with their place before they are summed, so no arithmetic pattern of the text (a
    polynomial of its bytes modulo a power of two, say) makes unlike spans alike.
    """
    if len(starts) == 0:
        return np.zeros(0, U64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data]
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix64((eights[starts] & _FIRST[np.minimum(size, 8)]) ^ U64(_MULT))
    long = np.flatnonzero(size > 8)
    if len(long):
        pieces = (size[long] - 1) // 8
        first = np.cumsum(pieces) - pieces
        place = np.arange(int(pieces.sum())) - np.repeat(first, pieces) + 1
        left = np.repeat(size[long], pieces) - 8 * place
        value = eights[np.repeat(starts[long], pieces) + 8 * place] & _FIRST[np.minimum(left, 8)]
        out[long] += np.add.reduceat(mix64(value ^ ((place + 1).astype(U64) * U64(_MULT))), first)
    return mix64(out + size.astype(U64) * U64(_MULT))


def window_hashes(words: np.ndarray, row_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` words inside a row: hashes, index of first word, row bounds (n+1)."""
    counts = np.maximum(np.diff(row_words) - width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = int(bounds[-1])
    at = np.arange(total) - np.repeat(bounds[:-1] - row_words[:-1], counts)
    if total == 0:
        return np.zeros(0, U64), at, bounds
    full = np.zeros(max(len(words) - width + 1, 0), U64)
    for k in range(width):
        full += words[k : k + len(full)] * mix64(np.array([7919 + k], U64))[0]
    return mix64(full[at]), at, bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and row bounds (n+1).

    A row of fewer than ``width`` words has its whole word sequence as its one shingle; a row without words has none.
    """
    starts, ends, row_words = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    grams, _, bounds = window_hashes(words, row_words, width)
    counts = np.diff(row_words)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        one = np.zeros(len(short), U64)
        for k in range(width - 1):
            has = counts[short] > k
            one[has] += words[row_words[short[has]] + k] * mix64(np.array([104729 + k], U64))[0]
        one = mix64(one + counts[short].astype(U64))
        grams = np.insert(grams, bounds[short], one)
        bounds = bounds + np.concatenate([[0], np.cumsum((counts > 0) & (counts < width))])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        grams[a:b].sort()
    if not len(grams):
        return grams, bounds
    keep = np.ones(len(grams), bool)
    keep[1:] = grams[1:] != grams[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return grams[keep], kept[bounds]


def vocabulary(data: np.ndarray, offsets: np.ndarray):
    """Distinct words of a buffer: their hashes (ascending), bytes (starts, ends), the id of every word, row bounds."""
    starts, ends, row_words = word_bounds(data, offsets)
    hashes, first, ids = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return hashes, starts[first], ends[first], ids.reshape(-1), row_words


def word_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of the words, A-Z lower-cased, each preceded by one space, and a last space."""
    sizes = ends - starts + 1
    out = np.full(int(sizes.sum()) + 1, 32, np.uint8)
    at = np.cumsum(sizes) - sizes + 1
    total = int((sizes - 1).sum())
    inner = np.arange(total) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1)
    out[np.repeat(at, sizes - 1) + inner] = _LOWER[data[np.repeat(starts, sizes - 1) + inner]]
    text = out.tobytes().decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def char_grams(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character n-grams of the words of ``word_points`` (their borders as spaces): hashes, word numbers, start positions."""
    space = points == 32
    spaces = np.flatnonzero(space)
    count = len(points) - n + 1
    if count <= 0 or len(spaces) < 2:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.cumsum(space)[:count] - 1
    at = np.arange(count)
    ok = (word < len(spaces) - 1) & (at + n - 1 <= spaces[np.minimum(word + 1, len(spaces) - 1)])
    if n == 1:
        ok &= ~space[:count]
    at = at[ok]
    h = np.full(len(at), U64(n))
    for k in range(n):
        h = h * U64(_MULT) + points[at + k].astype(U64)
    return mix64(h), word[ok], at
