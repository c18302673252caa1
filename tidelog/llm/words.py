"""Words of UTF-8 text columns as 64-bit hashes, computed on whole Arrow buffers.

A word is a run of bytes outside space and 0x09-0x0D, with A-Z lower-cased; in
UTF-8 these bytes never occur inside a longer character, so bytes and characters
give the same words. Word hashes are a polynomial in the bytes modulo 2**64,
finished by a mixing step; the same word has the same hash in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20  # text handled at once; longer texts pass in windows cut at white space

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PLAIN = _SPACE.copy()  # blanks and ASCII punctuation, for comparisons that ignore punctuation
PLAIN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[_LOWER]  # value of each raw byte, lower-cased
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, size: int) -> np.ndarray:
    if len(_powers[name]) < size:
        factor = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(size, CHUNK_BYTES + 1), factor, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:size]


def _window_words(data: np.ndarray, edges: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of ``data`` and, for each edge, the number of words that start before it."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    space = np.frombuffer(data.tobytes().translate(blanks.tobytes()), bool)
    rim = np.empty(len(data) + 1, bool)  # a text or a blank ends before this byte
    rim[1:] = space
    rim[edges] = True
    rim[0] = rim[-1] = True
    starts = np.flatnonzero(rim[:-1] > space)
    rim[:-1] = space  # a text or a blank begins at this byte
    rim[edges] = True
    rim[0] = rim[-1] = True
    ends = np.flatnonzero(rim[1:] > space) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.take(_BYTE, data, out=sums[1:], mode="clip")
    sums[1:] *= _power("up", len(data))
    np.cumsum(sums, out=sums)
    raw = (sums[ends] - sums[starts]) * _power("down", len(data))[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * _M2)), np.searchsorted(starts, edges)


def _long_words(data: np.ndarray, blanks: np.ndarray) -> np.ndarray:
    """Words of one text of any length, in windows that end at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        if end < len(data):
            blank = np.flatnonzero(blanks[data[at:end]])
            while not len(blank) and end < len(data):  # a word longer than the window
                end = min(len(data), end + CHUNK_BYTES)
                blank = np.flatnonzero(blanks[data[at:end]])
            if end < len(data):
                end = at + int(blank[-1]) + 1
        piece = data[at:end]
        parts.append(_window_words(piece, np.array([0, len(piece)]), blanks)[0])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offset of each text; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, blanks: np.ndarray = _SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after last, word hashes, word offsets per row) for runs of rows of at most ``limit`` bytes.

    A text above the limit comes alone.
    """
    data, offsets = text_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, len(column))
        piece = data[offsets[low]:offsets[high]]
        if high == low + 1 and len(piece) > CHUNK_BYTES:
            words = _long_words(piece, blanks)
            yield low, high, words, np.array([0, len(words)])
        elif len(piece) > CHUNK_BYTES:
            parts = [_long_words(data[offsets[i]:offsets[i + 1]], blanks) for i in range(low, high)]
            yield low, high, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        else:
            yield low, high, *_window_words(piece, offsets[low:high + 1] - offsets[low], blanks)
        low = high


def shingles(words: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row and their offsets.

    A row of one to k-1 words has one shingle, the whole sequence; a row without words has none.
    """
    count = np.diff(offsets)
    sizes = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], np.uint64)
    rows = np.repeat(np.arange(len(count)), sizes)
    first = offsets[:-1][rows] + (np.arange(at[-1]) - at[:-1][rows])
    span = np.minimum(count, k)[rows]
    for n in range(1, k):
        chosen = first[span == n]
        value = np.full(len(chosen), n, np.uint64)
        for j in range(n):
            value = mix(value * _M1 + words[chosen + j])
        out[span == n] = value
    windows = max(0, len(words) - k + 1)  # k words in a row, a few of them of two texts
    value = np.full(windows, k, np.uint64)
    for j in range(k):
        value *= _M1
        value += words[j:j + windows]
        value = mix(value)
    out[span == k] = value[first[span == k]]
    for i in np.flatnonzero(sizes > 1):
        out[at[i]:at[i + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[at]
