"""Maximal periodic runs of words by an enhanced suffix array and the branching-tandem test.

The words of many texts form one flat array; a symbol is a word of one text, so suffixes of different
texts never share a prefix. A pair (i, i + d) whose longest common prefix is exactly d is a branching
square: it ends where a run of period d ends. Such a pair is split at exactly one place of the LCP
array, in the interval of depth d around it. For every place the suffixes of the smaller side are
looked at, and the inverse suffix array tells whether suffix i + d or i - d lies on the other side.
Rotating the square to the left as far as the words agree gives the whole run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import _SPACE, text_bytes

MIN_LENGTH, MIN_EXPONENT = 6, 4
CHUNK_BYTES = 2 << 20  # text handled at once; a longer text comes alone
RUN_TYPE = "array<struct<start:long,length:long,period:long>>"


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then the same from starts[1] and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact word numbers, word offsets per text, the bytes of all words without blanks, and byte offsets per word."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = ~space & (np.concatenate([[True], space[:-1]]) | edge[:-1])
    starts = np.flatnonzero(first[~space])
    plain = data[~space]
    upto = np.append(starts, len(plain))
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(plain)])
    number = words.dictionary_encode().indices.to_numpy() if len(starts) else np.empty(0, np.int32)
    return number, np.concatenate([[0], np.cumsum(first)])[offsets], plain, upto


def suffix_order(symbol: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and the ranks by the first 1, 2, 4, ... symbols.

    ``stop`` is the end of the text of each place; a suffix ends there. Doubling goes on with the
    suffixes that still share their rank.
    """
    n = len(symbol)
    order = np.argsort(symbol, kind="stable").astype(np.int32)
    head = np.concatenate([[True], symbol[order[1:]] != symbol[order[:-1]]])
    first = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0)).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = first
    levels, size = [rank], 1
    tail = np.concatenate([head[1:], [True]])
    place = np.flatnonzero(~(head & tail))  # places of the order whose suffix shares its rank
    while len(place):
        some = order[place]
        then = some + size
        inside = then < stop[some]
        second = np.where(inside, rank[np.minimum(then, n - 1)], -1)
        key = rank[some].astype(np.int64) * (n + 1) + second + 1
        sort = np.argsort(key, kind="stable")
        key, some = key[sort], some[sort]
        order[place] = some  # groups keep their places, so the sorted ones fall into the same slots
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[some] = np.maximum.accumulate(np.where(fresh, place, 0))
        levels.append(rank)
        place = place[~(fresh & np.concatenate([fresh[1:], [True]]))]
        size *= 2
    return order, rank, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], stop: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix and the one before it in the order (0 for the first)."""
    n = len(order)
    lcp = np.zeros(n, np.int32)
    base = levels[0][order]
    k = np.flatnonzero(base[1:] == base[:-1]) + 1
    a, b = order[k - 1].astype(np.int64), order[k].astype(np.int64)
    ends_a, ends_b, length = stop[a], stop[b], np.zeros(len(k), np.int64)
    for h in range(len(levels) - 1, -1, -1):
        live = np.flatnonzero((a + length < ends_a) & (b + length < ends_b))
        equal = live[levels[h][a[live] + length[live]] == levels[h][b[live] + length[live]]]
        length[equal] += 1 << h
    lcp[k] = length
    return lcp


def _reach(lcp: np.ndarray, k: np.ndarray, step: int) -> np.ndarray:
    """How far the entries beside k, in one direction, are not below lcp[k] (to the left: above it)."""
    tables = [lcp]
    while 1 << len(tables) <= len(lcp) and tables[-1].any():
        half, last = 1 << (len(tables) - 1), tables[-1]
        tables.append(np.minimum(last[:-half], last[half:]))
    at, value, count = k.copy(), lcp[k], np.zeros(len(k), np.int64)
    for h in range(len(tables) - 1, -1, -1):
        low = at + 1 if step > 0 else at - (1 << h)
        fits = np.flatnonzero((low >= 0) & (low < len(tables[h])))
        least = tables[h][low[fits]]
        on = fits[least >= value[fits] if step > 0 else least > value[fits]]
        at[on] += step << h
        count[on] += 1 << h
    return count


def branching_squares(order: np.ndarray, inverse: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, d) of all pairs i, i + d whose common prefix is exactly d."""
    k = np.flatnonzero(lcp > 0)
    left, right = _reach(lcp, k, -1) + 1, _reach(lcp, k, 1) + 1  # suffixes on either side of place k
    small_left = left <= right
    size = np.where(small_left, left, right)
    suffix = order[ranges(np.where(small_left, k - left, k), size)].astype(np.int64)
    d = np.repeat(lcp[k], size).astype(np.int64)
    low, high = np.where(small_left, k, k - left), np.where(small_left, k + right, k)  # the other side
    found = []
    for sign in (1, -1):
        other = suffix + sign * d
        fits = np.flatnonzero((other >= 0) & (other < len(order)))
        owner = np.repeat(np.arange(len(k)), size)[fits]
        place = inverse[other[fits]]
        good = fits[(place >= low[owner]) & (place < high[owner])]
        found.append((suffix[good] if sign > 0 else other[good], d[good]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _rotate_left(symbol: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Smallest starts that keep the period, found by stretches that double while they agree and halve when not."""
    start, step = start.copy(), np.ones(len(start), np.int64)
    live = np.arange(len(start))
    shrinking = np.zeros(len(start), bool)
    while len(live):
        size = np.minimum(step[live], start[live])
        live, size = live[size > 0], size[size > 0]
        if not len(live):
            break
        at = ranges(start[live] - size, size)
        equal = symbol[at] == symbol[at + np.repeat(period[live], size)]
        whole = np.minimum.reduceat(equal, np.cumsum(size) - size)
        start[live[whole]] -= size[whole]
        shrinking[live] |= ~whole
        step[live] = np.where(shrinking[live], size // 2, size * 2)
        live = live[step[live] > 0]
    return start


def find_runs(symbol: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of the runs of all texts, by start and then period; places are flat.

    A symbol must belong to one text only.
    """
    none = np.empty(0, np.int64)
    if not len(symbol):
        return none, none, none
    stop = np.repeat(offsets[1:], np.diff(offsets))
    order, inverse, levels = suffix_order(symbol, stop)
    lcp = common_prefixes(order, levels, stop)
    del levels
    at, period = branching_squares(order, inverse, lcp)
    end = at + 2 * period
    sort = np.lexsort((period, end))
    end, period = end[sort], period[sort]
    starts, periods, ends = [none], [none], [none]
    # per end the smallest period first: what is a multiple of it inside its run is no period of its own
    while len(end):
        fresh = np.concatenate([[True], end[1:] != end[:-1]])
        e, q = end[fresh], period[fresh]
        s = _rotate_left(symbol, e - 2 * q, q)
        starts.append(s)
        periods.append(q)
        ends.append(e)
        group = np.cumsum(fresh) - 1
        part = (period % q[group] == 0) & (2 * period <= (e - s)[group])
        end, period = end[~part], period[~part]
    start, period, end = np.concatenate(starts), np.concatenate(periods), np.concatenate(ends)
    length = end - start
    good = (length >= min_length) & (length >= min_exponent * period)
    start, length, period = start[good], length[good], period[good]
    sort = np.lexsort((period, start))
    return start[sort], length[sort], period[sort]


def _chunk(texts: pa.Array, min_length: int, min_exponent: int) -> pa.StructArray:
    data, offsets = text_bytes(texts)
    number, edges, plain, upto = word_symbols(data, offsets)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(edges))
    start, length, period = find_runs(text * (int(number.max(initial=0)) + 1) + number, edges, min_length, min_exponent)
    of = text[start] if len(start) else np.empty(0, np.int64)
    runs = pa.StructArray.from_arrays([pa.array(start - edges[of]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), runs)
    # kept words, each with a blank behind it except the last one of its text
    change = np.zeros(len(number) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    size = np.diff(upto)[kept]
    some = text[kept]
    last = np.concatenate([some[1:] != some[:-1], [True]]) if len(some) else np.empty(0, bool)
    wide = size + ~last
    out = np.full(wide.sum(), 0x20, np.uint8)
    at = np.cumsum(wide) - wide
    out[ranges(at, size)] = plain[ranges(upto[:-1][kept], size)]
    ends = np.concatenate([[0], np.cumsum(np.bincount(some, weights=wide, minlength=len(texts)).astype(np.int64))])
    rest = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
    return pa.StructArray.from_arrays([pa.array(np.diff(edges)), listed, rest], names=["n_words", "runs", "collapsed"])


def periodic_runs(df: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, name: str = "periodic") -> DataFrame:
    """All columns of ``df`` and a struct ``name`` (replaced if there): n_words, runs, collapsed.

    Words are runs of characters outside space and 0x09-0x0D, numbered from 0. ``runs`` holds the
    maximal stretches whose smallest period q is repeated: at least ``min_length`` words and at least
    ``min_exponent`` (2 or more) times q, by start, then period. ``collapsed`` is the text without the
    words that any run holds after its first q words, joined by one space. Null and empty texts, and
    texts of blanks, have no words, no runs and an empty text. Texts are taken whole, one task works on
    many at once; memory grows with the longest text (about 200 bytes a word). Map only. An empty table
    gives an empty table.
    """
    if min_exponent < 2:
        raise ValueError("a run holds its period at least twice")

    @F.arrow_udf(f"struct<n_words:long,runs:{RUN_TYPE},collapsed:string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            offsets, low, parts = text_bytes(texts)[1], 0, []
            while low < len(texts):
                high = min(len(texts), max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1))
                parts.append(_chunk(texts.slice(low, high - low), min_length, min_exponent))
                low = high
            yield pa.concat_arrays(parts) if parts else _chunk(texts, min_length, min_exponent)

    return df.select(*[c for c in df.columns if c != name], find(F.col(text_col).cast("string")).alias(name))
