"""Substring dedup: repeated runs of consecutive sentences are kept at their first place only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .words import _BYTE, _LOWER, _M2, _SPACE, CHUNK_BYTES, _power, mix, text_bytes

SENTENCES, WORDS = 2, 12  # a run touches so many sentences and has so many words, or has twice the words
MARK = 8                  # sentences are cut into pieces after words whose sum of bytes is a multiple of this
HOT_PARTS = 512           # a run with more than this share of all runs is joined by broadcast; there are fewer of these

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


@dataclass
class Pieces:
    """Pieces of the sentences of some texts: bytes, words, first word of each piece, and offsets per text."""

    data: np.ndarray
    offsets: np.ndarray   # bytes of each text
    starts: np.ndarray    # first byte of each word
    hashes: np.ndarray    # of each word
    stops: np.ndarray     # whether a sentence ends with the word
    first: np.ndarray     # first word of each piece, and the number of words
    at: np.ndarray        # pieces of each text

    def bounds(self, text: int) -> np.ndarray:
        """First byte of each piece of a text, and its end; blanks before the first word belong to the first piece."""
        inner = self.starts[self.first[self.at[text]:self.at[text + 1]]]
        return np.concatenate([self.offsets[text:text + 1], inner[1:], self.offsets[text + 1:text + 2]])


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, hash and byte sum of each word; no word spans an edge."""
    space = _SPACE[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = space[:-1]
    new[edges] = True
    starts = np.flatnonzero(~space & new[:-1])
    new[1:-1] = space[1:]
    new[edges] = True
    ends = np.flatnonzero(~space & new[1:]) + 1
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LOWER[data], dtype=np.int64, out=sums[1:])
    raw = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=raw[1:])
    value = (raw[ends] - raw[starts]) * _power("down", len(data))[starts]
    return starts, ends, mix(value ^ (ends - starts).astype(np.uint64) * _M2), sums[ends] - sums[starts]


def _windows(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of one text of at least CHUNK_BYTES that end after white space; a longer word makes its part longer."""
    low = 0
    while low < len(data):
        high = low
        blank = np.empty(0, np.int64)
        while not len(blank) and high < len(data):
            blank = np.flatnonzero(_SPACE[data[high:high + CHUNK_BYTES]]) + high
            high = min(len(data), high + CHUNK_BYTES)
        if high < len(data):
            high = int(blank[-1]) + 1
        yield low, high
        low = high


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """Sentences end after . ! or ? and before a line break; pieces also after a word whose byte sum (A-Z lowered) MARK divides."""
    if len(data) > CHUNK_BYTES and len(offsets) == 2:
        parts = []
        for low, high in _windows(data):
            starts, ends, hashes, sums = _words(data[low:high], np.array([0, high - low]))
            parts.append((starts + low, ends + low, hashes, sums))
        starts, ends, hashes, sums = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        starts, ends, hashes, sums = _words(data, offsets)
    words_at = np.searchsorted(starts, offsets)
    breaks = np.flatnonzero(data == 10)
    after = np.append(starts[1:], len(data))[:len(starts)]
    stops = _STOP[data[ends - 1]] | (np.searchsorted(breaks, after) > np.searchsorted(breaks, ends))
    closes = stops | (sums % MARK == 0)
    closes[words_at[1:][words_at[1:] > words_at[:-1]] - 1] = True
    opens = np.ones(len(starts), bool)
    opens[1:] = closes[:-1]
    first = np.flatnonzero(opens)
    return Pieces(data, offsets, starts, hashes, stops, np.append(first, len(starts)), np.searchsorted(first, words_at))


def split_texts(column: pa.Array) -> Iterator[tuple[int, Pieces]]:
    """(first row, sentences) for rows of at most CHUNK_BYTES together; a longer text comes alone. Null is empty."""
    data, offsets = text_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
        yield low, _pieces(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        low = high


def find_runs(p: Pieces, least: int = SENTENCES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first piece in it, pieces and hash of the shortest runs from each piece on and up to each piece.

    Whatever longer span two places share is covered by these: a piece of it lies in the first run from the
    span's start, or else the pieces before it are enough for a run up to it. Equal hashes mean equal words
    with the same sentence ends between them; how the last one ends does not count.
    """
    n = len(p.first) - 1
    text = np.repeat(np.arange(len(p.at) - 1), np.diff(p.at))
    here = np.arange(n)
    ended = np.zeros(n + 1, np.int64)  # sentence ends before each piece
    np.cumsum(p.stops[p.first[1:] - 1], out=ended[1:])

    def reach(k):
        return np.searchsorted(p.first, p.first[:-1] + k), np.searchsorted(p.first, p.first[1:] - k, "right") - 1

    (some, some_back), (many, many_back) = reach(words), reach(2 * words)
    end = np.minimum(many, np.maximum(some, np.searchsorted(ended, ended[:-1] + least - 1) + 1))
    forward = end <= p.at[text + 1]
    begin = np.maximum(many_back, np.minimum(some_back, np.searchsorted(ended, ended[:-1] - (least - 1), "right") - 1))
    begin = np.minimum(begin, here)
    back = begin >= p.at[text]
    back &= ~(back & forward[begin] & (end[begin] == here + 1))  # found from its start already
    low, high = np.concatenate([here[forward], begin[back]]), np.concatenate([end[forward], here[back] + 1])
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    a, b = p.first[low], p.first[high]
    total = np.zeros(len(p.hashes) + 1, np.uint64)
    np.cumsum(mix(p.hashes + p.stops.astype(np.uint64)) * _power("up", len(p.hashes)), out=total[1:])
    value = (total[b - 1] - total[a]) * _power("down", len(p.hashes) + 1)[a] ^ (b - a).astype(np.uint64) * _M2
    return text[low], low - p.at[text[low]], high - low, mix(mix(value) ^ p.hashes[b - 1])


def _run_rows(least: int, words: int):
    def run(batches):
        for batch in batches:
            for low, pieces in split_texts(batch.column(1)):
                text, at, size, value = find_runs(pieces, least, words)
                place = pa.array(text + low)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(place), batch.column(2).take(place), pa.array(at.astype(np.int32)),
                    pa.array(size.astype(np.int32)), pa.array(value.view(np.int64))], names=["id", "version", "at", "size", "run"])

    return run


def _cut(batches):
    """Texts without the covered sentences; those between kept ones are joined as they stood."""
    for batch in batches:
        texts, spans = batch.column(2), batch.column(3)
        for low, pieces in split_texts(texts):
            count = np.diff(pieces.at)
            out, removed = [], []
            for i in range(len(count)):
                found, text = spans[low + i].as_py(), texts[low + i].as_py()
                gone = np.zeros(count[i], bool)
                for s in found or ():
                    gone[s["at"]:s["at"] + s["size"]] = True
                if gone.any():
                    bounds = pieces.bounds(i)
                    kept = np.flatnonzero(~gone)
                    text = b"".join(pieces.data[bounds[k]:bounds[k + 1]].tobytes() for k in kept).decode().rstrip(" \t\n\v\f\r")
                removed.append(int(gone.sum()))
                out.append(text)
            rows = batch.slice(low, len(count))
            yield pa.RecordBatch.from_arrays([
                rows.column(0), rows.column(1), pa.array(out, pa.string()), pa.array(count.astype(np.int32)), pa.array(removed, pa.int32()), rows.column(4)],
                names=["id", "version", "text", "n_sentences", "n_removed", "first_docs"])


def repeated_runs(texts: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(id, version, at, size, first_id) of every run of ``texts(id, text, version)`` that is not the first of its kind.

    First is the smallest id (null before all), then version, then place. Counts are combined before they
    are shuffled, and only repeated runs are joined back: the hot ones (more than a 1 / HOT_PARTS share of all
    runs each, so fewer than HOT_PARTS) where the rows lie, the others by their hash.
    """
    rows = materialize(texts.mapInArrow(_run_rows(least, words), "id long, version long, at int, size int, run long"), "runs")
    first = rows.groupBy("run").agg(F.min(F.struct("id", "version", "at")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first, "repeated-runs")
    hot = first.where(F.col("n") > F.lit(rows.count() / HOT_PARTS)).select("run", F.col("f").alias("hot"))
    marked = rows.join(F.broadcast(hot), "run", "left")
    others = marked.where("hot is null").drop("hot").join(first.select("run", "f"), "run")
    found = others.unionByName(marked.where("hot is not null").withColumnRenamed("hot", "f"))
    return found.where(~F.struct("id", "version", "at").eqNullSafe(F.col("f"))).select("id", "version", "at", "size", F.col("f.id").alias("first_id"))


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """Id, text without repeated runs, n_sentences, n_removed, first_docs (ids that hold the first places) of each row.

    Words stand between ASCII blanks; their A-Z are lowered for comparison. A sentence ends after a word that
    ends in . ! or ? and before a line break. Every sentence, whatever its length, is cut into pieces after words
    whose byte sum MARK divides, so a passage inside longer sentences is cut alike wherever it stands; n_sentences and
    n_removed count pieces. A run is a sequence of consecutive pieces with parts of at least ``least`` sentences
    and ``words`` words, or with twice ``words`` words, so one shared short sentence is left alone. All
    pieces of a run that also stands at an earlier place, in any text, are removed; an exact copy becomes empty. Rows
    that agree in id and text are one text: both are kept or cut alike. Null texts stay null; texts too short for
    a run are kept. An empty table gives an empty table. Other columns are not read.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("version", F.xxhash64("text"))
    again = repeated_runs(texts, least, words)
    spans = again.groupBy("id", "version").agg(
        F.collect_set(F.struct("at", "size")).alias("spans"), F.sort_array(F.collect_set("first_id")).alias("first_docs"))
    spans = materialize(spans, "run-spans").select(F.col("id").alias("i"), F.col("version").alias("v"), "spans", "first_docs")
    joined = texts.join(spans.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")), "left")
    cut = joined.select("id", "version", "text", "spans", F.coalesce("first_docs", F.expr("cast(array() as array<bigint>)")).alias("first_docs")).mapInArrow(
        _cut, "id long, version long, text string, n_sentences int, n_removed int, first_docs array<long>")
    return cut.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_sentences", "n_removed", "first_docs")
