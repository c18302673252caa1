"""Benchmark decontamination by latent semantic retrieval and subsequence checks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import PLAIN, chunks

HALF = 32            # a passage is two halves of so many words; passages overlap by one half
RANK = 160
BATCH_ITEMS = 224    # passages of items compared at once, little above RANK so that the subspace holds most of each
COMMON, FEW = 0.01, 50  # words in a larger share of passages (and in more than FEW) weigh nothing,
RAREST = 8           # but for the rarest words of each item
COSINE, SHARE = 0.5, 0.35
WHOLE, PARTLY, ANSWER = 0.62, 0.45, 0.8
ANSWER_WORDS = 8


@dataclass
class Items:
    """Benchmark passages as sequences of word numbers; vocabulary sorted by hash."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: np.ndarray


def _words_of(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, words, at in chunks(pa.array(texts, pa.string()), blanks=PLAIN):
        out += [words[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def prepare(rows: list[tuple[int, str | None]]) -> Items:
    """All passages of some rows as one batch."""
    return next(batches(rows, None), Items([], [], np.empty(0, np.uint64)))


def batches(rows: Iterable[tuple[int, str | None]], size: int | None = BATCH_ITEMS) -> Iterator[Items]:
    """Batches of ``size`` passages (None: all in one). Items without words are left out, longer ones are cut into passages of two halves.

    Passages of one item may lie in two batches. A batch has at most ``size`` passages of 64 words, however long the items are.
    """
    def batch() -> Items:
        vocabulary = np.unique(np.concatenate(words))
        return Items(ids, [np.searchsorted(vocabulary, w) for w in words], vocabulary)

    ids: list[int] = []
    words: list[np.ndarray] = []
    for item, text in rows:
        w = _words_of([text or ""])[0]
        for a in range(0, max(1, len(w) - HALF), HALF):
            piece = w[a:a + 2 * HALF]
            if len(piece):
                ids.append(item)
                words.append(piece)
            if len(ids) == size:
                yield batch()
                ids, words = [], []
    if ids:
        yield batch()


class _Finder:
    """Numbers of benchmark words in word hashes; -1 for all others."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int32)
        maybe = np.flatnonzero(self.filter[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
        right = self.vocabulary[place] == words[maybe]
        out[maybe[right]] = place[right]
        return out


def _passages(found: np.ndarray, at: np.ndarray, weighted: np.ndarray | None, overlap: bool):
    """(passage, term) pairs without repeats, sorted by passage; first passage of each row and their number."""
    halves = -(-np.diff(at) // HALF)
    count = np.maximum(halves - 1, np.minimum(halves, 1)) if overlap else -(-halves // 2)
    first = np.concatenate([[0], np.cumsum(count)])
    hit = np.flatnonzero(found >= 0 if weighted is None else (found >= 0) & weighted[found])
    row = np.searchsorted(at, hit, "right") - 1
    half = (hit - at[row]) // HALF
    term = found[hit].astype(np.int64)
    if overlap:
        here = half < count[row]
        before = half > 0
        passage = np.concatenate([(first[row] + half)[here], (first[row] + half - 1)[before]])
        term = np.concatenate([term[here], term[before]])
    else:
        passage = first[row] + half // 2
    size = int(found.max(initial=0)) + 1
    pairs = np.unique(passage * size + term)
    return pairs // size, pairs % size, first


def _counting(finder: _Finder):
    def run(batches):
        counts, passages = np.zeros(len(finder.vocabulary), np.int64), 0
        for batch in batches:
            for _, _, words, at in chunks(batch.column(0), blanks=PLAIN):
                _, term, first = _passages(finder(words), at, None, False)
                counts += np.bincount(term, minlength=len(counts))
                passages += int(first[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(len(counts)), -1]), pa.array(np.r_[counts, passages])], names=["term", "n"])

    return run


SLICE = 256  # terms whose part of a product travels together


def _multiplying(finder: _Finder, weights: np.ndarray, basis: np.ndarray):
    """Per task the part of (A'A) x basis that its passages give."""

    def run(batches):
        total = np.zeros(basis.shape, np.float32)
        scaled = (basis * weights[:, None]).astype(np.float32)
        for batch in batches:
            for _, _, words, at in chunks(batch.column(0), blanks=PLAIN):
                passage, term, _ = _passages(finder(words), at, weights > 0, False)
                for low in range(0, len(passage), 4096):
                    # whole passages only
                    high = min(len(passage), low + 4096)
                    a = np.searchsorted(passage, passage[low]) if low else 0
                    b = np.searchsorted(passage, passage[high - 1]) if high < len(passage) else high
                    p, t = passage[a:b], term[a:b]
                    if not len(p):
                        continue
                    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                    left = np.add.reduceat(scaled[t], starts)
                    number = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(p)]))
                    order = np.argsort(t, kind="stable")
                    cuts = np.flatnonzero(np.r_[True, t[order][1:] != t[order][:-1]])
                    total[t[order][cuts]] += np.add.reduceat(left[number[order]], cuts)
        total *= weights[:, None].astype(np.float32)
        parts = [(i, total[i:i + SLICE].tobytes()) for i in range(0, len(total), SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], pa.int32()), pa.array([x[1] for x in parts], pa.binary())], names=["part", "data"])

    return run


def _adding(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf.data)
    return pd.DataFrame({"part": [pdf.part.iloc[0]], "data": [total.tobytes()]})


def latent_space(texts: DataFrame, items: Items, rank: int = RANK, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(idf weights, right singular vectors) of the TF-IDF passages of ``texts(text)`` over the benchmark's words.

    Randomised SVD: the product of A'A with a random block is summed over all passages on the
    executors, made orthonormal, multiplied again and diagonalised. The benchmark's own passages
    are rows of A too, as heavy as the rest together, so that rare items keep a direction. Only
    matrices of (benchmark words x rank) reach the driver.
    """
    finder = _Finder(items.vocabulary)
    counted = dict(texts.mapInArrow(_counting(finder), "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    passages = counted.pop(-1, 0) or 0
    df = np.array([counted.get(i, 0) for i in range(len(items.vocabulary))], float)
    weights = np.log(np.maximum((passages + 2) / (df + 1), 1 / COMMON))  # an item in many texts keeps its weight
    telling = df <= max(COMMON * passages, FEW)
    for w in items.words:
        terms = np.unique(w)
        telling[terms[np.argsort(df[terms], kind="stable")[:RAREST]]] = True
    weights *= telling
    own = np.zeros((len(items.words), len(weights)))
    for i, w in enumerate(items.words):
        own[i, w] = weights[w]
    rank = min(rank, len(weights))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(weights), rank)))[0]
    heavy = max(1.0, passages / max(1, len(own)))
    for turn in range(2):
        parts = texts.mapInArrow(_multiplying(finder, weights, basis), "part int, data binary").groupBy("part").applyInPandas(
            _adding, "part int, data binary").collect()
        product = heavy * (own.T @ (own @ basis))
        for part, data in parts:
            block = np.frombuffer(data, float).reshape(-1, rank)
            product[part:part + len(block)] += block
        if turn == 0:
            basis = np.linalg.qr(product)[0]
    small = basis.T @ product
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return weights, basis @ vectors[:, ::-1]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit per element of ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _matching(finder: _Finder, items: Items, weights: np.ndarray, vectors: np.ndarray):
    informative = weights > 0
    query = np.zeros((len(items.words), vectors.shape[1]), np.float32)
    for i, w in enumerate(items.words):
        terms = np.unique(w)
        query[i] = weights[terms] @ vectors[terms]
    norm = np.linalg.norm(query, axis=1)
    useful = norm > 1e-6
    scaled = (vectors * weights[:, None]).astype(np.float32)
    key = [w[informative[w]] for w in items.words]

    def check(words: np.ndarray, j: int) -> float:
        """Share of the item found in order, 0 if it does not count as a leak."""
        item = items.words[j]
        share = lcs(item, words) / len(item)
        if share < PARTLY or lcs(key[j], words[(words >= 0) & informative[words]]) < 0.5 * len(key[j]):
            return 0.0
        if share < WHOLE:
            answer = item[-ANSWER_WORDS:]
            if lcs(answer, words) < ANSWER * len(answer):
                return 0.0
        return share

    def match(texts: pa.Array) -> pa.Array:
        leaks: list[dict[int, float]] = []
        for low, high, words, at in chunks(texts, blanks=PLAIN):
            found = finder(words)
            passage, term, first = _passages(found, at, informative, True)
            hits: list[dict[int, float]] = [{} for _ in range(high - low)]
            a = 0
            while a < len(passage):
                # whole passages, about 8192 entries at once
                b = min(len(passage), a + 8192)
                b = max(int(np.searchsorted(passage, passage[b - 1], "left")), int(np.searchsorted(passage, passage[a], "right"))) if b < len(passage) else b
                p, t = passage[a:b], term[a:b]
                a = b
                starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                latent = np.add.reduceat(scaled[t], starts)
                dot = latent @ query.T
                length = np.linalg.norm(latent, axis=1)[:, None]
                good = useful & (dot >= SHARE * norm ** 2) & (dot >= COSINE * length * norm)
                for r, j in zip(*np.nonzero(good)):
                    number = int(p[starts[r]])
                    doc = int(np.searchsorted(first, number, "right")) - 1
                    begin = at[doc] + (number - first[doc]) * HALF
                    item = items.ids[j]
                    if hits[doc].get(item, 0) < 1:
                        share = check(found[max(at[doc], begin - HALF // 2):min(at[doc + 1], begin + 2 * HALF + HALF // 2)], int(j))
                        if share > hits[doc].get(item, 0):
                            hits[doc][item] = share
            leaks += hits
        return pa.StructArray.from_arrays([
            pa.array([sorted(h) for h in leaks], pa.list_(pa.int64())),
            pa.array([max(h.values(), default=0.0) for h in leaks], pa.float64())], names=["items", "share"])

    return match


def find_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", rank: int = RANK) -> DataFrame:
    """All columns of ``df`` with leaked_items (sorted ids of benchmark items found) and leaked_share (largest part of an item found in order).

    Passages of documents whose latent vector points to an item (cosine and share of the item's
    weight) are compared with it word by word: a leak holds at least WHOLE of the item's words in
    order, or PARTLY of them and the answer, its last words. Punctuation and case do not
    count. Null texts are empty; an empty benchmark leaves every list empty. Large benchmarks go in batches of BATCH_ITEMS passages, over
    all texts each. Only benchmark rows and matrices of their words reach the driver. Columns of the new names are replaced.
    """
    rows = benchmark.select("item_id", F.lower("text").alias("text")).where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    text = F.lower(F.col(text_col).cast("string"))
    found = []
    for items in batches((r[0], r[1]) for r in rows.toLocalIterator()):
        weights, vectors = latent_space(df.select(text.alias("text")), items, rank)
        found.append(F.arrow_udf(_matching(_Finder(items.vocabulary), items, weights, vectors), "items array<long>, share double")(text))
    kept = [c for c in df.columns if c not in ("leaked_items", "leaked_share")]
    none = F.struct(F.expr("cast(array() as array<bigint>)").alias("items"), F.lit(0.0).alias("share"))
    marked = df.select(*kept, F.array(none, *found).alias("leaks__"))
    return marked.select(*kept, F.array_sort(F.array_distinct(F.flatten("leaks__.items"))).alias("leaked_items"), F.array_max("leaks__.share").alias("leaked_share"))
