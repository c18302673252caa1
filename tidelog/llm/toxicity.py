"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding look-alike characters."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SAMPLE = 20_000  # labelled rows to learn from at most, the smallest by a hash of their id
LEAST = 8        # toxic sample texts that must hold an entry
STEMS = range(3, 8)
THRESHOLD = 0.3

# Look-alike letters of other alphabets and digits used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "i", "l": "i"}
JOINERS = "­​‌‍⁠﻿'’"


class _Folding(dict):
    """Translation table filled as characters come: folded letters, no joiners, blanks for the rest.

    l, i, 1 and | fold together, since a digit 1 may stand for either letter.
    """

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char in JOINERS or unicodedata.combining(char):
            out = ""
        else:
            plain = unicodedata.normalize("NFKD", char).lower()
            out = "".join(DIGITS.get(c, c) for c in "".join(
                LOOKALIKES.get(c, c) for c in plain if not unicodedata.combining(c)))
            out = "".join(c if c.isalnum() else " " for c in out) or " "
        self[code] = out
        return out


_folding = _Folding()


def fold(text: str | None) -> str:
    """Folded text: one blank before and after, letters and blanks between."""
    return f" {(text or '').translate(_folding)} "


@dataclass
class ToxicityModel:
    """Entries start with a blank: `` word `` matches a word, `` stem`` the start of a word.

    A match inside an exception phrase (folded, blanks at both ends) does not count.
    """

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (-3.0, 1.0, 1.0)
    automaton: ahocorasick.Automaton = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "coefficients": self.coefficients, "automaton": None}

    def matcher(self) -> ahocorasick.Automaton:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self.automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self.automaton.add_word(phrase, (len(phrase), None))
            self.automaton.make_automaton()
        return self.automaton

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """(sum of weights, matches, words) of a text; of entries that start at one place the heaviest counts."""
        folded = fold(text)
        found, spared = {}, []
        if self.weights:
            for end, (size, weight) in self.matcher().iter(folded):
                start = end - size + 1
                if weight is None:
                    spared.append((start, end))
                else:
                    found[start] = max(weight, found.get(start, 0.0))
        if spared:
            found = {s: w for s, w in found.items() if not any(a <= s < b for a, b in spared)}
        return sum(found.values()), len(found), len(folded.split())

    def design(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Rows of the calibration: constant, log of the weight, log of the weight per hundred words."""
        return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / (words + 20))], 1)


def _features(words) -> set[str]:
    out = {f" {w} " for w in words if len(w) > 2}
    for n in STEMS:
        out.update(f" {w[:n]}" for w in words if len(w) > n)
    return out


def _positive(batches):
    for pdf in batches:
        counts = Counter()
        for text in pdf.text:
            counts.update(_features(set(fold(text).split())))
        yield pd.DataFrame({"entry": list(counts), "n": list(counts.values())})


def _negative(entries: set[str]):
    def run(batches):
        counts, n = Counter(), 0
        for pdf in batches:
            for text in pdf.text:
                counts.update(_features(set(fold(text).split())) & entries)
            n += len(pdf)
        yield pd.DataFrame({"entry": list(counts), "n": list(counts.values())})

    return run


def _phrases(weights: dict[str, float]):
    """Word pairs around lexicon matches, by label."""
    def run(batches):
        counts = Counter()
        for pdf in batches:
            for text, toxic in zip(pdf.text, pdf.toxic, strict=True):
                words = fold(text).split()
                held = set()
                for i, w in enumerate(words):
                    if f" {w} " in weights or any(f" {w[:n]}" in weights for n in STEMS):
                        if i:
                            held.add(f" {words[i - 1]} {w} ")
                        if i + 1 < len(words):
                            held.add(f" {w} {words[i + 1]} ")
                counts.update((p, int(toxic)) for p in held)
        yield pd.DataFrame({"phrase": [k[0] for k in counts], "toxic": [k[1] for k in counts], "n": list(counts.values())})

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", bound: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``bound`` labelled rows that may be learnt from, without repeats of a text.

    Rows whose crc32 of the id mod 4 is 2 are held out. The bound makes the label side safe to broadcast.
    """
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))
    ids = ids.groupBy(id_col).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(id_col), id_col).limit(bound)
    rows = docs.select(id_col, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), id_col)
    return rows.groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def fit_toxicity(sample: DataFrame, exceptions: tuple[str, ...] = ()) -> ToxicityModel:
    """Learn entries, exception phrases and calibration from a bounded (text, toxic) sample.

    Entries are words and word starts held by at least LEAST toxic texts, nearly none of them
    clean; their weight is the log odds. Exceptions are given ones and word pairs round an
    entry that mostly stand in clean texts. Without toxic texts the lexicon is empty.
    """
    sample = sample.cache()
    try:
        size = {int(r[0]): r[1] for r in sample.groupBy("toxic").count().collect()}
        bad, good = size.get(1, 0), size.get(0, 0)
        rows = sample.where("toxic = 1").mapInPandas(_positive, "entry string, n long").groupBy("entry").agg(
            F.sum("n").alias("n")).where(F.col("n") >= LEAST).collect()
        held = {r.entry: r.n for r in rows}
        rows = sample.where("toxic = 0").select("text").mapInPandas(_negative(set(held)), "entry string, n long").groupBy(
            "entry").agg(F.sum("n").alias("n")).collect() if held else []
        clean = {r.entry: r.n for r in rows}

        def odds(e: str) -> float:
            return math.log((held[e] + 0.5) / (bad + 1)) - math.log((clean.get(e, 0) + 0.5) / (good + 1))

        weights: dict[str, float] = {}
        for e in sorted(held, key=lambda e: (len(e.rstrip()), e.endswith(" "), e)):
            rate = held[e] / (held[e] + clean.get(e, 0) * max(1, bad) / max(1, good))
            if rate < 0.95 or odds(e) < 2.5:
                continue
            word = e.rstrip()
            if not any(word[:n + 1] in weights for n in STEMS if n < len(word)):  # a kept stem covers it
                weights[e] = round(odds(e), 6)
        spared = Counter()
        if weights:
            for r in sample.mapInPandas(_phrases(weights), "phrase string, toxic int, n long").groupBy("phrase").agg(
                    F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
                    F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")).where("good >= 3 and good > 4 * bad").collect():
                spared[r.phrase] = r.good
        model = ToxicityModel(weights, tuple(sorted({*spared, *(f" {' '.join(fold(p).split())} " for p in exceptions)})))
        seen = sample.mapInPandas(_weigher(model, ["toxic"]), "toxic int, total double, matches int, words int").toPandas()
    finally:
        sample.unpersist()
    x, y = model.design(seen.total.to_numpy(), seen.words.to_numpy()), seen.toxic.to_numpy(float)
    w = np.array(model.coefficients) * 1.0
    if bad and good:
        w = np.zeros(3)
        ridge = np.diag([1e-3, 0.1, 0.1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
    model.coefficients = tuple(round(float(v), 9) for v in w)
    return model


def _weigher(model: ToxicityModel, kept: list[str]):
    def run(batches):
        for pdf in batches:
            found = [model.weigh(t) for t in pdf.text]
            out = pdf[kept].copy()
            out["total"] = [x[0] for x in found]
            out["matches"] = [x[1] for x in found]
            out["words"] = [x[2] for x in found]
            yield out

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with toxic_score (0 to 1), toxic_matches and toxic_predicted (replaced if there).

    Null and empty texts weigh nothing and get the lowest score. Whole texts are matched, of any length.
    An empty table gives an empty table.
    """
    a, b, c = model.coefficients

    @F.pandas_udf("total double, matches int, words int")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.weigh(t) for t in texts], columns=["total", "matches", "words"]).astype(
            {"total": float, "matches": int, "words": int})

    names = [x for x in docs.columns if x not in ("toxic_score", "toxic_matches", "toxic_predicted")]
    z = F.lit(a) + b * F.log1p("w__.total") + c * F.log1p(100 * F.col("w__.total") / (F.col("w__.words") + 20))
    scored = docs.select(*names, weigh(F.col(text_col)).alias("w__")).withColumn("toxic_score", 1 / (1 + F.exp(-z)))
    return scored.select(*names, "toxic_score", F.col("w__.matches").alias("toxic_matches"),
                         (F.col("toxic_score") >= threshold).cast("int").alias("toxic_predicted"))
