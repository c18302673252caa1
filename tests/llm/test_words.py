import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tidelog.llm import words as W

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def hashed(texts, **options):
    out = []
    for _, _, words, at in W.chunks(pa.array(texts, pa.string()), **options):
        out += [words[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAé \n\t\x0b .", max_size=40)), max_size=8))
def test_same_words_same_hashes(texts):
    found = hashed(texts)
    assert [len(x) for x in found] == [len(plain(t)) for t in texts]
    names = {}
    for hashes, text in zip(found, texts):
        for h, w in zip(hashes, plain(text)):
            assert names.setdefault(h, w) == w
    assert len(names) == len({w for t in texts for w in plain(t)})


def test_windows_and_chunks_agree(monkeypatch):
    texts = ["one two  three", "x" * 700 + " y " + "z" * 900, None, "", "Four five six seven " * 200]
    whole = hashed(texts)
    monkeypatch.setattr(W, "CHUNK_BYTES", 256)
    assert hashed(texts, limit=256) == whole
    assert hashed(texts, limit=4096) == whole


def test_slices_of_a_column():
    column = pa.array(["a b", "c", None, "d e f"]).slice(1, 3)
    assert [len(x) for x in hashed(column.to_pylist())] == [1, 0, 3]
    assert [w.tolist() for _, _, w, _ in W.chunks(column)] == [w.tolist() for _, _, w, _ in W.chunks(pa.array(["c", None, "d e f"]))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), min_size=1, max_size=6))
def test_shingle_counts(texts):
    for _, _, words, at in W.chunks(pa.array(texts)):
        grams, ends = W.shingles(words, at)
        for text, a, b in zip(texts, ends[:-1], ends[1:]):
            w = plain(text)
            want = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
            assert b - a == len(want) == len(set(grams[a:b].tolist()))
            assert np.all(np.diff(grams[a:b].astype(object)) > 0)
