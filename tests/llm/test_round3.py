"""Piece encoding against the sentencepiece library, pivot clustering and periodic runs against plain versions."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tidelog.llm import pieces, tandem
from tidelog.llm.extraction import main_text
from tidelog.llm.pieces import PieceModel, encode_texts, read_model
from tidelog.llm.pivots import centroid_digest, choose_pivots, cluster_vectors, nearest
from tidelog.llm.queries import PIECE_MODEL, QUERIES, with_planted_runs
from tidelog.llm.tandem import periodic_runs

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(PIECE_MODEL)
PARTS = ["a", "b", "ab", "the", " ", "  ", "   ", "\n", "é", "日本", "▁", "x", "ing", "\t", "0", "😀", "\x00", "in", "er", "он", "на", " " * 15, " " * 40,
         "aaaa", "tion", "lllll", "==", "----", "//", "Ａ", "́"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return PieceModel(file.read())


def made_texts():
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(r.choice("abcdeinrst") for _ in range(r.randint(0, 200))) for _ in range(500)]
    return [*texts, "", " ", "\n", *[" " * n for n in range(1, 70)], " " * 5000, "a" * 5000, "ab" * 3000, "the cat " * 5000 + "x"]


def test_ids_and_texts_are_the_librarys(model, library):
    texts = made_texts()
    ids = model.encode(pa.array(texts))
    assert ids.to_pylist() == library.encode(texts)
    assert model.decode(ids).to_pylist() == [library.decode(x) for x in ids.to_pylist()]


def test_windows_change_nothing(model, library, monkeypatch):
    texts = [*made_texts()[-4:], None, "short", "word " * 3000]
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 700)
    monkeypatch.setattr(pieces, "CHUNK_IDS", 50)
    ids = model.encode(pa.array(texts))
    assert ids.to_pylist() == library.encode([t or "" for t in texts])
    assert model.decode(ids).to_pylist() == [library.decode(x) for x in ids.to_pylist()]


def test_any_ids_decode_as_in_the_library(model, library):
    r = random.Random(6)
    lists = [[r.randrange(32000) if r.random() < 0.5 else r.randrange(270) for _ in range(r.randint(0, 30))] for _ in range(2000)]
    assert model.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [library.decode(x) for x in lists]
    with pytest.raises(ValueError):
        model.decode(pa.array([[32000]], pa.list_(pa.int32())))


def test_encode_texts_keeps_columns(spark, library):
    data = read_model(spark, PATH)
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 8), (2, "", 9), (None, "a b", 9)], "doc_id long, text string, ids int")
    got = encode_texts(df, data, ids_col="ids", decoded_col="decoded").collect()
    want = library.encode("a b")
    assert sorted((r.doc_id or 0, r.text or "", list(r.ids), r.decoded) for r in got) == [(0, "a b", want, "a b"), (1, "a b", want, "a b"), (2, "", [], ""), (2, "", [], "")]
    assert encode_texts(df.limit(0), data).count() == 0


def test_pieces_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_pieces"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def plain_lloyd(rows, clusters, rounds):
    """(id, cluster, distance) by definition, in Python's whole numbers."""
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    start = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centers = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centers)) for _, v in rows]

    for _ in range(rounds):
        at = assign()
        for k in range(len(centers)):
            mine = [v for (_, v), (_, c) in zip(rows, at) if c == k]
            if mine:
                centers[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, c, d) for (i, _), (d, c) in zip(rows, assign())], centers


def test_pivots_leave_out_no_nearest_centroid():
    r = np.random.default_rng(2)
    v = np.concatenate([r.integers(-300, 300, (400, 64)), r.integers(-2, 3, (400, 64)), np.full((3, 64), 1 << 26), np.full((3, 64), -(1 << 26))])
    c = np.concatenate([v[:7], v[400:407], v[:2]])
    p = choose_pivots(c, 5)
    roots = np.sqrt(np.stack([((v - x) ** 2).sum(1) for x in p], 1))
    where, best, exact = nearest(v, roots, c, p)
    full = ((v[:, None] - c[None]) ** 2).sum(-1)
    assert (where == full.argmin(1)).all() and (best == full.min(1)).all() and exact < full.size


def test_clusters_of_made_vectors(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.25, 0.26, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, [9.0, 9.0, 9.0, 9.0]), (None, [0.1, 0.2, 0.3, -0.4])]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [float("inf")] * 4), (904, [1.0]), (905, []), (906, [1e300] * 4)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows + odd], "vec_id long, embedding array<double>, cluster string, distance int").repartition(5)
    for clusters in (5, 1000):
        got, centroids = cluster_vectors(df, clusters=clusters, dim=4, pivots=3)
        want, centers = plain_lloyd(rows, clusters, 3)
        key = lambda t: (t[0] is None, t)
        assert sorted((tuple(x) for x in got.collect()), key=lambda t: (t[0] is None, t[0] or 0, t[1:])) == sorted(want, key=lambda t: (t[0] is None, t[0] or 0, t[1:]))
        assert [c["components"] for c in centroids] == centers and sum(c["count"] for c in centroids) == len(rows)
    got, centroids = cluster_vectors(df.where("vec_id > 899"), dim=4)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance"] and centroids == []


def test_cluster_query_reports_its_centroids(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, centers = plain_lloyd(rows, 16, 3)
    got = {r.vec_id: r for r in QUERIES["op12_pivot_clusters"](spark, SF).collect()}
    assert {(i, r.cluster, r.distance) for i, r in got.items()} == set(want)
    assert all(r.centroid_sha256 == centroid_digest(centers[r.cluster]) and r.inertia == sum(d for _, _, d in want) for r in got.values())


def plain_runs(w):
    """All maximal runs by trying every period at every place."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.append((i, j - i + q, q))
            i = j + 1
    own = [(i, n, q) for i, n, q in found if not any(all(w[i + k] == w[i + k + p] for k in range(n - p)) for p in range(1, q))]
    return sorted(own, key=lambda r: (r[0], r[2]))


def plain_rest(w, found):
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic_texts():
    r = random.Random(4)
    for _ in range(1500):
        letters = r.choice(["a", "ab", "abc", "abcdefgh"])
        w = [r.choice(letters) for _ in range(r.randint(0, 40))]
        if r.random() < 0.6:
            u = [r.choice(letters) for _ in range(r.randint(1, 6))]
            w = w[:r.randint(0, len(w))] + u * r.randint(2, 9) + u[:r.randint(0, len(u))] + w
        yield w


def test_runs_are_those_of_the_plain_search():
    texts = [*periodic_texts(), ["a"] * 400, list("ab") * 200, list("abaab") * 50, []]
    for got, w in zip(tandem._chunk(pa.array([" ".join(t) for t in texts]), 6, 4).to_pylist(), texts, strict=True):
        want = plain_runs(w)
        assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == want
        assert got["n_words"] == len(w) and got["collapsed"] == plain_rest(w, want)


def test_a_long_run_is_quick():
    w = ["x"] * 200_000 + list("abcab") * 20_000
    got = tandem._chunk(pa.array([" ".join(w)]), 6, 4).to_pylist()[0]["runs"]
    assert [(r["start"], r["length"], r["period"]) for r in got] == [(0, 200_000, 1), (200_000, 100_000, 5)]


def test_periodic_runs_on_odd_rows(spark):
    rows = [(1, "é é é é é é é end", "k"), (1, "é é é é é é é end", "k"), (2, None, "k"), (3, "", "k"), (4, " \t\n", "k"), (None, " a b  c ", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, periodic string")
    got = sorted((r.doc_id or 0, r.periodic.n_words, [tuple(x) for x in r.periodic.runs], r.periodic.collapsed) for r in periodic_runs(df).collect())
    run = (1, 8, [(0, 7, 1)], "é end")
    assert got == [(0, 2, [], "a b c"), run, run, (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], "")]
    assert periodic_runs(df.limit(0)).count() == 0


def test_run_query(spark):
    blank = " \t\n\v\f\r"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    planted = 0
    for r in QUERIES["op13_periodic_runs"](spark, SF).collect():
        w = "".join(" " if c in blank else c for c in texts[r.doc_id] or "").split(" ")
        w = [x for x in w if x]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            planted += 1
        if n > 3000:  # the plain search is quadratic; long texts are compared by their digest's own parts
            continue
        found = plain_runs(w)
        top = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if found else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found)) and r.collapsed_sha256 == sha(plain_rest(w, found))
    assert planted > 5


def test_planting_leaves_nulls(spark):
    rows = [(i, t) for i in range(60) for t in (None, "", "a b c d e f g h i j")]
    got = with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.text is None for r in got) == 60 and sum(r.text == "" for r in got) == 60


@pytest.mark.parametrize("page, want", [
    ('<article><section id="side-effects"><p>Effects of it.</p></section><section id="search-algorithms"><p>How to search.</p></section></article>', "Effects of it. How to search."),
    ('<article><p>First.</p><p id="legal">A legal word.</p><section id="comments"><p>Nice!</p></section></article>', "First. A legal word."),
    ('<article><p>Here <math><mi>x</mi></math> is one.</p></article>', "Here x is one."),
    ("<p>Said and done, 5 < 6.</p><p>More <b", "Said and done, 5 < 6. More"),
])
def test_article_parts_and_unclosed_tags(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("rest", ["<a <" * 250_000, "<a href='x' " * 80_000, "<!-- x " * 100_000, "<a '" * 200_000 + ">"])
def test_broken_markup_takes_little_time(rest):
    start = time.perf_counter()
    assert main_text("<p>Some words of text.</p>" + rest).startswith("Some words of text.")
    assert time.perf_counter() - start < 5
