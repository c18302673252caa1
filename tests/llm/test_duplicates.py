import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import rows
from tests.llm.test_words import plain
from tidelog.llm import ngram_join as N, vector_dedup as V
from tidelog.llm.components import components
from tidelog.llm import substring_dedup as S
from tidelog.llm.substring_dedup import dedup_substrings


def groups(nodes, pairs):
    label = {n: n for n in nodes}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    w = plain(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_components(spark):
    random.seed(1)
    pairs = [(i, i + 1) for i in range(20, 60)] + [(100, 3), (3, 7), (7, 100), (9, 9)]
    pairs += [(500, random.randint(501, 560)) for _ in range(40)]
    found = dict(rows(components(spark.createDataFrame(pairs, "a long, b long"))))
    assert found == groups({n for p in pairs for n in p}, pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(random.choice(vocabulary) for _ in range(40))
    out = {}
    for i in range(60):
        out[i] = " ".join(random.choice(vocabulary) for _ in range(random.randint(1, 120)))
        if i % 3 == 0:
            out[i] += " " + passage  # common to many, near to none
    base = out[3].split()
    for i in range(60, 110):  # copies with more and more changes
        w = list(base)
        for _ in range((i - 60) // 4):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        out[i] = " ".join(w)
    out.update({110: "", 111: None, 112: "one two", 113: "ONE  two\n", 114: "a b c d e", 115: "a b c d e f", 116: out[5].upper(), 117: "w1 " * 5000})
    return out


def brute(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, groups(sets, near)


def test_ngram_join_equals_all_pairs(spark, texts, monkeypatch):
    sets, want = brute(texts)
    df = spark.createDataFrame([(t, i, "x", 0) for i, t in texts.items()], "text string, doc_id long, component string, id long").repartition(5)
    for tile, fragment in ((N.TILE_DOCS, N.FRAGMENT_BYTES), (8, 4096)):  # tiles and fragments of any size agree
        monkeypatch.setattr(N, "TILE_DOCS", tile)
        monkeypatch.setattr(N, "FRAGMENT_BYTES", fragment)
        found = {r.doc_id: (r.n_shingles, r.component) for r in N.ngram_join(df).collect()}
        assert found == {i: (len(sets[i]), want[i]) for i in sets}


def test_ngram_join_writes_no_row_per_ngram(spark, texts, monkeypatch):
    sets, want = brute(texts)
    written, write = {}, N.materialize

    def counted(df, label):
        out = write(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(N, "materialize", counted)
    monkeypatch.setattr(N, "FRAGMENT_GRAMS", 100, raising=False)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component for r in N.ngram_join(df).collect()} == want
    assert written and max(written.values()) <= len(texts)


def test_ngram_join_posts_one_row_per_block_and_fragment(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] * 3, "id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        assert df.mapInArrow(N._post(8, 5), N._POSTED).count() <= 8  # however many batches the task reads
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ngram_join_compares_only_sets_that_can_link(spark, monkeypatch):
    random.seed(11)
    words = lambda count: [f"v{random.randrange(5000)}" for _ in range(count)]
    out, base, far = {}, words(204), []

    def changed(places):
        w = list(base)
        for i in places:
            w[i] = f"new{len(out)}x{i}"
        return " ".join(w)

    for _ in range(30):
        out[len(out)] = changed([random.randrange(204)])
    for shift in range(8):  # a fifth of the n-grams belongs to none but this text
        far.append(len(out))
        out[len(out)] = changed(range(10 + shift, 204, 24))
    for _ in range(40):  # many small groups, some with a text too far for a link
        w = words(random.randint(20, 60))
        for change in (0, 1, 4)[:random.randint(2, 3)]:
            out[len(out)] = " ".join(w[:len(w) - change] + [f"end{len(out)}"] * change)
    sets, want = brute(out)
    assert all(want[i] == i for i in far)
    members, write = [], N.materialize

    def kept(df, label):
        found = write(df, label)
        if label == "ngram-members":
            members.append(found)
        return found

    monkeypatch.setattr(N, "materialize", kept)
    df = spark.createDataFrame(list(out.items()), "doc_id long, text string").repartition(3)
    for name, value in (("SMALL_DOCS", 64), ("SMALL_DOCS", 0), ("TILE_DOCS", 8)):  # shared tiles and tiles of their own agree
        monkeypatch.setattr(N, name, value, raising=False)
        monkeypatch.setattr(N, "BROADCAST_ROWS", value if value < 64 else 1 << 20, raising=False)
        monkeypatch.setattr(N, "BLOCK_GRAMS", 500 if value < 64 else 1 << 21, raising=False)
        found = N.ngram_join(df).select("doc_id", "n_shingles", "set_id", "component").collect()
        assert {r.doc_id: (r.n_shingles, r.component) for r in found} == {i: (len(sets[i]), want[i]) for i in sets}
        assert not {r.set_id for r in found if r.doc_id in far} & {r.node for r in members.pop().collect()}


def test_ngram_join_odd_rows(spark):
    schema = "doc_id long, text string"
    assert N.ngram_join(spark.createDataFrame([], schema)).count() == 0
    far = "p q r s t u v w x y"
    df = spark.createDataFrame([(7, far), (7, far), (None, far), (None, None), (8, "other words in here now"), (9, far), (9, "other words in here now")], schema)
    assert rows(N.ngram_join(df), "doc_id", "n_shingles", "component") == sorted(
        [(None, 0, None), (None, 6, None), (7, 6, 7), (7, 6, 7), (8, 1, 7), (9, 1, 7), (9, 6, 7)], key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_near_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 16))
    x[40:80] = x[5] + rng.standard_normal((40, 16)) * np.linspace(0.01, 0.6, 40)[:, None]
    x[90:95] = x[7]
    x[96] = x[7] * 1e-200
    x[97] = x[8] * 1e150
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, None] * 8), (204, []), (205, x[5][:8].tolist()), (206, x[5][:8].tolist()), (207, [float("inf")] * 16)]
    found = {r.vec_id: tuple(r)[1:] for r in V.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    pairs = [(a, b) for a, b in zip(*np.nonzero(near)) if a < b] + [(205, 206)]
    label = groups([i for i, _ in data], [(int(a), int(b)) for a, b in pairs])
    links = {i: int(near[i].sum()) if i < 120 else int(i in (205, 206)) for i, _ in data}
    assert found == {i: (links[i], label[i], label[i] == i) for i, _ in data}
    assert V.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((64, 24)) * 10.0 ** rng.integers(-3, 3, (64, 1))
    out = V._quantise(pa.table({"id": pa.array(range(64), pa.int64()), "vector": [v.tolist() for v in x], "dim": pa.array([24] * 64, pa.int32()), "block": pa.array([0] * 64, pa.int32())})).to_pylist()[0]
    codes = np.frombuffer(out["codes"], np.int8).reshape(64, 24).astype(float)
    s, e, a = np.frombuffer(out["bounds"]).reshape(3, -1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    error = np.abs(unit @ unit.T - (codes @ codes.T) * s[:, None] * s[None, :])
    assert np.all(error <= e[:, None] * a[None, :] + a[:, None] * e[None, :] + e[:, None] * e[None, :] + 1e-12)


def sentences(text):
    """Sentences of a text by the stated rule, one word after the other."""
    out, held = [], ""
    for unit in re.findall(r"[ \t-\r]*[^ \t-\r]+[ \t-\r]*", text or ""):
        held += unit
        word = unit.strip(" \t\n\v\f\r")
        spelt = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
        if sum(spelt.encode()) % 8 == 0 or word[-1] in ".!?" or "\n" in unit[unit.index(word) + len(word):]:
            out.append(held)
            held = ""
    return out + [held] if held else out


def brute_repeats(texts, longest=10**9):
    """Text, sentences and removed ones of each id, by looking at every span of sentences (of at most ``longest`` words)."""
    cut = {i: sentences(t) for i, t in texts.items()}
    stop = {i: [s.rstrip(" \t\n\v\f\r")[-1] in ".!?" or "\n" in s[len(s.rstrip(" \t\n\v\f\r")):] for s in c] for i, c in cut.items()}
    keys = {i: [tuple(plain(s)) for s in c] for i, c in cut.items()}
    seen, gone = {}, {i: set() for i in texts}
    for i in sorted(texts):
        for a in range(len(keys[i])):
            held = 0
            for b in range(a, len(keys[i])):
                held += len(keys[i][b])
                if held > longest:
                    break
                if (any(stop[i][a:b]) and held >= 12) or held >= 24:
                    if seen.setdefault((*keys[i][a:b + 1], *stop[i][a:b]), (i, a)) != (i, a):
                        gone[i] |= set(range(a, b + 1))
    return {i: ("".join(s for k, s in enumerate(cut[i]) if k not in gone[i]).rstrip(" \t\n\v\f\r") if gone[i] else texts[i], len(cut[i]), len(gone[i])) for i in texts}


def repeats_of(spark, texts):
    df = spark.createDataFrame([(t, i, "v") for i, t in texts.items()], "text string, doc_id long, version string").repartition(4)
    return {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in dedup_substrings(df).collect()}


@pytest.mark.parametrize("chunk", [S.CHUNK_BYTES, 200])
def test_sentences(monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    texts = ["One two. Three four!  Five\n\nsix seven, " + "Long été words here " * 50 + "\t, end", "", None, " \n ", "  lead\n tail \n", "x" * 900 + " y. z"]
    found = []
    for _, p in S.split_texts(pa.array(texts)):
        for i in range(len(p.at) - 1):
            b = p.bounds(i) if p.at[i + 1] > p.at[i] else []
            found.append([p.data[x:y].tobytes().decode() for x, y in zip(b[:-1], b[1:])])
    assert found == [sentences(t) for t in texts]


def test_substring_dedup_equals_all_spans(spark):
    random.seed(9)
    pool = [" ".join(random.choice("abcdefgh") * 3 + str(random.randint(0, 50)) for _ in range(random.randint(1, 15))) + random.choice(".!?,\n") for _ in range(80)]
    shared = " ".join(pool[:5])
    texts = {i: " ".join(random.choice(pool[10:]) + f" {i}." for _ in range(8)) for i in range(30)}
    for i in (4, 9, 20):
        texts[i] += " " + shared
    texts.update({30: texts[2], 31: None, 32: "", 33: "Short. Text.", 34: (pool[7] + " ") * 60, 35: " ".join(pool[:40]).upper(), 36: "x " * 300, 37: " \n"})
    want = brute_repeats(texts)
    assert repeats_of(spark, texts) == want
    assert want[20][2] >= 3 and want[4][2] == 0 and want[30][0] == ""
    twice = spark.createDataFrame([(1, shared), (1, shared), (None, shared)], "doc_id long, text string")
    assert [(r.doc_id, r.text, r.first_docs) for r in dedup_substrings(twice).orderBy("doc_id").collect()] == [
        (None, shared, []), (1, "", []), (1, "", [])]  # an id that is null is not listed
    assert dedup_substrings(twice.limit(0)).count() == 0


def test_copies_vanish_whole(spark):
    """Copies without any stop, with a short last sentence, of one word, and a passage inside longer sentences."""
    random.seed(3)
    draw = lambda n: " ".join("".join(random.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    a, b, c = draw(300), draw(10) + ". " + draw(10) + ". Yes. ", "word " * 40
    inner = draw(60)
    texts = {1: a, 2: a, 3: draw(30) + ". " + b, 4: b, 5: c, 6: c, 7: f"{draw(9)} {inner} {draw(9)}.", 8: f"{draw(40)} {inner} {draw(30)}."}
    found = repeats_of(spark, texts)
    assert {i: t for i, (t, _, _) in found.items() if i not in (7, 8)} == {1: a, 2: "", 3: texts[3], 4: "", 5: c, 6: ""}
    left = set(found[8][0].split()) & set(inner.split())
    assert found[7][0] == texts[7] and len(left) < 40 and set(texts[8].split()) - set(inner.split()) <= set(found[8][0].split())


def test_hot_runs_take_both_joins(spark, monkeypatch):
    random.seed(4)
    line = " ".join(random.choices("abcdefghijklmnop", k=40))
    texts = {i: f"{i} begins here.\n{line}\n" + " ".join(random.choices("qrstuvw", k=30)) + f" {i}" for i in range(40)}
    texts[90] = texts[7]
    want = brute_repeats(texts)
    for parts in (1, 20, 512):
        monkeypatch.setattr(S, "HOT_PARTS", parts)
        assert repeats_of(spark, texts) == want
