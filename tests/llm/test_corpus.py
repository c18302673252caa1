import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_duplicates import brute
from tidelog.llm.decontam import BATCH_ITEMS, batches, find_leaks, lcs, prepare
from tidelog.llm.mixing import MixTargets, mix_sources, share_out, token_count
from tidelog.llm.packing import FreeSpace, best_fit_decreasing, pack_tokens, segments, write_packed
from tidelog.llm.queries import VOCABULARY
from tidelog.llm.shards import permute, row_at, shard_rows


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 97, 1000])
def test_permutation_and_inverse(spark, n):
    df = spark.range(n).withColumn("p", permute(F.col("id"), n, 3)).withColumn("back", permute(F.col("p"), n, 3, inverse=True))
    found = df.collect()
    assert sorted(r.p for r in found) == list(range(n)) and all(r.back == r.id for r in found)


def test_shards(spark):
    data = [(i % 70 if i % 9 else None, f"t{i % 5}", i % 3) for i in range(500)] + [(3, "same", 0)] * 200
    df = spark.createDataFrame(data, "doc_id long, text string, shard int")
    found = shard_rows(df, 7, ["doc_id"], seed=1).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((a, b) for a, b, _ in data)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 7
    again = shard_rows(df.repartition(3), 7, ["doc_id"], seed=1).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    other = shard_rows(df, 7, ["doc_id"], seed=2).collect()
    assert sorted(map(str, other)) != sorted(map(str, found))
    assert shard_rows(df.limit(0), 7, ["doc_id"]).count() == 0


def test_row_at(spark):
    rows = shard_rows(spark.range(50), 4, ["id"], seed=9).withColumn("n", row_at(F.col("shard"), F.col("slot"), 4, 50, 9)).collect()
    assert all(r.n == r.id for r in rows)


def shares(leaves, weights, budget, epochs):
    """Budgets by repeated sharing: what saturated children cannot take goes to their siblings."""
    out = {}

    def cap(prefix):
        return epochs * sum(t for k, t in leaves.items() if k[:len(prefix)] == prefix)

    def give(prefix, amount):
        if len(prefix) == 2:
            out[prefix] = amount
            return
        kids = sorted({k[:len(prefix) + 1] for k in leaves if k[:len(prefix)] == prefix})
        w = {k: weights[len(prefix)].get(k[-1], 1) for k in kids}
        got, active, left = {}, [k for k in kids if w[k]], amount
        while True:
            total = sum(w[k] for k in active)
            full = [k for k in active if cap(k) * total <= left * w[k]]
            if not full:
                break
            for k in full:
                got[k] = cap(k)
                left -= cap(k)
                active.remove(k)
        for k in active:
            got[k] = min(cap(k), left * w[k] // total)
        for k in kids:
            give(k, got.get(k, 0))

    give((), budget)
    return out


def test_budgets_equal_repeated_sharing(spark):
    random.seed(8)
    for trial in range(4):
        leaves = {(f"d{a}", f"s{b}"): random.choice([0, 5, 40, 300, 2000]) for a in range(4) for b in range(5)}
        weights = [{f"d{a}": random.randint(0, 4) for a in range(4)}, {f"s{b}": random.randint(0, 6) for b in range(5)}]
        budget = random.choice([0, 100, 3000, 10 ** 6])
        targets = MixTargets(budget=budget, max_epochs=2, weights={"a": weights[0], "b": weights[1]})
        df = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "a string, b string, tokens long")
        assert {(r.a, r.b): r.budget for r in share_out(df, ["a", "b"], targets).collect()} == shares(leaves, weights, budget, 2), trial


def test_mixing(spark):
    random.seed(3)
    data = [(i, "w " * random.randint(0, 30), random.choice(["en", "de", None]), random.choice(["s0", "s1"]), i) for i in range(400)]
    data += [(None, "a b c", None, "s0", 0), (7, None, "en", "s1", 0), (7, "a b", "en", "s1", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, mix_epoch int")
    targets = MixTargets(percent=150, max_epochs=3, weights={"lang": {"de": 1000}}, seed=1)
    found = mix_sources(df, ["lang", "source"], targets).collect()
    assert sum(len((r.text or "").split()) for r in found) <= 1.5 * sum(len((x[1] or "").split()) for x in data)
    epochs = defaultdict(set)
    for r in found:
        epochs[r.doc_id, r.text, r.lang, r.source].add(r.mix_epoch)
    assert all(e == set(range(len(e))) and len(e) <= 3 for e in epochs.values())
    assert {len(e) for k, e in epochs.items() if k[2] == "de" and k[1]} == {3}  # the heavy leaves run short
    again = mix_sources(df.repartition(7), ["lang", "source"], targets).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mix_sources(df.limit(0), ["lang", "source"], targets).count() == 0
    assert df.limit(0).select(token_count(F.col("text"))).count() == 0


def test_best_fit_decreasing():
    random.seed(1)
    for width in (1, 7, 64):
        sizes = [random.randint(1, width) for _ in range(300)]
        bins, rest = [], []
        for i in sorted(range(300), key=lambda i: (-sizes[i], i)):  # plain search for the tightest bin
            fits = [b for b in range(len(bins)) if rest[b] >= sizes[i]]
            b = min(fits, key=lambda b: rest[b], default=None)
            if b is None:
                bins.append([])
                rest.append(width)
                b = len(bins) - 1
            bins[b].append(i)
            rest[b] -= sizes[i]
        found = best_fit_decreasing(sizes, width)
        assert sorted(i for b in found for i in b) == list(range(300))
        assert sorted(width - sum(sizes[i] for i in b) for b in found) == sorted(rest)
    assert FreeSpace(5).take(3) is None


def test_packing_round_trip(spark, tmp_path):
    from tidelog.llm.packing import _encoder

    encoder, end = _encoder(VOCABULARY)
    texts = [(1, "hello  world\n"), (2, ""), (3, None), (4, "long text " * 500), (None, "é ñ"), (4, "again"), (5, "x" * 3000)]
    df = spark.createDataFrame([(t, i, 0) for i, t in texts], "text string, doc_id long, piece int").repartition(2)
    written = write_packed(pack_tokens(df, VOCABULARY, width=64), str(tmp_path / "p"))
    found = defaultdict(list)
    used = defaultdict(list)
    for r in segments(written).orderBy("pack", "sequence", "start").collect():
        found[r.doc_id].append((r.piece, np.frombuffer(r.ids, np.uint16).tolist()))
        used[r.pack, r.sequence].append((r.start, r.length))
    for spans in used.values():
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= 64
    for i, t in texts:
        want = [*encoder.encode_ordinary(t or ""), end]
        pieces = [(k, want[a:a + 64]) for k, a in enumerate(range(0, len(want), 64))]
        assert all(p in found[i] for p in pieces)
    assert sum(map(len, found.values())) == sum(-(-(len(encoder.encode_ordinary(t or "")) + 1) // 64) for _, t in texts)
    assert segments(write_packed(pack_tokens(df.limit(0), VOCABULARY), str(tmp_path / "e"))).count() == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 40))
        assert lcs(a, b) == plain_lcs(a.tolist(), b.tolist())


def test_leaks(spark):
    random.seed(6)
    words = [f"q{i}" for i in range(3000)]
    items = [(j, " ".join(random.sample(words, 30)) + ".") for j in range(12)] + [(50, None), (51, ""), (None, "x y z")]
    docs = [(i, " ".join(random.choice(words) for _ in range(150)), "y") for i in range(200)]
    want = {}
    for i, (j, text) in enumerate(items[:12]):
        w = text.split()
        if i % 2:
            w = [x if random.random() > 0.12 else random.choice(words) for x in w]  # a paraphrase
        at = random.randint(0, 100)
        d = docs[i][1].split()
        docs[i] = (i, " ".join(d[:at] + w + d[at:]).upper() if i % 3 == 0 else " ".join(d[:at] + w + d[at:]), "y")
        want[i] = [j]
    docs += [(900, None, "y"), (901, "", "y"), (None, items[3][1], "y"), (0, docs[0][1], "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, leaked_items string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(df, bench).collect()
    assert len(found) == len(docs)
    assert {r.doc_id: r.leaked_items for r in found if r.leaked_items and r.doc_id is not None} == want
    assert [r.leaked_items for r in found if r.doc_id is None] == [[3]]
    # an item that stands in most documents is found in all of them
    spread = df.where("doc_id < 150").select("doc_id", F.concat_ws(" ", "text", F.lit(items[7][1])).alias("text"))
    assert all(7 in r.leaked_items for r in find_leaks(spread.union(df.where("doc_id >= 150").select("doc_id", "text")), bench).where("doc_id < 150").collect())
    assert find_leaks(df, bench.limit(0)).where(F.size("leaked_items") > 0).count() == 0
    assert find_leaks(df.limit(0), bench).count() == 0


def test_batches_count_passages():
    rows = [(1, "a b c"), (2, ""), (3, None), (4, " ".join(f"k{i}" for i in range(64 * 20))), (5, "d e")]
    found = list(batches(rows, 16))
    assert [len(x.ids) for x in found] == [16, 16, 9] and [i for x in found for i in x.ids] == [1] + [4] * 39 + [5]
    for x in found:
        assert max(map(len, x.words)) <= 64 and len(x.vocabulary) == len(np.unique(np.concatenate([x.vocabulary[w] for w in x.words])))
    assert list(batches([(2, ""), (3, None)])) == [] and len(prepare(rows).ids) == 41


def test_long_items_in_several_batches(spark):
    """Excerpts of 100 words from items of 700 words: at least 0.9 are found, clean documents are left alone."""
    random.seed(13)
    words = [f"v{int(20 * random.paretovariate(0.7)) % 6000}" for _ in range(60000)]  # the most frequent word is one in thirty
    draw = lambda n: [random.choice(words) for _ in range(n)]
    items = {j: draw(700) for j in range(30)}
    assert sum(len(x.ids) for x in batches([(j, " ".join(w)) for j, w in items.items()])) > 2 * BATCH_ITEMS
    docs, want = [], {}
    for i in range(240):
        d = draw(120)
        if i < 120:
            j = i % 30
            a = random.randint(0, 600)
            d[60:60] = items[j][a:a + 100]
            want[i] = j
        docs.append((i, " ".join(d)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in items.items()], "item_id long, text string")
    found = {r.doc_id: r.leaked_items for r in find_leaks(df, bench).collect()}
    assert sum(j in found[i] for i, j in want.items()) >= 0.9 * len(want)
    assert sum(len(found[i]) for i in range(120, 240)) == 0


def test_pipeline_equals_plain_python(spark, tmp_path):
    """Stages against set operations in Python, on documents with planted cases."""
    random.seed(11)
    words = [f"z{i}" for i in range(2000)]
    docs = {i: " ".join(random.choice(words) for _ in range(random.randint(20, 90))) for i in range(300)}
    labels = []
    for i in range(0, 120):
        if i % 4 == 0:
            docs[i] += random.choice([" moron", " m0ron"]) * 2
        labels.append((i, 1, int(i % 4 == 0)))
    for i in range(200, 220):
        docs[i] = docs[i - 90] + " extra"
    item = " ".join(random.sample(words, 25))
    for i in (130, 140, 299):
        docs[i] += " " + item
    docs.update({300: None, 301: ""})
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns = now.columns
    clean = {i for i, t in docs.items() if "moron" not in (t or "").replace("0", "o")}
    _, group = brute({i: docs[i] for i in clean})
    one = {i for i in clean if group[i] == i}
    want = [clean, one, one - {130, 140, 299} - {i for i in one if item in (docs[i] or "")}]
    for name, expected in zip(("toxicity", "ngram_join", "decontamination"), want):
        now = stages[name](spark, now, sf)
        assert now.columns == columns
        now.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        assert {r.doc_id for r in now.collect()} == expected, name
    mixed = stages["mixing"](spark, now, sf)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= want[-1]
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_distinct_keeps_unlinked_texts_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(5, a, "s0"), (5, b, "s0"), (5, b, "s1"), (3, b + " more", "s0"), (7, a + " more", "s0"), (8, c, "s0"), (9, c, "s0"),
            (5, None, "s0"), (None, a, "s0"), (6, "", "s0"), (6, "", "s0"), (6, " ", "s0"), (4, None, "s0"), (5, a, "s9")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    found = corpus_pipeline.distinct(spark, docs, "")
    want = {(5, a), (3, b + " more"), (8, c), (5, None), (None, a), (6, ""), (6, " "), (4, None)}
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(want)
    again = corpus_pipeline.distinct(spark, docs.repartition(5, "source"), "")
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, found.collect()))  # of equal texts of one id the same row stays
    assert corpus_pipeline.distinct(spark, docs.where("doc_id > 6"), "").count() == 2


def test_token_count_keeps_only_first_characters(spark):
    texts = ["", None, " ", "a", " a\tbb\n\x0bccc ", "é 日本 😀😀 x😀 \u00a0\x1c", "😀", "w " * 20_000]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", token_count(F.col("text")).alias("n"))
    assert [r.n for r in out.orderBy("i").collect()] == [0, 0, 0, 1, 3, 5, 1, 20_000]
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
