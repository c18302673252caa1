import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tests.llm.test_words import plain
from tidelog.llm import pitman_yor as P
from tidelog.llm.extraction import main_text, extract_pages, smooth
from tidelog.llm.toxicity import ToxicityModel, fit_toxicity, fold, labelled_sample, score_toxicity


@pytest.fixture(scope="module")
def corpus():
    random.seed(4)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    texts = {}
    for i in range(300):
        w, last = [], "w0"
        for _ in range(random.randint(0, 60)):
            last = "B" + last[1:] if last[0] == "w" and random.random() < 0.5 else random.choices(words, weights)[0]
            w.append(last)
        texts[i] = " ".join(w)
    texts[300], texts[301], texts[302] = None, "", "w1 " * 3000
    return texts


def brute_base(texts):
    tokens = {i: plain(t) + ["\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i in texts if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in tokens.items()}


def test_base_counts_for_any_cut(spark, corpus, monkeypatch):
    df = spark.createDataFrame([(t, i, 1) for i, t in corpus.items()], "text string, doc_id long, score int").repartition(3)
    want, scores = brute_base(corpus), []
    for size in (P.FRAGMENT_BYTES, 9000):  # one fragment; several, with hot contexts
        monkeypatch.setattr(P, "FRAGMENT_BYTES", size)
        found = {r.doc_id: r for r in P.score_texts(df).collect()}
        assert len(found) == len(want)
        for i, (held, n, known, train, base) in want.items():
            r = found[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
            assert r.base_score == pytest.approx(base, rel=1e-9)
        out = [i for i in want if want[i][0]]
        scores.append([sum(getattr(found[i], c) for i in out) for c in ("score", "base_score")])
    for score, base in scores:
        assert base < score < 0
    assert scores[0][0] == pytest.approx(scores[1][0], rel=0.02)


@pytest.mark.parametrize("fragments", [1, 4, 16])
def test_probabilities_after_every_context_add_up_to_one(spark, fragments):
    random.seed(9)
    words = [f"w{i}" for i in range(3000)]
    weights = [3.0, *[1 / i for i in range(2, 3001)]]
    rows = [(i, " ".join(random.choices(words, weights, k=random.randint(1, 300))), i % 10 != 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, text string, train boolean").repartition(4)
    hot = P.hot_contexts(df.select("text"), fragments)
    assert (len(hot) > 0) == (fragments > 1)
    cells, answers = (t.toArrow() for t in P._exchange(df, fragments, hot, 0))
    shares, spare, known, parent, discounts = Counter(), {}, {}, {}, set()
    for n in sorted(set(cells["fragment"].to_pylist())):
        f = P._Fragment(cells.filter(pc.equal(cells["fragment"], n)), P._parents(fragments), hot)
        a = P._Answers(answers.filter(pc.equal(answers["fragment"], n)))
        m = P._Predictive(f, a)
        discounts.add(a.discount)
        for room, share in zip(f.context[f.kind_room], m.share[:-1]):
            shares[room] += share
        for room, s, k in zip(f.context, m.spare, m.known):  # the same in every fragment that holds a part of the context
            assert spare.setdefault(room, s) == pytest.approx(s, abs=1e-9) and known.setdefault(room, k) == k
        parent.update({w: p for w, p, mass in zip(f.words, m.parent, a.mass) if mass > 0})
        rest = a.spare * P.UNKNOWN / (P.STRENGTH + a.customers)
    assert len(discounts) == 1 and sum(parent.values()) + rest == pytest.approx(1, abs=1e-6)
    for room in spare:
        assert (shares[room] + spare[room]) / (P.STRENGTH + known[room]) == pytest.approx(1, abs=1e-6)


def test_scores_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (5, "a b"), (5, "a b")], "doc_id long, text string")
    found = P.score_texts(df).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in found) == [(False, 3), (False, 3), (True, 1), (True, 3)]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    assert P.score_texts(df.limit(0)).count() == 0


def test_seating_keeps_its_counts():
    rng = np.random.default_rng(1)
    count = rng.integers(1, 9, 400)
    count[0] = 500
    room = rng.integers(0, 20, 400).astype(np.int32)
    seats = P.Restaurants(count, room, 20, 0.6, 7)
    parent = np.full(400, 0.05)
    for _ in range(60):
        seats.sweep(parent)
        slots = np.add.reduceat(seats.held > 0, seats.at[:-1])
        assert np.array_equal(slots, seats.tables[seats.kind])
        assert np.array_equal(np.add.reduceat(seats.held, seats.at[:-1]), count[seats.kind])
        assert np.array_equal(np.bincount(room, seats.tables, 20), seats.open)
    assert (seats.tables[count == 1] == 1).all() and (seats.tables <= count).all()


def test_gibbs_reaches_the_exact_table_distribution():
    # one restaurant, one dish with three customers: P(tables) in proportion to known products
    d, t0, h = 0.5, P.STRENGTH, 0.3
    weight = {1: (1 - d) * (2 - d) * h, 2: 3 * (t0 + d) * (1 - d) * h ** 2, 3: (t0 + d) * (t0 + 2 * d) * h ** 3}
    want = sum(k * v for k, v in weight.items()) / sum(weight.values())
    n = 4000  # as many independent restaurants
    seats = P.Restaurants(np.full(n, 3), np.arange(n, dtype=np.int32), n, d, 3)
    parent = np.full(n, h)
    for _ in range(60):
        seats.sweep(parent)
    assert seats.tables.mean() == pytest.approx(want, abs=0.03)


def exact_mean(n, others, d, h):
    """Mean tables of n customers of one dish beside other tables of the restaurant, from the plain recursion over n."""
    logs, t = np.r_[-np.inf, 0.0, np.full(n - 1, -np.inf)], np.arange(n + 1)
    for k in range(1, n):
        with np.errstate(divide="ignore"):
            logs = np.logaddexp(np.r_[-np.inf, logs[:-1]], logs + np.log(np.maximum(k - d * t, 0)))
    logs += t * math.log(h) + np.r_[0, np.cumsum(np.log(P.STRENGTH + d * (others + np.arange(n))))]
    w = np.exp(logs - logs.max())
    return (w * t).sum() / w.sum()


@pytest.mark.parametrize("n, h", [(500, 0.05), (500, 0.002), (40, 0.01), (3000, 0.05)])
def test_frequent_pairs_have_their_tables_after_the_sweeps_of_a_run(n, h):
    rooms, others = 24, 8000
    seats = P.Restaurants(np.full(rooms, n), np.arange(rooms, dtype=np.int32), rooms, 0.8, 3)
    seats.open += others
    tables, _ = seats.average(np.full(rooms, h))
    assert tables.mean() == pytest.approx(exact_mean(n, others, 0.8, h), rel=0.03)


def test_table_weights_above_the_recursion(monkeypatch):
    want = P.Seatings(0.7, np.array([1500])).row(1500)
    monkeypatch.setattr(P, "EXACT", 300)
    assert np.abs(np.diff(P.Seatings(0.7, np.array([2, 1500])).row(1500)) - np.diff(want)).max() < 0.02


def test_folding():
    assert fold("IdІоt 1d10t l0ser, t​rash!").split() == ["idiot", "idiot", "ioser", "trash"]
    assert fold(None) == "  " and fold("É") == " e "


def test_lexicon_matching_and_exceptions(spark):
    model = ToxicityModel({" scum ": 5.0, " vequ": 4.0}, (" pond scum ",), (-3.0, 1.0, 1.0))
    assert model.weigh("SCUM! vequix scummy")[:2] == (9.0, 2)
    assert model.weigh("pond scum, ѕcum")[:2] == (5.0, 1)
    df = spark.createDataFrame([("scum", 1, 2.0), ("", 2, 2.0), (None, None, 2.0), ("fine " * 50_000 + "scum", 4, 2.0)], "text string, doc_id long, toxic_score double")
    found = score_toxicity(df, model).orderBy("doc_id").collect()
    assert [r.toxic_matches for r in found] == [0, 1, 0, 1]
    assert found[1].toxic_score > found[3].toxic_score > found[0].toxic_score == found[2].toxic_score
    assert score_toxicity(df.limit(0), model).count() == 0


def test_toxicity_learns_from_its_part_only(spark):
    random.seed(2)
    words = [f"n{i}" for i in range(100)]
    docs, labels = [], []
    for i in range(600):
        w = [random.choice(words) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            w[random.randrange(30)] = random.choice(["moron", "M0RON", "vile" + random.choice("abcdef")])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1)], "doc_id long, toxic int")
    model = fit_toxicity(labelled_sample(docs, labels))
    assert " moron " in model.weights or any(" moron".startswith(e) for e in model.weights)
    held = score_toxicity(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert sum((r.toxic_score >= 0.3) == (r.toxic == 1) for r in held) / len(held) > 0.97
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert fit_toxicity(labelled_sample(docs, flipped)) == model
    assert fit_toxicity(labelled_sample(docs, labels.limit(0))).weights == {}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>home</a></header><div class="cookie-notice">We use cookies</div>
<div id=main><div class=sidebar><p>Side text that is here for all to read and is rather long.</p></div><div class="post"><h1>Title &amp; more</h1>
<p>Hello <b>wor</b>ld.  This is the first part with a good amount of text &eacute;.<p>Short.<ul><li>one item of text</ul><form><label>Mail</label></form>
<script>var x="</p>";</script><p>Another long paragraph of the article follows with <a href=x>a link</a> in it.</p></div>
<section class="comments"><p>Reader: a long comment about the thing, with many words in it to mislead.</p></section></div><footer>foot</footer></body></html>"""


def test_main_text(spark):
    want = "Title & more Hello world. This is the first part with a good amount of text é. Short. one item of text Another long paragraph of the article follows with a link in it."
    assert main_text(PAGE) == want
    for odd, text in ((None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<p>a<p>b &lt;c", "a b <c"), ("<div>" * 3000 + "deep", "deep")):
        assert main_text(odd) == text
    assert main_text("<![bad x <p>hello").endswith("hello")
    df = spark.createDataFrame([(1, PAGE, "x"), (2, None, "y"), (2, None, "y")], "page_id long, html string, main_text string")
    assert [tuple(r) for r in extract_pages(df).orderBy("page_id").select("page_id", "main_text").collect()] == [(1, want), (2, ""), (2, "")]
    assert extract_pages(df.limit(0)).count() == 0


def test_parts_beside_the_longest_one_stay():
    intro, long, end = ("intro " * 25).strip(), ("long " * 400).strip(), ("end " * 75).strip()
    for page in (f"<body><article><div><p>{intro}</p></div><section><p>{long}</p></section><section><p>{end}</p></section></article></body>",
                 f"<body><article><p>{intro}</p><blockquote><p>{long}</p></blockquote><p>{end}</p></article></body>",
                 f"<body><nav>menu</nav><div><div><p>{intro}</p></div><div><p>{long}</p></div><div><p>{end}</p></div></div><footer>foot</footer></body>",
                 f"<table><tr><td><p>{intro}</p></td><td><p>{long}</p></td></tr><tr><td><p>{end}</p></td></tr></table>"):
        assert main_text(page) == f"{intro} {long} {end}"


def test_form_around_the_page_and_links_of_an_article_stay():
    text = ("word " * 100).strip()
    form = f"<body><form id=aspnetForm><nav>menu</nav><div class=sidebar>side</div><div><p>{text}</p><label>Mail</label></div></form></body>"
    assert main_text(form) == text
    assert main_text(f"<body><form><div class=menu-wrapper><p>{text}</p></div></form></body>") == text
    assert main_text(f"<body><p>{text}</p><form><p>Your name please</p></form></body>") == text
    links = "<ul><li><a href=x>First reference, a book</a><li><a href=y>Second one</a></ul>"
    assert main_text(f"<body><article><p>{text}</p>{links}</article></body>") == f"{text} First reference, a book Second one"
    assert main_text(f"<body>{links}<p>{text}</p></body>") == text


def test_smoothing_keeps_constants():
    assert smooth(np.full(7, 3.0)) == pytest.approx(np.full(7, 3.0))
    assert smooth(np.array([0.0, 0, 9, 0, 0]))[2] == smooth(np.array([0.0, 0, 9, 0, 0])).max()


def test_names_of_page_parts():
    body = "<h1>Head</h1><p>Text of the article that is long enough to be the main part of this page, surely.</p>"
    want = "Head Text of the article that is long enough to be the main part of this page, surely."
    for page in (f'<div class="page with-sidebar">{body}</div>', f'<article class="post tags">{body}</article>',
                 f'<article><div class="article-header"><h1>Head</h1></div>{body[13:]}</article>',
                 f'<div id="nav-top">Menu and more</div><div class=story>{body}</div><div class="ad banner">Buy this thing</div><aside>Aside</aside>',
                 f'<main>{body}<div role=dialog>Sign in</div></main><div id=comments><p>{"First! " * 30}</p></div>'):
        assert main_text(f"<html><body>{page}</body></html>") == want, page
