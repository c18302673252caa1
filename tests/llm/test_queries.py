"""Every query of the subpackage on the smallest tables: against its SQL, or against plain Python where SQL has no form."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import compare, connect  # noqa: E402
from tests.llm.test_duplicates import brute_repeats  # noqa: E402
from tests.llm.test_scoring import brute_base  # noqa: E402
from tidelog.llm.extraction import main_text  # noqa: E402
from tidelog.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in ORACLES:
        assert compare(got, con.sql(ORACLES[name]).to_arrow_table()) == []
    if "doc_id" in got.column_names and "mixing" not in name:
        assert set(got["doc_id"].to_pylist()) == set(range(200))


def test_names_are_the_drivers():
    import __spark_entry__ as entry

    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_base_of_the_language_model(spark, con):
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    want = brute_base(texts)
    for r in QUERIES["op2_pitman_yor"](spark, SF).collect():
        held, n, known, train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score > base


def test_pages(spark, con):
    pages = {i: (u, main_text(h)) for i, u, h in con.sql("SELECT page_id, url, html FROM pages").fetchall()}
    found = QUERIES["op4_html_text"](spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in found} == pages and all(r.n_chars == len(r.text) > 0 for r in found)


def test_repeats(spark, con):
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    want = brute_repeats(texts, longest=60)  # longer spans consist of these
    assert {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in QUERIES["op1_substring_dedup"](spark, SF).collect()} == want


def test_leaks_hold_every_verbatim_item(spark, con):
    docs = con.sql("SELECT doc_id, text FROM documents").fetchall()
    items = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    plain = lambda t: " ".join((t or "").lower().split())
    want = {i: [j for j, x in items if len(x.split()) >= 8 and plain(x) in plain(t)] for i, t in docs}
    found = {r.doc_id: r.item_ids for r in QUERIES["op9_decontamination"](spark, SF).collect()}
    assert all(set(want[i]) <= set(found[i]) for i in want)
    assert sum(map(len, found.values())) <= sum(map(len, want.values())) + 3
