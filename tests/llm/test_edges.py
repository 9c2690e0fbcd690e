"""Every query over nulls, empty and long texts, ties, repeated rows, clashing columns, and over empty tables."""

import pytest
import corpus_pipeline
from conftest import CHATS, edge_rows

from lodestack.llm import registry, secrets
from lodestack.llm.common import documents

BY_ROW = ["op3_guess_cost_secrets", "op4_hierarchical_language", "op6_simhash_pigeonhole", "op7_weak_supervision_pii", "op8_suffix_repeats", "op9_bit_plane_output", "op10_quality_ledger"]


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op")) == list(range(1, 11))


@pytest.mark.parametrize("name", registry.queries())
def test_edges(spark, edges, name):
    rows = registry.queries()[name](spark, edges).collect()
    if name in BY_ROW:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in edge_rows())
    elif name.startswith("op5"):
        assert {r.doc_id for r in rows} == {r[0] for r in edge_rows()}
    elif name.startswith("op2"):
        assert len(rows) == len(set(r[:2] + r[3:4] for r in CHATS)) and sum(r.n_rows for r in rows) == len(CHATS)
    elif name.startswith("quality"):
        assert {r.policy for r in rows} == {"base-1", "strict-1"}
    else:
        assert {(r.doc_id, r.item_id) for r in rows} == {(18, 0), (19, 1), (20, 2)}


@pytest.mark.parametrize("name", registry.queries())
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edges(spark, edges, name, stage):
    docs = documents(spark, edges)
    out = stage(spark, docs, edges)
    rows, ids = out.collect(), [r[0] for r in edge_rows()]
    kept = sorted(str(r.doc_id) for r in rows)
    if name != "packing":
        assert out.columns == docs.columns
    if name == "language_id":  # texts without letters go
        assert {r.doc_id for r in rows} <= {r[0] for r in edge_rows() if r[1] and any(c.isalpha() for c in r[1])}
    elif name == "near_dedup":  # one of: no words; the same words in either case; one long text, alone and with more at its ends
        text = {r[0]: r[1] for r in edge_rows()}
        assert len([r for r in rows if not (r.text or "").split()]) == 1 and len([r for r in rows if (r.text or "").lower() == "one two three"]) == 1
        assert len([r for r in rows if text[10] in (r.text or "")]) == 1 and len(kept) < len(ids)
    elif name == "benchmark_decontamination":
        assert kept == sorted(str(i) for i in ids if i not in (18, 19, 20))
    elif name == "secret_scan":
        cost_of = secrets.Guesser(secrets.learn_words(docs))
        assert kept == sorted(map(str, ids)) and all(secrets.scan(r.text, cost_of=cost_of)[0] == [] for r in rows if r.text)
    else:
        assert {r.doc_id for r in rows} == set(ids)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables(spark, empty, name, stage):
    assert stage(spark, documents(spark, empty), empty).collect() == []


def test_pipeline_keeps_what_its_stages_keep(spark, edges):
    """Each document of the result is one that every stage, applied in order to the rows of the one before, keeps; and none is lost."""
    docs = documents(spark, edges)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, edges)
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    got = sorted({(r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.run(spark, edges).collect()})
    assert got == sorted(set(want))
