"""The pipeline, stage by stage, against brute force on a small table."""

import pytest

from hourglass.llm import pii
from hourglass.llm.common import Scratch, read_table

from .test_groups import brute_components, brute_kept
from .test_text_rows import base_pii, check_packing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    scratch, docs = Scratch(spark, "test-pipeline"), read_table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r.asDict() for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.put(stage(spark, docs, SF), name)
        rows = docs.collect()
        if name == "packing":
            check_packing(rows, [(i, r["text"]) for i, r in before.items()], 2048)
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.asDict() for r in rows}
        texts = [(i, r["text"]) for i, r in before.items()]
        if name == "quality":
            labels = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
            known = [i for i in before if i in labels]
            assert sum((i in after) == bool(labels[i]) for i in known) / len(known) > 0.95
            assert all(after[i] == before[i] for i in after)
        elif name == "near_duplicates":
            u = brute_components(texts)
            assert set(after) == {u.find(i) for i in before} and all(after[i] == before[i] for i in after)
        elif name == "repeated_passages":
            want = {i: kept if gone else before[i]["text"] for i, n, gone, _, kept in brute_kept(texts, 50) if not gone or kept}
            assert {i: r["text"] for i, r in after.items()} == want
        else:
            for i, t in texts:
                if not base_pii(t):
                    assert pii.find_spans(t) or after[i]["text"] == t
                else:
                    assert after[i]["text"] != t
                assert after[i]["n_chars"] == len(after[i]["text"])
        before = after


def test_run_is_registered_and_equals_its_stages(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_on_hard_rows_and_empty_tables(spark):
    """Nulls, empty and long texts, repeated rows and clashing names: every stage keeps the columns and the clean rows."""
    from .conftest import HARD, docs_frame
    rows = HARD + [(20, "write to a@b.example or 10.1.2.3 today"), (20, "write to a@b.example or 10.1.2.3 today")]
    for docs in (docs_frame(spark, rows, extra=True), docs_frame(spark, [], extra=True)):
        empty = docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            got = out.collect()
            assert (not got) if empty else any(r.doc_id == 20 for r in got), name
            assert all(r.spans == r.id == r.score == r.row == "x" for r in got), name
            if name == "near_duplicates" and not empty:
                assert sorted(r.doc_id for r in got if r.doc_id in (7, 8)) == [7]
            if name == "personal_data" and not empty:
                assert all("a@b" not in (r.text or "") and "10.1.2.3" not in (r.text or "") for r in got)
                assert all(r.n_chars == len(r.text) for r in got if r.text)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert (not pieces) if empty else {r.doc_id for r in pieces} == {i for i, _ in rows}
