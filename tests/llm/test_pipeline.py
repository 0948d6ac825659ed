"""The stages of the pipeline on a small table against plain versions, and on odd tables."""

from __future__ import annotations

import pytest

import corpus_pipeline as cp
from ripplegraph.llm.common import KEY, row_key, table
from ripplegraph.session import materialize
from tests.llm.conftest import EDGES, prose
from tests.llm.test_decontam_topk_quality import leaks
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "near-dedup", "decontamination", "best-fit packing"]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}

    good = materialize(stage["quality classifier"](spark, docs, SF), "t")
    kept = {r[0] for r in rows_of(good)}
    assert good.columns == docs.columns and sum(labels[i] == 1 for i in labels if i in kept) >= 0.95 * sum(labels.values())

    lines = materialize(stage["line dedup"](spark, good, SF), "t")
    assert lines.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = materialize(stage["near-dedup"](spark, lines, SF), "t")
    assert {r[0] for r in rows_of(near)} == {i for i, (_, c) in brute(rows_of(lines)).items() if c == i} and near.columns == docs.columns

    clean = materialize(stage["decontamination"](spark, near, SF), "t")
    bench = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert {r[0] for r in rows_of(clean)} == {r[0] for r in leaks(rows_of(near), bench) if not r[2]} and clean.columns == docs.columns

    packed = materialize(stage["best-fit packing"](spark, clean, SF), "t").collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows_of(clean)}
    assert sorted(map(repr, cp.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(repr(r) for r in spark.createDataFrame(packed).drop("sequence_id", "offset").collect())


@pytest.mark.parametrize("rows", [EDGES, []], ids=["edges", "empty"])
def test_stages_on_odd_tables(spark, make_docs, rows):
    docs = materialize(make_docs(rows), "t")
    for name, f in cp.STAGES:
        out = materialize(f(spark, docs, SF), "t")
        if name != "best-fit packing":
            assert out.columns == docs.columns
            docs = out
    assert out.count() >= docs.count()


def test_copies_that_fill_a_source_leave_one(spark, make_docs):
    copy = "\n".join(prose(50 + i, 12) for i in range(4))
    rows = [(i, copy + "\n\n", "en", "s1") for i in range(10)] + [(100 + i, f"{prose(100 + i, 30)}\nshared end", "en", "s1") for i in range(20)]
    rows += [(200 + i, copy[:40], "en", "small") for i in range(3)]
    docs = materialize(make_docs(rows), "t")
    lines = materialize(cp.line_stage(spark, docs, SF), "t")
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert got == {i: t.removesuffix("\nshared end") for i, t, *_ in rows} and all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = {r["doc_id"] for r in cp.near_stage(spark, lines, SF).collect()}
    assert len(near & set(range(10))) == 1 and len(near & {200, 201, 202}) == 1 and set(range(100, 120)) <= near


def test_key_is_by_content(make_docs):
    got = {(r["doc_id"], r["text"]): bytes(r[KEY]) for r in make_docs(EDGES).withColumn(KEY, row_key("doc_id", "text")).collect()}
    assert len(set(got.values())) == len({(r[0], r[1]) for r in EDGES})
