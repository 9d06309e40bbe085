from __future__ import annotations

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shoplens.llm import common, queries
from llm_brute import brute_components


@pytest.fixture(scope="module")
def stages(spark):
    d, out = "/root/testdata/sf0.001", [("documents", spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, common.stage_table(stage(spark, out[-1][1], d), "test")))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in stages[1:]] == ["quality rules", "near duplicates", "secret scans", "mixing", "packing"]
    assert all(df.columns == stages[0][1].columns for _, df in stages[1:-1])


def test_quality_agrees_with_its_query(spark, stages):
    kept = {r.doc_id for r in queries.op7_quality(spark, "/root/testdata/sf0.001").where("kept").collect()}
    assert {r.doc_id for r in stages[1][1].collect()} == kept


def test_one_document_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1][1].collect()]
    _, comp = brute_components(rows, 5)
    assert sorted(r.doc_id for r in stages[2][1].collect()) == sorted(i for i in comp if comp[i] == i)


def test_secrets_are_gone(stages):
    before = {r.doc_id: r for r in stages[2][1].collect()}
    after = {r.doc_id: r for r in stages[3][1].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password)\s*[:=]\s*[A-Za-z0-9]{6}", r.text)
        if r.text == before[i].text:
            assert r.n_chars == before[i].n_chars
        else:
            assert r.n_chars == len(r.text) and "[SECRET]" in r.text


def test_mix_keeps_the_number_of_tokens(stages):
    words = [df.select(F.sum(queries.mixing.count_tokens("text"))).first()[0] for _, df in stages[3:5]]
    assert words[1] <= words[0]
    assert stages[4][1].join(stages[3][1], "doc_id", "left_anti").count() == 0


def test_packing_holds_every_mixed_row(stages):
    mixed, pieces = stages[4][1], stages[5][1]
    assert pieces.where("start = 0").count() == mixed.count()
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    keys = ["doc_id", "start", "length"]
    assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, stages[5][1].select(*keys).collect()))
