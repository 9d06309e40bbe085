"""The chain against brute force, and held-out accuracy on the driver's labels."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoplens.llm import common, queries, toxicity

KEYS = np.array([1, 2, 3], np.uint64)


def chain(seed):
    rng = np.random.default_rng(seed)
    return toxicity.Chain(KEYS, rng.normal(0, 1, 3), -1.0, rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2))


def by_paths(c, odds, fresh):
    """Marginals from the weight of every state sequence."""
    n, total, ones = len(odds), 0.0, np.zeros(len(odds))
    for path in itertools.product((0, 1), repeat=n):
        w = 0.0
        for t, s in enumerate(path):
            w += odds[t] * s + (c.first[s] if fresh[t] else c.moves[path[t - 1], s])
        total += np.exp(w)
        ones += np.exp(w) * np.array(path)
    return ones / total


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 11])
def test_marginals_equal_all_paths(n):
    for seed in range(4):
        rng = np.random.default_rng(seed + n)
        odds, fresh = rng.normal(0, 2, n), rng.random(n) < .3
        fresh[0] = True
        c = chain(seed)
        assert np.allclose(c.marginals(odds, fresh), by_paths(c, odds, fresh))


def test_documents_of_a_chunk_do_not_meet():
    rng = np.random.default_rng(1)
    c, parts = chain(2), [rng.normal(0, 2, k) for k in (1, 30, 7, 400)]
    fresh = np.concatenate([np.arange(len(p)) == 0 for p in parts])
    alone = np.concatenate([c.marginals(p, np.arange(len(p)) == 0) for p in parts])
    assert np.allclose(c.marginals(np.concatenate(parts), fresh), alone)


def test_long_chain_stays_finite():
    rng = np.random.default_rng(3)
    odds = rng.normal(-8, 12, 200_000)
    p = chain(1).marginals(odds, np.arange(len(odds)) == 0)
    assert np.isfinite(p).all() and (p >= 0).all() and (p <= 1).all()


def made_up(count=400, seed=0):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    bad = ["Grumpf", "schnarkel", "schnarkelig", "schnarkelte"]
    rows = []
    for i in range(count):
        toxic = int(rng.random() < .2)
        w = rng.choices(plain, k=rng.randint(20, 80))
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), toxic))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = made_up()
    docs = spark.createDataFrame([(i, t, "x", 1.0, "y") for i, t, _ in rows], "doc_id long, text string, sig string, score double, word string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    return docs, labels, toxicity.learn_chain(docs, labels, lambda i: i % 4 != 2)


def test_words_and_stems_are_found(spark, learned):
    docs, labels, model = learned
    out = toxicity.score_documents(docs.select("doc_id", "text", "word"), model).join(labels, "doc_id").where("doc_id % 4 = 2").collect()
    assert len(out) == 100 and all((r.score >= .3) == r.toxic for r in out)
    for r in out:
        found = {r.text[int(a):int(b)].split(" ")[0] for a, b in (s.split(":") for s in r.spans.split(",") if s)}
        assert found <= {"Grumpf", "schnarkel", "schnarkelig", "schnarkelte"} and bool(found) == bool(r.toxic)


def test_hard_texts(spark, learned):
    model = learned[2]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "word1 schnarkel " * 100_000), (5, "x" * 300_000), (None, "schnarkel grumpf"),
            (6, "ÉÉ 　😀 GRUMPF! é schnarkelig, schnarkelte."), (6, "ÉÉ 　😀 GRUMPF! é schnarkelig, schnarkelte.")]
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score < .3 and by[1].spans == ""
    assert by[4].score > .9 and by[None].score > .3
    assert [by[6].text[int(a):int(b)] for a, b in (s.split(":") for s in by[6].spans.split(","))] == ["GRUMPF", "schnarkelig, schnarkelte"]
    assert toxicity.score_documents(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_one_kind_of_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, score in (([], 0.0), ([(1, 0), (2, None)], 0.0), ([(1, 1), (1, 0)], 1.0)):
        lab = spark.createDataFrame(labels, "doc_id long, toxic int")
        model = toxicity.learn_chain(docs, lab, lambda i: i > 0)
        assert [r.score for r in toxicity.score_documents(docs, model).collect()] == [score, score]


def test_copies_weigh_one(spark):
    text = " ".join(f"copied{i}" for i in range(50))
    docs = spark.createDataFrame([(i, text) for i in range(40)] + [(100, "other words of its own"), (101, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(40)] + [(100, 1), (101, 0)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, lambda i: i >= 0).collect()
    total = {y: round(sum(r.weight for r in rows if r.toxic == y), 6) for y in (0, 1)}
    assert len(rows) == 42 and total == {0: 2.0, 1: 2.0}


def test_feature_counts_are_complete(spark):
    rows = [("red Red fish", 1, 1.0), ("fish blue", 0, 0.5), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "text string, toxic int, weight double")
    got = df.mapInArrow(toxicity._statistics, toxicity.STATISTIC).groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).collect()
    by = {r.feature: (r.t, r.o) for r in got}
    data = np.frombuffer(b"red fish blue", np.uint8)
    h = next(toxicity.features(data, np.array([0, 4, 9]), np.array([3, 8, 13])))[1].view(np.int64).tolist()
    assert [by[x] for x in h] == [(1.0, 0.0), (1.0, 0.5), (0.0, 0.5)]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op13_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n.get((1, 1), 0) >= .6 * (n.get((1, 1), 0) + n.get((1, 0), 0))     # 36 toxic training documents, four languages
    assert n.get((0, 1), 0) <= .05 * n[0, 0]
    assert common.doc_chunks(None, pa.array([], pa.string())) is not None
