from __future__ import annotations

import re
from collections import Counter

from shoplens.llm import quality, queries


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_counts(hard, documents):
    for df in (hard, documents):
        for r in df.select("text", quality.count_text("text").alias("q")).collect():
            assert tuple(r.q)[:5] == brute(r.text)


def test_query_keeps_good_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op7_quality(spark, d).collect()}
    for r in got.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    labels = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    good = [g.kept for q, g in labels if q == 1 and not g.base_failed]
    bad = [g.kept for q, g in labels if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_em_finds_rule_accuracies():
    import numpy as np
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.8
    right = np.array([0.6, 0.3, 0.5, 0.2, 0.4])
    votes = [tuple(int(v) for v in np.where(rng.random(5) < np.where(y[i], 0.01, right), -1, 0)) for i in range(20000)]
    odds, ratio = quality.fit_votes(sorted(Counter(votes).items()), rules=5)
    post = odds + np.array([sum(ratio[j][v + 1] for j, v in enumerate(x)) for x in votes])
    agree = ((post > 0) == y)[[any(x) or not any(x) for x in votes]].mean()
    assert agree > 0.93 and (ratio[:, 0] < -1).all()


def test_filter_keeps_columns_and_handles_no_rows(hard, make_docs):
    out = quality.keep_good(hard)
    assert out.columns == hard.columns and out.where("doc_id in (1, 2, 3, 4, 5)").count() == 0
    assert quality.keep_good(make_docs([])).count() == 0
