from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.llm import ann, licenses, queries


def test_every_license_line_is_found(spark):
    d = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.license, r.start, r.end) for r in queries.op8_licenses(spark, d).collect()}
    lines = {k: v for k, v in licenses.TEMPLATES.items() if k.endswith("-line") or k == "all-rights-reserved"}
    want = set()
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        for name, line in lines.items():
            body, at = line.rstrip("."), (r.text or "").find(line.rstrip("."))
            while at >= 0:
                want.add((r.doc_id, name, at, at + len(body)))
                at = r.text.find(body, at + 1)
    assert want and got == want


def test_changed_and_partial_texts(spark, hard, make_docs):
    mit = licenses.TEMPLATES["mit-grant"]
    words = mit.split()
    rows = [(1, "é " + mit.upper() + " x"), (2, " ".join(w for i, w in enumerate(words) if i % 12)), (3, " ".join(words[:20])),
            (4, mit + " and " + mit), (5, "the following conditions apply")]
    got = [(r.doc_id, r.license, round(r.coverage, 2)) for r in licenses.find_licenses(make_docs(rows)).orderBy("doc_id", "start").collect()]
    assert got[0] == (1, "mit-grant", 1.0) and got[1][:2] == (2, "mit-grant") and 0.85 < got[1][2] < 1
    assert got[2:] == [(4, "mit-grant", 1.0)] * 2
    first = licenses.find_licenses(make_docs(rows[:1])).first()
    assert ("é " + mit.upper() + " x")[first.start:first.end] == mit.upper().rstrip(":")
    assert licenses.find_licenses(hard).count() == 0
    assert licenses.find_licenses(make_docs([])).count() == 0
    assert licenses.find_licenses(make_docs(rows), {"none": "...", "one": "conditions"}).count() == 5


def test_every_occurrence_is_a_row(spark, make_docs):
    one, mit = "All rights reserved", "Released under the MIT License"
    apache = licenses.TEMPLATES["apache-2.0-header"].rstrip(".")
    rows = [(1, f"{one}. (c) B Inc. {one}.", one, 2), (2, f"{one}. " * 3, one, 3), (3, f"{mit}. " * 4, mit, 4),
            (4, f"{one}. " * 4000, one, 4000), (5, f"{apache}. " * 3, apache, 3)]
    got = licenses.find_licenses(make_docs([r[:2] for r in rows])).collect()
    for i, text, notice, n in rows:
        spans = sorted((r.start, r.end) for r in got if r.doc_id == i and r.end - r.start == len(notice))
        assert len(spans) == n and all(text[a:b] == notice for a, b in spans)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_related_licenses_keep_their_names(spark, make_docs):
    header = licenses.TEMPLATES["gpl-3.0-header"]
    lesser = header.replace("General", "Lesser General")
    rows = [("Licensed under CC BY 4.0", "cc-by-4.0-short"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0-short"),
            ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0-line"), ("Licensed under CC BY-NC-SA 3.0.", "cc-by-nc-sa-3.0-short"),
            ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0-line"),
            (header, "gpl-3.0-header"), (lesser, "lgpl-3.0-header"), (header.replace("version 3", "version 2"), "gpl-2.0-header"),
            (header.replace("General", "Affero General"), "agpl-3.0-header"), (lesser.replace("version 3", "version 2.1"), "lgpl-2.1-header"),
            ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0-line"),
            ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0-line"),
            ("Released under the BSD License.", "bsd-line"), ("Released under the Foo License.", None),
            (licenses.TEMPLATES["bsd-3-clause-conditions"], "bsd-3-clause-conditions"), (licenses.TEMPLATES["bsd-2-clause"], "bsd-2-clause"),
            (licenses.TEMPLATES["mit-text"], "mit-text"), (licenses.TEMPLATES["unlicense"], "unlicense"),
            (licenses.TEMPLATES["apache-2.0-header"], "apache-2.0-header")]
    rows += [(x, n) for n, x in licenses.TEMPLATES.items()]
    got = licenses.find_licenses(make_docs([(i, "é " + t + " x") for i, (t, _) in enumerate(rows)])).collect()
    for i, (text, name) in enumerate(rows):
        assert [r.license for r in got if r.doc_id == i] == ([name] if name else []), text


def common_words(a, b):
    """Longest common subsequence by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_matches_equal_the_full_alignment(make_docs):
    """Notices with words changed, dropped and put in, against the full table of common words."""
    rng = random.Random(8)
    names = ["mit-grant", "apache-2.0-header", "bsd-2-clause", "mit-text"]
    rows = []
    for i in range(60):
        words, out = re.findall(r"[0-9a-z]+", licenses.TEMPLATES[names[i % 4]].lower()), []
        for w in words:
            x = rng.random()
            out += [] if x < 0.02 else ["zz%d" % rng.randrange(99)] if x < 0.04 else [w, "yy"] if x < 0.06 else [w]
        pad = [" ".join(f"q{rng.randrange(999)}" for _ in range(rng.randint(0, 30))) for _ in range(2)]
        rows.append((i, f"{pad[0]} {' '.join(out)} {pad[1]}", names[i % 4], words, out))
    got = licenses.find_licenses(make_docs([r[:2] for r in rows])).collect()
    for i, text, name, words, out in rows:
        r, = [r for r in got if r.doc_id == i]
        assert r.license == name
        assert r.matched_words == common_words(words, text[r.start:r.end].split()) == common_words(words, out)
        assert r.coverage == r.matched_words / len(words)


def test_interrupted_and_cut_notices(spark, make_docs):
    words = licenses.TEMPLATES["mit-grant"].split()
    footer = "Page 3 of 12 printed on 4 May by the records office".split()
    cut, tail = words[:len(words) * 3 // 4], words[len(words) // 4:]
    rows = [(1, words[:30] + footer + words[30:], 1.0, None), (2, cut, 0.75, None), (3, tail, 0.75, None),
            (4, cut + footer * 8 + words, 0.75, 1.0), (5, words[:12] + footer + words[12:40] + footer + words[40:], 1.0, None)]
    docs = make_docs([(i, " ".join(["intro", *w])) for i, w, *_ in rows])
    got = licenses.find_licenses(docs).orderBy("doc_id", "start").collect()
    for i, w, *want in rows:
        mine = [r for r in got if r.doc_id == i]
        assert [r.license for r in mine] == ["mit-grant"] * len([c for c in want if c]), i
        assert [r.coverage for r in mine] == pytest.approx([c for c in want if c], abs=0.03)
        assert mine[0].start == 6 and mine[-1].end >= len(" ".join(["intro", *w])) - 1
    assert licenses.find_licenses(docs, least_words=1000).where("doc_id in (2, 3)").count() == 0


def test_winnowing_meets_every_passage():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 50, 300).astype(np.uint64)
    kept = set(licenses.winnow(h, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(297))


def brute(x, ids, q, k):
    d = np.sqrt(((x - q[1]) ** 2).sum(1))
    d[ids == q[0]] = np.inf
    o = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in o if np.isfinite(d[i])]


def test_recall_and_scores(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in queries.op10_ann(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        want = brute(x, ids, (q, x[ids == q][0]), 10)
        hit += len({v for v, _ in want} & {v for v, _ in got[q]})
        total += len(want)
        assert [s for _, s in got[q]] == sorted(s for _, s in got[q])
        for v, s in got[q]:
            assert s == pytest.approx(np.sqrt(((x[ids == v][0] - x[ids == q][0]) ** 2).sum()), rel=1e-12)
    assert hit >= 0.95 * total


def test_cases(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.standard_normal(4)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(150)] + [(2000, [1.0, -0.0, 0.0, 0.0])]
    rows += [(3000, None), (3001, [0.0] * 4), (3002, [1.0, None, 0.0, 0.0]), (3003, [float("nan")] * 4), (3004, [float("inf")] * 4),
             (3005, [1.0, 2.0]), (None, [1.0] * 4), (3100, []), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "vec_id long, embedding array<double>, score double")
    asked = df.where("vec_id % 100 = 0")
    got = {}
    for r in ann.nearest(df, asked, k=10, shard_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = [r for r in rows[:451]]
    x, ids = np.array([v for _, v in good]), np.array([i for i, _ in good])
    assert set(got) == {0, 100, 200, 1000, 1100, 2000}
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in brute(x, ids, (q, x[ids == q][0]), 10)}) for q in got)
    assert hit >= 0.95 * 60
    assert [v for v, _ in got[2000]] == list(range(1000, 1010)) and [v for v, _ in got[1000]] == list(range(1001, 1011))
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 1.0)]
    assert ann.nearest(few.limit(0), few).count() == 0


def test_lanes_blocks_and_lengths(spark):
    """An index is read once a lane; small batches, lanes and blocks, and vectors of several lengths change nothing."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.standard_normal(4 + 2 * (i % 2))]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    lonely = spark.createDataFrame([(20, [1.0] * 9)], "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 5 = 0").unionByName(lonely.withColumn("vec_id", F.lit(-1).cast("long")))

    def run(**params):
        return sorted(map(tuple, ann.nearest(df, asked, k=5, shard_rows=150, **params).collect()))
    one = run()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert run(lane_rows=50) == one
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r[0] for r in one} == {i for i in range(0, 1200, 5)}
    hit = 0
    for q in range(0, 1200, 5):
        same = [r for r in rows if r[0] % 2 == q % 2]
        x = np.array([v for _, v in same], np.float32).astype(float)
        want = brute(x, np.array([i for i, _ in same]), (q, x[q // 2]), 5)
        hit += len({v for v, _ in want} & {r[2] for r in one if r[0] == q})
    assert hit >= 0.95 * 5 * 240


def test_a_search_measures_each_point_once():
    x = np.random.default_rng(9).standard_normal((3000, 16)).astype(np.float32)
    edges, start = ann.build_graph(x)
    ids, dist, _ = ann.beam_search(x, edges, start, x[:64], 40)
    assert (ids[:, 0] == np.arange(64)).all() and (np.diff(dist, axis=1) >= 0).all()
    assert all(len(set(r.tolist())) == 40 for r in ids)
    d = ((x[ids[5]] - x[5]) ** 2).sum(1)
    assert np.allclose(d, dist[5], atol=1e-3)
