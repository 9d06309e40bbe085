"""Collocations against a plain count of all n-grams."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoplens.llm import common, phrases


def plain(rows, minimum, longest=4, absorb=80, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) over (text, lang) rows."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= minimum}
    gone = set()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, w[i:i + k])
                if 100 * a >= absorb * cand[part]:
                    gone.add(part)
    out = []
    for lang in n:
        rows = []
        for (x, w), a in cand.items():
            if x == lang and (x, w) not in gone:
                s, _, l, r = min((2000000 * a // (f[x, w[:k]] + f[x, w[k:]]), k, f[x, w[:k]], f[x, w[k:]]) for k in range(1, len(w)))
                rows.append((-s, -a, " ".join(w).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def made(df, **more):
    return sorted(map(tuple, phrases.collocations(df, **more).collect()))


def texts(seed, count=80, vocabulary=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "Über", "x.y", "a,b", "\xa0", "the", "THE"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for _ in range(count):
        body = rng.choices(words, weights, k=rng.randint(0, 60))
        if rng.random() < .4:
            body += ["red", "green", "blue", "sky"] * rng.randint(1, 3)
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", "\n", ". ", "!"]) for w in body))
    return out


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_against_plain_counts(spark, chunk):
    """Chunks of a few hundred bytes: every phrase is stated by many of them."""
    rng = random.Random(5)
    rows = [(t, rng.choice(["en", "de", None, "und", ""])) for t in texts(1)]
    rows += [(None, "en"), ("", "xx"), (" . \t", "yy")] + [("red green blue", "en")] * 9
    df = spark.createDataFrame([(t, l, "x", 1) for t, l in rows], "text string, lang string, phrase string, chunk int").repartition(5)
    assert made(df, minimum=5, chunk_bytes=chunk) == plain(rows, 5)
    assert made(df, minimum=5, top=3, chunk_bytes=chunk) == plain(rows, 5, top=3)
    assert made(df, minimum=4, longest=3, absorb=50, chunk_bytes=chunk) == plain(rows, 4, 3, 50)


def test_overlaps_and_pieces(spark):
    rows = [("a a a a", "en"), ("a a. a a", "en"), ("a\na", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = {r[2]: r[3] for r in made(df, minimum=1, absorb=1000)}
    assert got == {"a a": 5, "a a a": 2, "a a a a": 1}


def test_long_text_and_words(spark):
    rows = [("alpha beta " * 40_000, "en"), ("z" * 300_000 + " alpha beta", "en"), ("q" * 300_000, "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert made(df, minimum=30, chunk_bytes=1 << 16) == plain(rows, 30)


def test_no_rows_and_no_phrases(spark, hard):
    none = spark.createDataFrame([], "text string, lang string")
    assert made(none) == []
    assert made(spark.createDataFrame([("a b", "en")], "text string, lang string")) == []
    rows = [(r.text, r.lang) for r in hard.collect()]
    assert made(hard, minimum=2) == plain(rows, 2)


def test_products_beyond_64_bits(spark):
    big = 9 * 10**18 // 5
    df = spark.createDataFrame([(big, [big], [big + 1])], "a long, pre array<long>, suf array<long>")
    r = df.select(phrases.weakest_cut(2).alias("c")).first().c
    assert r.score == 2000000 * big // (2 * big + 1) and (r.l, r.r) == (big, big + 1)


def test_one_statement_a_chunk(spark):
    """A phrase in half of all places meets as one row a chunk."""
    df = spark.createDataFrame([("hot pair " * 500, "en")] * 40, "text string, lang string").repartition(4)
    rel = common.stage_table(phrases.occurrences(df, chunk_bytes=20_000), "test_relation")
    chunks = rel.count()
    rows = phrases._statements(rel, "words", also=("lang",)).groupBy("words").count().collect()
    assert {r["count"] for r in rows} == {chunks} and chunks > 4
    assert rel.agg(F.sum("n")).first()[0] == 40_000


def test_statements_of_pairs_are_packed(spark):
    """Statements of pairs meet whole and are summed exactly, in under ten bytes each (four numbers of eight before)."""
    import numpy as np
    rng = np.random.default_rng(5)
    ids = (rng.integers(0, 3, 400) << 32) + rng.integers(0, 60_000, 400)
    rows, want = [], {}
    for chunk in (0, 1, 5, (1 << 31) - 1):
        pairs = sorted({(int(a), int(b)) for a, b in rng.choice(ids, (20_000, 2))})
        counts = [int(c) for c in rng.geometric(0.5, len(pairs))]
        rows.append((chunk, [p[0] for p in pairs], [p[1] for p in pairs], counts))
        for code, (p, c) in enumerate(zip(pairs, counts, strict=True)):
            want.setdefault(p, []).append(((chunk << 32) + code, c))
    rows.append((7, [], [], []))
    rel = spark.createDataFrame(rows, "chunk long, lefts array<long>, rights array<long>, counts array<long>")
    sent = rel.mapInArrow(phrases._stated_rows(6), phrases.PACKED)
    size = sent.agg(F.sum(F.length("body"))).first()[0]
    assert size < 10 * sum(map(len, want.values()))
    kept = {p: (min(x)[0], sum(c for _, c in x), x) for p, x in want.items() if sum(c for _, c in x) >= 6}
    first = {(i >> 32, i, *p, a) for p, (i, a, _) in kept.items()}
    told = {(at, i) for i, _, x in kept.values() for at, _ in x}
    for replies in (True, False):
        got = phrases._frequent_longer(rel, 6, replies, "test_kept").collect()
        new = [(r["at"], *x) for r in got for x in zip(r["id"], r["lefts"], r["rights"], r["a"], strict=True)]
        assert len(new) == len(first) and set(new) == first
        back = []
        for r in got:
            assert (r["body"] is not None) == replies
            if replies:
                steps, ids = phrases.unpack(r["body"])
                back += zip(((r["at"] << 32) + np.cumsum(steps, dtype=np.int64)).tolist(), ids.tolist(), strict=True)
        assert len(back) == replies * len(told) and set(back) == (told if replies else set())
