"""Near-duplicates and repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.llm import common, minhash, queries, suffix_dedup
from llm_brute import brute_components, word_set


def families(seed, groups=12, size=9):
    """Chains of texts that drift apart, and texts that share one long passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(words) for _ in range(60)]
    for _ in range(groups):
        text = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        for _ in range(size):
            rows.append(" ".join(text))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(4, 14))]) for _ in range(40)]
    rows += rows[:20]
    rng.shuffle(rows)
    return list(enumerate(rows))


def check(df, rows, k):
    got = minhash.components(df, k=k).collect()
    size, comp = brute_components(rows, k)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (size[r.doc_id], comp[r.doc_id]), r
    return comp


@pytest.mark.parametrize("k", [2, 5])
def test_components_of_families(make_docs, k):
    rows = families(k)
    comp = check(make_docs(rows), rows, k)
    assert len(set(comp.values())) < len(comp) - 50


def test_components_of_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op3_minhash(spark, "/root/testdata/sf0.001").collect()}
    size, comp = brute_components(rows, 2)
    assert got == {i: (size[i], comp[i], comp[i] == i) for i in size}


def test_hard_documents(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    check(hard, rows, 2)
    kept = minhash.drop_near_duplicates(hard, k=5)
    assert kept.columns == hard.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 0 and ids.count(4) == 1 and ids.count(None) == 1 and {1, 2, 3, 7, 9} <= set(ids)


def test_repeated_kept_row_stays_once(make_docs):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B C D E F G"), (3, "other")]
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(make_docs(rows)).collect()) == [1, 3]


def test_no_rows(make_docs):
    assert minhash.components(make_docs([])).count() == 0
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 3, 50, 3000):
        shared = rng.integers(0, 2**54, n, dtype=np.uint64)
        other = rng.integers(0, 2**54, max(1, n // 4), dtype=np.uint64)
        sets = [np.unique(shared), np.unique(np.concatenate((shared, other)))]
        doc = np.repeat([0, 1], [len(s) for s in sets])
        sk = minhash.sketch_sets(doc, np.concatenate(sets), 2)
        assert (sk != minhash._EMPTY).all()
        if n == 3000:
            assert abs((sk[0] == sk[1]).mean() - len(sets[0]) / len(sets[1])) < 0.12


def test_components_of_graphs(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 200)]
    noise = [(rng.randint(400, 460), rng.randint(400, 460)) for _ in range(40)]
    edges = [tuple(rng.sample(e, 2)) for e in chain + star + [n for n in noise if n[0] != n[1]]]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for x in list(parent)}


# --- repeated byte strings --------------------------------------------------

def brute_removed(rows, width=50):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            first.setdefault(b[p:p + width], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            f = first[b[p:p + width]]
            if f is not None and (i is None or f < i):
                gone[p:p + width] = b"\1" * width
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(df, **options):
    out = suffix_dedup.remove_repeats(df, **options)
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return sorted((tuple(r) for r in out.select("doc_id", "n_bytes", cut, F.size("spans"), F.sha2("kept", 256)).collect()), key=str)


def test_removed_bytes_of_documents(spark, documents):
    got = sorted((tuple(r) for r in queries.op9_suffix(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute_removed([(r.doc_id, r.text) for r in documents.collect()])


def test_removed_bytes_of_hard_documents(hard):
    assert removed(hard) == brute_removed([(r.doc_id, r.text) for r in hard.collect()])


def test_removed_bytes_of_spliced_texts(make_docs):
    rows = spliced()
    assert removed(make_docs(rows)) == brute_removed(rows)


def spliced(seed=9, n=150):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcé ") for _ in range(rng.randint(30, 140))) for _ in range(12)] + ["ab" * 60, "x" * 90]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 20):] for _ in range(rng.randint(0, 7)))) for i in range(n)]
    return rows + [(i + 200, t) for i, t in rows[:10]] + [(3, rows[3][1])]


@pytest.mark.parametrize("hot_from", [0, 100])
def test_split_anchors_change_no_result(make_docs, hard, hot_from):
    rows = spliced(11)
    assert removed(make_docs(rows), hot_from=hot_from) == brute_removed(rows)
    assert removed(hard, hot_from=hot_from) == brute_removed([(r.doc_id, r.text) for r in hard.collect()])


def test_a_phrase_between_ever_other_neighbours(make_docs):
    """One 54-byte phrase in 20,000 documents: its anchors are split, the result is exact."""
    rng = random.Random(4)
    phrase = "the committee reserves every right under this clause.."
    rows = [(i, rng.randbytes(30).hex() + phrase + rng.randbytes(30).hex()) for i in range(20000)]
    got = removed(make_docs(rows))
    assert got == brute_removed(rows)
    assert sum(r[2] >= 54 for r in got) == len(rows) - 1        # neighbours may agree by chance, too


def test_sub_groups_of_a_hot_anchor_are_bounded():
    n, per, rng = 40000, 27, np.random.default_rng(3)
    data = rng.integers(0, 256, n * (per + 49)).astype(np.uint8)
    anchor = np.full(n, 12345, np.uint64)
    bits = suffix_dedup.sub_bits(np.full(n, n * per // 8))      # most of them uncounted
    run, at, group, key = suffix_dedup.single_windows(data, np.arange(n) * (per + 49), np.full(n, per), anchor, bits, 50)
    assert len(run) == n * per and len(np.unique(key)) == len(key)
    assert np.unique(group, return_counts=True)[1].max() <= 2 * suffix_dedup.WINDOWS


def test_one_word_over_and_over(make_docs):
    """Long runs of one anchor: texts of a repeated word with other words between."""
    rng = random.Random(6)
    rows = [(i, " ".join("spam" if rng.random() < 0.98 else f"w{rng.randrange(10**6)}" for _ in range(400)))
            for i in range(400)]
    assert removed(make_docs(rows)) == brute_removed(rows)


def test_windows_of_distinct_runs_are_counted():
    anchor = np.array([3, 3, 3, 5, 7, 7], np.uint64)
    count, key = np.array([10, 10, 4, 30, 6, 5]), np.array([1, 1, 2, 9, 4, 8], np.uint64)
    at, windows = suffix_dedup.distinct_windows(count, key, suffix_dedup._heads(anchor), 12)
    assert (at.tolist(), windows.tolist()) == ([0, 1], [14, 30])


def test_slices_hold_each_window_once():
    off = np.array([0, 10, 10, 400, 1000, 1003])
    seen = []
    for a, b, o, d in suffix_dedup.slices(off, 50, size=120):
        for n in range(len(o) - 1):
            seen += [(d + n, a + p) for p in range(o[n], o[n + 1] - 49)]
    want = [(d, p) for d in range(5) for p in range(off[d], off[d + 1] - 49)]
    assert sorted(seen) == want


def test_suffix_sort_reads_each_word_once():
    """Sorting reads each suffix's bytes at most once, eight at a time, however many are equal."""
    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            Counted.read += np.size(at)
            return np.asarray(self)[at]
    rng = np.random.default_rng(3)
    data = np.concatenate([np.tile(rng.integers(97, 99, 90), 30), rng.integers(97, 123, 2000)]).astype(np.uint8)
    at = rng.permutation(len(data) - 49)[:4000]
    s = suffix_dedup.Suffixes(data, 50)
    s.eight = s.eight.view(Counted)
    order = s.sort(at, np.zeros(len(at), np.int64))
    raw = data.tobytes()
    got = [raw[at[i]:at[i] + 50] for i in order]
    assert got == sorted(got) and sorted(order) == list(range(len(at)))
    assert 0 < Counted.read <= 7 * len(at)


def test_suffix_sort_orders_groups():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    at = rng.integers(0, 340, 150)
    group = np.sort(rng.integers(0, 7, 150))
    s = suffix_dedup.Suffixes(data, 50)
    order = s.sort(at, group)
    raw = data.tobytes()
    assert sorted(order) == list(range(150))
    got = [(group[i], raw[at[i]:at[i] + 50]) for i in order]
    assert got == sorted(got)
    common_len = s.common(at[:-1], at[1:])
    for x, y, n in zip(at[:-1], at[1:], common_len, strict=True):
        want = next((i for i in range(50) if raw[x + i] != raw[y + i]), 50)
        assert n == want
