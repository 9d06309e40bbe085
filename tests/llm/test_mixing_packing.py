from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shoplens.llm import mixing, packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def water(budget, nodes):
    """Exact capped shares (Fractions) of {name: (weight, cap)}."""
    got, open_ = {n: Fraction(0) for n in nodes}, dict(nodes)
    left = Fraction(budget)
    while open_:
        w = sum(x for x, _ in open_.values())
        short = [n for n, (x, c) in open_.items() if left * x / w >= c]
        if not short:
            return {**got, **{n: left * x / w for n, (x, _) in open_.items()}}
        for n in short:
            got[n] = Fraction(open_[n][1])
            left -= open_.pop(n)[1]
    return got


def test_budgets_follow_the_tree(spark):
    rows = [("a", "x", "s1", 100), ("a", "x", "s2", 5), ("a", "y", "s1", 50), ("b", "x", "s3", 3), ("b", None, "s4", 7),
            (None, "x", None, 1000)]
    leaves = spark.createDataFrame(rows, "d string, l string, s string, tokens long")
    for budget in (0, 1, 10, 97, 500, 2330, 10**6):
        got = {(r.d, r.l, r.s): r.budget for r in mixing.leaf_budgets(
            leaves, ["d", "l", "s"], budget, {"d": F.when(F.col("d") == "a", 3).otherwise(1)}, 2).collect()}
        caps = {r[:3]: 2 * r[3] for r in rows}
        assert sum(got.values()) == min(budget, sum(caps.values()))
        assert all(got[k] <= caps[k] for k in got)

        def down(prefix, amount):
            kids = sorted({k[len(prefix)] for k in caps if k[:len(prefix)] == prefix}, key=str)
            nodes = {n: (3 if not prefix and n == "a" else 1, sum(c for k, c in caps.items() if k[:len(prefix) + 1] == (*prefix, n)))
                     for n in kids}
            for n, share in water(amount, nodes).items():
                have = sum(v for k, v in got.items() if k[:len(prefix) + 1] == (*prefix, n))
                assert abs(have - share) <= 1, (budget, prefix, n, have, share)
                if len(prefix) < 2:
                    down((*prefix, n), have)
        down((), min(budget, sum(caps.values())))


def test_prefix_of_seeded_epochs(spark):
    rows = [(i, "big" if i % 3 else "small", 1 + i % 7) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, leaf string, tokens long")
    made = mixing.plan(docs, ["leaf"], 9000, None, 2, seed=5, range_rows=64)
    plan = {r.leaf: r for r in made.collect()}
    got = defaultdict(dict)
    for r in mixing.take(docs, made, ["leaf"], seed=5).collect():
        got[r.leaf, r.epoch][r.doc_id] = (r.tokens, r.taken)
    for leaf, p in plan.items():
        mine = [(i, t) for i, x, t in rows if x == leaf]
        assert sum(taken for (x, _), d in got.items() if x == leaf for _, taken in d.values()) == p.budget
        for e in range(p.full):
            assert {i: t for i, t in mine} == {i: taken for i, (_, taken) in got[leaf, e].items()}
        place = {i: int(hashlib.md5(f"5:{p.full}:{i}".encode()).hexdigest()[:15], 16) for i, _ in mine}
        left = p.budget - p.full * sum(t for _, t in mine)
        want = {}
        for i, t in sorted(mine, key=lambda x: (place[x[0]], x[0])):
            if left > 0:
                want[i] = (t, min(t, left))
                left -= t
        assert got.get((leaf, p.full), {}) == want


def test_mix_of_hard_documents(hard, make_docs):
    levels = {"kind2": F.lit("k"), "lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(hard, levels, 100, None, 2)
    assert out.columns == hard.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect())
    assert 95 <= words <= 105
    assert mixing.mix(make_docs([]), levels, 0.5).count() == 0


def test_text_prefix(spark):
    df = spark.createDataFrame([(" a  b\tc d ", 2), ("a b", 2), ("é 　x y", 1)], "t string, n long")
    got = [r[0] for r in df.select(mixing.text_prefix(F.col("t"), F.col("n"), mixing.count_tokens("t"))).collect()]
    assert got == [" a  b", "a b", "é"]


def test_mix_query_hits_the_weights(spark):
    got = queries.op4_mixing(spark, "/root/testdata/sf0.01")
    total = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.sum(mixing.count_tokens("text"))).first()[0]
    by = {r.domain: r.t for r in got.groupBy("domain").agg(F.sum("taken").alias("t")).collect()}
    assert sum(by.values()) == total * 500_000 // 1_000_000
    assert got.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0


# --- packing ----------------------------------------------------------------

def check_pieces(rows, pieces):
    tok = Tokenizer.from_file(PATH)
    ids = [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for i, t in rows]
    want = Counter((i, x.tobytes()) for i, x in ids)
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for (i, body), copies in want.items():
        mine = sorted((p for p in by[i] if p.doc_tokens == len(body) // 4), key=lambda p: p.start)
        spans = Counter()
        for p in mine:
            spans.update(range(p.start, p.start + p.length))
            assert zlib.crc32(body[4 * p.start:4 * (p.start + p.length)]) == p.ids_crc32
        assert spans == Counter({k: copies for k in range(len(body) // 4)})
    lengths, seq = Counter(), defaultdict(list)
    for p in pieces:
        seq[p.sequence_id].append(p)
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        lengths[at] += 1
    assert all(n <= 1024 and n & (n - 1) == 0 for n in lengths)


def crc(df):
    return df.withColumn("ids_crc32", F.crc32("ids")).collect()


def test_pieces_of_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check_pieces(rows, queries.op6_packing(spark, "/root/testdata/sf0.001").collect())


def test_pieces_of_hard_documents(hard, make_docs):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    check_pieces(rows, crc(packing.pack_documents(hard, PATH)))
    assert packing.pack_documents(make_docs([]), PATH).count() == 0


def test_encoder_equals_the_library():
    e, tok = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    assert e.fast is not None
    for t in ["a  b", "a \n b", "  x", "x ", "\n\n b", " ", "", "é à　b  c", "<|endoftext|> a <|endoftext|>",
              "don't we'll  I'm 12 34", "a\x1c b", "😀 日本語", "a" * 3000]:
        assert np.frombuffer(e(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
    cells = np.stack(axes, -1).reshape(-1, dims)
    key = packing.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_copies_are_neighbours(spark):
    rows = [(i, f"topic{i % 5} " * 30 + f"id{i}") for i in range(200)]
    keys = [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").select(packing.curve_key("text")).collect()]
    order = sorted(range(200), key=lambda i: (keys[i], i))
    switches = sum(order[i] % 5 != order[i + 1] % 5 for i in range(199))
    assert switches < 40
