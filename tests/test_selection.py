"""Rows at given ranks against a full sort."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplens.operators import selection as S


def order(row):
    return tuple((v is not None, v) for v in row)


CASES = {
    "numbers": lambda r, i: (r.choice([0, 5, 5, 5, r.randint(0, 400)]), i),
    "hot value": lambda r, i: (Decimal("7.50") if i % 3 else Decimal(r.randint(0, 900)) / 100, f"p{i * 7919 % 3001:05d}"),
    "nulls": lambda r, i: (None if r.random() < .5 else r.randint(-9, 9), f"é{i}" if i % 2 else f"z{i}"),
    "one key": lambda r, i: (1, "same"),
    "two keys": lambda r, i: (1, "a" if i % 3 else "b"),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("most, sample", [(1, 8), (40, 64), (10_000, 64)])
def test_keys_at_any_rank(spark, case, most, sample):
    rnd = random.Random(len(case))
    rows = [CASES[case](rnd, i) for i in range(1500)]
    kinds = {int: "long", str: "string", Decimal: "decimal(12,2)"}
    kind = [kinds[type(next(x[c] for x in rows if x[c] is not None))] for c in (0, 1)]
    df = spark.createDataFrame(rows, f"v {kind[0]}, id {kind[1]}").repartition(3)
    want = sorted(rows, key=order)
    ranks = [0, 1, 2, 375, 750, 751, 1125, 1499, 1500, 1501]
    n, got = S.keys_at(df, ["v", "id"], lambda n: ranks, most=most, sample=sample)
    assert n == 1500 and {r: tuple(k) for r, k in got.items()} == {r: want[r - 1] for r in ranks if 1 <= r <= 1500}


def test_rows_are_not_shuffled(spark):
    df = spark.range(5000).select(F.col("id").alias("pid"), (F.col("id") % 11).alias("v"))
    out = S.with_ntile(df, "v", "pid", 4, "m", most=100, sample=256)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    ref = df.withColumn("m2", F.ntile(4).over(Window.orderBy("v", "pid")))
    assert out.join(ref, "pid").where("m != m2").count() == 0


def test_median_of_nulls_and_pairs(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (4, 3)], "v long, id long")
    assert S.exact_median(df, "v", "id").first()[0] is None
    df = spark.createDataFrame([(None, 1), (4, 3)], "v long, id long")
    assert S.exact_median(df, "v", "id").first()[0] == 4.0
    df = spark.createDataFrame([(3, 1), (4, 3)], "v long, id long")
    assert S.exact_median(df, "v", "id").first()[0] == 3.5
