"""Numbering per group: plain windows, ordered buckets, and both at once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplens.operators.ranking import numbered


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    data = [(rnd.choice(["hot", "hot", "warm", None, f"p{rnd.randint(0, 40)}"]), rnd.choice([None, 1, 2, rnd.randint(0, 90)]), i,
             rnd.choice([None, i])) for i in range(3000)]
    return spark.createDataFrame(data, "person string, t long, id long, v long").cache()


@pytest.mark.parametrize("how", [{}, {"heavy": []}, {"heavy": ["hot"]}, {"heavy": ["hot", "warm", "p3", "nobody"]}, {"buckets": 7}])
def test_equals_one_window(rows, how):
    out = numbered(rows, "person", ["t", "id"], "n", ["v", "t"], **how)
    w = Window.partitionBy("person").orderBy(F.col("t").asc_nulls_first(), "id")
    ref = rows.withColumn("n", F.row_number().over(w)).withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_t", F.lag("t").over(w))
    cols = ["person", "t", "id", "v", "n", "prev_v", "prev_t"]
    assert sorted(map(str, out.select(cols).collect())) == sorted(map(str, ref.select(cols).collect()))
    assert out.columns == cols and dict(out.dtypes)["n"] == "int"


def test_light_groups_need_one_shuffle(rows):
    plan = numbered(rows.where("person like 'p%'"), "person", ["t", "id"], "n", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(person") == 1 and "_bkt" not in plan
