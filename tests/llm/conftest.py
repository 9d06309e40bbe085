from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text) pairs, with columns whose names the operators also use inside."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en" if i is None or i % 2 else None, None if i is None or i % 3 == 0 else f"s{i % 2}",
              None if t is None else len(t), 1, "x", 2) for i, t in rows],
            DOCS + ", _q int, kind string, tokens int")
    return make


HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here"), (6, "two words"),
        (7, "a" * 20_000), (8, "word " * 30_000), (9, "x\x00y 　é😀 z"), (10, "\n".join(["same line here"] * 50))]


@pytest.fixture
def hard(make_docs):
    return make_docs(HARD)
