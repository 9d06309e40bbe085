"""Helpers shared by the operators: stage tables, salted joins, components
and vectorised text kernels.

Spark side
----------
``stage_table`` writes a frame once under ``spark.checkpoint.dir`` and reads
it back (a lineage cut that survives lost executors). ``salted_join`` spreads
a hot key over several tasks. ``connected_components`` labels a graph by
repeated contraction; nothing of it reaches the driver but one count a round.

Task side
---------
``doc_chunks`` cuts an Arrow batch into runs of whole documents of about half a
megabyte, so the temporary arrays of the numpy kernels stay bounded. A
document longer than that is one chunk of its own. Words are runs of bytes
outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.session import checkpoint_dir

SPACES = (9, 10, 11, 12, 13, 32)
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------------------
# Spark helpers
# ---------------------------------------------------------------------------

def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex[:12]}")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back with its schema."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def all_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column,
                salts: int = 8, how: str = "inner") -> DataFrame:
    """Join whose left keys may be hot: each left row goes to one of ``salts``
    sub-keys by ``spread``, each right row (few per key) to all of them."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every node that has an edge: (node, component).

    Contraction: each node takes the smallest of itself and its neighbours,
    pointers are followed once, edges are rewritten to the new labels and
    repeated edges and loops dropped, until no edge is left. The minimum is
    pre-aggregated before its shuffle, and joins on hot labels are salted.
    Empty input gives an empty result.
    """
    live = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")) \
        .where(F.col("u") != F.col("v"))
    live = stage_table(live.distinct(), "cc_edges")
    result = None
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        # one pointer jump: p(p(u))
        hop = step.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        step = stage_table(salted_join(step, hop, ["p"], F.col("u"), 4)
                           .select("u", F.least("p", "pp").alias("p")), "cc_jump")
        if result is None:
            result = step.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            result = stage_table(relabel(result, step.withColumnRenamed("u", "node").withColumnRenamed("p", "component"),
                                         F.col("node")), "cc_labels")
        left = step.select("u", F.col("p").alias("pu"))
        right = step.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        live = salted_join(salted_join(live, left, ["u"], F.col("v"), 4), right, ["v"], F.col("u"), 4)
        live = stage_table(live.where("pu != pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
                           .distinct(), "cc_edges")
    if result is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return result


def relabel(rows: DataFrame, labels: DataFrame, spread: Column, column: str = "component") -> DataFrame:
    """``rows`` with the labels in ``column`` replaced where ``labels`` (node,
    component) knows better."""
    to, = fresh(rows, "_to")
    new = labels.select(F.col("node").alias(column), F.col("component").alias(to))
    return salted_join(rows, new, [column], spread, 4, how="left") \
        .withColumn(column, F.coalesce(to, column)).select(*rows.columns)


# ---------------------------------------------------------------------------
# numpy kernels
# ---------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (in uint64 arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i <= n."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        size = max(n + 1, 1 << 16)
        p, q = np.full(size, BASE, np.uint64), np.full(size, _INV, np.uint64)
        p[0] = q[0] = 1
        np.multiply.accumulate(p, out=p)
        np.multiply.accumulate(q, out=q)
        _powers.update(p=p, q=q)
    return _powers["p"], _powers["q"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H[i] = sum over j < i of code(data[j]) * BASE**j, length n + 1."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * p[:len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of data[start:end] from the prefix hash."""
    _, q = powers(len(prefix) - 1)
    return mix64((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64))


def doc_chunks(ids, texts, max_bytes: int = 1 << 19, max_docs: int = 1024
               ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents: (first row, end row, bytes, offsets).

    ``texts`` is an Arrow string or binary array; a null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = pc.fill_null(texts, "")
    else:
        texts = pc.fill_null(texts, b"")
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, i + max_docs, max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1))
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; words never cross documents."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    isw = ~IS_SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, isw[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, isw[1:]
    full = np.flatnonzero(off[1:] > off[:-1])
    before[off[full]] = False
    after[off[full + 1] - 1] = False
    start = np.flatnonzero(isw & ~before)
    end = np.flatnonzero(isw & ~after) + 1
    doc = np.searchsorted(off, start, "right") - 1
    return start, end, doc


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True):
    """(hash, start, end, document) of every word; A-Z are lower-cased first if asked."""
    start, end, doc = word_bounds(data, off)
    prefix = prefix_hash(LOWER[data] if lower else data)
    return range_hash(prefix, start, end), start, end, doc


SET_BITS = 54
_SET_SHIFT = np.uint64(64 - SET_BITS)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document of a chunk (at most 1024
    documents): (document, 54-bit hash), sorted. A document of fewer than k
    words has its whole word sequence as one shingle; one without words none."""
    h, _, _, doc = word_hashes(data, off)
    nd = len(off) - 1
    count = np.bincount(doc, minlength=nd)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    short = np.flatnonzero((count > 0) & (count < k))
    odd = np.uint64(0xD6E8FEB86659FD93)
    m = len(h) - k + 1
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for i in range(k):
            acc = acc * odd + h[i:i + m]
        inside = doc[:m] == doc[k - 1:]
        sh, sd = mix64(acc[inside] + np.uint64(k)), doc[:m][inside]
    else:
        sh, sd = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = count[short] > i
            extra[has] = extra[has] * odd + h[first[short[has]] + i]
        sh = np.concatenate((sh, mix64(extra + count[short].astype(np.uint64))))
        sd = np.concatenate((sd, short))
    key = (sd.astype(np.uint64) << np.uint64(SET_BITS)) | (sh >> _SET_SHIFT)
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(SET_BITS)).astype(np.int64), key & np.uint64(2**SET_BITS - 1)


def char_starts(data: np.ndarray) -> np.ndarray:
    """Code points before each byte (length n + 1), for byte-to-character offsets."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
