"""Near-duplicate groups by fast similarity sketching, banding and exact checks.

Sketch: coordinates are bins. In round i every shingle is hashed to a bin and
a value that lies above all values of earlier rounds; a bin keeps its smallest
value. Rounds go on until every bin is filled; after as many rounds as there
are bins, round t + b places all shingles in bin b, so two t rounds always
suffice. Long documents fill their bins in the first round or two, which costs
one hash a shingle instead of one a coordinate, and the share of equal bins
concentrates around the Jaccard similarity.

Banding: ``bands`` keys of ``rows`` coordinates each; documents that share a
key are candidates. At the threshold of 0.8, 32 bands of 4 miss a pair with
probability (1 - 0.8**4)**32, below 5e-8.

Verification: documents with equal shingle sets are one class, represented by
their smallest id. In each bucket every representative is compared with one
centre, the smallest id, on the full sets; confirmed links give components.
Members of buckets that are then still in several components are compared with
each other where they share one of their rarest shingles, which every pair at
the threshold does (prefix filtering): so every pair that shares a key is
confirmed, refuted, or already connected, and no bucket is expanded into all
its pairs. All comparisons of one centre are dealt to groups of about
``GROUP`` members.

Defined cases: a null or empty text, or one without words, has the empty set,
is linked with nothing and is its own component; a text of fewer words than a
shingle has its whole sequence as one; rows that repeat an id (and so its
text) are one node and get equal results; a row without an id takes no part in
links; an empty table gives an empty result; extra columns are ignored by
``components`` and carried along by ``drop_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import (
    SET_BITS,
    connected_components,
    doc_chunks,
    fresh,
    mix64,
    relabel,
    salted_join,
    shingle_sets,
    stage_table,
)

BINS, BANDS, ROWS, GROUP = 128, 32, 4, 256
SKETCH = "n_shingles long, s1 long, s2 long, bands array<long>"
_EMPTY = np.uint64(2**64 - 1)


def sketch_sets(doc: np.ndarray, h: np.ndarray, docs: int, bins: int = BINS) -> np.ndarray:
    """Filled sketch (docs x bins) of the sets given as sorted (document, hash)
    pairs; documents without elements keep the empty value."""
    out = np.full(docs * bins, _EMPTY, np.uint64)
    bits = np.uint64(bins - 1)
    low = np.uint64(14)
    for i in range(2 * bins):
        x = mix64(h ^ np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64))
        value = (x >> low) + np.uint64(i << 50)
        if i < bins:
            np.minimum.at(out, doc * bins + (x & bits).astype(np.int64), value)
        else:
            np.minimum.at(out, doc * bins + (i - bins), value)
        open_doc = (out.reshape(docs, bins) == _EMPTY).any(1)
        live = open_doc[doc]
        if not live.all():
            doc, h = doc[live], h[live]
        if not len(doc):
            break
    return out.reshape(docs, bins)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band (docs x bands)."""
    part = sketch[:, :bands * rows].reshape(len(sketch), bands, rows)
    key = np.tile(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketch), 1))
    for r in range(rows):
        key = mix64(key ^ part[:, :, r]) * np.uint64(0x9E3779B97F4A7C15 | 1) + np.uint64(r)
    return key.astype(np.int64)


def sketch_documents(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands) of every row. s1 and s2 identify the
    set (order-free sums over its hashes); documents without words have no bands."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids = b.column(0)
            for i, j, data, off in doc_chunks(None, b.column(1)):
                doc, h = shingle_sets(data, off, k)
                n = np.bincount(doc, minlength=j - i)
                sums = []
                for seed in (1, 2):
                    acc = np.concatenate(([np.uint64(0)], np.cumsum(mix64(h + (np.uint64(seed) << np.uint64(SET_BITS))))))
                    at = np.concatenate(([0], np.cumsum(n)))
                    sums.append((acc[at[1:]] - acc[at[:-1]]).astype(np.int64))
                keys = band_keys(sketch_sets(doc, h, j - i))
                has = n > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(np.where(has, keys.shape[1], 0)))), pa.int32()),
                    pa.array(keys[has].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists],
                    ["doc_id", "n_shingles", "s1", "s2", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + SKETCH)


def confirm_pairs(pairs: DataFrame, texts: DataFrame, k: int, percent: int = 80) -> DataFrame:
    """The (a, c) pairs whose texts' full shingle sets reach 100 * intersection
    >= percent * union. ``texts`` has (doc_id, text).

    The pairs of one centre ``c`` are dealt to groups of about ``GROUP``
    members; each group reads its centre's text once and streams the others."""
    count = pairs.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("_g"))
    dealt = salted_join(pairs, count, ["c"], F.col("a"), 4).select(
        "a", "c", F.pmod(F.xxhash64("a"), F.col("_g")).cast("int").alias("g"))
    need = dealt.select(F.col("a").alias("doc_id"), "c", "g", F.lit(1).alias("role")).unionByName(
        dealt.select(F.col("c").alias("doc_id"), "c", "g", F.lit(0).alias("role")).distinct())
    sent = need.join(texts, "doc_id").select("c", "g", "role", "doc_id", "text")
    sent = sent.repartition("c", "g").sortWithinPartitions("c", "g", "role")

    def run(batches):
        import pyarrow as pa
        held, centre = None, np.zeros(0, np.uint64)
        for b in batches:
            cs, gs, roles, ids = (b.column(x).to_numpy() for x in range(4))
            a_out, c_out = [], []
            for i, j, data, off in doc_chunks(None, b.column(4)):
                doc, h = shingle_sets(data, off, k)
                at = np.searchsorted(doc, np.arange(j - i + 1))
                for r in range(i, j):
                    mine = h[at[r - i]:at[r - i + 1]]
                    if roles[r] == 0:
                        held, centre = (cs[r], gs[r]), mine.copy()
                    elif held == (cs[r], gs[r]) and len(mine) and len(centre):
                        both = len(np.intersect1d(mine, centre, assume_unique=True))
                        if 100 * both >= percent * (len(mine) + len(centre) - both):
                            a_out.append(ids[r])
                            c_out.append(cs[r])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(c_out, pa.int64())], ["a", "c"])

    return sent.mapInArrow(run, "a long, c long").distinct()


def split_groups(rows: DataFrame) -> DataFrame:
    """Rows (key, a, n, l) of the keys that hold several components ``l``, with
    the key's largest component as ``main``."""
    parts = rows.groupBy("key", "l").agg(F.count(F.lit(1)).alias("m"))
    by_key = parts.groupBy("key").agg(F.max(F.struct("m", "l")).alias("top"), F.count(F.lit(1)).alias("parts")) \
        .where("parts > 1").select("key", F.col("top.l").alias("main"))
    return salted_join(rows, by_key, ["key"], F.col("a"), 4)


def rare_shingles(rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (key, a, n, l) for the rarest shingles ``key`` of each document ``a``.

    Shingles are ordered by how many of these documents have them. Two sets
    that reach ``percent`` share one of their first n - ceil(percent * n / 100)
    + 1 shingles, whatever the order; the rarest first keeps passages that many
    documents share out of the comparison."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, _, data, off in doc_chunks(None, b.column(1)):
                doc, h = shingle_sets(data, off, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + doc]), pa.array(h.astype(np.int64))], ["a", "key"])

    mine = texts.join(rows.select(F.col("a").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    all_of = stage_table(mine.mapInArrow(run, "a long, key long"), "rest_sets")
    often = all_of.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    by = Window.partitionBy("a").orderBy("f", "key")
    ranked = salted_join(all_of, often, ["key"], F.col("a"), 4).withColumn("r", F.row_number().over(by))
    first = ranked.join(rows, "a").where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return stage_table(first.where("f > 1").select("key", "a", "n", "l", "r"), "rare")


def compare_rare(tokens: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x, y) of documents in different components that can still
    reach ``percent``, from rows (key, a, n, l, r, main).

    The first shingle two sets share has places r and cr in their orders, so
    the intersection is at most min(n - r, cn - cr) + 1, and it must be
    percent / (100 + percent) of n + cn. For the smaller set this leaves only
    its first n - ceil(2 percent n / (100 + percent)) + 1 shingles."""
    short = F.col("r") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1
    small, other = tokens.where(short), F.col("l") != F.col("main")

    def meet(smaller: DataFrame, larger: DataFrame) -> DataFrame:
        left = smaller.select("key", *[F.col(c).alias(f"c{c}") for c in ("a", "n", "l", "r")])
        both = salted_join(larger.select("key", "a", "n", "l", "r"), left, ["key"], F.col("a"), 4)
        bound = F.least(F.col("n") - F.col("r"), F.col("cn") - F.col("cr")) + 1
        both = both.where("l != cl and (cn < n or cn = n and ca < a)").where(F.col("cn") * 100 >= F.col("n") * percent) \
            .where(bound * (100 + percent) >= (F.col("n") + F.col("cn")) * percent)
        return both.select(F.least("a", "ca").alias("x"), F.greatest("a", "ca").alias("y"))
    return meet(small.where(other), tokens).unionByName(meet(small.where(~other), tokens.where(other))).distinct()


def components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
               ) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; links reach
    100 * intersection >= percent * union of distinct k-word shingles."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sk = stage_table(sketch_documents(rows, k, "doc_id", "text"), "sketch")
    full = sk.where("n_shingles > 0")
    # classes of equal sets; a class is its smallest id
    classes = full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n"))
    reps = stage_table(classes.where("rep is not null"), "classes")
    keyed = full.join(reps.select(F.col("rep").alias("doc_id"), "s1", "s2", "n_shingles"),
                      ["doc_id", "s1", "s2", "n_shingles"], "left_semi")
    members = keyed.dropDuplicates(["doc_id", "s1", "s2"]).select(
        F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    size = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("_m"), F.min(F.struct("a", "n")).alias("_c"),
        F.bit_xor(F.xxhash64("a")).alias("_x"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("_y")).where("_m > 1")
    # of buckets with the same members one is enough
    size = size.groupBy("_m", "_x", "_y", "_c").agg(F.min("key").alias("key")).select("key", "_c")
    buckets = stage_table(salted_join(members, size, ["key"], F.col("a"), 4).select(
        "key", "a", "n", F.col("_c.a").alias("c"), F.col("_c.n").alias("cn")), "buckets")

    def near(x: str, y: str) -> str:            # sets whose sizes alone refute a link
        return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"
    pairs = buckets.where("a != c").where(near("n", "cn")).select("a", "c").distinct()
    pairs = stage_table(pairs, "star")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("c").alias("doc_id")))
    # a pair that is compared later needs its members' texts too
    more = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).where("_m > 2").select("key")
    ids = ids.unionByName(salted_join(buckets, more, ["key"], F.col("a"), 4).select(F.col("a").alias("doc_id")))
    texts = stage_table(rows.join(ids.distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "near_texts")
    label = stage_table(connected_components(confirm_pairs(pairs, texts, k, percent), "a", "c"), "labels")

    # All members were compared with their bucket's centre. What is left are pairs of other members in
    # different components: only buckets that have such pairs go on.
    cur = salted_join(buckets.where("a != c").select("key", "a", "n"), label.withColumnRenamed("node", "a"), ["a"],
                      F.col("key"), 4, how="left").withColumn("l", F.coalesce("component", "a")).drop("component")
    rest = stage_table(split_groups(cur).select("a", "n", "l").distinct(), "rest")
    tokens = split_groups(rare_shingles(rest, texts, k, percent))
    new = compare_rare(tokens, percent)
    done = pairs.select(F.least("a", "c").alias("x"), F.greatest("a", "c").alias("y"))
    new = stage_table(new.join(done, ["x", "y"], "left_anti"), "pairs")
    links = confirm_pairs(new.select(F.col("x").alias("a"), F.col("y").alias("c")), texts, k, percent)
    # new links join components: contract them by their labels
    ends = relabel(relabel(links, label, F.col("c"), "a"), label, F.col("a"), "c")
    joined = connected_components(ends, "a", "c")
    label = stage_table(relabel(label, joined, F.col("node")).unionByName(
        joined.join(label.select("node"), "node", "left_anti")), "labels")
    # classes back to rows; rows of one class, and the class's own links, by its smallest id
    named = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").where("_n > 1 or component is not null") \
        .select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = salted_join(sk.select("doc_id", "n_shingles", "s1", "s2"), named, ["s1", "s2", "n_shingles"],
                      F.coalesce("doc_id", F.lit(-1)), 4, how="left")
    own = F.when(F.col("doc_id").isNull(), F.col("doc_id")).when(
        F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their group's smallest, columns
    unchanged; of rows that repeat such an id one stays."""
    found = stage_table(components(docs, k, percent, id_col, text_col), "components")
    name, = fresh(docs, "_gone")
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]) \
            .unionByName(kept.where(F.col(id_col).isNull()))
    return kept
