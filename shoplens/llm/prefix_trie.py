"""Prefix trie of conversations: what many of them begin with is stored once.

A turn becomes a fixed-width id, the first 16 bytes of the SHA-256 of its role
and text, and a conversation the byte string of its turns' ids. The strings are
range-sorted, equal ones by conversation id, so a prefix that a third of all
conversations share is spread over many parts. Each part builds an adaptive
radix tree of its strings (:mod:`shoplens.llm.radix`) and emits a trie node at
every byte depth that is a whole number of turns, inside compressed paths as
well. Only the prefixes that a part shares with its neighbours are met by
other parts too: their counts are added up by Spark, each turn sequence and
leaf being counted by exactly one part, which sees that from the last string
of the part before and the first of the part behind it.

A conversation's turns are one unit of work, as a document's text is; there is
no bound on the number of conversations below a node. Nodes of two different
sequences are told apart by 128 bits of SHA-256.

Cases: a null role or text is empty; turns are ordered by ``turn``, null
first, turns of one number by their id; rows without a conversation id belong
to none and are left out; repeated rows are turns of their own; an empty table
gives no node. Further columns may have any name, four are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import WORD, stage_table
from shoplens.llm.radix import RadixTree, common

WIDTH = 16
TURNS_PER_PART = 200_000
IDS_PER_PIECE = 512
EMPTY_DIGEST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"   # SHA-256 of nothing


# ---------------------------------------------------------------------------
# conversations as byte strings
# ---------------------------------------------------------------------------

def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of the SHA-256 of a turn; the role's length keeps the two apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256), 1, 2 * WIDTH))


def sequences(conversations: DataFrame) -> DataFrame:
    """A row a conversation: (conv_id, turns array<struct<id, words>>) in order."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", turn_id(F.col("role"), F.col("text")).alias("id"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))


def rebuilt(seqs: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that begin like the first one of their group: h turns of
    conversation c - c % ``group`` (fewer if it has fewer, none if it is
    absent), then their own after the first h; h = crc32(c) % ``heads``.
    ``seqs`` (conv_id, turns) is read twice. Groups have ``group`` members, so
    no join key is hot."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    first = seqs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_g"),
                                                             F.slice("turns", 1, heads - 1).alias("_first"))
    own = seqs.withColumn("_g", F.col("conv_id") - F.col("conv_id") % group).withColumn("_h", h)
    rest = F.when(F.size("turns") > F.col("_h"),
                  F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(1))))
    empty = F.slice("turns", 1, 0)
    return own.join(first, "_g", "left").select("conv_id", F.concat(
        F.coalesce(F.slice("_first", 1, F.col("_h")), empty), F.coalesce(rest, empty)).alias("turns"))


# ---------------------------------------------------------------------------
# one part of the sorted strings
# ---------------------------------------------------------------------------

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "held long, once long, ends_sha256 string, node binary, parent binary, part int, ends array<string>")


def _part_nodes(keys: list[bytes], convs: list[list[int]], words: list[list[int]], before: bytes | None,
                behind: bytes | None, part: int) -> dict[str, list]:
    """Trie nodes of one part: distinct sorted ``keys``, the sorted ids and the
    words per turn of each. ``held``: words of the last turn times members,
    summed over the subtree; ``once``: words of each sequence that this part is
    the first to hold. A node shared with a neighbour has its name in ``node``."""
    from hashlib import blake2b, sha256
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    down = -1 if before is None else common(before, keys[0]) // WIDTH       # depths shared with the part before
    up = -1 if behind is None else common(keys[-1], behind) // WIDTH
    first, last = tree.trail(keys[0]), tree.trail(keys[-1])
    out: dict[str, list] = {c.split()[0]: [] for c in NODE.split(", ")}
    above: list[int] = []                                                   # row of each node's parent
    turn: list[bytes] = []
    shared: list[bool] = []
    state: dict[int, tuple] = {}                                            # of a finished child, by its identity

    for node, end in tree.walk():
        below = [state.pop(id(k)) for k in node.children()]
        n, low, leaves, held, once, kids = (sum(s[i] for s in below) if i != 1 else 0 for i in range(6))
        waiting = [r for s in below for r in s[6]]                          # rows whose parent is still to come
        sample = below[0][7] if below else node.end
        low = min((s[1] for s in below), default=None)
        mine = None
        if node.end is not None:
            mine, sample = convs[node.end], node.end
            n, low = n + len(mine), mine[0] if low is None else min(low, mine[0])
        for depth in range(end // WIDTH, -1 if node is tree.root else (end - len(node.path)) // WIDTH, -1):
            to_first, to_last = id(node) in first and depth <= down, id(node) in last and depth <= up
            row, own = len(above), [] if mine is None or depth * WIDTH != end else mine
            weight = words[sample][depth - 1] if depth else 0
            if not waiting and not to_last:
                leaves += 1
            held, once = held + n * weight, once + (0 if to_first else weight)
            edge = to_first or to_last or not depth
            for r in waiting:
                above[r] = row
            texts = [",".join(map(str, own[i:i + IDS_PER_PIECE])) for i in range(0, len(own), IDS_PER_PIECE)]
            sha = sha256(",".join(texts).encode()).hexdigest() if not edge else None
            for c, v in (("conv_id", low), ("depth", depth), ("n_convs", n), ("n_children", kids), ("n_leaves", leaves),
                         ("held", held), ("once", once), ("ends_sha256", sha), ("part", part), ("ends", texts if edge else [])):
                out[c].append(v)
            above.append(row)
            turn.append(keys[sample][(depth - 1) * WIDTH:depth * WIDTH] if depth else b"")
            shared.append(edge)
            waiting, kids = [row], 0 if to_first else 1
        state[id(node)] = (n, low, leaves, held, once, kids, waiting, sample)

    names: list[bytes | None] = [None] * len(above)
    for r in range(len(above) - 1, -1, -1):                                 # parents come after their children
        if shared[r]:
            names[r] = blake2b((names[above[r]] if above[r] != r else b"") + turn[r], digest_size=WIDTH).digest()
    out["node"] = names
    out["parent"] = [names[p] if p != r else None for r, p in enumerate(above)]
    out["parent_conv_id"] = [None if shared[p] or p == r else out["conv_id"][p] for r, p in enumerate(above)]
    return out


def _part(rows, edge):
    """One part of the sorted strings (Arrow), with its neighbours' end strings."""
    import pyarrow as pa
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in NODE.split(", "))])
    if rows.num_rows == 0:
        return schema.empty_table()
    strings, ids, counts = (rows.column(c).to_pylist() for c in ("key", "conv_id", "words"))
    keys: list[bytes] = []
    convs: list[list[int]] = []
    words: list[list[int]] = []
    for i in sorted(range(len(ids)), key=lambda i: (strings[i], ids[i])):
        if not keys or strings[i] != keys[-1]:
            keys.append(strings[i])
            convs.append([])
            words.append(counts[i])
        convs[-1].append(ids[i])
    e = edge.to_pylist()[0]
    return pa.Table.from_pydict(_part_nodes(keys, convs, words, e["before"], e["behind"], e["at"]), schema=schema)


# ---------------------------------------------------------------------------
# the whole trie
# ---------------------------------------------------------------------------

def _digests(batches: Iterator) -> Iterator:
    """SHA-256 of the comma-joined pieces of each node; its rows come together
    and in order, and only the digest's state is held between batches."""
    import hashlib

    import pyarrow as pa
    name, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if state is None or node != name:
                if state is not None:
                    done.append((name, state.hexdigest()))
                name, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_pydict({"node": [d[0] for d in done], "sha": [d[1] for d in done]},
                                         schema=pa.schema([("node", pa.binary()), ("sha", pa.string())]))
    if state is not None:
        yield pa.RecordBatch.from_pydict({"node": [name], "sha": [state.hexdigest()]},
                                         schema=pa.schema([("node", pa.binary()), ("sha", pa.string())]))


def trie(seqs: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Every node of the trie of ``seqs`` (conv_id, turns array<struct<id, words>>):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``seqs`` is read twice (range sample and write)."""
    spark = seqs.sparkSession
    rows = stage_table(seqs.select("conv_id", F.array_join(F.transform("turns", lambda x: F.hex(x["id"])), "").alias("_hex"),
                                   F.transform("turns", lambda x: x["words"]).alias("words"))
                       .select("conv_id", F.unhex("_hex").alias("key"), "words"), "strings")
    turns = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // turns_per_part))
    dealt = stage_table(rows.repartitionByRange(parts, "key", "conv_id").withColumn("part", F.spark_partition_id()), "parts")
    over = Window.orderBy("part")                                            # one row a part
    edges = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).select(
        F.col("part").alias("at"), F.lag("high").over(over).alias("before"), F.lead("low").over(over).alias("behind"))
    nodes = stage_table(dealt.groupBy("part").cogroup(edges.groupBy("at")).applyInArrow(_part, NODE), "nodes")

    shared = nodes.where(F.col("node").isNotNull())
    added = shared.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("part").alias("part"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "held", "once")])
    pieces = shared.select("node", "part", F.posexplode("ends").alias("i", "text"))
    # A digest takes its bytes one after the other: a node's pieces stream through one task, which holds none of them.
    digests = pieces.repartition("node").sortWithinPartitions("node", "part", "i").select("node", "text") \
        .mapInArrow(_digests, "node binary, sha string")
    added = stage_table(added.join(digests, "node", "left")
                        .withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_DIGEST))).drop("sha"), "shared_nodes")
    cols = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "held", "once", "ends_sha256", "parent", "part"]
    alone = nodes.where(F.col("node").isNull())
    every = alone.select(*cols, "parent_conv_id").unionByName(added.select(*cols, F.lit(None).cast("long").alias("parent_conv_id")))
    # A parent that parts share may have any number of children (the root above all), but one part holds few of them.
    names = shared.select("node", "part").join(added.select("node", F.col("conv_id").alias("_above")), "node") \
        .withColumnRenamed("node", "parent")
    out = every.where(F.col("parent").isNull()).withColumn("_above", F.col("parent_conv_id")) \
        .unionByName(every.where(F.col("parent").isNotNull()).join(names, ["parent", "part"]))
    return out.select("conv_id", "depth", F.col("_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      (F.col("held") - F.col("once")).alias("saved_tokens"), "ends_sha256")


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(rebuilt(stage_table(sequences(conversations), "sequences"), group, heads))
