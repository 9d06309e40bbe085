"""Mixing sources to target weights, with DataFrame functions only.

Leaves are the distinct paths of the level columns (domain, language, source).
A token budget flows from the root down: each node's budget goes to its
children by weight, no child gets more than its subtree can give (its tokens
times ``max_epochs``), and what a short child leaves is shared among its
siblings by weight; only what a whole family cannot use was never given to it,
so it stays with the ancestors' other children.

Capped sharing among siblings has a closed form: order them by capacity per
weight; those that fall short come first, and prefix sums tell where the
shares start to fit. So each level takes one window over the (small) table of
its nodes. Shares are whole tokens, the rest of a division goes to the first
siblings by weight and name, as far as their capacity allows.

A leaf with q full epochs takes each of its documents q times; the rest of its
budget is a token prefix of the next epoch, whose order is a seeded hash of
(epoch, document). The prefix is found without sorting a leaf in one task:
token sums of hash ranges locate the range where it ends, and only that
range's documents are ordered.

Defined cases: null levels form leaves of their own (shown as null); a null or
empty text has no tokens and is never taken; rows with the same leaf and
document id are taken together, in full or cut at the same token; an empty
table gives an empty result; extra columns are carried along by ``take``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import WORD, all_columns, fresh, salted_join, stage_table

BIG = "decimal(38,0)"


def count_tokens(text: Column | str) -> Column:
    """Words of a text: runs outside the ASCII white space."""
    text = F.col(text) if isinstance(text, str) else text
    gone = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "\u0001")
    return F.length(F.regexp_replace(gone, r"[\x20\x09-\x0D]+", "")).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of two non-negative whole numbers, exactly."""
    a, b = a.cast(BIG), b.cast(BIG)
    return ((a - a % b) / b).cast(BIG)


def share_capped(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Column ``budget`` of each row from its family's ``parent_budget``, its
    ``weight`` (whole, positive) and its ``cap``.

    Families are rows with equal ``parents``; a family holds at most the
    children of one node."""
    by = Window.partitionBy(*parents)
    ratio = (F.col("cap").cast("double") / F.col("weight")).alias("r")
    df = nodes.select("*", ratio)
    order = by.orderBy("r", "weight", F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cap_before = F.coalesce(F.sum("cap").over(before), F.lit(0).cast(BIG))
    w_left = F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    left = F.col("parent_budget").cast(BIG) - cap_before
    # Short when the family's level, with all before it saturated, reaches its capacity.
    short = (F.col("cap").cast(BIG) * w_left.cast(BIG)) <= (F.greatest(left, F.lit(0).cast(BIG))
                                                            * F.col("weight").cast(BIG))
    df = df.withColumn("_short", short)
    spent = F.coalesce(F.sum(F.when(F.col("_short"), F.col("cap"))).over(by), F.lit(0).cast(BIG))
    open_w = F.sum(F.when(~F.col("_short"), F.col("weight"))).over(by)
    free = F.col("parent_budget").cast(BIG) - spent
    df = df.withColumn("_free", free).withColumn("_open", open_w)
    whole = F.when(F.col("_short"), F.col("cap").cast(BIG)) \
        .otherwise(_div(F.col("_free") * F.col("weight").cast(BIG), F.col("_open")))
    df = df.withColumn("_whole", whole)
    rest = F.col("parent_budget").cast(BIG) - F.sum("_whole").over(by)
    room = F.when(~F.col("_short") & (F.col("_whole") < F.col("cap")), 1).otherwise(0)
    df = df.withColumn("_rest", rest).withColumn("_room", room)
    turn = F.sum("_room").over(by.orderBy(F.col("weight").desc(), F.col(name).asc_nulls_first()))
    extra = F.when((F.col("_room") == 1) & (turn <= F.col("_rest")), 1).otherwise(0)
    return df.withColumn("budget", (F.col("_whole") + extra).cast("long")) \
        .drop("r", "_short", "_free", "_open", "_whole", "_rest", "_room")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], budget: int, weights: dict[str, Column] | None = None,
                 max_epochs: int = 2) -> DataFrame:
    """Tokens each leaf (``levels`` and ``tokens``) has to give of ``budget``.

    ``weights`` maps a level to its nodes' weight, a whole positive number
    given as a column of the level's name (default 1: equal shares)."""
    weights = weights or {}
    cap = F.col("tokens").cast(BIG) * max_epochs
    nodes = [leaves.groupBy(*levels[:i + 1]).agg(F.sum(cap).cast(BIG).alias("cap")).where("cap > 0")
             for i in range(len(levels))]
    total = F.lit(int(budget)).cast(BIG)
    top = nodes[0].withColumn("_all", F.sum("cap").over(Window.partitionBy(F.lit(1))))
    given = top.withColumn("parent_budget", F.least(total, F.col("_all"))).drop("_all")
    for i, level in enumerate(levels):
        if i:
            up = given.select(*[F.col(c).alias(f"_{c}") for c in levels[:i]], F.col("budget").alias("parent_budget"))
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels[:i]]
            cond = same[0]
            for x in same[1:]:
                cond = cond & x
            given = nodes[i].join(up, cond).drop(*[f"_{c}" for c in levels[:i]])
        weight = weights.get(level, F.lit(1))
        given = given.withColumn("weight", weight.cast("long"))
        given = share_capped(given, [F.lit(1)] if i == 0 else levels[:i], level)
    return given.select(*levels, "budget")


def _place(seed: int, epoch: Column, doc: Column) -> Column:
    """Seeded place of a document in an epoch: 60 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _range_of(place: Column, ranges: Column) -> Column:
    """Which of ``ranges`` equal parts of the 60-bit places holds ``place``."""
    return F.shiftright(F.shiftright(place, 29) * ranges, 31)


def _leaf_key(levels: Sequence[Column | str]) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in levels]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def plan(docs: DataFrame, levels: Sequence[str], budget: int | float, weights: dict[str, Column] | None = None,
         max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", tokens: str = "tokens",
         range_rows: int = 4096) -> DataFrame:
    """Per leaf: its budget, full epochs, and where the last epoch's prefix ends.

    ``docs`` has the levels, the id and a token count. A ``budget`` below or
    equal to 1.0 given as a float is that share of all tokens. The result has
    one row per leaf with tokens: levels, tokens, budget, full, and the cut
    (``cut_place``, ``cut_id``, ``cut_tokens``: the last unit taken and how
    many of its tokens; null when the last epoch takes nothing)."""
    rows = docs.select(*levels, F.col(id_col).alias("_id"), F.col(tokens).cast("long").alias("_t")).where("_t > 0")
    unit = stage_table(rows.groupBy(*levels, "_id").agg(F.sum("_t").alias("_t")), "mix_units")
    leaves = unit.groupBy(*levels).agg(F.sum(F.col("_t").cast(BIG)).alias("tokens"), F.count(F.lit(1)).alias("_n"))
    leaves = stage_table(leaves, "mix_leaves")
    if isinstance(budget, float):
        have = leaves.agg(F.sum("tokens")).first()[0] or 0
        budget = int(have * int(budget * 1_000_000) // 1_000_000)
    alloc = leaf_budgets(leaves, levels, budget, weights, max_epochs)
    key = _leaf_key(levels)
    base = stage_table(
        leaves.withColumn("_leaf", key).join(alloc.select(key.alias("_leaf"), "budget"), "_leaf")
        .withColumn("full", _div(F.col("budget"), F.col("tokens")).cast("long"))
        .withColumn("_rest", (F.col("budget").cast(BIG) % F.col("tokens")).cast("long"))
        .withColumn("_ranges", F.ceil(F.col("_n") / range_rows).cast("long")), "mix_plan")
    part = base.where("_rest > 0").select("_leaf", "full", "_rest", "_ranges")
    placed = salted_join(unit.select(key.alias("_leaf"), "_id", "_t"), part, ["_leaf"],
                         F.coalesce("_id", F.lit(-1)), how="inner") \
        .withColumn("_place", _place(seed, F.col("full"), F.col("_id"))) \
        .withColumn("_range", _range_of(F.col("_place"), F.col("_ranges")))
    sums = placed.groupBy("_leaf", "_rest", "_range").agg(F.sum("_t").alias("_s"))
    upto = Window.partitionBy("_leaf").orderBy("_range")
    sums = sums.withColumn("_upto", F.sum("_s").over(upto)).withColumn("_before", F.col("_upto") - F.col("_s"))
    last = stage_table(sums.where("_before < _rest and _upto >= _rest").select("_leaf", "_range", "_before"), "mix_cut")
    inside = placed.join(last, ["_leaf", "_range"])
    w = Window.partitionBy("_leaf", "_range").orderBy("_place", F.col("_id").asc_nulls_first())
    inside = inside.withColumn("_at", F.col("_before") + F.sum("_t").over(w) - F.col("_t"))
    cut = inside.where("_at < _rest and _at + _t >= _rest").select(
        "_leaf", F.col("_place").alias("cut_place"), F.col("_id").alias("cut_id"), "_range",
        (F.col("_rest") - F.col("_at")).alias("cut_tokens"))
    out = base.join(cut, "_leaf", "left")
    return stage_table(out.select(*levels, "_leaf", "tokens", "budget", "full", "_ranges",
                                  F.col("_range").alias("cut_range"), "cut_place", "cut_id", "cut_tokens"), "mix_full")


def take(docs: DataFrame, made: DataFrame, levels: Sequence[Column | str], seed: int = 17, id_col: str = "doc_id",
         tokens: str = "tokens", epoch_col: str = "epoch", taken_col: str = "taken") -> DataFrame:
    """Rows of ``docs`` that a plan takes, once per epoch, with ``epoch_col``
    (from 0) and ``taken_col`` (tokens from the start of the text)."""
    leaf, full, ranges, cut_range, cut_place, cut_id, cut_tokens, last = fresh(
        docs, "_leaf", "_full", "_ranges", "_cut_range", "_cut_place", "_cut_id", "_cut_tokens", "_last")
    small = made.select(F.col("_leaf").alias(leaf), F.col("full").alias(full), F.col("_ranges").alias(ranges),
                        F.col("cut_range").alias(cut_range), F.col("cut_place").alias(cut_place),
                        F.col("cut_id").alias(cut_id), F.col("cut_tokens").alias(cut_tokens))
    t, doc = F.col(tokens), F.col(id_col)
    rows = docs.withColumn(leaf, _leaf_key(levels)).where(t > 0)
    rows = salted_join(rows, small, [leaf], F.coalesce(doc, F.lit(-1)))
    place = _place(seed, F.col(full), doc)
    part = _range_of(place, F.col(ranges))
    smaller = F.when(doc.isNull(), F.col(cut_id).isNotNull()).otherwise(F.coalesce(doc < F.col(cut_id), F.lit(False)))
    before = (part < F.col(cut_range)) | ((part == F.col(cut_range)) & (
        (place < F.col(cut_place)) | ((place == F.col(cut_place)) & smaller)))
    at_cut = (place == F.col(cut_place)) & doc.eqNullSafe(F.col(cut_id))
    rest = F.when(F.col(cut_tokens).isNull(), F.lit(0)).when(at_cut, F.least(F.col(cut_tokens), t)) \
        .when(before, t).otherwise(F.lit(0))
    rows = rows.withColumn(last, rest.cast("long"))
    whole = F.when(F.col(full) > 0, F.sequence(F.lit(0).cast("long"), F.col(full) - 1)) \
        .otherwise(F.array().cast("array<bigint>"))
    epochs = F.when(F.col(last) > 0, F.concat(whole, F.array(F.col(full)))).otherwise(whole)
    rows = rows.withColumn(epoch_col, F.explode(epochs))
    out = rows.withColumn(taken_col, F.when(F.col(epoch_col) < F.col(full), t).otherwise(F.col(last)))
    return out.select(*all_columns(docs), epoch_col, taken_col)


def mix(docs: DataFrame, levels: dict[str, Column], budget: int | float, weights: dict[str, Column] | None = None,
        max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
        chars_col: str = "n_chars") -> DataFrame:
    """The mixed documents themselves, columns unchanged: one row per epoch a
    document is taken in, the text of a cut one ended after its last token
    (and its length column, where present, brought up to date).

    ``levels`` maps level names, as ``weights`` uses them, to their columns."""
    tokens, epoch, taken = fresh(docs, "_tokens", "_epoch", "_taken")
    count = count_tokens(text_col)
    narrow = docs.select(*[c.alias(k) for k, c in levels.items()], F.col(id_col).alias("_unit"), count.alias("_count"))
    made = plan(narrow, list(levels), budget, weights, max_epochs, seed, "_unit", "_count")
    got = take(docs.withColumn(tokens, count), made, list(levels.values()), seed, id_col, tokens, epoch, taken)
    text = text_prefix(F.col(text_col), F.col(taken), F.col(tokens))
    cut = F.col(taken) < F.col(tokens)
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(text.alias(c))
        elif c == chars_col:
            cols.append(F.when(cut, F.length(text).cast("long")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return got.select(*cols)


def text_prefix(text: Column, taken: Column, tokens: Column) -> Column:
    """``text`` up to the end of its ``taken``-th word; whole if it has no more."""
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), taken.cast("string"), F.lit("}+"))
    return F.when(taken < tokens, F.call_function("regexp_extract", text, pattern, F.lit(0))).otherwise(text)
