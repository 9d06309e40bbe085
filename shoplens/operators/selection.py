"""Rows at given ranks without sorting the rows.

``keys_at`` finds the ordering keys that stand at some ranks (the two middle
rows, the three cuts between quartiles) of any number of rows:

1. a bounded sample of keys, chosen by hash, gives an interval round each rank
   that holds it almost surely (approximate quantile bounds);
2. one aggregate counts, exactly, how many keys lie at or below each bound, so
   an interval that misses its rank is seen and the other side is taken;
3. what lies between goes round again until it has at most ``MOST`` rows. Those
   alone are sorted.

A round leaves about a tenth to a fiftieth of the rows, so 10^10 rows take
five rounds or so: scans of the key columns that shuffle nothing but the sample.
NULLs come first, as in an ascending sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

MOST = 20_000        # rows that are sorted and read in the end
SAMPLE = 4_096       # keys that a round looks at


@dataclass
class Band:
    """Keys above ``low`` (None: all) up to ``high`` (None: all): ``size`` of them, ``below`` before them."""
    low: Row | None
    high: Row | None
    below: int
    size: int

    def bounds(self) -> tuple:
        return self.low, self.high


def keys_at(df: DataFrame, cols: list[str], ranks: Callable[[int], list[int]],
            most: int = MOST, sample: int = SAMPLE) -> tuple[int, dict[int, Row]]:
    """Number of rows n, and the key ``cols`` at every rank (from 1) in
    ``ranks(n)``; ranks outside 1 .. n are left out. ``df`` is scanned a few
    times: hand in a written view or a plain scan. Rows with equal keys may
    stand in any order among themselves."""
    keys = df.select(*cols)
    n = keys.count()
    wanted = sorted({r for r in ranks(n) if 1 <= r <= n})
    at = {r: Band(None, None, 0, n) for r in wanted}
    found: dict[int, Row] = {}
    turn = 0
    while True:
        wide = {b.bounds(): b for r, b in at.items() if r not in found and b.size > most}
        if not wide:
            break
        turn += 1
        bounds: dict[tuple, list[Row]] = {}
        for name, band in wide.items():
            seen = (_within(keys, cols, band).orderBy(F.xxhash64(*cols, F.lit(turn)), *cols).limit(sample)
                    .orderBy(*[F.col(c).asc_nulls_first() for c in cols]).collect())
            if seen[0] == seen[-1] and turn > 1:             # perhaps one key only: then it is the answer
                ends = _within(keys, cols, band).agg(F.min(_key(cols)).alias("a"), F.max(_key(cols)).alias("b")).first()
                if ends.a == ends.b:
                    found.update({r: ends.a for r, b in at.items() if b.bounds() == name})
                    continue
            bounds[name] = [seen[i] for r, b in at.items() if b.bounds() == name
                            for i in _around((r - band.below) / band.size, len(seen))]
        points = {p for ps in bounds.values() for p in ps}
        order = sorted(points, key=hash)
        if not order:
            continue
        sums = keys.agg(*[F.count_if(_key(cols) <= _literal(keys, cols, p)).alias(f"c{i}") for i, p in enumerate(order)]).first()
        upto = {p: sums[f"c{i}"] for i, p in enumerate(order)}
        for r, band in at.items():
            if r in found or band.bounds() not in bounds:
                continue
            cuts = sorted([(upto[p], p) for p in bounds[band.bounds()]], key=lambda x: x[0])
            low = max([c for c in cuts if c[0] < r], default=(band.below, band.low), key=lambda x: x[0])
            high = min([c for c in cuts if c[0] >= r], default=(band.below + band.size, band.high), key=lambda x: x[0])
            at[r] = Band(low[1], high[1], low[0], high[0] - low[0])
    for name in {b.bounds() for r, b in at.items() if r not in found}:
        mine = [r for r, b in at.items() if r not in found and b.bounds() == name]
        band = at[mine[0]]
        rows = _within(keys, cols, band).orderBy(*[F.col(c).asc_nulls_first() for c in cols]).collect()    # at most ``most``
        found.update({r: rows[r - band.below - 1] for r in mine})
    return n, found


def _around(share: float, m: int) -> list[int]:
    """Places in a sorted sample of m keys round the one at ``share``: four
    standard deviations to either side, and the place itself."""
    reach = 4 * math.sqrt(m * share * (1 - share)) + 2
    return sorted({max(0, min(m - 1, i)) for i in (math.floor(share * m - reach), math.floor(share * m), math.ceil(share * m + reach))})


def _key(cols: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(c) for c in cols])


def _literal(df: DataFrame, cols: list[str], row: Row) -> Column:
    return F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in cols])


def _within(keys: DataFrame, cols: list[str], band: Band) -> DataFrame:
    if band.low is not None:
        keys = keys.where(_key(cols) > _literal(keys, cols, band.low))
    if band.high is not None:
        keys = keys.where(_key(cols) <= _literal(keys, cols, band.high))
    return keys


def with_ntile(df: DataFrame, value_col: str, id_col: str, tiles: int, out: str, **limits: int) -> DataFrame:
    """``NTILE(tiles) OVER (ORDER BY value_col, id_col)``: the last key of every
    tile is selected, then the tile is an expression of a row's own key. The
    rows are not shuffled. The first ``N mod tiles`` tiles get one row more."""
    cols = [value_col, id_col]
    last = lambda n: [t * (n // tiles) + min(t, n % tiles) for t in range(1, tiles)]
    n, keys = keys_at(df, cols, last, **limits)
    tile = F.lit(1)
    for r in last(n):
        if r in keys:
            tile = tile + (_key(cols) > _literal(df, cols, keys[r])).cast("int")
    return df.withColumn(out, tile)


def exact_median(df: DataFrame, value_col: str, id_col: str, out: str = "median", **limits: int) -> DataFrame:
    """Exact median, one row: the mean of the values at ranks floor((N+1)/2)
    and ceil((N+1)/2); NULL for an empty input."""
    n, keys = keys_at(df, [value_col, id_col], lambda n: [(n + 1) // 2, n // 2 + 1], **limits)
    middle = [keys[r][value_col] for r in ((n + 1) // 2, n // 2 + 1) if r in keys]
    values = [F.lit(v).cast(df.schema[value_col].dataType) for v in middle if v is not None]
    one = df.sparkSession.range(1)
    if not values:
        return one.select(F.lit(None).cast("double").alias(out))
    return one.select((sum(values[1:], values[0]).cast("double") / F.lit(float(len(values)))).alias(out))
