"""Column helpers shared by the operators.

All of these build JVM-side expressions (no Python UDF).

Numeric conventions (kept identical in the SQL oracle):
* money is summed as DECIMAL and only turned into DOUBLE at the output edge;
* averages of money or day counts are ``double(sum) / count`` so both engines
  divide the same exact sum;
* unrounded ratios are ``double / double`` and NULL when the denominator is 0
  (the reference's engine returns NULL there, Spark with ANSI on would raise);
* rounded ratios and averages are whole-number arithmetic on the exact sums and
  counts (``rounded_ratio``), half away from zero, and only then DOUBLE;
* statistics that are doubles by nature round as ``sign(x)*floor(|x|*10^n+0.5)/10^n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: ColumnOrName) -> Column:
    return col(c).cast("double")


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` as doubles; NULL instead of an error for a zero denominator."""
    return F.try_divide(as_double(num), as_double(den))


def round_half_up(c: ColumnOrName, digits: int) -> Column:
    """Round half away from zero to ``digits`` decimals, on doubles."""
    scale = float(10 ** digits)
    x = as_double(c)
    return (F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale))


def rounded_ratio(num: ColumnOrName, den: ColumnOrName, digits: int, scale: int = 1) -> Column:
    """``scale * num / den`` rounded half away from zero to ``digits`` decimals.

    Both are whole numbers or money with at most two decimals; everything up
    to the rounded value is exact. NULL for a zero denominator."""
    def cents(c: ColumnOrName) -> Column:
        return (col(c).cast("decimal(36,2)") * F.lit(100)).cast("decimal(38,0)")
    n, d = cents(num), cents(den)
    up = F.abs(n) * F.lit(2 * scale * 10 ** digits).cast("decimal(38,0)") + F.abs(d)
    by = F.nullif(F.abs(d) * F.lit(2), F.lit(0).cast("decimal(38,0)"))
    whole = ((up - up % by) / by).cast("decimal(38,0)")
    sign = F.signum(n.cast("double")) * F.signum(d.cast("double"))
    return sign * whole.cast("double") / F.lit(float(10 ** digits))


def rounded_avg(c: ColumnOrName, digits: int) -> Column:
    """Average of exact values, rounded by :func:`rounded_ratio`."""
    return rounded_ratio(F.sum(col(c)), F.count(col(c)), digits)


def exact_avg(c: ColumnOrName) -> Column:
    """Average as ``double(exact sum) / count`` (sum stays DECIMAL / BIGINT)."""
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)).cast("double"))


def flag(cond: Column) -> Column:
    """0/1 integer flag (flags are summed by the reports)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_if(cond: Column) -> Column:
    return F.sum(flag(cond)).cast("bigint")


def share_within(df: DataFrame, count_col: str, partition_cols: list[str] | None = None,
                 out: str = "ratio", digits: int | None = 4, scale: int = 1) -> DataFrame:
    """Share of ``count_col`` within its partition (or of the whole frame).

    Meant for already-aggregated frames (a handful of rows per partition),
    where a window over the grouped result is the cheap way to get totals.
    """
    w = Window.partitionBy(*partition_cols) if partition_cols else Window.partitionBy()
    total = F.sum(count_col).over(w)
    if digits is not None:
        return df.withColumn(out, rounded_ratio(count_col, total, digits, scale))
    return df.withColumn(out, safe_ratio(F.col(count_col).cast("double") * F.lit(float(scale)), total))


def money(c: ColumnOrName) -> Column:
    """Money at the output edge: DECIMAL -> DOUBLE."""
    return as_double(c)
