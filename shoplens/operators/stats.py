"""Statistics on a category x cohort count table: chi-square test of
independence, Pearson residuals with a Bonferroni flag, and A/B sample sizes.

The count table is a DataFrame (one row per category, one count column per
cohort); totals come from one-row aggregates joined back. Only scalars reach
the driver: the number of categories m (for the Bonferroni z) and the chi2
statistic (for its tail probability); these special functions are evaluated
there with the standard library and go back into the plan as literals.

Note: a person can count in several categories (one per category of the
first order), so cells are memberships, not independent observations; the
test treats them as independent, as the reference does.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.common import round_half_up

_N = NormalDist()


# ---------------------------------------------------------------------------
# scalar helpers (pure Python, used on one-row frames or for parameters)
# ---------------------------------------------------------------------------

def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:                          # series for P, then Q = 1 - P
        term = total = 1.0 / a
        ap = a
        for _ in range(1000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - gln))
    b = x + 1.0 - a                           # continued fraction (Lentz)
    c = 1.0 / 1e-300
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf(x: float, dof: float) -> float:
    """P(X > x) for X ~ chi-square(dof)."""
    if x is None or dof is None or dof <= 0 or math.isnan(x):
        return float("nan")
    return _gamma_q(dof / 2.0, x / 2.0)


def norm_ppf(q: float) -> float:
    return _N.inv_cdf(q)


def two_sided_power_root(alpha: float, power: float) -> float:
    """d such that Phi(d - c) + Phi(-d - c) = power, c = z_{1-alpha/2}.

    This is the standardised effect times sqrt(n/2) at which a two-sided
    z-test reaches ``power`` (both rejection tails counted). Starting from the
    one-tail closed form c + z_power, Newton steps add the far tail.
    """
    c = _N.inv_cdf(1.0 - alpha / 2.0)
    d = c + _N.inv_cdf(power)
    for _ in range(50):
        f = _N.cdf(d - c) + 0.5 * math.erfc((d + c) / math.sqrt(2.0)) - power
        fp = _N.pdf(d - c) - _N.pdf(d + c)
        step = f / fp
        d -= step
        if abs(step) < 1e-15:
            break
    return d


# ---------------------------------------------------------------------------
# operators
# ---------------------------------------------------------------------------

def counts_from_rows(df: DataFrame, row_col: str, col_col: str, levels: list[str]) -> DataFrame:
    """Raw (category, cohort) rows -> one count column per cohort level."""
    return (df.groupBy(row_col).pivot(col_col, levels).agg(F.count(F.lit(1)))
            .na.fill(0, subset=levels)
            .select(row_col, *[F.col(v).cast("bigint").alias(v) for v in levels]))


def _with_expected(counts: DataFrame, count_cols: list[str]) -> DataFrame:
    # column totals as scalar subqueries (one aggregate, no join)
    col_totals = {c: counts.agg(F.sum(c).cast("double")).scalar() for c in count_cols}
    grand = sum((col_totals[c] for c in count_cols), F.lit(0.0))
    row_total = sum((F.col(c).cast("double") for c in count_cols), F.lit(0.0))
    df = counts.select("*", *[col_totals[c].alias(f"_ct_{c}") for c in count_cols],
                       grand.alias("_grand"), row_total.alias("_rt"))
    for c in count_cols:
        df = df.withColumn(f"_e_{c}", F.try_divide(F.col("_rt") * F.col(f"_ct_{c}"), F.col("_grand")))
    return df


def expected_counts(counts: DataFrame, count_cols: list[str], label_col: str = "category_group",
                    suffix: str = "_expected") -> DataFrame:
    """Expected frequencies under independence, row total x column total /
    grand total, one column per cohort (the table the test compares with)."""
    df = _with_expected(counts, count_cols)
    return df.select(label_col, *[F.col(f"_e_{c}").alias(c.replace("_cnt", "") + suffix)
                                  for c in count_cols])


def chi_square_statistic(counts: DataFrame, count_cols: list[str]) -> DataFrame:
    """chi2 = sum (observed - expected)^2 / expected; dof = (rows-1)(cols-1).
    No continuity correction (it only applies to 2x2 tables)."""
    df = _with_expected(counts, count_cols)
    def sq(x):
        return x * x

    cell = sum((F.try_divide(sq(F.col(c).cast("double") - F.col(f"_e_{c}")), F.col(f"_e_{c}"))
                for c in count_cols), F.lit(0.0))
    # Rounded to 10 decimals: a sum of doubles depends on the order of
    # addition, which differs between engines and partitionings.
    return df.agg(round_half_up(F.sum(cell), 10).alias("chi2"),
                  ((F.count(F.lit(1)) - 1) * (len(count_cols) - 1)).cast("bigint").alias("dof"))


def chi_square_independence(counts: DataFrame, count_cols: list[str]) -> DataFrame:
    """chi2, dof and the p-value P(chi-square(dof) > chi2)."""
    s = chi_square_statistic(counts, count_cols)
    row = s.first()                                            # one row: two scalars
    p = None if row is None or row["chi2"] is None else chi2_sf(float(row["chi2"]), float(row["dof"]))
    # rounded: the tail is a sum of doubles
    return s.withColumn("p_value", round_half_up(F.lit(p).cast("double"), 10))


def residual_report(counts: DataFrame, label_col: str = "category_group",
                    cohort_col: str = "star_cnt", other_col: str = "one_time_cnt",
                    alpha: float = 0.05, adjusted: bool = False) -> DataFrame:
    """Pearson residuals (observed - expected)/sqrt(expected) of both cohorts,
    and whether |cohort residual| exceeds the Bonferroni z for m categories,
    z = Phi^-1(1 - (alpha/m)/2). ``adjusted=True`` divides by the standard
    error of the cell instead (adjusted residuals)."""
    cols = [cohort_col, other_col]
    df = _with_expected(counts, cols)

    def resid(c: str):
        e = F.col(f"_e_{c}")
        den = F.sqrt(e)
        if adjusted:
            den = F.sqrt(e * (1 - F.col("_rt") / F.col("_grand")) * (1 - F.col(f"_ct_{c}") / F.col("_grand")))
        return F.try_divide(F.col(c).cast("double") - e, den)

    m = counts.count()                                         # one scalar
    z = norm_ppf(1.0 - (alpha / m) / 2.0) if m else float("inf")
    out = df.select(label_col, resid(cohort_col).alias("star_resid"),
                    resid(other_col).alias("one_time_resid"))
    return out.select(label_col, "star_resid", "one_time_resid",
                      (F.abs("star_resid") > F.lit(z)).alias("significant_bonferroni"))


def ab_sample_size(baselines: DataFrame, p1_col: str = "p1",
                   lifts=(0.10, 0.15, 0.20, 0.30), alpha: float = 0.05, power: float = 0.80,
                   exact: bool = True, effect_digits: int | None = 12) -> DataFrame:
    """Sample size per group for a two-sided two-proportion z-test (equal
    groups) at each relative lift of the baseline ``p1``.

    effect size h = 2 asin sqrt(p2) - 2 asin sqrt(p1) (Cohen's h), p2 = p1 (1 + lift);
    n = ceil(2 (d / h)^2) where d solves the two-sided power equation
    (``exact=True``, both tails) or d = z_{1-alpha/2} + z_power (closed form).
    """
    d = two_sided_power_root(alpha, power) if exact else (norm_ppf(1 - alpha / 2) + norm_ppf(power))
    p1 = F.col(p1_col).cast("double")
    p2 = p1 * (F.lit(1.0) + F.col("relative_lift"))
    valid = (p1 >= 0) & (p1 <= 1) & (p2 >= 0) & (p2 <= 1)          # else undefined: NULL
    h = F.when(valid, F.lit(2.0) * F.asin(F.sqrt(p2)) - F.lit(2.0) * F.asin(F.sqrt(p1)))
    ratio = F.try_divide(F.lit(d), h)
    n = F.ceil(F.lit(2.0) * (ratio * ratio)).cast("bigint")
    eff = h if effect_digits is None else round_half_up(h, effect_digits)
    lift_values = F.array(*[F.lit(float(x)) for x in lifts])
    return (baselines.withColumn("relative_lift", F.explode(lift_values))
            .select(p1.alias("p1"), "relative_lift", p2.alias("p2"), eff.alias("effect_size"),
                    n.alias("n_per_group"), (n * 2).alias("n_total")))
