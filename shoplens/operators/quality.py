"""Data checks: spelling variants, attribute drift, key uniqueness, orphans,
flag domains, mapping cardinality. All are aggregates or anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_report(df: DataFrame, key: str, raw_col: str = "city", clean_col: str = "clean_city",
                   other_col: str = "state", n: int = 10) -> DataFrame:
    """Keys with more than one raw spelling of ``raw_col``: distinct raw and
    cleaned spellings, distinct ``other_col`` values, rows. Top ``n`` by
    raw spellings (ties: key ascending). The limit is the report's feature.

    The first aggregate finds the keys with two spellings by their smallest
    and largest one and ranks nothing yet; only the rows of those keys are
    counted further."""
    varied = (df.groupBy(key).agg(F.count(F.lit(1)).alias("row_cnt"), _differ(raw_col).alias("_differ"))
              .where("_differ").drop("_differ"))
    names = {f"raw_{raw_col}_cnt": raw_col, f"{clean_col}_cnt": clean_col, f"{other_col}_cnt": other_col}
    g = distinct_counts(df, varied, key, names)
    return (g.select(key, *names, "row_cnt").orderBy(F.desc(f"raw_{raw_col}_cnt"), F.asc(key)).limit(n))


def _differ(col: str) -> Column:
    """Whether a group holds two values of ``col`` or more (NULLs are none)."""
    return F.coalesce(F.min(col) < F.max(col), F.lit(False))


def distinct_counts(df: DataFrame, keys: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """``keys`` (unique in ``key``) with the number of distinct values that the
    rows of ``df`` with that key have in each column (new name: column).

    The rows of those keys shrink to their distinct combinations, with partial
    aggregation, and only these are turned into (key, column, value) rows, made
    distinct and counted: no raw row is copied once per column, and a key with
    any number of rows or values is spread over their hash."""
    few, cols = keys.select(F.col(key).alias("_key")), list(names.values())
    combos = df.join(few, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(key, *cols).distinct()   # NULL is a key as well
    values = combos.select(F.col(key).alias("_key"), F.explode(_numbered_values(cols)).alias("x")).select("_key", "x.*") \
        .where(F.col("v").isNotNull()).distinct()
    counted = values.groupBy("_key").agg(*[F.count(F.when(F.col("i") == i, F.lit(1))).alias(f"_{i}") for i in range(len(cols))])
    joined = keys.join(counted, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(*keys.columns, *[F.coalesce(F.col(f"_{i}"), F.lit(0)).alias(name) for i, name in enumerate(names)])


def _numbered_values(cols: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])


def collated_groups(df: DataFrame, col: str, collation: str = "UNICODE_CI_AI", other: str | None = None) -> DataFrame:
    """Rows grouped by ``col`` under a collation (the default folds case and
    accents, as the reference's does): the smallest spelling in byte order,
    the number of spellings and rows, and the rows' distinct ``other`` values.
    Spellings are grouped as they are written first, so the collation is
    applied once per spelling and not once per row."""
    by = [col] if other is None else [col, other]
    written = df.where(F.col(col).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    spelled = written.groupBy(col).agg(F.sum("_n").alias("_n"))
    same = F.collate(F.col(col), collation)
    out = spelled.groupBy(same.alias("_same")).agg(F.min(F.collate(F.col(col), "UTF8_BINARY")).alias(col),
                                                   F.count(F.lit(1)).alias("spelling_cnt"), F.sum("_n").alias("row_cnt"))
    if other is not None:
        pairs = written.select(same.alias("_same"), other).distinct().groupBy("_same").agg(F.count(other).alias(f"{other}_cnt"))
        out = out.join(pairs, "_same")
    return out.drop("_same")


def collated_count(df: DataFrame, key: str, col: str, collation: str = "UNICODE_CI_AI") -> DataFrame:
    """Per key: distinct values of ``col`` as written and under a collation, and rows."""
    written = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("_n"))
    counts = written.groupBy(key).agg(F.count(col).alias(f"{col}_cnt"), F.sum("_n").alias("row_cnt"))
    folded = written.where(F.col(col).isNotNull()).select(F.col(key).alias("_key"), F.collate(F.col(col), collation).alias("_same")) \
        .distinct().groupBy("_key").agg(F.count("_same").alias("_folded"))
    return (counts.join(folded, F.col(key).eqNullSafe(F.col("_key")), "left")
            .select(key, f"{col}_cnt", F.coalesce("_folded", F.lit(0)).alias(f"collated_{col}_cnt"), "row_cnt"))


def distinct_values(df: DataFrame, cols: list[str], where=None) -> DataFrame:
    """``SELECT DISTINCT cols FROM df [WHERE ...]``."""
    if where is not None:
        df = df.where(where)
    return df.select(*cols).distinct()


def attribute_drift(df: DataFrame, key: str, cols: list[str], suffix: str = "_cnt",
                    names: dict[str, str] | None = None) -> DataFrame:
    """Keys whose rows disagree on any of ``cols`` (distinct count > 1).
    Output columns are ``<col><suffix>`` unless renamed by ``names``."""
    names = names or {}
    out = {names.get(c, c + suffix): c for c in cols}
    # "More than one value" is smallest < largest: one plain aggregate; then only the keys that drift are counted.
    drifts = df.groupBy(key).agg(reduce(lambda a, b: a | b, [_differ(c) for c in cols]).alias("_differ")) \
        .where("_differ").drop("_differ")
    return distinct_counts(df, drifts, key, out).select(key, *out)


def key_uniqueness(df: DataFrame, key: str, unique_col: str = "unique_key_cnt") -> DataFrame:
    """Rows versus distinct keys (equal when the key is unique)."""
    return df.agg(F.count(F.lit(1)).alias("row_cnt"), F.count_distinct(key).alias(unique_col))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row (anti join)."""
    p = parent.select(F.col(parent_col).alias("_pk")).distinct()
    return (child.where(F.col(child_col).isNotNull())
            .join(p, F.col(child_col) == F.col("_pk"), "left_anti"))


def orphan_count(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str) -> DataFrame:
    """Number of child rows whose non-NULL reference has no parent (one row).

    Child rows are counted per key first (map-side partial aggregation), so
    the anti join shuffles one row per distinct key, not every child row,
    and a key held by a third of the rows is one row after each map task."""
    per_key = (child.where(F.col(child_col).isNotNull())
               .groupBy(F.col(child_col).alias("_k")).agg(F.count(F.lit(1)).alias("_n")))
    p = parent.select(F.col(parent_col).alias("_k")).distinct()
    return (per_key.join(p, "_k", "left_anti")
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("violations")))


def integrity_report(tables: dict[str, DataFrame], foreign_keys, primary_keys,
                     rejects: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per declared constraint: ``kind`` ('pk' or 'fk'), table,
    column, referenced table/column, and the number of violating rows
    (duplicate key rows beyond the first, or orphan rows). ``rejects`` adds a
    row of kind 'reject' per raw table: its records that do not fit the schema."""
    none = F.lit(None).cast("string")
    parts = [r.select(F.lit("reject").alias("kind"), F.lit(t).alias("table_name"), none.alias("column_name"),
                      none.alias("ref_table"), none.alias("ref_column"), F.col("rejected").alias("violations"))
             for t, r in (rejects or {}).items()]
    for table, cols in primary_keys.items():
        if table not in tables:
            continue
        dup = (duplicate_keys(tables[table], cols)
               .agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("bigint").alias("violations")))
        parts.append(dup.select(F.lit("pk").alias("kind"), F.lit(table).alias("table_name"),
                                F.lit(",".join(cols)).alias("column_name"),
                                F.lit(None).cast("string").alias("ref_table"),
                                F.lit(None).cast("string").alias("ref_column"), "violations"))
    for child, ccol, parent, pcol in foreign_keys:
        if child not in tables or parent not in tables:
            continue
        o = orphan_count(tables[child], tables[parent], ccol, pcol)
        parts.append(o.select(F.lit("fk").alias("kind"), F.lit(child).alias("table_name"),
                              F.lit(ccol).alias("column_name"), F.lit(parent).alias("ref_table"),
                              F.lit(pcol).alias("ref_column"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def mapping_cardinality(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values of each column, e.g. cleaned categories versus groups.
    The rows shrink to their distinct combinations before anything is counted."""
    pairs = df.select(*cols).distinct()
    each = pairs.select(F.explode(_numbered_values(cols)).alias("x")).select("x.*")
    values = each.where(F.col("v").isNotNull()).distinct()
    return values.agg(*[F.count(F.when(F.col("i") == i, F.lit(1))).alias(f"{c}_cnt") for i, c in enumerate(cols)])
