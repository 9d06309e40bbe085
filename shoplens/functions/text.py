"""Text normalisation used by the cleaning step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoplens.functions.common import ColumnOrName, col

# Fixed replacement rules of the reference's cleaning step (values that must
# match): category names drop carriage returns and line feeds; city names turn
# an apostrophe into a blank. Both then trim blanks and lower-case.
CATEGORY_REPLACEMENTS: tuple[tuple[str, str], ...] = (("\r", ""), ("\n", ""))
CITY_REPLACEMENTS: tuple[tuple[str, str], ...] = (("'", " "),)


def clean_text(c: ColumnOrName, replacements=CATEGORY_REPLACEMENTS,
               collation: str | None = None) -> Column:
    """``lower(trim(replace(...)))``; trim strips blanks only, like SQL TRIM.

    ``collation`` (e.g. ``'UNICODE_CI_AI'``) attaches a Spark collation to the
    result, so later GROUP BY / DISTINCT / equality fold case and accents the
    way a case- and accent-insensitive database collation does
    ('São Paulo' and 'sao paulo' become one city). Default: binary.
    """
    out = col(c)
    for old, new in replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.lower(F.trim(out))
    return out if collation is None else F.collate(out, collation)


def clean_city(c: ColumnOrName, collation: str | None = None) -> Column:
    return clean_text(c, CITY_REPLACEMENTS, collation)


def clean_category(c: ColumnOrName) -> Column:
    return clean_text(c, CATEGORY_REPLACEMENTS)
