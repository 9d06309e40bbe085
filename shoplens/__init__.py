"""shoplens: customer analytics on order data, written as Spark DataFrame operators.

Every public operator is a function ``op(DataFrame, ..., params) -> DataFrame``.
Nothing is collected on the driver except one-row scalars.

Sub-packages
------------
sources    schemas, CSV/Parquet readers, the star-schema adapter (``Tables``)
functions  column helpers (exact ratios and rounding, text cleaning, joins on
           hot keys, the category dictionary)
operators  the analyses: master table, funnel, sequence, Lorenz, segments,
           categories, regions, first purchase, trends, RFM, cohort, statistics,
           data-quality checks, and the distributed global-rank operator
plans      query catalogue wiring operators to tables (used by
           ``__spark_entry__.py``) and the matching SQL oracle text
"""

from shoplens.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
