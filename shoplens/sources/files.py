"""File readers and writers.

CSV dialect of the raw exports: comma separated, fields optionally enclosed in
double quotes, a doubled quote inside a quoted field is a literal quote,
newlines may occur inside quoted fields, one header line. Empty fields become
NULL (never zero dates or zero numbers). The schema is always declared; no
inference pass over the data.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.sources import schemas

CSV_OPTIONS = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
    "nullValue": "",
    "emptyValue": "",
}
BAD = "_bad_record"
FILE = "_file"


def csv_options(multi_line: bool = True) -> dict[str, str]:
    return CSV_OPTIONS | {"multiLine": str(bool(multi_line)).lower()}


def read_marked(spark: SparkSession, path: str, table: str, multi_line: bool = True) -> DataFrame:
    """Records of a raw file under its declared schema, and beside them the
    text of a record that does not fit it (``_bad_record``, else NULL) and the
    file it came from (``_file``)."""
    fields = [*schemas.TABLES[table].fields, T.StructField(BAD, T.StringType())]
    df = (spark.read.schema(T.StructType(fields)).options(**csv_options(multi_line))
          .option("columnNameOfCorruptRecord", BAD).option("enforceSchema", "true").csv(path))
    # The line end is the reader's, not the record's; a record of white space keeps its text.
    return _finish(df.withColumn(BAD, F.regexp_replace(BAD, r"[\r\n]+$", ""))
                   .withColumn(FILE, F.col("_metadata.file_path")), table)


def _finish(df: DataFrame, table: str) -> DataFrame:
    return df.withColumn("zip_code_prefix", F.lpad(F.col("zip_code_prefix"), 5, "0")) if table == "sellers" else df


def reject_reason(table: str, record: str = BAD) -> Column:
    """Why a record does not fit the schema of its table: another number of
    fields, or the first value that its column's type cannot hold. The record
    is split again as text, so the reason names the value as it is written."""
    names = [f.name for f in schemas.TABLES[table].fields]
    text = ", ".join(f"`{n}` STRING" for n in [*names, BAD])
    opts = {k: v for k, v in CSV_OPTIONS.items() if k in ("sep", "quote", "escape", "mode", "nullValue", "emptyValue")}
    again = F.from_csv(F.col(record), text, opts | {"columnNameOfCorruptRecord": BAD})
    reason = F.when(again[BAD].isNotNull(), F.lit(f"number of fields is not {len(names)}"))
    for f in schemas.TABLES[table].fields:
        if not isinstance(f.dataType, T.StringType):
            reason = reason.when(again[f.name].isNotNull() & F.col(f"`{f.name}`").isNull(),
                                 F.concat(F.lit(f"{f.name}: not {f.dataType.simpleString()}: "), again[f.name]))
    return reason.otherwise(F.lit("not readable as a record"))


def import_table(spark: SparkSession, path: str, table: str, target: str,
                 multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Load a raw file into Parquet under ``target``, in one pass over it:
    (records that fit the schema, rejected records).

    Accepted records go to ``target/rejected=false`` with the table's columns;
    the others to ``target/rejected=true`` with the text of the record, its
    file and the reason (``table_name, source_file, record, reason``), and none
    of their values reaches the table. Both come back as plain scans, so every
    later report reads columnar files instead of parsing text again. An
    existing import in ``target`` is replaced.
    """
    bad = F.col(BAD).isNotNull()
    (read_marked(spark, path, table, multi_line)
     .withColumn("_reason", F.when(bad, reject_reason(table))).withColumn(FILE, F.when(bad, F.col(FILE)))
     .withColumn("rejected", bad).write.mode("overwrite").partitionBy("rejected").parquet(target))
    return imported(spark, target, table)


def imported(spark: SparkSession, target: str, table: str) -> tuple[DataFrame, DataFrame]:
    """The two parts of an earlier :func:`import_table`."""
    schema = schemas.TABLES[table]
    stored = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields],
                           *[T.StructField(c, T.StringType()) for c in (BAD, FILE, "_reason")],
                           T.StructField("rejected", T.BooleanType())])
    df = spark.read.schema(stored).parquet(target)
    good = df.where(~F.col("rejected")).select(*[f.name for f in schema.fields])
    rejects = df.where("rejected").select(F.lit(table).alias("table_name"), F.col(FILE).alias("source_file"),
                                          F.col(BAD).alias("record"), F.col("_reason").alias("reason"))
    return good, rejects


def rejected_rows(spark: SparkSession, path: str, table: str, multi_line: bool = True) -> DataFrame:
    """One row: how many records of a raw file do not fit the declared schema
    (a value that cannot be read, or another number of fields)."""
    df = read_marked(spark, path, table, multi_line)
    # Every column is read (a scan pruned to the marker would not parse the values): always true, but not for the optimizer.
    parsed = F.pmod(F.xxhash64(*df.columns), F.lit(2)) < 2
    return df.agg(F.count(F.when(F.col(BAD).isNotNull() & parsed, F.lit(1))).alias("rejected"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds a file or folder there, on whatever file system."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def load_csv(spark: SparkSession, path: str, table: str, multi_line: bool = True) -> DataFrame:
    """Read one raw table with its declared schema. Values that cannot be read
    become NULL; :func:`rejected_rows` counts their records and
    :func:`import_table` sets them apart.

    ``multi_line`` (default): line breaks may lie inside quoted fields of any
    table; a file is then one task's work, so large exports should come as
    folders of files. Whoever knows that a table has none passes ``False``,
    and its files are split between tasks.

    Windows line ends inside values are left to ``clean_text``; trailing ``\\r``
    at line ends is handled by the CSV reader. The sellers zip is left-padded
    to five characters (it is an integer in the source export).
    """
    df = spark.read.schema(schemas.TABLES[table]).options(**csv_options(multi_line)).csv(path)
    return _finish(df, table)


def load_parquet(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if table is not None:
        schema = schemas.TABLES[table]
        df = df.select([F.col(f.name).cast(f.dataType) for f in schema.fields])
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Sink for any result (the reference hands results to a client or a CSV)."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        # White space is part of a value, and a value's line breaks are kept inside quotes.
        writer = (writer.option("header", "true").option("quote", '"').option("escape", '"')
                  .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
                  .option("timestampNTZFormat", CSV_OPTIONS["timestampNTZFormat"]))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
