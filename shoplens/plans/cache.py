"""Reuse of intermediate frames that are read several times.

``materialize`` writes a frame once as Parquet under the session's checkpoint
folder (``spark.checkpoint.dir`` on a cluster: shared, reliable storage) and
reads it back. That cuts the lineage: later reports plan against a small
scan instead of re-analysing the whole chain of views, a lost executor costs
a re-read instead of a recomputation, and Parquet reads get column pruning,
filter pushdown and real size statistics for join planning.

Views may be bucketed (``bucket_by``): rows are shuffled on that key once, when
the view is written, and every later join or aggregate on the key reads them
as they lie.

``Views`` is a store of such tables that outlives the session: a view belongs
to the state of the files it was built from and to the code that built it, a
manifest written after the data says that it is complete, and a second session
over the same state finds it there. States that are no longer wanted are
deleted, the newest ``KEEP_STATES`` of a folder stay.

``keep`` persists with MEMORY_AND_DISK for frames that one operator reads a
few times (count, sample, statistics, result). Every frame kept here is a
deterministic function of the input tables, so recomputed blocks hold the
same rows. ``release`` drops everything kept so far.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shoplens.session import checkpoint_dir

_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(df)
    return df


def materialize(df: DataFrame, name: str, bucket_by: str | None = None) -> DataFrame:
    """Write ``df`` to ``<checkpoint dir>/shoplens/<run>/<name>`` and read it back.

    The rows read back must be as many as were written: fewer means that the
    folder is not shared between the executors and this process."""
    path = os.path.join(checkpoint_dir(df.sparkSession), "shoplens", _run_id(), name)
    buckets, rows = _write(df, path, bucket_by)
    back = _read(df.sparkSession, path, df.schema, buckets)
    _check_rows(rows, back.count(), path)
    return back


def _write(df: DataFrame, path: str, bucket_by: str | None) -> tuple[list | None, int]:
    """Write a view; its bucketing (column, number of buckets) and its rows."""
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if bucket_by is None:
        df.write.mode("overwrite").parquet(path)
        return None, seen.get["rows"]
    # As many buckets as shuffle partitions: a side that is not bucketed is shuffled to the buckets, not the other way round.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, bucket_by).write.mode("overwrite").format("parquet").option("path", path) \
        .bucketBy(n, bucket_by).sortBy(bucket_by).saveAsTable(_table_name(path))
    return [bucket_by, n], seen.get["rows"]


def _read(spark: SparkSession, path: str, schema: StructType, buckets: list | None) -> DataFrame:
    """A written view. The written schema is passed back explicitly: types come
    back exactly (TIMESTAMP_NTZ stays NTZ whatever the inference settings) and
    no footer has to be read to infer them."""
    if buckets is None:
        return spark.read.schema(schema).parquet(path)
    name = _table_name(path)
    if not spark.catalog.tableExists(name):                  # written by another session
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY (`{buckets[0]}`) "
                  f"SORTED BY (`{buckets[0]}`) INTO {buckets[1]} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _table_name(path: str) -> str:
    return "shoplens_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _check_rows(written: int, found: int, path: str) -> None:
    if found != written:
        raise RuntimeError(f"{written} rows were written to {path}, {found} are there: is the folder shared?")


_RUN = []


def _run_id() -> str:
    if not _RUN:
        _RUN.append(uuid.uuid4().hex[:12])
    return _RUN[0]


# ---------------------------------------------------------------------------
# views that outlive the session
# ---------------------------------------------------------------------------

KEEP_STATES = 2


def code_state() -> str:
    """Digest of the library's sources: views of other code are not reused."""
    root, h = Path(__file__).resolve().parent.parent, hashlib.sha256()
    for part in ("functions", "operators", "plans", "sources"):
        for f in sorted((root / part).glob("*.py")):
            h.update(f.name.encode() + f.read_bytes())
    return h.hexdigest()


class Files:
    """The few operations on small files and folders that a manifest needs, on
    whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Under another name first: a file that is there is whole."""
        part = f"{name}.{uuid.uuid4().hex[:8]}"
        stream = self.fs.create(self.path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.delete(self.path(name), False)
        self.fs.rename(self.path(part), self.path(name))

    def folders(self, name: str) -> list[tuple[int, str]]:
        """(time of change, name) of the folders in a folder."""
        if not self.fs.exists(self.path(name)):
            return []
        return sorted((s.getModificationTime(), s.getPath().getName()) for s in self.fs.listStatus(self.path(name)) if s.isDirectory())

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Views:
    """Views of one data folder in one state, under
    ``<checkpoint dir>/shoplens/views/<folder>/<state>``.

    Each view is a folder of its own name and a manifest beside it (schema,
    rows, bucketing and the folder), written last; whoever writes a view again
    writes a new folder and a new manifest, so a reader never sees half of
    one. Making the store of a new state deletes the oldest states of the same
    folder beyond ``KEEP_STATES``: a session that still reads one of those has
    to build its views again."""

    def __init__(self, spark: SparkSession, folder: str, state: object):
        self.spark = spark
        name = re.sub(r"[^A-Za-z0-9]+", "_", folder).strip("_")[-60:] + "_" + hashlib.sha256(folder.encode()).hexdigest()[:8]
        self.home = os.path.join(checkpoint_dir(spark), "shoplens", "views", name)
        self.state = hashlib.sha256(repr((state, code_state())).encode()).hexdigest()[:20]
        self.files = Files(spark, self.home)
        self.prune()

    def place(self, name: str) -> str:
        return os.path.join(self.home, self.state, name)

    def get(self, name: str, build: Callable[[], DataFrame], bucket_by: str | None = None) -> DataFrame:
        """The view, from its manifest if it has one, else built, written and read back."""
        manifest = self.place(name + ".json")
        text = self.files.read(manifest)
        if text is None:
            df = build()
            path = self.place(f"{name}-{uuid.uuid4().hex[:8]}")
            buckets, rows = _write(df, path, bucket_by)
            _check_rows(rows, _read(self.spark, path, df.schema, buckets).count(), path)
            text = json.dumps({"path": path, "rows": rows, "buckets": buckets, "schema": df.schema.json()})
            self.files.write(manifest, text)
        m = json.loads(text)
        return _read(self.spark, m["path"], StructType.fromJson(json.loads(m["schema"])), m["buckets"])

    def prune(self, keep: int = KEEP_STATES) -> list[str]:
        """Delete all but the newest states of this folder; this one always stays."""
        others = [s for _, s in self.files.folders(self.home) if s != self.state]
        old = others[:max(0, len(others) - (keep - 1))]
        for s in old:
            self.files.remove(os.path.join(self.home, s))
        return old


def remove_run(spark: SparkSession) -> None:
    """Delete what :func:`materialize` wrote in this run, once its reports are written elsewhere."""
    if _RUN:
        folder = os.path.join(checkpoint_dir(spark), "shoplens", _RUN.pop())
        Files(spark, folder).remove(folder)


def release() -> None:
    while _KEPT:
        _KEPT.pop().unpersist(blocking=False)
