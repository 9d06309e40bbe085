"""Session construction and the shared checkpoint folder.

On a cluster the session is handed in by the caller and its settings win;
``get_spark`` only fills defaults for local runs (tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings applied only when the builder creates a new session.
LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app_name: str = "shoplens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("SHOPLENS_DRIVER_MEMORY", "8g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    Uses ``spark.checkpoint.dir`` where the cluster names one (shared
    storage). Only a session on this machine alone (a ``local`` master) may go
    without: it gets one scratch folder. Anywhere else executors would write
    to their own disks and later reads would find nothing, so that is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:                      # Spark Connect: no SparkContext on the client
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", None) if sc is None else sc.master
        if not is_local(master):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all "
                               "executors share")
        if id(spark) not in _SCRATCH:
            _SCRATCH[id(spark)] = tempfile.mkdtemp(prefix="shoplens-ckpt-")
        configured = _SCRATCH[id(spark)]
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def is_local(master: str | None) -> bool:
    """Whether driver and executors are one process: ``local`` or ``local[...]``."""
    return master == "local" or (master or "").startswith("local[")


_SCRATCH: dict[int, str] = {}
