"""Spark session helpers.

A cluster sets its own options (shuffle partitions, checkpoint dir, AQE); these helpers only fill in
what is unset, so tests and local runs get sane defaults without overriding a cluster's choices.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# Options every job relies on. AQE coalesces small shuffle partitions and splits skewed join
# partitions at run time; UTC keeps timestamp parsing identical to the SQL oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Shuffles start with many partitions, which AQE merges by measured size: a task's share of a large table stays small
    # enough not to spill, and small tables still end in a few tasks.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "320",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "riskframe") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("RISKFRAME_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder comes from the session (a shared file system path). Only when it is
    unset, as in local tests, a fresh scratch folder is created.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # pragma: no cover
            d = None
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="riskframe-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder (never a machine-local temp folder on a cluster)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskframe-scratch/{name}-{uuid.uuid4().hex}"
    memo(spark).setdefault("scratch", []).append(path)
    return path


SMALL_ROWS = 1000


def kept(df: DataFrame, rows: int, name: str) -> DataFrame:
    """A result of at most ``rows`` rows, computed once: up to SMALL_ROWS narrow rows as literals of later plans, more as a written table."""
    if rows > SMALL_ROWS:
        return written(df, name)
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def release(spark: SparkSession) -> int:
    """Delete the scratch tables that this session wrote; returns how many there were. Call it when results have been written: lazy frames
    that read them, and fitted things held in the session, are gone afterwards."""
    paths = memo(spark).pop("scratch", [])
    memo(spark).clear()
    for path in paths:
        delete(spark.sparkContext, path)
    return len(paths)


def delete(sc: SparkContext, path: str) -> None:
    """Delete a file or folder of the shared storage."""
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, however often they are read, and kept if executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def memo(spark: SparkSession) -> dict:
    """A store for small fitted things and lazy plans that lives and dies with the session object."""
    if not hasattr(spark, "_riskframe_memo"):
        spark._riskframe_memo = {}
    return spark._riskframe_memo


def session_defaults(spark: SparkSession) -> None:
    """Apply DEFAULT_CONF entries that the running session has not set (once per session). The time zone is
    the exception: it is always set to UTC, as the domain's timestamps are wall-clock times."""
    if memo(spark).get("defaults"):
        return
    memo(spark)["defaults"] = True
    for k, v in DEFAULT_CONF.items():
        if k == "spark.ui.enabled":
            continue
        try:
            cur = spark.conf.get(k, None)
        except Exception:  # pragma: no cover - static conf
            cur = None
        if cur is None:
            try:
                spark.conf.set(k, v)
            except Exception:  # pragma: no cover - static conf
                pass
    # Timestamps in the test tables are wall-clock (NTZ); parse and format them in UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
