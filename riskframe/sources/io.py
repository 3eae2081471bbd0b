"""Readers and sinks.

* ``read_table``: CSV or Parquet chosen by path suffix (or an explicit format), explicit schema for CSV,
  NaN normalised to null so aggregates skip it.
* ``optional_table``: a missing optional source yields an empty frame of the declared schema.
* ``read_run``: run-partitioned tables; the runs are read off the partition folders, one is chosen in the driver, and
  only its folder is listed and scanned, under a literal partition filter.
* sinks append per ``run_id`` partition, so older runs stay as history/backup.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import nan_to_null

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".orc": "orc"}


def detect_format(path: str) -> str:
    p = path.rstrip("/").lower()
    for suffix, fmt in FORMATS.items():
        if p.endswith(suffix):
            return fmt
    raise ValueError(f"Unsupported file format: {path}")


def normalise_nans(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column (pandas skips NaN, Spark aggregates would not)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not cols:
        return df
    return df.withColumns({c: nan_to_null(F.col(c)).cast(df.schema[c].dataType) for c in cols})


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None,
               **options) -> DataFrame:
    fmt = fmt or detect_format(path)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("mode", "PERMISSIVE")
        if schema is not None:
            reader = reader.schema(schema)
        else:
            reader = reader.option("inferSchema", "true")
    elif schema is not None and fmt == "json":
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(path)
    if schema is not None and fmt != "csv":
        missing = [f.name for f in schema.fields if f.name not in df.columns]
        if missing:
            df = df.withColumns({m: F.lit(None).cast(schema[m].dataType) for m in missing})
    return normalise_nans(df)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system, so it works for any cluster storage."""
    jvm = spark.sparkContext._jvm
    jsc = spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def optional_table(spark: SparkSession, path: str | None, schema: T.StructType, fmt: str | None = None) -> DataFrame:
    """Optional source: absent path -> empty frame with the declared schema."""
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_table(spark, path, schema, fmt)


def list_runs(spark: SparkSession, path: str, run_col: str = "run_id") -> list[str]:
    """The runs of a partitioned table, ascending, from its partition metadata: the folders of a path, or the catalog's
    partitions of a table name. No data file is opened. Folders without a data file (a run that was begun) do not count."""
    if "/" not in path and spark.catalog.tableExists(path):
        # one row a partition: run_id=... , further partition columns behind a slash
        names = [r[0].split("/", 1)[0] for r in spark.sql(f"SHOW PARTITIONS {path}").collect()]
        found = {n.split("=", 1)[1] for n in names if n.startswith(f"{run_col}=")}
    else:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = set()
        for status in fs.listStatus(hadoop) if fs.exists(hadoop) else []:
            name = status.getPath().getName()
            if status.isDirectory() and name.startswith(f"{run_col}="):
                if any(not x.getPath().getName().startswith(("_", ".")) for x in fs.listStatus(status.getPath())):
                    found.add(unquote(name.split("=", 1)[1]))
    return sorted(found - {"__HIVE_DEFAULT_PARTITION__"})


def choose_run(runs: list[str], run_id: str | None = None) -> str | None:
    """The requested run if it is there, else the lexicographically last one; None without runs."""
    return run_id if run_id in runs else max(runs, default=None)


def read_run(spark: SparkSession, path: str, run_id: str | None = None, run_col: str = "run_id", schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of the requested run if it was saved, else of the last run, with the run as a text column.

    The choice is made from partition metadata (``list_runs``); of a path only the chosen folder is listed, of a table only the
    chosen partition is planned. Without any run: the empty frame of ``schema``, or an error if none is given."""
    run = choose_run(list_runs(spark, path, run_col), run_id)
    if run is None:
        if schema is None:
            raise FileNotFoundError(f"no run in {path}")
        return spark.createDataFrame([], schema)
    if "/" not in path and spark.catalog.tableExists(path):
        return spark.table(path).where(F.col(run_col) == F.lit(run))
    folder = [f"{path.rstrip('/')}/{run_col}={part}" for part in (escape_partition(run), run)]
    folder = next((f for f in folder if path_exists(spark, f)), folder[0])
    data = spark.read.parquet(folder).schema if schema is None else (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    data = T.StructType([f for f in data.fields if f.name != run_col] + [T.StructField(run_col, T.StringType())])  # never read as a date or number
    return spark.read.schema(data).option("basePath", path).parquet(folder).where(F.col(run_col) == F.lit(run))


def escape_partition(value: str) -> str:
    """A partition value as Spark writes it in a folder's name. Fixed set of characters."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\\x7f{[]^" or ord(c) < 32 else c for c in value)


def write_run(df: DataFrame, path: str, run_id: str, mode: str = "append") -> None:
    """Append one run's rows under ``run_id=<id>`` (older runs remain as history)."""
    (df.withColumn("run_id", F.lit(run_id))
       .write.mode(mode).partitionBy("run_id").parquet(path))
