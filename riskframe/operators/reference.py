"""Reference data of a run: its rows, statistics and distributions, saved once and compared with later batches.

``save_reference`` appends three run-partitioned tables under one root:

* ``rows``: the reference rows themselves;
* ``stats``: the tidy statistics of ``monitor.reference_stats``;
* ``distribution``: per numeric feature and value range the distinct values with their counts and running counts, and
  ``ranges``: per feature the range edges, the number of rows, and a mergeable KLL sketch.

``ks_saved`` then needs the batch's own counts only: the batch's distinct values are sent to the saved ranges, meet the
saved running counts there, and both distribution functions are compared at every value. The reference rows are
neither read nor counted again; no feature is sorted in one task, as each range is a window of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..sources.io import list_runs, read_run, write_run
from . import ranking
from .monitor import STATS, column_kinds, reference_stats

RANGES = "feature string, edges array<double>, n long, sketch binary, run_id string"
DISTRIBUTION = "feature string, value_range int, value double, n long, cum_n long, run_id string"


def _before() -> Window:
    """The ranges in front of a row's, of its feature: as many rows as ranges."""
    return Window.partitionBy("feature").orderBy("value_range").rowsBetween(Window.unboundedPreceding, -1)


def _upto() -> Window:
    """The values of a range up to a row's."""
    return Window.partitionBy("feature", "value_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)


def numeric_long(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(feature, value) of the numeric and boolean columns, nulls left out."""
    num, boo, _ = column_kinds(df)
    cols = [c for c in num + boo if cols is None or c in cols]
    long = df.select(*[F.col(c).cast("int" if c in boo else "double").cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    return long.where(F.col("value").isNotNull())


def distribution(df: DataFrame, n_ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(distribution, ranges) of the numeric columns, see the module."""
    long = numeric_long(df)
    b = n_ranges if n_ranges is not None else max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of = ranking.summary(long, ["feature"], "value", moments=False)
    probs = F.array(*[F.lit(i / b) for i in range(1, b)])
    edges = F.array_distinct(F.array_sort(F.kll_sketch_get_quantile_double("sketch", probs))) if b > 1 else F.array().cast("array<double>")
    ranges = of.where("n > 0").select("feature", edges.alias("edges"), "n", "sketch")
    at = ranking.join_small(long, ranges.select("feature", "edges"), ["feature"], None)
    at = at.withColumn("value_range", ranking.range_index(F.col("edges"), F.col("value"), max(b - 1, 1)))
    counts = at.groupBy("feature", "value_range", "value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("feature", "value_range").agg(F.sum("n").alias("in_range"))
    before = total.select("feature", "value_range", F.coalesce(F.sum("in_range").over(_before()), F.lit(0)).alias("before"))
    cum = F.sum("n").over(_upto()) + F.col("before")
    return ranking.join_small(counts, before, ["feature", "value_range"], None).select("feature", "value_range", "value", "n", cum.alias("cum_n")), ranges


def save_reference(df: DataFrame, root: str, run_id: str, n_ranges: int | None = None) -> None:
    """Append one run's reference rows, statistics and distributions under ``root``; earlier runs stay."""
    spark = df.sparkSession
    if run_id in list_runs(spark, f"{root}/stats"):
        raise ValueError(f"run {run_id} is saved already")
    write_run(df, f"{root}/rows", run_id)
    saved = read_run(spark, f"{root}/rows", run_id).drop("run_id")  # everything else is derived from the saved rows
    dist, ranges = distribution(saved, n_ranges)
    write_run(dist, f"{root}/distribution", run_id)
    write_run(ranges, f"{root}/ranges", run_id)
    write_run(reference_stats(saved), f"{root}/stats", run_id)  # last: a run with statistics is complete


def saved_rows(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """Reference rows of the requested run, or of the last one."""
    return read_run(spark, f"{root}/rows", run_id)


def saved_stats(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """Statistics of the requested run, or of the last one; no rows if none was saved."""
    return read_run(spark, f"{root}/stats", run_id, schema=STATS)


def ks_saved(new: DataFrame, root: str, run_id: str | None = None, threshold: float = C.KS_THRESHOLD) -> DataFrame:
    """Two-sample KS of a batch against a saved run: ``feature, n_ref, n_new, ks_statistic, p_value, drifted`` for the numeric
    features of both. The same figures as ``monitor.drift_ks`` against the reference rows."""
    spark = new.sparkSession
    ranges = read_run(spark, f"{root}/ranges", run_id, schema=RANGES).select("feature", "edges", F.col("n").alias("n_ref"))
    saved = read_run(spark, f"{root}/distribution", run_id, schema=DISTRIBUTION)
    own = numeric_long(new).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("m"))
    own = ranking.join_small(own, ranges.select("feature", "edges", F.size("edges").alias("k")), ["feature"], None)
    most = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), ranges.agg(F.max(F.size("edges"))).first()[0] or 1)
    own = own.withColumn("value_range", ranking.range_index(F.col("edges"), F.col("value"), most)).select("feature", "value_range", "value", "m")
    known = own.select("feature").distinct()
    both = saved.join(known, "feature", "left_semi").select("feature", "value_range", "value", "cum_n", F.lit(0).cast("long").alias("m")) \
        .unionByName(own.withColumn("cum_n", F.lit(None).cast("long")))
    both = both.groupBy("feature", "value_range", "value").agg(F.max("cum_n").alias("cum_n"), F.sum("m").alias("m"))
    per = both.groupBy("feature", "value_range").agg(F.max("cum_n").alias("c"), F.sum("m").alias("s"))
    per = per.select("feature", "value_range", F.coalesce(F.max("c").over(_before()), F.lit(0)).alias("ref_before"), F.coalesce(F.sum("s").over(_before()), F.lit(0)).alias("new_before"))
    # a value that the reference lacks has the running count of the last one below it
    run = ranking.join_small(both, per, ["feature", "value_range"], None) \
        .select("feature", F.coalesce(F.max("cum_n").over(_upto()), "ref_before").alias("cum_n"), (F.sum("m").over(_upto()) + F.col("new_before")).alias("cum_m"))
    total = own.groupBy("feature").agg(F.sum("m").alias("n_new"))
    run = ranking.join_small(ranking.join_small(run, total, ["feature"], None), ranges.select("feature", "n_ref"), ["feature"], None)
    gap = F.abs(F.col("cum_n") / F.col("n_ref") - F.col("cum_m") / F.col("n_new"))
    out = run.groupBy("feature").agg(F.first("n_ref").alias("n_ref"), F.first("n_new").alias("n_new"), F.max(gap).alias("ks_statistic"))
    p = ranking.kolmogorov_pvalue(F.col("ks_statistic"), F.col("n_ref").cast("double"), F.col("n_new").cast("double"))
    return out.withColumn("p_value", p).withColumn("drifted", F.col("ks_statistic") > threshold)
