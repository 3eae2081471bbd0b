"""Streaming jobs: daily drift of the event stream, scoring, performance metrics per micro-batch, monitored performance.

Daily drift: every micro-batch is aggregated by day and event type to mergeable moments (count, exact sum parts, mean,
sum of squared deviations) and written to a table folder of its own batch id; a retried batch overwrites its folder, so
the sink is idempotent. Reading the table merges the moments of all batches, so the result does not depend on the order in
which files and events arrive: there is no watermark, nothing is late, and the stream keeps no state.

Monitored performance is a second stream, over the table of the batches' metrics: keyed state holds a model's first entry
ever and its last entries, and every batch's entry leaves with its comparison with that baseline.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as C
from ..functions.expressions import exact_avg, exact_parts, merged_sum
from ..operators import monitor
from ..sources import fixtures
from ..sources.io import path_exists


def reference_by_type(events: DataFrame, split_ts: str = fixtures.DRIFT_SPLIT_TS) -> DataFrame:
    ref = events.where(F.col("ts") < F.to_timestamp_ntz(F.lit(split_ts)))
    return ref.groupBy("event_type").agg(exact_avg("value").alias("ref_mean"), F.stddev_samp("value").alias("ref_std"))


def compare_daily(daily: DataFrame, ref: DataFrame, threshold: float = C.DRIFT_THRESHOLD) -> DataFrame:
    eps = F.lit(C.RELATIVE_EPS)
    md = F.abs(F.col("mean") - F.col("ref_mean")) / F.greatest(F.abs(F.col("ref_mean")), eps)
    sd = F.abs(F.col("std") - F.col("ref_std")) / F.greatest(F.abs(F.col("ref_std")), eps)
    j = daily.join(ref, "event_type", "inner")  # one row per event type: AQE broadcasts it after measuring
    return j.select("day", "event_type", "n", "mean", "std", md.alias("mean_diff"),
                    ((md > threshold) | F.coalesce(sd > threshold, F.lit(False))).alias("drifted"))


def daily_drift(events: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Batch twin: per calendar day and event type."""
    from ..plans.common import sig
    daily = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), exact_avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    out = compare_daily(daily, reference_by_type(events))
    return out.withColumn("std", sig("std"))


def batch_table(path: str):
    """A foreachBatch sink: each micro-batch becomes the folder batch=<id>, overwritten if the batch is retried."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable moments of a part of the rows: n, exact sum parts, mean and sum of squared deviations."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"), *exact_parts(value), F.avg(value).alias("part_mean"),
                                 (F.var_pop(value) * F.count(value)).alias("m2"))


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, std (ddof 1) of all rows from the moments of their parts, by parallel variance."""
    whole = Window.partitionBy(*keys)  # one row a part
    centre = F.sum(F.col("n_values") * F.coalesce("part_mean", F.lit(0.0))).over(whole) / F.nullif(F.sum("n_values").over(whole), F.lit(0))
    rows = parts.withColumn("shift", F.col("part_mean") - centre)
    var = F.sum(F.col("m2") + F.col("n_values") * F.col("shift") * F.col("shift")) / F.when(F.sum("n_values") > 1, F.sum("n_values") - 1)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), (merged_sum() / F.nullif(F.sum("n_values"), F.lit(0))).alias("mean"), F.sqrt(var).alias("std"))


def stream_daily_stats(spark: SparkSession, events_path: str, checkpoint: str, table: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Run the daily stream over all files there are (``availableNow``); day, event_type, n, mean, std from the table.

    Later runs on the same checkpoint add the files that came since; events of any age count in their day."""
    schema = spark.read.parquet(events_path).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(events_path)
    write = batch_table(table)

    def part(df: DataFrame, batch_id: int) -> None:
        write(moments(df.withColumn("day", F.to_date("ts")), ["day", "event_type"], "value"), batch_id)

    q = src.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    none = moments(spark.createDataFrame([], schema).withColumn("day", F.to_date("ts")), ["day", "event_type"], "value")
    return merged_moments(spark.read.parquet(table) if path_exists(spark, table) else none, ["day", "event_type"])


def stream_scores(spark: SparkSession, source_path: str, checkpoint: str, table: str, score, max_files_per_trigger: int = 4) -> DataFrame:
    """Score a stream of feature rows with ``score(DataFrame) -> DataFrame`` into a Parquet table (exactly once)."""
    schema = spark.read.parquet(source_path).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_path)
    q = score(src).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(table)


def stream_performance(spark: SparkSession, source_path: str, checkpoint: str, history: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Metrics of every micro-batch of labelled predictions (ts, prediction, actual), appended to the history table:
    batch, ts (first of the batch), n, accuracy, precision, recall, f1. A batch is read once."""
    schema = spark.read.parquet(source_path).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_path)
    write = batch_table(history)

    def entry(df: DataFrame, batch_id: int) -> None:
        write(monitor.binary_performance(df, extra=[F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n")]), batch_id)

    q = src.writeStream.foreachBatch(entry).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(history)


CHECKED = "model string, batch int, ts date, accuracy double, f1 double, baseline_accuracy double, baseline_f1 double, rel_accuracy_change double, " \
          "rel_f1_change double, degradation_detected boolean, entries long, kept int"
KEPT = "base_accuracy double, base_f1 double, entries long, kept array<struct<batch:int,accuracy:double,f1:double>>"


def stream_monitor(spark: SparkSession, history: str, checkpoint: str, table: str, model: str = "current", keep: int = C.HISTORY_KEEP,
                   min_accuracy: float = C.MIN_ACCURACY_MONITOR, min_f1: float = C.MIN_F1_MONITOR,
                   rel_threshold: float = C.RELATIVE_DEGRADATION_THRESHOLD) -> DataFrame:
    """Stateful performance check over the history table: each new entry of a model (column ``model``, else one model of that name) is
    compared with the first entry ever and leaves as a row with ``degradation_detected``. The state of a model is its baseline, the number of
    entries so far and its last ``keep`` entries; it lives in the checkpoint, so a restarted stream goes on where it was."""
    schema = spark.read.parquet(history).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(history)
    name = F.col("model") if "model" in schema.names else F.lit(model)
    rows = src.select(name.alias("model"), F.col("batch").cast("int").alias("batch"), F.col("ts").cast("date").alias("ts"), "accuracy", "f1")

    def check(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base_accuracy, base_f1, entries, kept = state.get if state.exists else (None, None, 0, [])
        kept, out = [tuple(k) for k in kept], []
        for r in pd.concat(list(parts)).sort_values("batch").itertuples():
            if not entries:
                base_accuracy, base_f1 = float(r.accuracy), float(r.f1)
            entries += 1
            kept = [*kept, (int(r.batch), float(r.accuracy), float(r.f1))][-keep:]
            change = (r.accuracy - base_accuracy) / max(base_accuracy, 1e-10), (r.f1 - base_f1) / max(base_f1, 1e-10)
            worse = r.accuracy < min_accuracy or r.f1 < min_f1 or change[0] < rel_threshold or change[1] < rel_threshold
            out.append((key[0], r.batch, r.ts, r.accuracy, r.f1, base_accuracy, base_f1, *change, bool(worse), entries, len(kept)))
        state.update((base_accuracy, base_f1, entries, kept))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHECKED.split(", ")])

    # one row a batch and model comes in: what is large has been aggregated before
    checked = rows.groupBy("model").applyInPandasWithState(check, CHECKED, KEPT, "append", GroupStateTimeout.NoTimeout)
    q = checked.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(CHECKED).parquet(table)
