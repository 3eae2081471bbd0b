"""Model monitoring: reference statistics, drift (stats, categorical, KS), performance checks, history.

Reference statistics are a tidy table ``(feature, kind, stat, value)``: numeric -> mean, std, min, max,
median, p10, p90; boolean -> mean; categorical -> one share per category plus ``nunique``. Numeric
features are unpivoted so every statistic of every feature comes from two scans, independent of the number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.expressions import exact_avg
from ..sources.io import read_run
from . import ranking
from .stats import unpivot_numeric, unpivot_strings

STATS = "feature string, kind string, stat string, value double, run_id string"  # a table of saved statistics
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def column_kinds(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    boo = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    cat = [f.name for f in df.schema.fields if f.name not in num and f.name not in boo]
    return num, boo, cat


def numeric_stats(df: DataFrame, cols: list[str], quantiles: bool = True) -> DataFrame:
    """Wide per-feature numeric stats: ``feature, n, mean, std, min, max[, median, p10, p90]``."""
    long = unpivot_numeric(df, cols).where(F.col("value").isNotNull())
    if quantiles:
        return ranking.described(long, ["feature"], "value", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), exact_avg("value").alias("mean"),
                                       F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                       F.max("value").alias("max"))


def boolean_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, n long, mean double")
    long = df.select(*[F.col(c).cast("int").alias(c) for c in cols]).unpivot([], cols, "feature", "value") \
        .where(F.col("value").isNotNull())
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), exact_avg("value").alias("mean"))


def category_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """``feature, category, n, share, nunique`` (nulls dropped; category cast to string)."""
    long = unpivot_strings(df, cols).where(F.col("value").isNotNull())
    counts = long.groupBy("feature", F.col("value").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy("feature").agg(F.sum("n").alias("__total"), F.count(F.lit(1)).alias("nunique"))
    j = ranking.join_small(counts, tot, ["feature"], len(cols))
    return j.select("feature", "category", "n", (F.col("n") / F.col("__total")).alias("share"), "nunique")


def reference_stats(df: DataFrame, quantiles: bool = True) -> DataFrame:
    """Tidy reference statistics of every column (empty columns skipped). ``quantiles=False`` leaves out
    median/p10/p90 (drift checks only compare means, stds and shares)."""
    num, boo, cat = column_kinds(df)
    parts = []
    if num:
        ns = numeric_stats(df, num, quantiles)
        stats = ["mean", "std", "min", "max"] + (["median", "p10", "p90"] if quantiles else [])
        parts.append(ns.select("feature", *stats).unpivot(["feature"], stats, "stat", "value")
                     .select("feature", F.lit("numeric").alias("kind"), "stat", "value"))
    if boo:
        parts.append(boolean_stats(df, boo).select("feature", F.lit("boolean").alias("kind"),
                                                   F.lit("mean").alias("stat"), "mean"))
    if cat:
        cs = category_shares(df, cat)
        parts.append(cs.select("feature", F.lit("categorical").alias("kind"), F.col("category").alias("stat"),
                               "share"))
        parts.append(cs.groupBy("feature").agg(F.first("nunique").cast("double").alias("value"))
                     .select("feature", F.lit("categorical").alias("kind"), F.lit("__nunique").alias("stat"), "value"))
    out = parts[0].toDF("feature", "kind", "stat", "value")
    for p in parts[1:]:
        out = out.unionByName(p.toDF("feature", "kind", "stat", "value"))
    return out


def drift_numeric(new: DataFrame, ref_stats: DataFrame, threshold: float = C.DRIFT_THRESHOLD) -> DataFrame:
    """Relative change of mean and std against the reference stats (denominator ``max(|ref|, 1e-10)``)."""
    num, _, _ = column_kinds(new)
    if not num:
        return new.sparkSession.createDataFrame([], "feature string, mean_diff double, std_diff double, drifted boolean")
    ref = ref_stats.where(F.col("kind") == "numeric").groupBy("feature").agg(
        F.max(F.when(F.col("stat") == "mean", F.col("value"))).alias("ref_mean"),
        F.max(F.when(F.col("stat") == "std", F.col("value"))).alias("ref_std"))
    long = unpivot_numeric(new, num).where(F.col("value").isNotNull())
    cur = long.groupBy("feature").agg(exact_avg("value").alias("new_mean"), F.stddev_samp("value").alias("new_std"))
    j = cur.join(ref, "feature", "inner")
    eps = F.lit(C.RELATIVE_EPS)
    md = F.abs(F.col("new_mean") - F.col("ref_mean")) / F.greatest(F.abs(F.col("ref_mean")), eps)
    sd = F.abs(F.col("new_std") - F.col("ref_std")) / F.greatest(F.abs(F.col("ref_std")), eps)
    return j.select("feature", md.alias("mean_diff"), sd.alias("std_diff"),
                    ((md > threshold) | (sd > threshold)).alias("drifted"))


def drift_categorical(new: DataFrame, ref_stats: DataFrame, threshold: float = C.CATEGORICAL_DRIFT_THRESHOLD,
                      cols: list[str] | None = None) -> DataFrame:
    """New vs reference category shares: unseen categories count when their share exceeds the
    threshold; known ones always contribute |diff|; vanished categories are ignored."""
    _, _, cat = column_kinds(new)
    cols = cols or cat
    if not cols:
        return new.sparkSession.createDataFrame([], "feature string, max_category_diff double, drifted boolean")
    ref = ref_stats.where((F.col("kind") == "categorical") & (F.col("stat") != "__nunique")) \
        .select("feature", F.col("stat").alias("category"), F.col("value").alias("ref_share"))
    cur = category_shares(new, cols).select("feature", "category", F.col("share").alias("new_share"))
    known_features = ref.select("feature").distinct()
    j = cur.join(known_features, "feature", "left_semi").join(ref, ["feature", "category"], "left")
    unseen = F.col("ref_share").isNull()
    diff = F.when(unseen, F.when(F.col("new_share") > threshold, F.col("new_share"))).otherwise(
        F.abs(F.col("new_share") - F.col("ref_share")))
    flag = F.when(unseen, F.col("new_share") > threshold).otherwise(F.abs(F.col("new_share") - F.col("ref_share")) > threshold)
    return j.groupBy("feature").agg(F.coalesce(F.max(diff), F.lit(0.0)).alias("max_category_diff"),
                                    F.max(flag).alias("drifted"))


def drift_ks(new: DataFrame, ref: DataFrame, threshold: float = C.KS_THRESHOLD, n_ranges: int | None = None) -> DataFrame:
    """Two-sample KS per common numeric column (booleans count as numeric)."""
    num_n, boo_n, _ = column_kinds(new)
    num_r, boo_r, _ = column_kinds(ref)
    cols = [c for c in num_n + boo_n if c in set(num_r + boo_r)]
    ln = new.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    lr = ref.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    ks = ranking.ks_two_sample(lr, ln, ["feature"], "value", n_ranges)
    return ks.withColumn("drifted", F.col("ks_statistic") > threshold)


def drift_report(new: DataFrame, ref: DataFrame | None = None, ref_stats: DataFrame | None = None,
                 saved_stats: str | None = None) -> DataFrame:
    """Dispatch: statistics when reference stats are given, KS against reference data when those are, else the
    latest run in the table of saved statistics (path or table name; none saved: no rows)."""
    if ref_stats is None and ref is None and saved_stats is not None:
        ref_stats = read_run(new.sparkSession, saved_stats, schema=STATS)
    if ref_stats is not None:
        a = drift_numeric(new, ref_stats).select("feature", F.lit("stats").alias("method"),
                                                 F.greatest("mean_diff", "std_diff").alias("score"), "drifted")
        b = drift_categorical(new, ref_stats).select("feature", F.lit("categorical").alias("method"),
                                                     F.col("max_category_diff").alias("score"), "drifted")
        return a.unionByName(b)
    if ref is None:
        raise ValueError("need reference data, reference statistics or saved statistics")
    return drift_ks(new, ref).select("feature", F.lit("ks").alias("method"), F.col("ks_statistic").alias("score"),
                                     "drifted")


def binary_performance(df: DataFrame, pred: str = "prediction", actual: str = "actual",
                       group_cols: list[str] | None = None, extra: list[Column] | None = None) -> DataFrame:
    """accuracy, and precision/recall/F1 of class 1 with the max(n,1) and max(p+r,1e-10) guards; ``extra``: further named
    aggregates of the same pass."""
    g = list(group_cols or [])
    p1 = F.col(pred) == 1
    a1 = F.col(actual) == 1
    aggs = [F.count(F.lit(1)).alias("__n"), F.sum((F.col(pred) == F.col(actual)).cast("long")).alias("__correct"),
            F.sum((p1 & a1).cast("long")).alias("__tp"), F.sum(p1.cast("long")).alias("__pp"),
            F.sum(a1.cast("long")).alias("__ap"), *(extra or [])]
    m = df.groupBy(*g).agg(*aggs) if g else df.agg(*aggs)
    more = [c for c in m.columns if c not in g and not c.startswith("__")]
    prec = F.col("__tp") / F.greatest(F.col("__pp"), F.lit(1))
    rec = F.col("__tp") / F.greatest(F.col("__ap"), F.lit(1))
    m = m.select(*g, *more, (F.col("__correct") / F.col("__n")).alias("accuracy"), prec.alias("precision"), rec.alias("recall"))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-10))
    return m.withColumn("f1", f1)


def history_tail(history: DataFrame, keep: int = C.HISTORY_KEEP, ts: str = "ts") -> DataFrame:
    """Last ``keep`` entries (a top-k: per-partition top-k, then a small merge)."""
    return history.orderBy(F.col(ts).desc()).limit(keep)


def baseline(history: DataFrame, ts: str = "ts") -> DataFrame:
    """Baseline = the first entry ever, over the untrimmed history: it is set once and outlives the trim."""
    return history.agg(F.min_by("accuracy", ts).alias("baseline_accuracy"), F.min_by("f1", ts).alias("baseline_f1"))


def performance_check(current: DataFrame, base: DataFrame | None,
                      min_accuracy: float = C.MIN_ACCURACY_MONITOR, min_f1: float = C.MIN_F1_MONITOR,
                      rel_threshold: float = C.RELATIVE_DEGRADATION_THRESHOLD) -> DataFrame:
    deg = (F.col("accuracy") < min_accuracy) | (F.col("f1") < min_f1)
    if base is None:
        return current.withColumn("degradation_detected", deg)
    j = ranking.join_small(current, base, [], 1)
    ra = (F.col("accuracy") - F.col("baseline_accuracy")) / F.greatest(F.col("baseline_accuracy"), F.lit(1e-10))
    rf = (F.col("f1") - F.col("baseline_f1")) / F.greatest(F.col("baseline_f1"), F.lit(1e-10))
    j = j.withColumn("rel_accuracy_change", ra).withColumn("rel_f1_change", rf)
    return j.withColumn("degradation_detected", deg | (ra < rel_threshold) | (rf < rel_threshold))


def concept_drift(df: DataFrame, order: str, error: Column, group_cols: list[str] | None = None, warning: float = C.CONCEPT_WARNING,
                  drift: float = C.CONCEPT_DRIFT, least: int = C.CONCEPT_LEAST, n_ranges: int | None = None) -> DataFrame:
    """Change detection on the sequence of a model's errors (drift detection method): after every value of ``order`` the error rate p so far
    and its standard error s are compared with the point at which p + s was smallest. p + s above that p by more than ``warning`` of its s
    is a warning, by more than ``drift`` a drift; the first ``least`` rows set no minimum.

    ``group_cols, order, n, errors, error_rate, error_std, min_rate, min_std, state``. Prefix counts and prefix minima are carried over
    value ranges, so no sequence lies in one task; rows with a null order or a null error are left out."""
    g = list(group_cols or [])
    rows = df.select(*g, F.col(order).alias("__at"), error.cast("int").alias("__e")).where(F.col("__e").isNotNull())
    seq = ranking.cumulative_counts(rows, g, "__at", {"n": F.lit(1), "e": F.col("__e")}, n_ranges, keep_range=True)
    p = F.col("cum_e") / F.col("cum_n")
    seq = seq.withColumn("error_rate", p).withColumn("error_std", F.sqrt(F.col("error_rate") * (1 - F.col("error_rate")) / F.col("cum_n")))
    point = F.when(F.col("cum_n") >= least, F.struct((F.col("error_rate") + F.col("error_std")).alias("level"), F.col("error_rate").alias("rate"), F.col("error_std").alias("std")))
    seq = seq.withColumn("__point", point)
    ends = seq.groupBy(*g, "__range").agg(F.min("__point").alias("__low"))
    earlier = Window.partitionBy(*g).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    ends = ends.select(*g, "__range", F.min("__low").over(earlier).alias("__low"))
    here = Window.partitionBy(*g, "__range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    j = ranking.join_small(seq.withColumn("__here", F.min("__point").over(here)), ends, [*g, "__range"], None)
    best = F.least("__here", "__low")
    level = F.col("error_rate") + F.col("error_std")
    over = lambda times: level > best["rate"] + times * best["std"]
    state = F.when(best.isNull(), "learning").when(over(drift), "drift").when(over(warning), "warning").otherwise("stable")
    return j.select(*g, F.col("value").alias(order), "n", F.col("e").alias("errors"), "error_rate", "error_std", best["rate"].alias("min_rate"),
                    best["std"].alias("min_std"), state.alias("state"))
