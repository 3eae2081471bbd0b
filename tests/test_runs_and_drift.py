"""Runs from partition metadata, saved references, quantiles by cells, streams in any order, change detection, narrowing."""

import math
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import joins, monitor, ranking, reference, split, stats
from riskframe.session import shared_path
from riskframe.sources import io
from riskframe.streaming import daily


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------------------------------------ runs

def test_runs_come_from_the_folders_and_only_one_is_read(spark):
    path = shared_path(spark, "runs")
    names = ["2024-01-09", "2024-01-10", "a=b/c d%", "10"]
    for i, n in enumerate(names):
        io.write_run(spark.range(i + 1), path, n)
    os.makedirs(f"{path.removeprefix('file:')}/run_id=zzz/_temporary")  # begun, never finished
    assert io.list_runs(spark, path) == sorted(names)
    last = io.read_run(spark, path)
    assert "PartitionFilters: [isnotnull(run_id#" in plan_of(last) and "a=b/c d%)]" in plan_of(last)
    assert last.schema["run_id"].dataType.simpleString() == "string"
    assert len({os.path.dirname(f) for f in last.inputFiles()}) == 1
    for i, n in enumerate(names):
        assert {(r["id"], r["run_id"]) for r in io.read_run(spark, path, n).collect()} == {(k, n) for k in range(i + 1)}
    assert io.read_run(spark, path, "2031").first()["run_id"] == "a=b/c d%"


def test_runs_of_a_catalog_table_and_no_runs(spark):
    spark.sql("DROP TABLE IF EXISTS runs_t")
    spark.createDataFrame([("r1", 1), ("r3", 3), ("r2", 2)], "run_id string, v int").write.partitionBy("run_id").saveAsTable("runs_t")
    try:
        assert io.list_runs(spark, "runs_t") == ["r1", "r2", "r3"]
        assert [r["v"] for r in io.read_run(spark, "runs_t").collect()] == [3] and [r["v"] for r in io.read_run(spark, "runs_t", "r2").collect()] == [2]
    finally:
        spark.sql("DROP TABLE runs_t")
    absent = shared_path(spark, "absent")
    assert io.list_runs(spark, absent) == [] and io.read_run(spark, absent, schema="v int, run_id string").count() == 0
    with pytest.raises(FileNotFoundError):
        io.read_run(spark, absent)


def test_required_suffix_is_checked(spark):
    with pytest.raises(ValueError):
        io.detect_format("/data/loan.xlsx")
    with pytest.raises(ValueError):
        io.read_table(spark, "/data/loan")


# -------------------------------------------------------------------------------------- saved references

@pytest.mark.parametrize("n_ranges", [1, 2, 7, None])
def test_ks_against_saved_equals_ks_against_rows(spark, n_ranges):
    rng = random.Random(n_ranges or 0)
    row = lambda shift: (rng.choice([None, round(rng.gauss(shift, 1), 1)]), float(rng.randint(0, 3)), rng.random() < 0.4 + shift / 5, rng.choice("abc"))
    ref = spark.createDataFrame([row(0) for _ in range(700)], "x double, k double, b boolean, c string")
    new = spark.createDataFrame([row(1) for _ in range(300)] + [(99.0, None, None, None)], "x double, k double, b boolean, c string").withColumn("only_new", F.lit(1.0))
    root = shared_path(spark, "ref")
    reference.save_reference(new.drop("only_new"), root, "r1", n_ranges)
    reference.save_reference(ref, root, "r2", n_ranges)
    want = {r["feature"]: r for r in monitor.drift_ks(new, ref).collect()}
    got = {r["feature"]: r for r in reference.ks_saved(new, root).collect()}
    assert set(got) == set(want) == {"x", "k", "b"}
    for f, r in got.items():
        assert (r["n_ref"], r["n_new"], r["ks_statistic"], r["drifted"]) == (want[f]["n_ref"], want[f]["n_new"], want[f]["ks_statistic"], want[f]["drifted"])
    assert all(r["ks_statistic"] == 0 for r in reference.ks_saved(new, root, "r1").collect())
    assert "rows" not in "".join(reference.ks_saved(new, root).inputFiles()).replace(root, "")
    assert reference.saved_rows(spark, root).drop("run_id").exceptAll(ref).count() == 0 and reference.saved_rows(spark, root).count() == 700
    assert reference.saved_stats(spark, root, "r2").where("feature = 'k' AND stat = 'median'").first()["value"] == ref.agg(F.percentile("k", 0.5)).first()[0]
    with pytest.raises(ValueError):
        reference.save_reference(ref, root, "r2")


# ------------------------------------------------------------------------------------------- quantiles

@pytest.mark.parametrize("k", [8, 200, 4000])
def test_quantiles_by_cells(spark, k):
    rng = np.random.default_rng(k)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 4000), "v": np.round(rng.normal(size=4000), 2)})
    pdf.loc[pdf.index % 7 == 0, "v"] = 0.25                      # a hot value
    pdf.loc[pdf.index % 11 == 0, "v"] = np.nan
    rows = [(None if g == "c" else g, None if math.isnan(v) else float(v)) for g, v in zip(pdf["g"], pdf["v"])] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    named = {"lo": 0.0, "q1": 0.1, "m": 0.5, "q3": 0.995, "hi": 1.0}
    got = {r["g"]: r for r in ranking.described(df, ["g"], "v", named).collect()}
    assert set(got) == {"a", "b", None, "one", "none"} and got["none"]["n"] == 0 and got["none"]["m"] is None and got["one"]["q3"] == 5.0
    for g, key in (("a", "a"), ("b", "b"), ("c", None)):
        v = pdf.loc[pdf["g"] == g, "v"].dropna()
        assert got[key]["n"] == len(v) and got[key]["std"] == pytest.approx(v.std())
        for name, p in named.items():
            assert got[key][name] == pytest.approx(v.quantile(p), rel=1e-12, abs=1e-12)
    if k < 4000:
        again = {r["g"]: r["m"] for r in ranking.quantiles(df, ["g"], "v", {"m": 0.5}, k=k).collect()}
        assert again == {g: got[g]["m"] for g in again} and len(again) == 4


def test_quantiles_when_the_sketch_is_wrong(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    of = ranking.summary(df, ["g"], "v")
    wrong = ranking.summary(df.withColumn("v", F.col("v") * 10 + 1e6), ["g"], "v")
    of = of.drop("sketch").join(wrong.select("g", "sketch"), "g")
    got = {r["g"]: r["m"] for r in ranking.quantiles(df, ["g"], "v", {"m": 0.5}, of).collect()}
    assert got == {0: 2499.0, 1: 2500.0}
    empty = ranking.described(df.limit(0), [], "v", {"m": 0.5}).first()
    assert empty["n"] == 0 and empty["m"] is None


def test_correlations_of_many_columns_in_tiles(spark):
    cols = [f"c{i}" for i in range(23)]
    df = spark.range(300).select(*[F.when(F.pmod(F.xxhash64("id", F.lit(-i)), F.lit(9)) > 0, F.pmod(F.xxhash64("id", F.lit(i % 17)), F.lit(50)) + F.col("id") * (i % 5)).cast("double").alias(c)
                                   for i, c in enumerate(cols)])
    got = {(r["f1"], r["f2"]): r["corr"] for r in stats.corr_matrix(df, cols).collect()}
    want = df.toPandas().corr()
    assert len(got) == 23 * 23 and all(got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9) for a in cols for b in cols)
    assert "Generate" not in plan_of(stats.corr_matrix(df, cols))


# --------------------------------------------------------------------------------------------- streams

def _events(seed):
    rng = random.Random(seed)
    return [(f"2024-01-{d:02d} {rng.randint(0, 23):02d}:00:00", rng.choice("ab"), rng.choice([None, round(rng.gauss(d, 2), 3), rng.gauss(1e7, 1)])) for d in range(1, 9) for _ in range(12)]


def test_daily_stream_in_any_order(spark):
    rows = spark.createDataFrame(_events(1), "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    whole = {(str(r["day"]), r["event_type"]): r for r in rows.groupBy(F.to_date("ts").alias("day"), "event_type")
             .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).collect()}
    parts = [rows.where(F.dayofmonth("ts") == d).coalesce(1) for d in range(1, 9)]
    seen = []
    for shuffle in range(5):
        order = list(range(8))
        random.Random(shuffle).shuffle(order)
        path, ckpt, out = (shared_path(spark, x) for x in ("ev", "ck", "out"))
        for half in (order[:5], order[5:]):                       # stopped and started again between
            for d in half:
                parts[d].write.mode("append").parquet(path)
                time.sleep(0.01)
            got = daily.stream_daily_stats(spark, path, ckpt, out, max_files_per_trigger=2)
        got = {(str(r["day"]), r["event_type"]): r for r in got.collect()}
        assert set(got) == set(whole) and all(got[k]["n"] == whole[k]["n"] for k in whole)
        for k in whole:
            assert all(got[k][c] == whole[k][c] == None or got[k][c] == pytest.approx(whole[k][c], rel=1e-9) for c in ("mean", "std"))  # noqa: E711
        seen.append(sorted((k, r["mean"]) for k, r in got.items()))
    assert all(s == seen[0] for s in seen)


def test_moments_of_parts_merge(spark):
    df = spark.createDataFrame([("a", i % 4, None if i % 5 == 0 else 1e6 + i / 7) for i in range(400)] + [("b", 0, None), ("c", 1, 2.5)], "k string, part int, v double")
    parts = daily.moments(df, ["k", "part"], "v")
    got = {r["k"]: r for r in daily.merged_moments(parts, ["k"]).collect()}
    want = {r["k"]: r for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).collect()}
    assert got["b"]["mean"] is None and got["c"]["std"] is None and got["b"]["n"] == 1
    assert got["a"]["mean"] == pytest.approx(want["a"]["mean"], rel=1e-14) and got["a"]["std"] == pytest.approx(want["a"]["std"], rel=1e-9)


def test_monitored_stream_keeps_its_state_over_restarts(spark):
    history, ckpt, out = (shared_path(spark, x) for x in ("hist", "ck", "out"))
    entries = [("m1", 0.9, 0.8), ("m2", 0.5, 0.9), ("m1", 0.85, 0.75), ("m1", 0.78, 0.8), ("m2", 0.75, 0.9), ("m1", 0.9, 0.71), ("m1", 0.95, 0.95)]
    schema = "model string, ts date, accuracy double, f1 double"
    for i, (m, a, f) in enumerate(entries):
        spark.createDataFrame([(m, a, f)], "model string, accuracy double, f1 double").withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), i)) \
            .select(*[c.split()[0] for c in schema.split(", ")]).write.parquet(f"{history}/batch={i}")
        if i in (2, 4, 6):                                         # three starts of the same stream
            got = daily.stream_monitor(spark, history, ckpt, out, keep=2)
    got = {r["batch"]: r for r in got.collect()}
    assert len(got) == 7
    first, count = {}, {}
    for i, (m, a, f) in enumerate(entries):
        base = first.setdefault(m, (a, f))
        count[m] = count.get(m, 0) + 1
        r = got[i]
        assert (r["model"], r["baseline_accuracy"], r["baseline_f1"], r["entries"], r["kept"]) == (m, *base, count[m], min(2, count[m]))
        cur = spark.createDataFrame([(a, f)], "accuracy double, f1 double")
        b = spark.createDataFrame([base], "baseline_accuracy double, baseline_f1 double")
        assert r["degradation_detected"] == monitor.performance_check(cur, b).first()["degradation_detected"]
    assert {r["degradation_detected"] for r in got.values()} == {True, False}


# -------------------------------------------------------------------------------------- change detection

@pytest.mark.parametrize("n_ranges", [1, 5, None])
def test_concept_drift_finds_a_planted_change(spark, n_ranges):
    rows = [(g, i, i * 7 % 10 < (5 if g == "bad" and i >= 600 else 1)) for g in ("bad", "good") for i in range(1000)] + [("bad", None, True), ("good", 3, None)]
    df = spark.createDataFrame(rows, "g string, i int, wrong boolean").repartition(4)
    got = {(r["g"], r["i"]): r for r in monitor.concept_drift(df, "i", F.col("wrong"), ["g"], n_ranges=n_ranges).collect()}
    assert len(got) == 2000 - (1 if ("good", 3) not in got else 0)
    for g in ("bad", "good"):
        n = e = 0
        low = None
        for i in range(1000):
            own = [w for a, b, w in rows if a == g and b == i and w is not None]
            if not own:
                continue
            n, e = n + len(own), e + sum(own)
            p = e / n
            s = math.sqrt(p * (1 - p) / n)
            if n >= 30 and (low is None or (p + s, p, s) < low):
                low = (p + s, p, s)
            want = "learning" if low is None else "drift" if p + s > low[1] + 3 * low[2] else "warning" if p + s > low[1] + 2 * low[2] else "stable"
            assert got[g, i]["state"] == want, (g, i)
    drifted = [i for (g, i), r in got.items() if g == "bad" and r["state"] == "drift"]
    assert 600 < min(drifted) < 660 and not [1 for (g, _), r in got.items() if g == "good" and r["state"] == "drift"]


# --------------------------------------------------------------------------------------- split and joins

def test_split_by_narrowing(spark):
    rows = [(f"k{i}", None if i % 3 == 0 else i % 3) for i in range(1500)] + [("same", 1)] * 40 + [(None, 2)]
    df = spark.createDataFrame(rows, "k string, s int").repartition(6)
    wide = split.stratified_split(df, "k", "s", 0.2)
    narrow = split.stratified_split(df, "k", "s", 0.2, prefix_len=1, ranked=2)
    assert sorted(map(str, wide.collect())) == sorted(map(str, narrow.collect())) and wide.count() == len(rows)
    n_test = {r["s"]: r["count"] for r in wide.where("split = 'test'").groupBy("s").count().collect()}
    assert n_test[None] == 100 and n_test[2] == math.ceil(501 * 0.2) and 108 <= n_test[1] <= 148  # 'same' goes one way
    assert "hashpartitioning" not in plan_of(wide) and "Window" not in plan_of(wide)
    assert split.stratified_split(df.limit(0), "k", "s").count() == 0


def test_null_safe_join_deals_null_ids(spark):
    loan = spark.createDataFrame([(f"L{i}", None if i % 3 else str(i % 9)) for i in range(90)], "loanId string, clarityFraudId string")
    clarity = spark.createDataFrame([(None, 1.0), (None, 2.0), ("0", 3.0), ("0", 4.0), ("", 5.0)], "underwritingid string, clearfraudscore double")
    got = joins.join_fraud(loan, clarity, null_safe=True)
    want = loan.join(clarity, loan["clarityFraudId"].eqNullSafe(clarity["underwritingid"]), "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    assert joins.null_salts(loan) == int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------------------------- wide categories

def test_wide_categories_are_indexed_by_a_table_and_train(spark, monkeypatch):
    from pyspark.ml import PipelineModel

    from riskframe.operators import model as MD

    number = F.pmod(F.xxhash64("id"), F.lit(1500))
    df = spark.range(4000).select((F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("v"), number.cast("string")).alias("c"),
                                  F.when(F.col("id") % 9 == 0, None).otherwise("n").alias("few"), (F.col("id") % 7 + number / 500).cast("double").alias("y"))
    values = sorted({r["c"] for r in df.select("c").collect()})
    index = {r["value"]: r["index"] for r in ranking.dense_index(df, "c").collect()}
    assert index == {v: i for i, v in enumerate(values)}
    monkeypatch.setattr(MD, "WIDE_LABELS", 100)
    assert MD.wide_columns(df, ["c", "few"], 100) == ["c"] and MD.wide_columns(df, []) == []
    wide = MD.index_wide(df, "c", "c__idx")
    stages, inputs = MD.preprocessing_stages(["x"], ["few"], [wide])
    out = MD.Pipeline(stages=stages).fit(df).transform(df.limit(1).unionByName(spark.createDataFrame([(1.0, "unseen", None, 1.0)], df.schema)))
    got = [(r["c"], r["c__ohe"].size, r["c__ohe"].indices.tolist()) for r in out.collect()]
    assert inputs == ["x", "few__ohe", "c__ohe"] and ("unseen", len(values), []) in got
    assert any(c != "unseen" and i == [index[c]] for c, _, i in got)
    monkeypatch.setattr(MD, "wide_columns", lambda df, columns, most=100: ["c"])
    model, task = MD.fit_model(df, ["x"], ["few", "c"], "y", "regression", {"maxIter": 2, "maxDepth": 2, "seed": 1})
    path = shared_path(spark, "wide-model")
    model.save(path)
    again = PipelineModel.load(path)
    a, b = (sorted(r["prediction"] for r in m.transform(df.limit(50)).collect()) for m in (model, again))
    assert a == b and task == "regression"


# ------------------------------------------------------------------------------------------ feature lists

def test_feature_lists_of_a_fit(spark):
    """Indicators: columns with nulls first, then the absent ones; categories: text columns with nulls, else the base ones; base numerics on request."""
    from riskframe.functions import constants as C
    from riskframe.operators import features as FE

    rows = [(f"L{i}", None if i % 4 == 0 else 100.0 + i, 50.0 + i, float(i % 3), 1.0 + i, "W" if i % 2 else None, "TX" if i % 3 else "CA", "a" if i % 5 else "b", i % 2 == 0, "Paid Off Loan") for i in range(40)]
    df = spark.createDataFrame(rows, "loanId string, loanAmount double, apr double, nPaidOff double, leadCost double, payFrequency string, state string, leadType string, originated boolean, loanStatus string")
    pipe = FE.FeaturePipeline({"drop_low_variance": False})
    spec = pipe.fit(df)
    assert spec.indicator_columns[0] == "loanAmount_missing" and sorted(spec.indicator_columns) == sorted(f"{c}_missing" for c in C.MISSING_INDICATOR_COLUMNS)
    assert spec.categorical_features == ["payFrequency"] == spec.encoded
    assert not set(C.BASE_NUMERIC) & set(spec.numeric_features) and "payFrequency_target_encoded" in spec.numeric_features and spec.ratio_feature
    base = FE.FeaturePipeline({"drop_low_variance": False}, include_base=True).fit(df)
    assert base.numeric_features[:4] == list(C.BASE_NUMERIC)
    full = FE.FeaturePipeline({"drop_low_variance": False}).fit(df.na.fill({"payFrequency": "W"}))
    assert full.categorical_features == list(C.BASE_CATEGORICAL)
    assert "ObjectHashAggregate" not in plan_of(pipe.transform(df, spec)) and "HashAggregate" not in plan_of(pipe.transform(df, spec))  # encodings are not computed again


def test_release_deletes_scratch_tables(spark):
    from riskframe import session

    own = dict(session.memo(spark))  # what other tests have fitted stays
    session.memo(spark)["scratch"] = []
    kept = session.written(spark.range(3), "kept")
    path = session.memo(spark)["scratch"][0]
    assert kept.count() == 3 and io.path_exists(spark, path)
    assert session.release(spark) == 1 and not io.path_exists(spark, path) and session.release(spark) == 0
    session.memo(spark).update(own)
