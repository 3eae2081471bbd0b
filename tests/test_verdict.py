"""Range and edge behaviour that small fixtures of the domain do not reach."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskframe.functions import constants as C
from riskframe.functions.expressions import exact_avg, exact_sum
from riskframe.operators import artefact as AR
from riskframe.operators import evaluate as EV
from riskframe.operators import features as FE
from riskframe.operators import joins, monitor, ranking, split, stats
from riskframe.operators import model as MD
from riskframe.operators import score as SC
from riskframe.session import shared_path
from riskframe.sources import io


def doubles(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)


@pytest.mark.parametrize("values", [[1e10, 2e10], [1e-10, 2e-10], [3e18, -1.5, 2.25], [0.1] * 7, [1e9 + 0.25, 123.4567], [1e300, 1e300]])
def test_sums_over_the_double_range(spark, values):
    got = doubles(spark, values).agg(exact_sum("x").alias("a"), exact_avg("x").alias("b"), exact_sum(F.col("x")).alias("c")).first()
    assert got["a"] == got["c"] == pytest.approx(math.fsum(values), rel=1e-12)
    assert got["b"] == pytest.approx(math.fsum(values) / len(values), rel=1e-12)


def test_nan_is_not_zero(spark):
    got = doubles(spark, [2.0, float("nan")]).agg(exact_sum("x").alias("a")).first()
    assert math.isnan(got["a"])
    assert io.normalise_nans(doubles(spark, [2.0, float("nan")])).agg(exact_avg("x").alias("a")).first()["a"] == 2.0


def test_exact_sum_ignores_order(spark):
    rnd = random.Random(4)
    values = [round(rnd.uniform(-1e6, 1e6), 4) for _ in range(2000)]
    a = doubles(spark, values).agg(exact_sum("x")).first()[0]
    rnd.shuffle(values)
    assert a == doubles(spark, values).repartition(7).agg(exact_sum("x")).first()[0]


def test_scaler_and_regression_metrics_of_large_values(spark):
    values = list(range(100_000, 300_000, 200))
    med, mean, std = MD.fit_scaler(doubles(spark, values), ["x"])["x"]
    n = len(values)
    want = math.sqrt(sum((v - sum(values) / n) ** 2 for v in values) / n)
    assert std == pytest.approx(want, rel=1e-12) and mean == pytest.approx(sum(values) / n)
    df = spark.createDataFrame([(float(v), float(v) + 1000.0) for v in values], "y_true double, y_pred double")
    m = EV.regression_metrics(df).first()
    assert m["mse"] == pytest.approx(1e6) and m["r2"] == pytest.approx(1 - 1e6 / want**2, rel=1e-9)


def test_evaluate_equals_its_parts_and_takes_limits(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(f"r{i % 3}", rnd.random(), rnd.random()) for i in range(400)], "run string, y_true double, y_pred double")
    for limits in (EV.LIMITS, (0.1, 0.95)):
        one = {r["run"]: r for r in EV.evaluate(df, group_cols=["run"], limits=limits).collect()}
        two = {r["run"]: r for r in EV.classification_metrics(EV.band_counts(df, group_cols=["run"], limits=limits), ["run"]).collect()}
        for k in one:
            for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro"):
                assert one[k][c] == pytest.approx(two[k][c], rel=1e-12)


def frame(spark, labels, n=120):
    rnd = random.Random(2)
    return spark.createDataFrame([(f"k{i}", labels[i % len(labels)], float(i % len(labels)) + rnd.random() / 4, "ab"[i % 2]) for i in range(n)],
                                 "loanId string, target double, x double, c string")


SMALL = {"maxIter": 3, "maxDepth": 3, "seed": 1}


@pytest.mark.parametrize("labels, task", [([0.2, 0.95], "binary"), ([0.1, 0.4, 0.9], "multiclass")])
def test_classifier_paths(spark, labels, task):
    df = frame(spark, labels)
    model, got = MD.fit_model(df, ["x"], ["c"], "target", None, SMALL)
    assert got == task == MD.task_of(model)
    out = SC.score(model, df).collect()
    assert sum(float(r["prediction_label"]) == r["target"] for r in out) > 0.9 * len(out)
    if task == "binary":
        assert all(0 <= r["p1"] <= 1 and r["decision"] == (r["p1"] >= 0.5) for r in out)


def test_bucketed_target_and_sources_of_slots(spark):
    df = frame(spark, [i / 20 for i in range(20)])
    binned, label = MD.bucket_target(df)
    assert label == "target_bin" and {r[0] for r in binned.select(label).distinct().collect()} == set(range(5))
    assert MD.bucket_target(frame(spark, [0.1, 0.2]))[1] == "target"
    model, task = MD.fit_model(binned, ["x"], ["c"], label, None, SMALL)
    assert task == "multiclass"
    names = [r["feature"] for r in MD.importances(model, binned).collect()]
    assert "x" in names and {MD.source_column(n, df.columns) for n in names} == {"x", "c"}
    assert sum(r["importance"] for r in MD.importances(model, binned).collect()) == pytest.approx(1.0)


def test_artefact_in_another_session(spark, tmp_path):
    rows = [(f"L{i}", float(100 + i), 1.0 + i % 7, float(i % 3), 5.0, ["NJ", "TX"][i % 2], "web", "W", ["New Loan", "Rejected"][i % 2], i % 2 == 0) for i in range(60)]
    loan = spark.createDataFrame(rows, "loanId string, loanAmount double, apr double, nPaidOff double, leadCost double, state string, leadType string, "
                                       "payFrequency string, loanStatus string, originated boolean")
    pipe = FE.FeaturePipeline({"drop_low_variance": False}, include_base=True)
    spec = pipe.fit(loan)
    df = pipe.transform(loan, spec)
    model, task = MD.fit_model(df, spec.numeric_features, spec.categorical_features, "target", "regression", SMALL)
    root = str(tmp_path / "models")
    for v in ("v1", "v2"):
        AR.publish(spark, root, v, f"run_{v}", pipe, spec, model, task, MD.importances(model, df), 60)
    with pytest.raises(ValueError):
        AR.publish(spark, root, "v1", "again", pipe, spec, model, task, MD.importances(model, df), 60)
    other = spark.newSession()
    art = AR.load(other, root)
    assert art.version == "v2" and art.spec == spec and AR.load(other, root, "v1").version == "v1"
    fresh = other.createDataFrame(rows, loan.schema)
    a = {r["loanId"]: r["prediction"] for r in SC.score(art.model, art.features(fresh)).collect()}
    b = {r["loanId"]: r["prediction"] for r in SC.score(model, df, task).collect()}
    assert a == b


def test_history_baseline_survives_the_trim(spark):
    full = spark.createDataFrame([(i, 0.5 + i / 1000, 0.4 + i / 1000) for i in range(150)], "ts int, accuracy double, f1 double")
    assert monitor.history_tail(full).count() == 100
    assert monitor.baseline(full).first()["baseline_accuracy"] == 0.5


def test_run_fallback_split_fallback_and_saved_stats(spark):
    path = shared_path(spark, "runs")
    spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "run_id string, v int").write.partitionBy("run_id").parquet(path)
    assert [r["v"] for r in io.read_run(spark, path, run_id="b").collect()] == [2]
    assert [r["v"] for r in io.read_run(spark, path, run_id="zz").collect()] == [3] == [r["v"] for r in io.read_run(spark, path).collect()]
    df = spark.createDataFrame([(f"k{i}", "x" if i else "y") for i in range(50)], "k string, s string")
    assert split.stratified_split(df, "k", "s").select("k", "split").orderBy("k").collect() == split.hash_split(df, "k").select("k", "split").orderBy("k").collect()
    ref, new = doubles(spark, range(100)), doubles(spark, range(50, 150))
    saved = shared_path(spark, "stats")
    assert monitor.drift_report(new, saved_stats=saved).count() == 0
    io.write_run(monitor.reference_stats(new, quantiles=False), saved, "r1")
    io.write_run(monitor.reference_stats(ref, quantiles=False), saved, "r2")
    a = monitor.drift_report(new, saved_stats=saved).collect()
    assert a == monitor.drift_report(new, ref_stats=monitor.reference_stats(ref, quantiles=False)).collect()


def test_output_defaults_take_the_request_score(spark):
    done = spark.createDataFrame([("a",), ("b",)], "loanId string")
    src = spark.createDataFrame([("a", 5.0), ("b", None)], "loanId string, clearfraudscore double")
    out = {r["loanId"]: r for r in SC.output_defaults(done, src).collect()}
    assert out["a"]["clearfraudscore_squared"] == 25.0 and out["b"]["clearfraudscore"] is None
    assert all(out["a"][c] == v for c, v in C.SCORE_OUTPUT_DEFAULTS.items())


def test_null_fraud_ids_match_nothing(spark):
    loan = spark.createDataFrame([(f"L{i}", None if i % 3 else str(i)) for i in range(300)], "loanId string, clarityFraudId string")
    clarity = spark.createDataFrame([(str(i), float(i)) for i in range(300)], "underwritingid string, clearfraudscore double")
    out = joins.join_fraud(loan, clarity).collect()
    assert len(out) == 300 and all((r["clearfraudscore"] is None) == (r["clarityFraudId"] is None) for r in out)


def test_ranking_of_distinct_and_dominant_groups(spark):
    distinct = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))  # compresses to nothing on disk
    small = spark.range(30).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("g"), F.col("id").cast("double").alias("v"))
    both = distinct.unionByName(small)
    got = {r["g"]: r for r in ranking.quantiles_wide(both, ["g"], "v", {"m": 0.5, "q": 0.9}).collect()}
    assert got["g"]["m"] == pytest.approx(9999.5) and got["g"]["q"] == pytest.approx(17999.1) and got["s7"]["m"] == 7.0
    assert ranking.quantiles_wide(distinct, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(9999.5)


def test_shown_correlation_columns(spark):
    df = spark.range(200).select(*[(F.col("id") * (i + 1) + F.pmod(F.xxhash64("id", F.lit(i)), F.lit(400 - 15 * i))).cast("double").alias(f"c{i}") for i in range(25)],
                                 F.col("id").cast("double").alias("target"))
    cols = [f"c{i}" for i in range(25)]
    shown = stats.shown_columns(df, cols, "target")
    assert len(shown) == 16 and shown[-1] == "target" and len(stats.shown_columns(df, cols)) == 15 and stats.shown_columns(df, cols[:20]) == cols[:20]
    assert stats.corr_matrix(df, cols).count() == 625
