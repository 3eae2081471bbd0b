"""Edge cases on hand-made fixtures (nulls, ties, empty sources, unseen categories)."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.functions import constants as C
from riskframe.operators import features as FE
from riskframe.operators import joins, ranking, stats
from riskframe.sources import io, schemas


def test_null_join_keys(spark):
    loan = spark.createDataFrame([(None,), ("x",)], "clarityFraudId string")
    clarity = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", 3.0)], "underwritingid string, clearfraudscore double")
    assert joins.join_fraud(loan, clarity).count() == 2
    assert joins.join_fraud(loan, clarity, null_safe=True).count() == 3


def test_payment_nulls_and_null_key(spark):
    pay = spark.createDataFrame(
        [("a", 1, 1.0, "Checked", 1.0, 0.1), ("a", 2, None, None, 1.0, 0.1), ("b", 1, None, "Late", None, None),
         (None, 1, 5.0, "Checked", 1.0, 1.0)], schemas.PAYMENT)
    loans = spark.createDataFrame([("a",), ("b",), ("c",)], "loanId string")
    out = {r["loanId"]: r for r in joins.join_payments(loans, pay).collect()}
    assert out["a"]["paymentAmount_mean"] == 1.0 and out["a"]["paymentAmount_sum"] == 1.0
    assert out["a"]["paymentAmount_count"] == 1.0 and out["a"]["payment_success_rate"] == 0.5
    assert out["b"]["paymentAmount_mean"] == 0.0 and out["b"]["paymentAmount_sum"] == 0.0
    assert out["b"]["paymentAmount_count"] == 0.0 and out["b"]["payment_success_rate"] == 0.0
    assert out["c"]["paymentAmount_sum"] == 0.0
    agg = joins.payment_aggregates(pay)
    assert agg.where(F.col("loanId").isNull()).count() == 0


def test_equal_width_cut(spark):
    df = spark.createDataFrame([(x,) for x in [0.05, 0.2, 0.24, 0.41, 0.95]], "x double")
    out, edges = stats.cut(df, "x", 5)
    assert [r["x_bin"] for r in out.orderBy("x").collect()] == [0, 0, 1, 1, 4]


def test_quantile_cut_with_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 3, 4, 5]], "x double")
    out, edges = stats.qcut(df, "x", 5)
    assert [round(e, 9) for e in edges] == [1.0, 2.2, 3.6, 5.0]
    assert [r["x_qbin"] for r in out.orderBy("x").collect()] == [0, 0, 0, 0, 0, 1, 2, 2]


@pytest.mark.parametrize("n_ranges", [None, 1, 3])
def test_ks_statistic(spark, n_ranges):
    ref = spark.createDataFrame([("f", float(x)) for x in [1, 2, 4, 10]], "feature string, v double")
    new = spark.createDataFrame([("f", float(x)) for x in [2, 3, 11]], "feature string, v double")
    r = ranking.ks_two_sample(ref, new, ["feature"], "v", n_ranges).first()
    assert abs(r["ks_statistic"] - 1 / 3) < 1e-12
    same = ranking.ks_two_sample(ref, ref, ["feature"], "v", n_ranges).first()
    assert same["ks_statistic"] == 0.0 and same["p_value"] == 1.0


@pytest.mark.parametrize("n_ranges", [None, 2])
def test_quantiles_and_variance(spark, n_ranges):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 4, 10]], "x double")
    q = {round(r["p"], 3): r["q"] for r in ranking.exact_quantiles(df, [], "x", [0.5, 0.1, 0.9], n_ranges).collect()}
    assert q[0.5] == pytest.approx(3.0) and q[0.1] == pytest.approx(1.3) and q[0.9] == pytest.approx(8.2)
    assert df.agg(F.var_samp("x")).first()[0] == pytest.approx(16.25)


def test_single_row_variance_not_dropped(spark):
    base = spark.createDataFrame([("L1", 5.0, "a", True)], "loanId string, loanAmount double, state string, originated boolean")
    spec = FE.FeaturePipeline(config={"categorical_encoding": "onehot"}).fit(base)
    assert "loanAmount_squared" not in spec.dropped  # variance of one row is null, not < threshold


def test_zero_amount_disables_ratio(spark):
    rows = [("L1", 0.0, 10.0, 5.0), ("L2", 100.0, 20.0, 6.0)]
    base = spark.createDataFrame(rows, "loanId string, loanAmount double, apr double, leadCost double")
    spec = FE.FeaturePipeline().fit(base)
    assert spec.ratio_feature is False
    rows2 = [("L1", 50.0, 10.0, 5.0), ("L2", 100.0, 20.0, 6.0)]
    spec2 = FE.FeaturePipeline().fit(spark.createDataFrame(rows2, "loanId string, loanAmount double, apr double, leadCost double"))
    assert spec2.ratio_feature is True


def test_nan_is_null_after_ingest(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(p)
    df = io.read_table(spark, p)
    assert df.where(F.col("x").isNull()).count() == 1
    assert df.agg(F.avg("x")).first()[0] == 1.0


def test_empty_optional_sources(spark, tmp_path):
    loan = spark.createDataFrame([("L1", "C1")], "loanId string, clarityFraudId string")
    clarity = io.optional_table(spark, str(tmp_path / "nope.csv"), schemas.CLARITY)
    payment = io.optional_table(spark, str(tmp_path / "nope2.csv"), schemas.PAYMENT)
    assert clarity.count() == 0 and payment.columns == [f.name for f in schemas.PAYMENT.fields]
    out = joins.join_payments(joins.join_fraud(loan, clarity), payment)
    assert "clearfraudscore" not in out.columns and "paymentAmount_sum" not in out.columns


def test_unseen_category_one_hot(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from riskframe.operators import model as MD
    train = spark.createDataFrame([("a",), ("b",), ("Unknown",)], "c string")
    stages, _ = MD.preprocessing_stages([], ["c"])
    m = Pipeline(stages=stages).fit(train)
    score = spark.createDataFrame([("zz",), (None,)], "c string").na.fill("Unknown", ["c"])
    vecs = {r["c"]: r["v"] for r in m.transform(score).select("c", vector_to_array("c__ohe").alias("v")).collect()}
    assert sum(vecs["zz"]) == 0.0  # unseen -> all zeros
    assert sum(vecs["Unknown"]) == 1.0  # null -> 'Unknown' after imputation


def test_status_risk_and_bands(spark):
    from riskframe.functions.expressions import app_band, band3, display_normalize, serving_band, status_risk
    df = spark.createDataFrame([("Rejected", 0.3), ("nope", 0.7), (None, 0.6)], "s string, p double")
    out = df.select(status_risk("s").alias("t"), band3("p").alias("b"), serving_band("p").alias("sb"),
                    app_band("p").alias("ab"), display_normalize(F.col("p") * 10).alias("d")).collect()
    assert [r["t"] for r in out] == [0.95, C.DEFAULT_RISK, C.DEFAULT_RISK]
    assert [r["b"] for r in out] == [0, 1, 1]
    assert [r["sb"] for r in out] == ["low_risk", "medium_risk", "medium_risk"]
    assert [r["ab"] for r in out] == ["Low Risk", "High Risk", "High Risk"]
    assert out[1]["d"] == 1.0 and math.isclose(out[0]["d"], 4 / 6)
