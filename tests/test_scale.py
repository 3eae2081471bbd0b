"""Work and memory that grow with the data: one narrow shuffle of payments, one join for a fit, compiled correlations, training memory."""

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from riskframe.operators import joins
from riskframe.operators import model as MD
from riskframe.operators import stats as ST
from riskframe.plans.q_features import _fitted
from riskframe.plans.q_features import features_full
from riskframe.session import DEFAULT_CONF

from .conftest import SF001


def test_payments_are_shuffled_as_rows_and_aggregated_once(spark):
    rows = [("a", 1.0, "Checked", 2.0, 0.5), ("a", None, None, 1.0, 0.5), ("a", 3.0, "Rejected", None, None), ("b", None, "Checked", None, None), (None, 9.0, "Checked", 1.0, 1.0)]
    pay = spark.createDataFrame(rows, "loanId string, paymentAmount double, paymentStatus string, principal double, fees double")
    agg = joins.payment_aggregates(pay)
    plan = agg._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan[plan.index("Exchange"):]  # no partial aggregates below the shuffle
    got = {r["loanId"]: r.asDict() for r in agg.collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["paymentAmount_mean"], a["paymentAmount_sum"], a["paymentAmount_count"], a["principal_sum"], a["fees_sum"]) == (2.0, 4.0, 2, 3.0, 1.0)
    assert a["payment_success_rate"] == pytest.approx(1 / 3)
    assert (b["paymentAmount_mean"], b["paymentAmount_sum"], b["paymentAmount_count"], b["payment_success_rate"]) == (None, 0.0, 0, 1.0)


def test_a_fit_and_the_steps_after_it_join_once(spark):
    base, _, _ = _fitted(spark, SF001)
    assert base.inputFiles() and all("/base-" in f for f in base.inputFiles())
    out = features_full(spark, SF001)
    assert all("/base-" in f or "/encoding-" in f for f in out.inputFiles())
    assert int(DEFAULT_CONF["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) >= 200


def test_correlations_of_an_aggregate_are_few_enough_to_compile(spark, monkeypatch):
    cols = [f"c{i}" for i in range(11)]
    df = spark.range(200).select(*[F.when(F.col("id") % (i + 5) != 0, F.sin(F.col("id") * (i + 1))).alias(c) for i, c in enumerate(cols)])
    most, corr = [0], F.corr
    real = type(df).agg

    def agg(self, *exprs):
        most[0] = max(most[0], sum("corr(" in str(e) for e in exprs))
        return real(self, *exprs)

    monkeypatch.setattr(type(df), "agg", agg)
    got = {(r["f1"], r["f2"]): r["corr"] for r in ST.corr_matrix(df, cols).collect()}
    assert 0 < most[0] <= 16 and len(got) == 121
    pdf = df.toPandas().corr()
    assert all(v == pytest.approx(pdf.loc[a, b], abs=1e-9) for (a, b), v in got.items())
    assert corr is F.corr


def test_training_vectors_leave_memory_to_the_learner(spark, monkeypatch):
    seen = []

    class Learner:
        def fit(self, ready):
            seen.append(ready.storageLevel)
            raise InterruptedError

    monkeypatch.setattr(MD, "estimator", lambda *a: Learner())
    df = spark.range(60).select((F.col("id") / 60).alias("target"), F.col("id").cast("double").alias("x"))
    with pytest.raises(InterruptedError):
        MD.fit_model(df, ["x"], [])
    assert [(s.useDisk, s.useMemory) for s in seen] == [(StorageLevel.DISK_ONLY.useDisk, False)]
