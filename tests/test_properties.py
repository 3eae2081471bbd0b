"""Properties: brute-force equality of the distributed rank operators, partition independence,
fit-then-transform consistency, invariants of shares and confusion counts."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.functions.expressions import exact_avg, exact_sum
from riskframe.operators import evaluate as EV
from riskframe.operators import features as FE
from riskframe.operators import ranking, split, stats

from .conftest import SF01


def _random_frame(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "b", "c"]), float(rnd.randint(0, 200)) / 4 if rnd.random() > 0.05 else None)
            for _ in range(n)]
    return spark.createDataFrame(rows, "g string, v double"), pd.DataFrame(rows, columns=["g", "v"])


@pytest.mark.parametrize("n_ranges", [1, 7, 64])
def test_quantiles_match_pandas(spark, n_ranges):
    df, pdf = _random_frame(spark)
    probs = [0.1, 0.25, 0.5, 0.9, 0.995]
    got = {(r["g"], round(r["p"], 4)): r["q"] for r in ranking.exact_quantiles(df, ["g"], "v", probs, n_ranges).collect()}
    for g, part in pdf.dropna().groupby("g"):
        for p in probs:
            assert got[(g, round(p, 4))] == pytest.approx(part["v"].quantile(p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("n_ranges", [1, 5])
def test_ks_matches_brute_force(spark, n_ranges):
    df, pdf = _random_frame(spark, 2000, 3)
    ref = df.where(F.col("g") != "c").withColumn("g", F.lit("f"))
    new = df.where(F.col("g") == "c").withColumn("g", F.lit("f"))
    d = ranking.ks_two_sample(ref, new, ["g"], "v", n_ranges).first()["ks_statistic"]
    a = np.sort(pdf[pdf.g != "c"].v.dropna().values)
    b = np.sort(pdf[pdf.g == "c"].v.dropna().values)
    xs = np.concatenate([a, b])
    brute = np.max(np.abs(np.searchsorted(a, xs, "right") / len(a) - np.searchsorted(b, xs, "right") / len(b)))
    assert d == pytest.approx(brute, abs=1e-12)


@pytest.mark.parametrize("n_ranges", [1, 6])
def test_percentile_of_score_matches_brute_force(spark, n_ranges):
    df, pdf = _random_frame(spark, 1500, 5)
    acts = pdf.v.dropna().values
    scores = spark.createDataFrame([(float(x),) for x in [0.0, 3.25, 10.0, 25.5, 50.0, 99.0]], "s double")
    got = {r["score"]: r["pct"] for r in ranking.percentile_of_score(df, "v", scores, "s", n_ranges).collect()}
    for s, pct in got.items():
        lt, le = (acts < s).sum(), (acts <= s).sum()
        assert pct == pytest.approx((lt + le + (1 if le > lt else 0)) * 50.0 / len(acts) / 100.0)


def test_exact_sum_is_partition_independent(spark):
    """Decimals are summed exactly, whatever the partitioning; other doubles to within rounding of a double sum."""
    import math
    from decimal import Decimal
    rnd = random.Random(11)
    vals = [rnd.uniform(-1e4, 1e4) for _ in range(20000)]
    for decimals in (True, False):
        own = [round(v, 6) for v in vals] if decimals else vals
        df = spark.createDataFrame([(v,) for v in own], "v double")
        a = df.repartition(1).agg(exact_sum("v").alias("s"), exact_avg("v").alias("m")).first()
        b = df.repartition(13).agg(exact_sum(F.col("v")).alias("s"), exact_avg(F.col("v")).alias("m")).first()
        if decimals:
            assert a["s"] == b["s"] == float(sum(Decimal(repr(v)) for v in own)) and a["m"] == b["m"]
        else:
            assert a["s"] == pytest.approx(math.fsum(own), rel=1e-12) and b["s"] == pytest.approx(math.fsum(own), rel=1e-12)


def test_shares_sum_to_one(spark):
    df, _ = _random_frame(spark)
    s = stats.value_shares_long(df.withColumn("v", F.col("v").cast("string")), ["g", "v"])
    for r in s.groupBy("feature").agg(F.sum("share").alias("t")).collect():
        assert r["t"] == pytest.approx(1.0)


def test_confusion_cells_sum_to_n(spark):
    rnd = random.Random(2)
    rows = [(rnd.random(), rnd.random()) for _ in range(1000)]
    df = spark.createDataFrame(rows, "y_true double, y_pred double")
    cm = EV.confusion_matrix(EV.band_counts(df))
    assert cm.agg(F.sum("n")).first()[0] == 1000
    assert cm.count() == 9


def test_split_stable_under_repartition(spark):
    ids = spark.range(5000).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("k"),
                                   (F.col("id") % 3).cast("int").alias("s"))
    a = {r["k"]: r["split"] for r in split.stratified_split(ids.repartition(1), "k", "s", 0.2).collect()}
    b = {r["k"]: r["split"] for r in split.stratified_split(ids.repartition(9), "k", "s", 0.2, prefix_len=1).collect()}
    assert a == b
    n_test = sum(1 for v in a.values() if v == "test")
    assert n_test == sum(-(-c // 5) for c in [1667, 1667, 1666])
    h1 = {r["k"]: r["split"] for r in split.hash_split(ids.repartition(3), "k").collect()}
    h2 = {r["k"]: r["split"] for r in split.hash_split(ids.repartition(7), "k").collect()}
    assert h1 == h2


def test_one_row_transform_equals_batch(spark):
    from riskframe.plans.common import inputs
    loan, clarity, payment = inputs(spark, SF01)
    base = FE.base_frame(loan, clarity, payment)
    pipe = FE.FeaturePipeline()
    spec = pipe.fit(base)
    batch = pipe.transform(base, spec)
    one_id = batch.select("loanId").orderBy("loanId").first()["loanId"]
    single = pipe.transform(base.where(F.col("loanId") == one_id), spec).collect()
    from_batch = batch.where(F.col("loanId") == one_id).collect()
    assert len(single) == 1 and single[0].asDict() == from_batch[0].asDict()


def test_bracketed_quantiles_match_pandas(spark):
    df, pdf = _random_frame(spark, 5000, 9)
    probs = [0.0, 0.1, 0.5, 0.9, 0.995, 1.0]
    got = ranking.quantiles_of(df, ["g"], "v", probs, k=16)  # coarse sketch: still exact
    for g, part in pdf.dropna().groupby("g"):
        for p in probs:
            assert got[((g,), round(p, 12))] == pytest.approx(part["v"].quantile(p), rel=1e-12, abs=1e-12)
    # a hot value (a third of the rows) collapses into one counted row
    hot = spark.createDataFrame([(1.0,)] * 3000 + [(float(i),) for i in range(6000)], "v double")
    q = ranking.quantiles_of(hot, [], "v", [0.5])
    assert q[((), 0.5)] == pytest.approx(pd.Series([1.0] * 3000 + list(range(6000))).quantile(0.5))


def test_column_quantiles_match_pandas_without_a_row_per_column(spark):
    """Nulls, hot values, other numeric types, a name with a dot; a coarse sketch that misses is made good."""
    df, pdf = _random_frame(spark, 5000, 9)
    more = df.withColumns({"hot": F.when(F.col("v") > 0, 1.0).otherwise(F.round("v", 1)), "none": F.lit(None).cast("double"), "a.b": (F.col("v") * 7).cast("int"), "same": F.lit(3)})
    cols = ["v", "hot", "none", "a.b", "same"]
    local = more.select(*[F.col(f"`{c}`") for c in cols]).toPandas()
    for p, k in ((0.5, 4000), (0.5, 8), (0.0, 4000), (0.9, 16), (1.0, 4000)):
        got = ranking.column_quantiles(more, cols, p, k)
        assert list(got) == ["v", "hot", "a.b", "same"]
        assert all(q == pytest.approx(local[c].dropna().astype(float).quantile(p), rel=1e-12, abs=1e-12) for c, q in got.items())
    assert ranking.column_quantiles(more, ["none"], 0.5) == {}


def test_a_fit_takes_its_medians_from_the_columns(spark, monkeypatch):
    """No unpivoted copy of the frame, which has a row per value."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_):
        raise AssertionError("unpivoted")

    monkeypatch.setattr(DataFrame, "unpivot", refuse)
    df = spark.range(50).select(F.col("id").cast("double").alias("loanAmount"), F.when(F.col("id") > 9, F.col("id") % 7).alias("apr"), F.lit("x").alias("state"))
    assert FE.FeaturePipeline().fit(df).medians == {"loanAmount": 24.5, "apr": 3.0}


def test_exact_sum_rounds_the_same_below_and_above_whole_doubles(spark):
    """Sums of fixed-point values below 2 ** 53 are divided as doubles, larger ones as decimals: both the nearest double."""
    import math
    from fractions import Fraction
    rnd = random.Random(4)
    groups = {i: [round(rnd.uniform(-m, m), d) for _ in range(9)] for i, (m, d) in enumerate([(1e-3, 9), (100, 4), (1e4, 5), (2e6, 2), (4.4e6, 2), (9e6, 3), (9e9, 2)] * 30)}
    groups |= {1000: [9007199.254740992], 1001: [9007199.254740993], 1002: [-9007199.254740993], 1003: [4398046.511104] * 2, 1004: [0.0], 1005: [-1e-9]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double")
    got = df.groupBy("g").agg(exact_sum("v").alias("a"), exact_sum(F.col("v")).alias("b"))
    for g, a, b in got.collect():
        assert a == b == float(Fraction(sum(math.floor(v * 1e9 + 0.5) for v in groups[g]), 10 ** 9)), g
    assert f"< {1 << 51}" in got._jdf.queryExecution().toString()
