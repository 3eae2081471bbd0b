"""Boosting by histograms: the sums of a level, equality with MLlib where nothing is drawn, the size of a cached row."""

import os
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from riskframe.operators import boosting as BO
from riskframe.operators import model as MD


@pytest.mark.parametrize("slots, n_bins, depth", [(5, 32, 4), (4, 7, 3), (3, 100, 3), (6, 32, 8)])
def test_histograms_of_a_level(slots, n_bins, depth):
    g = np.random.default_rng(3)
    bins, y, splits = g.integers(0, n_bins, (slots, 2000)).astype(np.uint8), g.random(2000), {}
    for node in range(1, 2 ** depth):
        if node == 1 or (node // 2 in splits and g.random() < 0.8):
            splits[node] = int(g.integers(slots)), int(g.integers(n_bins - 1))
    at = np.ones(2000, int)
    for i in range(2000):
        while at[i] in splits:
            slot, last = splits[at[i]]
            at[i] = 2 * at[i] + (bins[slot, i] > last)
    assert (BO.routed(bins, splits) == at).all()
    wanted = sorted(set(at))[::2]
    counts, sums = next(BO.level("squared", wanted, splits, n_bins, 1.0, (1, 0))([(0, bins.tobytes(), y.tobytes(), None)]))
    for i, node in enumerate(wanted):
        for slot in range(slots):
            mine = at == node
            assert (counts[i, slot] == np.bincount(bins[slot][mine], minlength=n_bins)).all()
            assert np.allclose(sums[i, slot], np.bincount(bins[slot][mine], y[mine], minlength=n_bins))


def frame(spark):
    df = spark.range(4000).select(F.rand(1).alias("a"), F.randn(2).alias("b"), (F.col("id") % 3).cast("double").alias("c"), F.lit(1.0).alias("same"))
    df = df.withColumn("y", F.sin(F.col("a") * 6) + F.col("b") * F.col("c") + F.rand(9) / 4).withColumn("z", (F.col("y") > 0.7).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c", "same"], outputCol="features")]).fit(df).transform(df).cache()


@pytest.mark.parametrize("learner, label", [(GBTRegressor, "y"), (GBTClassifier, "z")])
def test_equals_mllib_where_nothing_is_drawn(spark, learner, label):
    df = frame(spark)
    est = learner(labelCol=label, maxIter=3, maxDepth=4, stepSize=0.1, minInstancesPerNode=5, seed=7)
    one, two = est.fit(df), BO.Boosted(est).fit(df)
    assert type(one) is type(two) and two.getNumTrees == 3 and two.treeWeights == one.treeWeights and two.numFeatures == 4
    out = two.setPredictionCol("p2").transform(one.transform(df).select("features", F.col("prediction").alias("p1")))
    assert out.where(F.abs(F.col("p1") - F.col("p2")) > 1e-9).count() == 0
    assert two.featureImportances.toArray() == pytest.approx(one.featureImportances.toArray(), abs=1e-9)


def test_drawn_rows_and_slots_learn_as_well(spark):
    df = frame(spark)
    est = GBTRegressor(labelCol="y", maxIter=20, maxDepth=4, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=7)
    one, two = (m.transform(df).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0] for m in (est.fit(df), BO.Boosted(est).fit(df)))
    assert two < 1.25 * one


def test_a_cached_row_has_a_byte_a_slot():
    x = np.random.default_rng(1).random((1000, 30))
    cuts = {s: BO.cut_points(x[:, s], 32) for s in range(30)}
    assert all(len(c) == 31 for c in cuts.values())
    batch = pa.RecordBatch.from_pydict({"label": x[:, 0], "features": pa.array(list(x))})
    out = list(BO.binned(cuts, 400)(batch.slice(i, 250) for i in range(0, 1000, 250)))
    assert len(out) == 2 and sum(len(v) for b in out for c in b.columns for v in c.to_pylist()) == 1000 * (30 + 8)
    with pytest.raises(ValueError):
        list(BO.binned(cuts, 400)([pa.RecordBatch.from_pydict({"label": [np.nan], "features": pa.array([x[0]])})]))
    assert isinstance(MD.estimator(), BO.Boosted) and isinstance(MD.estimator(task="binary"), BO.Boosted)


def learned(spark, rows, together, monkeypatch, held=None, **more):
    """(trees, Spark jobs) of 5 rounds, 3 a barrier job, over chunks of 100 rows in 3 tasks."""
    monkeypatch.setattr(BO, "CHUNK_ROWS", 100)
    g = np.random.default_rng(5)
    x = np.stack([g.random(rows), g.random(rows), g.integers(0, 2, rows), g.random(rows), g.integers(0, 3, rows)], 1)
    y = np.sin(6 * x[:, 0]) + x[:, 1] * x[:, 2] + g.random(rows) / 4
    cuts = {s: BO.cut_points(x[:, s], 32) for s in range(5)}
    batches = [pa.RecordBatch.from_pydict({"label": y[i:i + 100], "features": pa.array(list(x[i:i + 100]))}) for i in range(0, rows, 100)]
    chunks = [r for b in BO.binned(cuts, 100)(batches) for r in b.to_pylist()]
    if held is not None:
        monkeypatch.setattr(BO.rounds, "__defaults__", (held,))
    p = {"loss": "squared", "trees": 5, "step": 0.1, "depth": 4, "least": 5, "min_gain": 0.0, "rate": 0.8, "share": 0.8, "seed": 7, "checkpoint": 3, **more}
    if p["loss"] == "logistic":
        chunks = [{**c, "label": np.where(np.frombuffer(c["label"]) > 0.7, 1.0, -1.0).tobytes()} for c in chunks]
    sc = spark.sparkContext
    group = f"learned-{uuid.uuid4().hex}"
    sc.setJobGroup(group, "")
    trees = BO.boost(sc.parallelize(chunks, 2), 3, cuts, 5, p, together)
    jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)
    return trees, jobs


@pytest.mark.parametrize("rows, held, more", [(1000, None, {}), (1000, 700, {}), (150, None, {}), (1000, None, {"loss": "logistic"}), (1000, None, {"checkpoint": -1, "rate": 1.0})])
def test_rounds_in_one_job_give_the_same_trees_as_a_job_a_level(spark, monkeypatch, rows, held, more):
    """Also with bins in a file, with a task that has no chunk, and with nothing left in the shared folder."""
    folder = f"{BO.common_folder(spark)}/riskframe-scratch"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    one, few = learned(spark, rows, True, monkeypatch, held, **more)
    two, many = learned(spark, rows, False, monkeypatch, **more)
    assert repr(one) == repr(two) and len(one) == 5 and all(t[0] for t in one)
    assert few <= 10 and many > 5 * 4
    assert not [f for f in set(os.listdir(folder)) - before if f.startswith("boosting-exchange")]


def test_training_runs_its_rounds_together(spark):
    df = frame(spark)
    sc = spark.sparkContext
    sc.setJobGroup("together", "")
    BO.Boosted(GBTRegressor(labelCol="y", maxIter=20, maxDepth=4, seed=7)).fit(df)
    jobs = len(sc.statusTracker().getJobIdsForGroup("together"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 40  # a job a level: 80 and more
    assert BO.fits_together(spark, 1, 1000) and not BO.fits_together(spark, 10_000, 1000) and not BO.fits_together(spark, 1, BO.HELD_ROWS + 1)
