"""Preprocessing, training, importances with MLlib.

* numeric: exact median imputation (fitted medians, distributed ranking) and standardisation with the
  population std (zero std -> scale 1) as column expressions — MLlib's ``Imputer`` is approximate and its
  ``StandardScaler`` uses the sample std;
* categorical: ``StringIndexer(handleInvalid='keep', alphabetAsc)`` + ``OneHotEncoder(dropLast=True)``:
  an unseen category becomes the all-zero vector. Columns of more than WIDE_LABELS values are indexed by a table
  (value, index) that never passes through the driver and is joined by key; the one-hot vectors are sparse either way;
* ``VectorAssembler`` -> boosted trees (regression target, two classes; configured as MLlib's GBT, learned by ``boosting``) or, for
  more classes, MLlib's random forest.

Training runs on the executors; boosting checkpoints its state every ``checkpointInterval`` iterations to
the shared checkpoint directory, so a lost executor does not replay the whole boosting history.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark import StorageLevel
from pyspark.ml import Transformer
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import exact_avg
from ..session import shared_path, written
from . import ranking, stats
from .boosting import Boosted

# Pipeline configuration of the boosted trees (fixed values of the configuration file).
WIDE_LABELS = 10_000  # columns of more values are indexed by a table instead of by labels in the driver
DEFAULT_HYPERPARAMETERS = {
    "n_estimators": 200, "learning_rate": 0.05, "num_leaves": 50, "max_depth": 10, "min_child_samples": 30,
    "subsample": 0.8, "colsample_bytree": 0.8, "reg_alpha": 0.1, "reg_lambda": 0.1, "random_state": 42,
}


def mllib_params(h: dict | None = None) -> dict:
    """Map boosted-tree settings to MLlib GBT parameters.

    ``num_leaves`` -> depth ``ceil(log2(num_leaves))`` capped by ``max_depth`` (MLlib grows level-wise);
    ``colsample_bytree`` -> ``featureSubsetStrategy``; L1/L2 leaf penalties have no MLlib counterpart.
    """
    h = dict(DEFAULT_HYPERPARAMETERS, **(h or {}))
    depth = math.ceil(math.log2(max(2, h["num_leaves"])))
    if h.get("max_depth", -1) and h["max_depth"] > 0:
        depth = min(depth, h["max_depth"])
    return {"maxIter": int(h["n_estimators"]), "stepSize": float(h["learning_rate"]), "maxDepth": int(depth),
            "minInstancesPerNode": int(h["min_child_samples"]), "subsamplingRate": float(h["subsample"]),
            "featureSubsetStrategy": str(h["colsample_bytree"]), "seed": int(h["random_state"])}


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float, float]]:
    """Exact median, mean and population std (after median imputation) per column: two passes."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    med = {k[0]: q for (k, _), q in ranking.quantiles_of(long, ["feature"], "value", [0.5]).items()}
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med.get(c))).alias(c) for c in cols])
    row = filled.agg(*[exact_avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (med.get(c), row[f"m_{c}"], row[f"s_{c}"] or 0.0) for c in cols}


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float, float]], suffix: str = "") -> DataFrame:
    cols = {}
    for c, (med, mean, std) in params.items():
        scale = std if std > 0 else 1.0
        cols[c + suffix] = (F.coalesce(F.col(c).cast("double"), F.lit(med)) - F.lit(mean)) / F.lit(scale)
    return df.withColumns(cols)


class WideIndexModel(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Index of a column by a table (value, index) in shared storage; null and unknown values get the number of values, as a
    StringIndexer's ``keep`` does."""

    table = Param(Params._dummy(), "table", "path of the index table", typeConverter=TypeConverters.toString)
    size = Param(Params._dummy(), "size", "number of values", typeConverter=TypeConverters.toInt)

    def of(self, column: str, out: str, table: str, size: int) -> WideIndexModel:
        return self._set(inputCol=column, outputCol=out, table=table, size=size)

    def _transform(self, df: DataFrame) -> DataFrame:
        c, out = self.getInputCol(), self.getOutputCol()
        index = df.sparkSession.read.parquet(self.getOrDefault("table")).select(F.col("value").alias("__value"), F.col("index").alias("__index"))
        joined = df.join(index, F.col(c).cast("string") == F.col("__value"), "left")
        return joined.withColumn(out, F.coalesce("__index", F.lit(self.getOrDefault("size"))).cast("double")).drop("__value", "__index")


def index_wide(df: DataFrame, column: str, out: str) -> WideIndexModel:
    """Fit the index table of a column."""
    path = shared_path(df.sparkSession, f"index-{column}")
    ranking.dense_index(df, column).write.parquet(path)
    return WideIndexModel().of(column, out, path, df.sparkSession.read.parquet(path).count())


def wide_columns(df: DataFrame, columns: list[str], most: int = WIDE_LABELS) -> list[str]:
    """Columns of more than about ``most`` values, counted for all of them in one pass."""
    if not columns:
        return []
    row = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > most]


def preprocessing_stages(numeric: list[str], categorical: list[str], wide: list[WideIndexModel] | None = None) -> tuple[list, list[str]]:
    """One indexer and one one-hot encoder for all categoricals, the same for fitted wide indexes, plus the assembler input list."""
    stages = []
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=[f"{c}__idx" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical], outputCols=[f"{c}__ohe" for c in categorical], dropLast=True))
    names = [w.getInputCol() for w in wide or []]
    if names:
        stages += wide
        stages.append(OneHotEncoder(inputCols=[w.getOutputCol() for w in wide], outputCols=[f"{c}__ohe" for c in names], dropLast=True, handleInvalid="keep"))
    return stages, [*numeric, *[f"{c}__ohe" for c in [*categorical, *names]]]


def estimator(label: str = "target", task: str = "regression", params: dict | None = None, checkpoint_interval: int = 10):
    """The learner of a task. Classifiers expect an indexed label (0, 1, ...)."""
    p = {"maxMemoryInMB": 1024, **(params or {})}  # all nodes of a level in one pass
    if task == "regression":
        est = Boosted(GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction",
                                   checkpointInterval=checkpoint_interval, **p))
    elif task == "binary":
        est = Boosted(GBTClassifier(featuresCol="features", labelCol=label, predictionCol="prediction",
                                    checkpointInterval=checkpoint_interval, **p))
    else:
        keep = {k: v for k, v in p.items() if k in ("maxDepth", "minInstancesPerNode", "subsamplingRate",
                                                    "featureSubsetStrategy", "seed", "maxMemoryInMB")}
        est = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=int(p.get("maxIter", 100)),
                                     checkpointInterval=checkpoint_interval, **keep)
    return est


def fit_model(train: DataFrame, numeric: list[str], categorical: list[str], label: str = "target", task: str | None = None,
              params: dict | None = None, checkpoint_interval: int = 10) -> tuple[PipelineModel, str]:
    """(model, task). The training columns are written once. Preprocessing is fitted on them; the learner then reads only label and vector,
    kept on disk and released: memory belongs to the learner's own binned rows, which every boosting round
    scans, while the vectors are read a few times before the first one. Class labels are indexed in order of value and turned
    back after prediction."""
    train = written(train.where(F.col(label).isNotNull()).select(label, *dict.fromkeys(c for c in [*numeric, *categorical] if c != label)), "training-rows")
    task = task or choose_task(train, label)
    wide = wide_columns(train, categorical)
    stages, inputs = preprocessing_stages(numeric, [c for c in categorical if c not in wide], [index_wide(train, c, f"{c}__idx") for c in wide])
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    back, on = [], label
    if task != "regression":
        values = sorted(r[0] for r in train.select(F.col(label).cast("double")).distinct().collect())  # at most 10, see choose_task
        index = StringIndexerModel.from_labels([repr(v) for v in values], inputCol="__label", outputCol="__y", handleInvalid="error")
        train, on = train.withColumn("__label", F.col(label).cast("double").cast("string")), "__y"
        train = index.transform(train)
        back = [IndexToString(inputCol="prediction", outputCol="prediction_label", labels=[repr(v) for v in values])]
    prep = Pipeline(stages=stages).fit(train)
    ready = prep.transform(train).select(on, "features")
    if task == "multiclass":  # MLlib's learner: one partition a core
        ready = ready.repartition(train.sparkSession.sparkContext.defaultParallelism)
    ready = ready.persist(StorageLevel.DISK_ONLY)
    try:
        learned = estimator(on, task, params, checkpoint_interval).fit(ready)
    finally:
        ready.unpersist()
    return PipelineModel(stages=[*prep.stages, learned, *back]), task


def learner_of(model: PipelineModel):
    """The fitted trees among the stages."""
    return next(s for s in reversed(model.stages) if hasattr(s, "featureImportances"))


def task_of(model: PipelineModel) -> str:
    """Task read from the stored model: a learner with class probabilities is a classifier."""
    s = learner_of(model)
    return "regression" if not hasattr(s, "numClasses") else "binary" if s.numClasses <= 2 else "multiclass"


def bucket_target(df: DataFrame, label: str = "target", bins: int = 5) -> tuple[DataFrame, str]:
    """Bucketed target mode: a label with more than 10 distinct values is cut into equal-width bins 0 .. bins - 1."""
    if choose_task(df, label) != "regression":
        return df, label
    out, _ = stats.cut(df, label, bins)
    return out, f"{label}_bin"


def choose_task(df: DataFrame, label: str) -> str:
    """<= 10 distinct target values -> classifier (2 classes: binary), else regression."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).count().limit(11).count()
    if n > 10:
        return "regression"
    return "binary" if n <= 2 else "multiclass"


def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the assembled vector slots (from the ML attribute metadata)."""
    schema = model.transform(df).schema  # analysis only: the metadata lives in the schema
    meta = schema["features"].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    named = {a["idx"]: a.get("name") for a in attrs}
    return [named.get(i) or f"f{i}" for i in range(max(named, default=-1) + 1)]


def source_column(name: str, columns: list[str]) -> str | None:
    """The frame's column that a vector slot comes from: its own name, or the category column before __ohe."""
    if name in columns:
        return name
    base = name.split("__ohe", 1)[0]
    return base if base in columns else None


def importances(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Feature importances (gain-based) with names, as a DataFrame."""
    est = learner_of(model)
    names = feature_names(model, df)
    imp = est.featureImportances.toArray().tolist()
    rows = [(names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(imp)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")
