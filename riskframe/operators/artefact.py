"""Servable artefacts: feature spec, encodings, model, importances and metadata under a version, with a registry.

``publish`` writes a version's folder in the shared storage and appends a registry row; older versions stay as
backups. ``load`` reads the current (or a named) version in any session: what it returns builds features and
scores without the training frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import path_exists
from . import features as FE
from .gate import registry_current
from .model import WideIndexModel

REGISTRY = "model_version string, deployment_date timestamp, run_id string, task string, n_rows long"


@dataclass
class Artefact:
    version: str
    task: str
    pipeline: FE.FeaturePipeline
    spec: FE.FeatureSpec
    model: PipelineModel
    importances: DataFrame

    def features(self, base: DataFrame) -> DataFrame:
        return self.pipeline.transform(base, self.spec)


def publish(spark: SparkSession, root: str, version: str, run_id: str, pipeline: FE.FeaturePipeline, spec: FE.FeatureSpec,
            model: PipelineModel, task: str, importances: DataFrame, n_rows: int) -> str:
    """Write one version and register it. A version is written once; nothing is overwritten."""
    at = f"{root}/{version}"
    if path_exists(spark, at):
        raise ValueError(f"version {version} exists")
    spark.createDataFrame([(version, run_id, task, spec.to_json(), int(n_rows))], "version string, run_id string, task string, spec string, n_rows long") \
        .coalesce(1).write.parquet(f"{at}/metadata")
    for name in spec.encoded:
        pipeline.encodings[name].write.parquet(f"{at}/encodings/{name}")
    importances.write.parquet(f"{at}/importances")
    kept = [s for s in model.stages if isinstance(s, WideIndexModel)]
    for s in kept:  # index tables move into the version's folder, which then needs nothing else
        spark.read.parquet(s.getOrDefault("table")).write.parquet(f"{at}/index/{s.getInputCol()}")
    paths = {s.getInputCol(): f"{at}/index/{s.getInputCol()}" for s in kept}
    PipelineModel(stages=[s.copy({s.table: paths[s.getInputCol()]}) if s in kept else s for s in model.stages]).save(f"{at}/model")
    # the registry row comes last: a version that is listed is complete
    spark.range(1).select(F.lit(version).alias("model_version"), F.current_timestamp().alias("deployment_date"), F.lit(run_id).alias("run_id"),
                          F.lit(task).alias("task"), F.lit(int(n_rows)).cast("long").alias("n_rows")).write.mode("append").parquet(f"{root}/registry")
    return at


def registry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(f"{root}/registry")


def load(spark: SparkSession, root: str, version: str | None = None) -> Artefact:
    version = version or registry_current(registry(spark, root)).first()["current_version"]
    at = f"{root}/{version}"
    meta = spark.read.parquet(f"{at}/metadata").first()
    spec = FE.FeatureSpec.from_json(meta["spec"])
    pipeline = FE.FeaturePipeline(spec.config)
    pipeline.encodings = {name: spark.read.parquet(f"{at}/encodings/{name}") for name in spec.encoded}
    return Artefact(version, meta["task"], pipeline, spec, PipelineModel.load(f"{at}/model"), spark.read.parquet(f"{at}/importances"))
