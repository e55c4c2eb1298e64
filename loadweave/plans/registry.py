"""Model versions, their fitted state, and the aliases that point to them, kept as tables and Spark ML folders."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.config import CHAMPION, MODEL_NAME, TARGET
from loadweave.plans.packaged import TrendResidualModel
from loadweave.sources.sinks import table_exists

REGISTRY = (
    "model_name string, model_version int, features array<string>, target string, "
    "model_family string, feature_version string, train_end string, test_start string, params string, path string"
)

#: One row each time an alias is set; the row of the largest ``set_no`` holds.
ALIASES = "model_name string, alias string, model_version int, set_no int"


@dataclass
class Bundle:
    """A registered version ready for scoring."""

    name: str
    version: int
    features: list[str]
    feature_version: str
    state: DataFrame
    residual_model: PipelineModel | None

    @property
    def use_holiday(self) -> bool:
        return "holiday_freq" in self.features


def register(spark: SparkSession, root: str, state: DataFrame, residual_model: PipelineModel | None,
             features: Sequence[str], family: str, feature_version: str, train_end: str, test_start: str,
             params: dict | None = None, alias: str | None = None, name: str = MODEL_NAME, keys: Sequence[str] = ("series_id",)) -> int:
    """Save the model with its state, then append the registry row: a version is visible only when complete.
    It takes over ``alias`` if one is given."""
    table = f"{root}/registry"
    version = 1
    if table_exists(spark, table):
        last = spark.read.parquet(table).where(F.col("model_name") == name).agg(F.max("model_version")).first()[0]
        version = (last or 0) + 1
    path = f"{root}/versions/{name}/{version}"
    # what a registration that broke off has left is no version
    TrendResidualModel(state=state, residual=residual_model, keyCols=list(keys)).write().overwrite().save(f"{path}/model")
    row = [(name, version, list(features), TARGET, family, feature_version, str(train_end), str(test_start),
            json.dumps(params or {}), path)]
    spark.createDataFrame(row, REGISTRY).write.mode("append").parquet(table)
    if alias is not None:
        set_alias(spark, root, version, alias, name)
    return version


def _history(spark: SparkSession, root: str, name: str, alias: str) -> list[tuple[int, int]]:
    """(set_no, version) of each time an alias was set, one row per decision."""
    if not table_exists(spark, f"{root}/aliases"):
        return []
    rows = spark.read.parquet(f"{root}/aliases").where((F.col("model_name") == name) & (F.col("alias") == alias))
    return sorted((r["set_no"], r["model_version"]) for r in rows.collect())


def set_alias(spark: SparkSession, root: str, version: int, alias: str = CHAMPION, name: str = MODEL_NAME) -> None:
    """Point an alias to a registered version, newer or older."""
    known = spark.read.parquet(f"{root}/registry").where((F.col("model_name") == name) & (F.col("model_version") == version))
    if known.isEmpty():
        raise LookupError(f"{name} has no version {version}")
    past = _history(spark, root, name, alias)
    row = [(name, alias, version, past[-1][0] + 1 if past else 1)]
    spark.createDataFrame(row, ALIASES).write.mode("append").parquet(f"{root}/aliases")


def roll_back(spark: SparkSession, root: str, alias: str = CHAMPION, name: str = MODEL_NAME) -> int:
    """Point an alias back to the version it named last before the present one; returns that version."""
    past = [v for _, v in _history(spark, root, name, alias)]
    earlier = [v for v in past if v != past[-1]]
    if not earlier:
        raise LookupError(f"{alias} of {name} never named another version")
    set_alias(spark, root, earlier[-1], alias, name)
    return earlier[-1]


def champion_rows(registry: DataFrame, aliases: DataFrame, alias: str = CHAMPION) -> DataFrame:
    """The version that the alias points to, per model."""
    current = (aliases.where(F.col("alias") == alias).groupBy("model_name")
               .agg(F.max_by("model_version", "set_no").alias("model_version")))
    return registry.join(current, ["model_name", "model_version"]).withColumn(
        "use_holiday_feature", F.array_contains("features", "holiday_freq"))


def load_champion(spark: SparkSession, root: str, name: str = MODEL_NAME, alias: str = CHAMPION) -> Bundle:
    row = None
    if table_exists(spark, f"{root}/aliases"):
        found = champion_rows(spark.read.parquet(f"{root}/registry"), spark.read.parquet(f"{root}/aliases"), alias)
        row = found.where(F.col("model_name") == name).first()
    if row is None:
        raise LookupError(f"no version of {name} under alias {alias}")
    model = TrendResidualModel.load(f"{row['path']}/model")
    return Bundle(name, row["model_version"], list(row["features"]), row["feature_version"], model.state, model.residual)
