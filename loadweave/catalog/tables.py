"""The shared inputs of the registered queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loadweave.config import CITIES, DAILY, HOURLY
from loadweave.operators import features as feat
from loadweave.operators.align import align_and_join, join_on_time
from loadweave.operators.folds import Fold, Split, chronological_split, expanding_folds
from loadweave.operators.weather import stations_wide
from loadweave.session import materialise
from loadweave.sources import adapters

FOLDS: list[Fold] = expanding_folds("1995-01-01 00:00:00", "1997-01-01 00:00:00", 4, 7, DAILY.step)
TEST_START_LOCAL = "2001-01-01 00:00:00"
ROLL = {"window": 28, "minimum": 7, "back": 1}


def hourly_joined(spark: SparkSession, sf: str) -> DataFrame:
    wide = stations_wide(adapters.station_weather(spark, sf), CITIES)
    return align_and_join(adapters.hourly_load(spark, sf), wide)


def hourly_core(spark: SparkSession, sf: str) -> DataFrame:
    return feat.core_features(hourly_joined(spark, sf), HOURLY, aligned=True)


def daily_joined(spark: SparkSession, sf: str) -> DataFrame:
    return join_on_time(adapters.daily_load(spark, sf), adapters.daily_weather(spark, sf))


def daily_core(spark: SparkSession, sf: str) -> DataFrame:
    return feat.core_features(daily_joined(spark, sf), DAILY, feat.DAY_LAGS, aligned=True)


def daily_base(spark: SparkSession, sf: str) -> DataFrame:
    """Features over the stored core table: the raw tables are scanned once, to build it."""
    core = materialise(daily_core(spark, sf), "core")
    return feat.drop_warmup(feat.add_base_features(core, DAILY, **ROLL))


@dataclass
class Daily:
    core: DataFrame
    split: Split

    @property
    def train(self) -> DataFrame:
        return self.split.train

    @property
    def test(self) -> DataFrame:
        return self.split.test


def daily(spark: SparkSession, sf: str, calendar_scope: str = "train") -> Daily:
    """Feature rows of all zones, split with a purge; holidays are named over the train span by default.

    The core and the feature table are stored, since every fit reads the latter several times.
    """
    core = materialise(daily_core(spark, sf), "core")
    base = materialise(feat.drop_warmup(feat.add_base_features(core, DAILY, **ROLL)), "features")
    train = chronological_split(base, test_start_local=TEST_START_LOCAL).train
    named = feat.attach_holiday_names(base, train, DAILY, calendar_scope=calendar_scope)
    return Daily(core, chronological_split(named, test_start_local=TEST_START_LOCAL))
