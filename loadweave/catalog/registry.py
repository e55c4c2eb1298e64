"""Where query functions and their SQL counterparts are collected."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.session import pin_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin_utc(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn
    return keep


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Computed doubles are compared after rounding, on both sides."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
