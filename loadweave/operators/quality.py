"""Declarative table checks, evaluated together in one aggregation."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.config import (
    GATE_COLUMNS, GATE_RANGES, GATE_ROW_TOLERANCE, GATE_ROWS, GATE_TIMESTAMP, JOINED_VALUES,
)

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Check:
    """One expectation: a kind, the column it looks at (if any), and its parameters."""

    kind: str
    column: str | None = None
    params: dict = field(default_factory=dict)


def gate_suite(columns: Sequence[str] = tuple(GATE_COLUMNS), rows: int = GATE_ROWS,
               tolerance: float = GATE_ROW_TOLERANCE, ranges: dict = GATE_RANGES,
               pattern: str = GATE_TIMESTAMP) -> list[Check]:
    """The raw-data gate: shape, size, nulls, physical ranges, timestamp text."""
    return [
        Check("column_count", params={"value": len(columns)}),
        Check("column_set", params={"columns": list(columns)}),
        Check("row_count", params={"min": int(rows * (1 - tolerance)), "max": int(rows * (1 + tolerance))}),
        *[Check("not_null", c) for c in columns],
        *[Check("between", c, {"min": lo, "max": hi}) for c, (lo, hi) in ranges.items()],
        Check("matches", columns[0], {"regex": pattern}),
    ]


def joined_suite(rows: int = GATE_ROWS) -> list[Check]:
    """The same gate for the nine-column joined table."""
    return gate_suite(["timestamp", "timestamp_central", *JOINED_VALUES], rows)


def rename_if_same_width(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Positional rename, only when the number of columns agrees."""
    return df.toDF(*names) if len(df.columns) == len(names) else df


def _bad(check: Check) -> Column:
    """Condition under which a non-null value breaks the check."""
    col = F.col(check.column)
    if check.kind == "between":
        lo, hi = check.params["min"], check.params["max"]
        value = col.cast("double")
        tests = [F.isnan(value)]
        tests += [value < F.lit(lo)] if lo is not None else []
        tests += [value > F.lit(hi)] if hi is not None else []
        return reduce(lambda a, b: a | b, tests)
    if check.kind == "matches":
        return ~col.cast("string").rlike(check.params["regex"])
    raise ValueError(check.kind)


def evaluate(df: DataFrame, suite: Sequence[Check]) -> DataFrame:
    """One result row per check: ``check_no, expectation, column_name, params, observed,
    unexpected_pct, success``. ``observed`` is the measured count (columns, rows or bad values)."""
    present = set(df.columns)
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for i, check in enumerate(suite):
        if check.column is None or check.column not in present:
            continue
        col = F.col(check.column)
        aggregates.append(F.count(col).alias(f"_k{i}"))
        if check.kind != "not_null":
            aggregates.append(F.count_if(col.isNotNull() & _bad(check)).alias(f"_b{i}"))
    n = F.col("_n")
    results = []
    for i, check in enumerate(suite):
        pct = F.lit(None).cast("double")
        if check.kind == "column_count":
            observed = F.lit(len(df.columns)).cast("long")
            ok = F.lit(len(df.columns) == check.params["value"])
        elif check.kind == "column_set":
            observed = F.lit(len(set(check.params["columns"]) ^ present)).cast("long")
            ok = observed == 0
        elif check.kind == "row_count":
            observed = n
            ok = n.between(check.params["min"], check.params["max"])
        elif check.column not in present:
            observed, ok = F.lit(None).cast("long"), F.lit(False)
        else:
            known = F.col(f"_k{i}")
            observed = n - known if check.kind == "not_null" else F.col(f"_b{i}")
            base = n if check.kind == "not_null" else known
            pct = F.when(base > 0, F.lit(100.0) * observed / base).otherwise(0.0)
            ok = observed == 0
        results.append(F.struct(
            F.lit(i + 1).alias("check_no"),
            F.lit(check.kind).alias("expectation"),
            F.lit(check.column).cast("string").alias("column_name"),
            F.lit(json.dumps(check.params)).alias("params"),
            observed.alias("observed"),
            pct.alias("unexpected_pct"),
            ok.alias("success"),
        ))
    return df.agg(*aggregates).select(F.inline(F.array(*results)))


def verdict(results: DataFrame) -> DataFrame:
    """Number of checks, number failed, and the pass flag, in one row."""
    return results.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(~F.col("success")).alias("n_failed"),
        F.bool_and("success").alias("passed"),
    )


def validate(df: DataFrame, suite: Sequence[Check] | None = None,
             positional: bool = False) -> tuple[bool, DataFrame | None]:
    """Pass flag and results; never raises.

    With ``positional``, a table of the right width takes the canonical names first, which leaves the
    check of the names nothing to find; by default the names are checked as they come.
    """
    try:
        if positional:
            df = rename_if_same_width(df, GATE_COLUMNS)
        results = evaluate(df, suite or gate_suite())
        rows = results.collect()  # one row per check
        failed = [r for r in rows if not r["success"]]
        for r in failed:
            log.error("failed %s(%s) %s observed=%s unexpected_pct=%s",
                      r["expectation"], r["column_name"], r["params"], r["observed"], r["unexpected_pct"])
        log.info("%d of %d checks failed", len(failed), len(rows))
        return not failed, results
    except Exception:
        log.exception("gate could not run")
        return False, None


def run_gate(spark: SparkSession, path: str, suite: Sequence[Check] | None = None) -> bool:
    """Read a CSV, its first column as raw text, and validate it. Missing file: False."""
    from loadweave.sources.readers import read_gate_csv

    try:
        return validate(read_gate_csv(spark, path), suite)[0]
    except Exception:
        log.exception("could not read %s", path)
        return False


def output_problems(df: DataFrame, expected: Sequence[str] | None = None,
                    aside: Sequence[str] = ("trend_idx",)) -> DataFrame:
    """``(problem, column_name, n)`` of a model-ready table, no row where nothing is wrong.

    ``null`` counts the rows a column lacks; ``text`` (a column models cannot read), ``absent`` and
    ``surplus`` (against ``expected``, which need not list the columns ``aside``) hold for a whole
    column and have no count. One pass over the data.
    """
    findings = [("null", c, F.count_if(F.col(c).isNull())) for c in df.columns]
    unknown = F.lit(None).cast("long")
    findings += [("text", f.name, unknown) for f in df.schema if not isinstance(f.dataType, T.NumericType)]
    if expected is not None:
        listed = {*expected, *aside}
        findings += [("surplus", c, unknown) for c in df.columns if c not in listed]
        findings += [("absent", c, unknown) for c in expected if c not in df.columns]
    cells = [F.struct(F.lit(problem).alias("problem"), F.lit(column).alias("column_name"), n.alias("n"))
             for problem, column, n in findings]
    return df.agg(F.array(*cells).alias("_all")).select(F.inline("_all")).where("n is null or n > 0")
