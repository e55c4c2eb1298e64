"""Completeness of a regular series: bounds, duplicates, gaps, and filling them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadweave.config import LOCAL_ZONE, Layout
from loadweave.functions.timefn import tick, to_local
from loadweave.operators.blocks import BLOCK


def series_bounds(df: DataFrame, layout: Layout) -> DataFrame:
    """First and last timestamp and row count of each series."""
    return df.groupBy(*layout.keys).agg(
        F.min(layout.ts).alias("first_ts"),
        F.max(layout.ts).alias("last_ts"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def duplicate_report(df: DataFrame, layout: Layout) -> DataFrame:
    """Rows beyond the first at each timestamp, per series."""
    per_ts = df.groupBy(*layout.order).agg(F.count(F.lit(1)).alias("_n"))
    return per_ts.groupBy(*layout.keys).agg(
        F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_duplicates")
    )


def gap_report(df: DataFrame, layout: Layout, block: int = BLOCK) -> DataFrame:
    """Neighbouring rows that are not exactly one step apart.

    Neighbours inside a time block come from a window over the block. The pair that straddles two
    blocks comes from the blocks' first and last rows, a table of one row per block.
    """
    keys = list(layout.keys)
    ts = layout.ts
    based = df.select(*layout.order).withColumn("_tb", F.floor(tick(layout) / F.lit(block)))
    inside = Window.partitionBy(*keys, "_tb").orderBy(ts)
    near = based.select(*keys, F.lag(ts).over(inside).alias("prev_ts"), F.col(ts))
    edges = based.groupBy(*keys, "_tb").agg(F.min(ts).alias(ts), F.max(ts).alias("_last"))
    across = edges.select(
        *keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_tb")).alias("prev_ts"), ts
    )
    seconds = (
        F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col("prev_ts").cast("timestamp"))
    )
    return (
        near.unionByName(across)
        .where(F.col("prev_ts").isNotNull())
        .withColumn("delta_seconds", seconds)
        .where(F.col("delta_seconds") != layout.step)
        .withColumn("n_missing", F.greatest(F.floor(F.col("delta_seconds") / layout.step) - 1, F.lit(0)))
    )


def on_grid(df: DataFrame, layout: Layout) -> DataFrame:
    """Rows that lie whole steps after their series' first row."""
    first = df.groupBy(*layout.keys).agg(F.min(layout.ts).alias("_first"))
    since = F.unix_micros(F.col(layout.ts).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    return df.join(first, list(layout.keys)).where(since % (layout.step * 1_000_000) == 0).drop("_first")


def gap_fill(df: DataFrame, layout: Layout, zone: str = LOCAL_ZONE, local_name: str | None = "timestamp_central",
             block: int = BLOCK, aligned: bool = False) -> DataFrame:
    """One row per step from a series' first to its last row; absent steps come in with nulls.

    There is no spine to join. Inside a time block, each row brings along the steps missing before
    it; holes that straddle blocks come from the blocks' first and last rows. Arrays hold at most
    one block. Rows off the grid that a series' first timestamp sets are left out, as reindexing
    would; pass ``aligned=True`` when all timestamps are known to be whole steps.
    """
    keys = list(layout.keys)
    ts, step = layout.ts, layout.step
    values = [c for c in df.columns if c not in layout.order]
    if not aligned:
        df = on_grid(df, layout)

    def as_ts(seconds):
        return F.timestamp_seconds(seconds).cast("timestamp_ntz")

    based = df.withColumn("_tb", F.floor(tick(layout) / F.lit(block)))
    now = F.unix_seconds(F.col(ts).cast("timestamp"))
    before = F.lag(now).over(Window.partitionBy(*keys, "_tb").orderBy(ts))
    steps = F.when(F.col("_now") - F.col("_prev") > step, F.sequence(F.col("_prev") + step, F.col("_now"), F.lit(step)))
    inside = (
        based.withColumns({"_now": now, "_prev": before})
        .withColumn("_s", F.explode(F.coalesce(steps, F.array("_now"))))
        .select(*keys, F.when(F.col("_s") == F.col("_now"), F.col(ts)).otherwise(as_ts(F.col("_s"))).alias(ts),
                *[F.when(F.col("_s") == F.col("_now"), F.col(c)).alias(c) for c in values])
    )
    edges = based.groupBy(*keys, "_tb").agg(F.min(now).alias("_a"), F.max(now).alias("_z"))
    chunk = step * block
    across = (
        edges.select(*keys, F.lag("_z").over(Window.partitionBy(*keys).orderBy("_tb")).alias("_z"), "_a")
        .where(F.col("_a") - F.col("_z") > step)
        .select(*keys, "_a", F.explode(F.sequence(F.col("_z") + step, F.col("_a") - step, F.lit(chunk))).alias("_c"))
        .select(*keys, F.explode(F.sequence(
            F.col("_c"), F.least(F.col("_a"), F.col("_c") + chunk) - step, F.lit(step))).alias("_s"))
        .select(*keys, as_ts(F.col("_s")).alias(ts))
    )
    filled = inside.unionByName(across, allowMissingColumns=True)
    return filled.withColumn(local_name, to_local(F.col(ts), zone)) if local_name else filled


def quality_check(df: DataFrame, layout: Layout) -> DataFrame:
    """Raise on duplicate timestamps or unreadable time; return the gap report as the warning."""
    kind = df.schema[layout.ts].dataType.typeName()
    if not kind.startswith("timestamp"):
        raise ValueError(f"{layout.ts} is {kind}, expected a UTC timestamp")
    totals = duplicate_report(df, layout).agg(F.sum("n_duplicates").alias("n")).first()
    if totals["n"]:
        raise ValueError(f"{totals['n']} duplicate timestamp(s)")
    return gap_report(df, layout)


def lag_spot_check(df: DataFrame, layout: Layout, lags: dict[str, tuple[str, int]]) -> DataFrame:
    """Rows whose lag column differs from the value found by joining on the shifted timestamp."""
    parts = []
    for name, (column, n) in lags.items():
        earlier = df.select(
            *layout.keys,
            (F.col(layout.ts) + F.make_dt_interval(secs=F.lit(n * layout.step))).alias(layout.ts),
            F.col(column).alias("_was"),
        )
        parts.append(
            df.select(*layout.order, name).join(earlier, layout.order, "left")
            .agg(
                F.lit(name).alias("lag_name"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count(name).alias("n_known"),
                F.count_if(~F.col(name).eqNullSafe(F.col("_was"))).alias("n_mismatch"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
