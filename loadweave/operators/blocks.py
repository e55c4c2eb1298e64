"""Windows over long series without putting one series in one task.

``Window.partitionBy(series)`` sends a whole series to a single task, which fails when one series
holds a large share of the rows. Here a series is cut into blocks of consecutive positions; the
last ``halo`` rows of each block are also sent to the next one, so a frame reaching back at most
``halo`` rows sees all it needs. Each block is small, and a hot series spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loadweave.config import Layout
from loadweave.functions.timefn import tick

BLOCK = 4096


def over_blocks(
    df: DataFrame,
    keys: tuple[str, ...],
    position: str,
    halo: int,
    outputs: Mapping[str, Callable[[WindowSpec], Column]],
    block: int = BLOCK,
) -> DataFrame:
    """Add window columns whose frames reach back at most ``halo`` positions.

    ``position`` is an integer column, unique within ``keys``; ``outputs`` maps a new column name
    to a function from an ordered window to an expression.
    """
    block = max(block, halo)
    own = F.floor(F.col(position) / F.lit(block)).cast("long")
    offset = F.col(position) - own * block
    here = F.struct(own.alias("_blk"), F.lit(False).alias("_halo"))
    after = F.struct((own + 1).alias("_blk"), F.lit(True).alias("_halo"))
    copies = F.when(offset >= block - halo, F.array(here, after)).otherwise(F.array(here))
    window = Window.partitionBy(*keys, "_blk").orderBy(position)
    return (
        df.select("*", F.inline(copies))
        .select("*", *[fn(window).alias(name) for name, fn in outputs.items()])
        .where(~F.col("_halo"))
        .drop("_blk", "_halo")
    )


def with_positions(df: DataFrame, layout: Layout, out: str = "_pos", origin: str | None = None,
                   block: int = BLOCK) -> DataFrame:
    """Number the rows of each series 0, 1, 2, ... in time order; optionally add its first timestamp.

    Rows are numbered inside time blocks, then shifted by the row count of earlier blocks. The
    shift needs one window per series over block totals only. Timestamps are unique within a
    series and the calendar ends in year 9999, so an hourly series has at most about 21,400 blocks.
    """
    keys = list(layout.keys)
    based = df.withColumn("_tb", F.floor(tick(layout) / F.lit(block)).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        based.groupBy(*keys, "_tb").agg(F.count(F.lit(1)).alias("_n"), F.min(layout.ts).alias("_first"))
        .select(*keys, "_tb", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"),
                *([F.min("_first").over(Window.partitionBy(*keys)).alias(origin)] if origin else []))
    )
    inside = Window.partitionBy(*keys, "_tb").orderBy(layout.ts)
    numbered = based.withColumn("_rn", F.row_number().over(inside) - 1)
    return (
        numbered.join(shifts, [*keys, "_tb"])
        .withColumn(out, F.col("_shift") + F.col("_rn"))
        .drop("_tb", "_rn", "_shift")
    )


def time_lags(df: DataFrame, layout: Layout, lags: Mapping[str, tuple[str, int]],
              block: int = BLOCK) -> DataFrame:
    """``out = column`` as it was ``n`` steps earlier on the clock; null where that hour is absent.

    On a complete grid this equals a positional shift, and it needs no inserted rows.
    """
    halo = max(n for _, n in lags.values())
    outputs = {
        out: (lambda w, c=column, n=n: F.first(c).over(w.rangeBetween(-n, -n)))
        for out, (column, n) in lags.items()
    }
    ticked = df.withColumn("_tick", tick(layout))
    return over_blocks(ticked, layout.keys, "_tick", halo, outputs, block).drop("_tick")


def rolling_std(column: str, window: int, minimum: int, rows: bool = True) -> Callable[[WindowSpec], Column]:
    """Sample deviation over the last ``window`` positions, null below ``minimum`` known values."""
    def build(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-(window - 1), 0) if rows else w.rangeBetween(-(window - 1), 0)
        return F.when(F.count(column).over(frame) >= minimum, F.stddev_samp(column).over(frame))
    return build


def change_from(column: str, n: int, rows: bool = True) -> Callable[[WindowSpec], Column]:
    def build(w: WindowSpec) -> Column:
        before = F.lag(column, n).over(w) if rows else F.first(column).over(w.rangeBetween(-n, -n))
        return F.col(column) - before
    return build


def on_rows(df: DataFrame, layout: Layout, halo: int, outputs: Mapping[str, Callable[[WindowSpec], Column]],
            origin: str | None = None, block: int = BLOCK) -> DataFrame:
    """Frames counted in rows: holes in the series are skipped over.

    The input is read twice (rows, and row counts per block), so give it a stored table.
    """
    numbered = with_positions(df, layout, origin=origin, block=block)
    return over_blocks(numbered, layout.keys, "_pos", halo, outputs, block).drop("_pos")


def on_clock(df: DataFrame, layout: Layout, halo: int,
             outputs: Mapping[str, Callable[[WindowSpec], Column]], block: int = BLOCK) -> DataFrame:
    """Frames counted in steps of the clock: holes stay holes."""
    ticked = df.withColumn("_tick", tick(layout))
    return over_blocks(ticked, layout.keys, "_tick", halo, outputs, block).drop("_tick")
