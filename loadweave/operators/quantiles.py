"""Exact interpolated quantiles of groups of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. That is fine
for a group whose size the calendar bounds (one series, one fold), and those callers use it. For
unbounded groups the quantile is found by narrowing: a mergeable sketch brackets the wanted rank, a
histogram inside the bracket picks one thin slice, and only that slice is ranked exactly. The input
is read three times, and only sketches, slice counts and the rows of one slice are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
SLICES = 2048


def exact_quantiles(df: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[str, float]],
                    accuracy: int = ACCURACY, slices: int = SLICES, few_groups: bool = False) -> DataFrame:
    """One row per group; ``wanted`` maps an output name to (column, q). Nulls are skipped.

    Interpolation is linear between the two nearest ranks, as in ``percentile``. Set ``few_groups``
    when the number of groups is fixed by the caller (models, columns): the per-group tables are
    then broadcast, so the values need not be shuffled onto a handful of keys.
    """
    by = list(by)
    near = F.broadcast if few_groups else (lambda small: small)
    columns = sorted({c for c, _ in wanted.values()})
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns
    ]))).where(F.col("_v").isNotNull())

    # A sketch of rank error below n/accuracy, widened by three such errors on both sides.
    slack = 3.0 / accuracy
    probes = sorted({p for _, q in wanted.values() for p in (max(q - slack, 0.0), min(q + slack, 1.0))})
    sketch = long.groupBy(*by, "_c").agg(
        F.percentile_approx("_v", probes, accuracy).alias("_s"),
        F.count(F.lit(1)).alias("_total"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    )
    small = F.col("_total") <= accuracy
    targets = []
    for name, (column, q) in wanted.items():
        a, z = probes.index(max(q - slack, 0.0)), probes.index(min(q + slack, 1.0))
        position = F.lit(q) * (F.col("_total") - 1)
        targets.append(F.when(F.col("_c") == column, F.struct(
            F.lit(name).alias("_name"),
            position.alias("_pos"),
            F.when(small, F.col("_min")).otherwise(F.col("_s")[a]).alias("_lo"),
            F.when(small, F.col("_max")).otherwise(F.col("_s")[z]).alias("_hi"),
        )))
    aims = sketch.select(*by, "_c", F.inline(F.filter(F.array(*targets), lambda t: t.isNotNull())))

    width = (F.col("_hi") - F.col("_lo")) / slices
    slice_no = (
        F.when(F.col("_v") < F.col("_lo"), F.lit(-1))
        .when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(slices - 1)))
        .otherwise(F.lit(0)).cast("int")
    )
    placed = long.join(near(aims), [*by, "_c"]).where(F.col("_v") <= F.col("_hi")).withColumn("_bin", slice_no)
    tag = [*by, "_name"]
    up_to = Window.partitionBy(*tag).orderBy("_bin")  # at most slices + 1 rows per group
    chosen = (
        placed.groupBy(*tag, "_bin").agg(F.count(F.lit(1)).alias("_m"), F.max("_pos").alias("_pos"))
        .withColumn("_before", F.sum("_m").over(up_to) - F.col("_m"))
        .where((F.col("_before") <= F.ceil("_pos")) & (F.col("_before") + F.col("_m") > F.floor("_pos")))
        .select(*tag, "_bin", "_before")
    )
    inside = Window.partitionBy(*tag, "_bin").orderBy("_v")
    ranked = (
        placed.join(near(chosen), [*tag, "_bin"])
        .groupBy(*tag, "_bin", "_v")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_before").alias("_before"), F.max("_pos").alias("_pos"))
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    low, high = F.floor("_pos"), F.ceil("_pos")

    def holds(rank):
        return (F.col("_start") <= rank) & (F.col("_end") > rank)

    found = ranked.groupBy(*tag).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(high), F.col("_v"))).alias("_b"),
        F.max("_pos").alias("_pos"),
    )
    part = F.col("_pos") - F.floor("_pos")
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        (F.lit(1.0) - part) * F.col("_a") + part * F.col("_b")
    )
    # A rank outside its bracket would leave a null bound: fail loudly rather than return less.
    sure = F.when(
        F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("quantile bracket missed its rank"))
    ).otherwise(value)
    return (
        found.withColumn("_q", sure).groupBy(*by)
        .agg(*[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in wanted])
    )
