"""The tables behind exploratory charts: histograms, per-feature profiles, train/test distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.functions.scalar import equal_width_bin, is_finite
from loadweave.operators.quantiles import exact_quantiles
from loadweave.session import materialise


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.StringType, T.VarcharType, T.CharType))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, min, exact quartiles and max of each column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.inline(rows))
    basic = long.groupBy("column_name").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    quarts = exact_quantiles(long, ["column_name"], {"p25": ("v", 0.25), "p50": ("v", 0.5), "p75": ("v", 0.75)},
                             few_groups=True)
    return basic.join(quarts, "column_name", "left").select(
        "column_name", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def target_histogram(df: DataFrame, column: str, n_bins: int = 100) -> DataFrame:
    """Equal-width bins, the last one closed, with the mean and deviation of the column on each row."""
    cell = F.array(F.struct(F.lit(column).alias("feature"), F.col(column).alias("v")))
    known = df.where(F.col(column).isNotNull()).select(F.inline(cell))
    stats = known.groupBy("feature").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    placed = known.join(F.broadcast(stats), "feature")  # a single row of statistics
    index = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(equal_width_bin(F.col("v"), F.col("lo"), F.col("hi"), n_bins), F.lit(n_bins - 1)))
    counts = placed.groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    bins = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    return bins.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        F.when(F.col("bin") == n_bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "mean", "std")


def _values(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, value, all its rows, those where feature and target are finite, their sum of target), stored:
    all that a profile needs of the rows, with one shuffle."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    used = is_finite(F.col("x")) & is_finite(F.col("y"))
    values = (
        df.select(F.col(target).cast("double").alias("y"), F.inline(rows)).groupBy("feature", "x")
        .agg(F.count(F.lit(1)).alias("n_all"), F.count_if(used).alias("n"), F.sum(F.when(used, F.col("y"))).alias("sum_y"))
    )
    return materialise(values, "values")


def numeric_profile(df: DataFrame, columns: Sequence[str], target: str, n_bins: int = 10,
                    value_max: int | None = 20) -> DataFrame:
    """Count and mean target per value or per bin.

    A feature with at most ``value_max`` values, or fewer than ``n_bins``, is shown per value;
    otherwise in ``n_bins`` equal bins. The largest value counts in the last bin but not in its mean.
    """
    return _shown(_values(df, columns, target), n_bins, value_max)


def _shown(values: DataFrame, n_bins: int, value_max: int | None) -> DataFrame:
    values = values.where("n > 0").drop("n_all")
    stats = values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_used"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    per_value = F.col("n_used") < n_bins
    if value_max is not None:
        per_value = (F.col("n_used") <= value_max) | per_value
    mode = F.when(per_value, F.lit("value")).otherwise(F.lit("histogram"))
    placed = values.join(F.broadcast(stats.withColumn("mode", mode)), "feature")  # a row per feature
    shown = placed.where(F.col("mode") == "value").select(
        "feature", "mode", F.col("x").alias("bin_lo"), F.col("x").alias("bin_hi"),
        F.col("n").alias("n_rows"), (F.col("sum_y") / F.col("n")).alias("mean_target"))

    raw = equal_width_bin(F.col("x"), F.col("lo"), F.col("hi"), n_bins)
    inner = raw < n_bins
    counts = (
        placed.where(F.col("mode") == "histogram")
        .select("feature", F.least(raw, F.lit(n_bins - 1)).cast("int").alias("bin"), "n",
                F.when(inner, F.col("n")).alias("n_in"), F.when(inner, F.col("sum_y")).alias("y_in"))
        .groupBy("feature", "bin")
        .agg(F.sum("n").alias("n_rows"), (F.sum("y_in") / F.sum("n_in")).alias("mean_target"))
    )
    width = (F.col("hi") - F.col("lo")) / n_bins
    bins = stats.withColumn("mode", mode).where(F.col("mode") == "histogram").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    binned = bins.join(counts, ["feature", "bin"], "left").select(
        "feature", "mode", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        F.when(F.col("bin") == n_bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "mean_target")
    return shown.unionByName(binned)


def category_profile(df: DataFrame, column: str, target: str, order: Sequence[str] | None = None) -> DataFrame:
    """Count and mean target per category, sorted by the given order, then by count; else by name.

    ``preferred`` is the place in the given order, or one past its end.
    """
    groups = df.where(F.col(column).isNotNull() & F.col(target).isNotNull()).groupBy(
        F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(target).alias("mean_target"))
    if not order:
        return groups.withColumn("preferred", F.lit(1)).orderBy("category")
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category"))
    ranked = groups.withColumn("preferred", F.when(place > 0, place).otherwise(F.lit(len(order) + 1)).cast("int"))
    return ranked.orderBy("preferred", F.col("n_rows").desc(), "category")


def feature_profile(df: DataFrame, columns: Sequence[str], target: str, n_bins: int = 10,
                    value_max: int | None = 20, order: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Long profile of numeric and text features, with their distinct and null counts."""
    numeric = [c for c in columns if not is_text(df, c)]
    text = [c for c in columns if is_text(df, c)]
    parts, counts = [], []
    if numeric:
        values = _values(df, numeric, target)
        parts.append(_shown(values, n_bins, value_max).withColumn("category", F.lit(None).cast("string")))
        counts.append(_counts(values, "x", "n_all"))
    if text:
        counts.append(column_counts(df, text))
    for c in text:
        parts.append(category_profile(df, c, target, (order or {}).get(c)).select(
            F.lit(c).alias("feature"), F.lit("category").alias("mode"),
            F.lit(None).cast("double").alias("bin_lo"), F.lit(None).cast("double").alias("bin_hi"),
            "n_rows", "mean_target", "category"))
    return reduce(DataFrame.unionByName, parts).join(reduce(DataFrame.unionByName, counts), "feature")


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values, as text, and nulls per column, counted over pre-aggregated values."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns])
    return _counts(df.select(F.inline(rows)).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")), "v", "n")


def _counts(values: DataFrame, value: str, n: str) -> DataFrame:
    return values.groupBy("feature").agg(
        F.count(value).alias("n_unique"),
        F.coalesce(F.sum(F.when(F.col(value).isNull(), F.col(n))), F.lit(0)).alias("n_null"))


def train_test_distribution(train: DataFrame, test: DataFrame, columns: Sequence[str], n_bins: int = 20) -> DataFrame:
    """Counts of both splits over shared bins, or over the union of categories. Columns that either
    split lacks are skipped."""
    shared = [c for c in columns if c in train.columns and c in test.columns]
    numeric = [c for c in shared if not is_text(train, c)]
    text = [c for c in shared if is_text(train, c)]

    def long(df: DataFrame, mark: int, cols: Sequence[str], kind: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("v")) for c in cols])
        return df.select(F.lit(mark).alias("in_test"), F.inline(rows)).where(F.col("v").isNotNull())

    def both(cols: Sequence[str], kind: str) -> DataFrame:
        return long(train, 0, cols, kind).unionByName(long(test, 1, cols, kind))

    per_split = [F.count_if(F.col("in_test") == 0).alias("n_train"), F.count_if(F.col("in_test") == 1).alias("n_test")]

    parts = []
    if numeric:
        values = both(numeric, "double")
        stats = values.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        flat = F.col("hi") == F.col("lo")
        index = F.when(flat, F.lit(0)).otherwise(
            F.least(equal_width_bin(F.col("v"), F.col("lo"), F.col("hi"), n_bins), F.lit(n_bins - 1)))
        counts = values.join(F.broadcast(stats), "feature").groupBy("feature", index.cast("int").alias("bin")).agg(*per_split)
        last = F.when(flat, F.lit(0)).otherwise(F.lit(n_bins - 1))
        spine = stats.select("feature", "lo", "hi", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
        width = (F.col("hi") - F.col("lo")) / n_bins
        parts.append(spine.join(counts, ["feature", "bin"], "left").select(
            "feature", F.lit(None).cast("string").alias("category"), "bin",
            (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
            F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("n_test", F.lit(0)).alias("n_test")))
    if text:
        parts.append(both(text, "string").groupBy("feature", "v").agg(*per_split).select(
            "feature", F.col("v").alias("category"), F.lit(None).cast("int").alias("bin"),
            F.lit(None).cast("double").alias("bin_lo"), "n_train", "n_test"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
