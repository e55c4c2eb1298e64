"""Out-of-fold forecasts that need no iterative fit: baselines and the linear trend; and measures.

Forecasts are rows ``(keys..., timestamp, model, fold_id, y_true, y_pred)``. A row that is in no
validation range simply is not there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.config import PEAK_SHARE, TARGET, Layout
from loadweave.functions import metrics
from loadweave.functions.scalar import is_finite
from loadweave.operators.folds import Fold, fit_by_fold, fold_roles, validation_overlaps
from loadweave.operators.quantiles import exact_quantiles

OOF = ("model", "fold_id", "y_true", "y_pred")


def oof_select(df: DataFrame, layout: Layout, model: str, pred: Column) -> DataFrame:
    return df.select(*layout.order, F.lit(model).alias("model"), "fold_id",
                     F.col(TARGET).alias("y_true"), pred.alias("y_pred"))


TREND_STATS = {
    "slope": lambda m: F.regr_slope(m(F.col(TARGET)), m(F.col("trend_idx"))),
    "intercept": lambda m: F.regr_intercept(m(F.col(TARGET)), m(F.col("trend_idx"))),
}


def fit_trend(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[fn(lambda c: c).alias(k) for k, fn in TREND_STATS.items()])


def fit_trend_by_fold(df: DataFrame, folds: Sequence[Fold], layout: Layout) -> DataFrame:
    """Least squares on the trend index for every series and fold, in one pass."""
    return fit_by_fold(df, folds, layout.keys, TREND_STATS, layout.ts)


def trend_value() -> Column:
    return F.col("slope") * F.col("trend_idx") + F.col("intercept")


SIMPLE_MODELS = {
    # model -> (fitted statistics, forecast)
    "constant": ({"mean_load": lambda m: F.avg(m(F.col(TARGET)))}, lambda: F.col("mean_load")),
    "persistence": ({}, lambda: F.col("load_lag_24")),
    "trend": (TREND_STATS, trend_value),
}


def _fitted(df: DataFrame, folds: Sequence[Fold], layout: Layout, models: Sequence[str]) -> DataFrame:
    """Validation rows of each fold beside what the models fitted on its train rows."""
    stats = {k: fn for m in models for k, fn in SIMPLE_MODELS[m][0].items()}
    val = fold_roles(df, folds, layout.ts, roles=("val",))
    if stats:
        val = val.join(fit_by_fold(df, folds, layout.keys, stats, layout.ts), [*layout.keys, "fold_id"])
    return val


def simple_wide(df: DataFrame, folds: Sequence[Fold], layout: Layout,
                models: Sequence[str] = tuple(SIMPLE_MODELS)) -> DataFrame:
    """The same forecasts as one column per model, rows that every model forecasts: a row's forecasts are
    made side by side, so nothing is shuffled to bring them together. Folds must not validate a row twice."""
    if validation_overlaps(folds):
        raise ValueError("validation ranges overlap: use oof_wide on merged forecasts")
    wide = _fitted(df, folds, layout, models).select(
        *layout.order, F.col(TARGET).alias("y_true"), *[SIMPLE_MODELS[m][1]().alias(m) for m in models])
    return wide.dropna(subset=list(models))


def simple_oof(df: DataFrame, folds: Sequence[Fold], layout: Layout,
               models: Sequence[str] = tuple(SIMPLE_MODELS)) -> DataFrame:
    """Forecasts of the models that one aggregation can fit: all folds and models in one pass."""
    val = _fitted(df, folds, layout, models)
    forecasts = F.array(*[
        F.struct(F.lit(m).alias("model"), SIMPLE_MODELS[m][1]().alias("y_pred")) for m in models])
    return val.select(*layout.order, "fold_id", F.col(TARGET).alias("y_true"), F.inline(forecasts)).select(
        *layout.order, *OOF)


def naive_baselines(df: DataFrame, folds: Sequence[Fold], layout: Layout) -> DataFrame:
    """Train mean, and the load one day earlier, on every validation row."""
    return simple_oof(df, folds, layout, ("constant", "persistence"))


def trend_oof(df: DataFrame, folds: Sequence[Fold], layout: Layout) -> DataFrame:
    """The trend half of the two-part model, alone."""
    return simple_oof(df, folds, layout, ("trend",))


def scaler_stats(columns: Sequence[str]):
    """Mean and population deviation per column, as statistics for :func:`fit_by_fold`."""
    stats = {}
    for c in columns:
        stats[f"mean_{c}"] = lambda m, c=c: F.avg(m(F.col(c)))
        stats[f"std_{c}"] = lambda m, c=c: F.stddev_pop(m(F.col(c)))
    return stats


def scaled(column: str) -> Column:
    """Standard score with the fitted statistics in scope; a constant column divides by one."""
    std = F.col(f"std_{column}")
    return (F.col(column) - F.col(f"mean_{column}")) / F.when(std == 0, 1.0).otherwise(std)


def last_fold_wins(oof: DataFrame, layout: Layout, folds: Sequence[Fold] | None = None) -> DataFrame:
    """Where validation ranges overlap, the forecast of the latest fold stands."""
    if folds is not None and not validation_overlaps(folds):
        return oof
    return oof.groupBy(*layout.order, "model").agg(
        F.max("fold_id").alias("fold_id"),
        F.max_by("y_true", "fold_id").alias("y_true"),
        F.max_by("y_pred", "fold_id").alias("y_pred"),
    )


def oof_metrics(oof: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    y, p = F.col("y_true"), F.col("y_pred")
    return oof.where(p.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), metrics.rmse(y, p).alias("rmse"), metrics.mape(y, p).alias("mape"))


def compare_models(oof: DataFrame, peak_share: float = PEAK_SHARE, by: Sequence[str] = ("model",)) -> DataFrame:
    """RMSE, MAPE and peak MAPE per model; the peak cutoff is an exact quantile of the actuals.

    ``by`` names models and folds, so the cutoffs are a table of fixed, small size.
    """
    by = list(by)
    known = oof.where(is_finite(F.col("y_pred")))
    cutoffs = exact_quantiles(known, by, {"cutoff": ("y_true", 1 - peak_share)}, few_groups=True)
    y, p = F.col("y_true"), F.col("y_pred")
    return known.join(F.broadcast(cutoffs), by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        metrics.rmse(y, p).alias("rmse"),
        metrics.mape(y, p).alias("mape"),
        metrics.peak_mape(y, p, F.col("cutoff")).alias("peak_mape"),
        F.first("cutoff").alias("cutoff"),
    )


def oof_wide(oof: DataFrame, models: Sequence[str], layout: Layout) -> DataFrame:
    """One column per model, only rows that every model forecast."""
    wide = oof.groupBy(*layout.order).agg(
        F.max("y_true").alias("y_true"),
        *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models],
    )
    return wide.dropna(subset=list(models))


def residual_correlation(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of models' residuals, in one aggregation."""
    resid = {m: F.col("y_true") - F.col(m) for m in models}
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]]
    corr = {(a, b): F.corr(resid[a], resid[b]).alias(f"c_{i}") for i, (a, b) in enumerate(pairs)}
    row = wide.agg(*corr.values(), F.count(F.lit(1)).alias("n_rows"))
    cells = []
    for a in models:
        for b in models:
            i = pairs.index((a, b) if (a, b) in pairs else (b, a))
            cells.append(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"c_{i}").alias("corr")))
    return row.select(F.inline(F.array(*cells)), "n_rows")


def prediction_accuracy(log: DataFrame, actuals: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Logged predictions against actuals that have since arrived."""
    y, p = F.col(TARGET), F.col("predicted_load_mw")
    return log.join(actuals.select(*key, TARGET), list(key), "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.count(TARGET).alias("n_actuals"),
        metrics.rmse(y, p).alias("rmse"),
        metrics.mape(y, p).alias("mape"),
    )


def compare_forecasts(a: DataFrame, b: DataFrame, key: Sequence[str], column: str, tolerance: float) -> DataFrame:
    """Largest difference between two forecasts of the same rows, and whether it is tolerable."""
    joined = a.select(*key, F.col(column).alias("_a")).join(
        b.select(*key, F.col(column).alias("_b")), list(key), "full")
    gap = F.max(F.abs(F.col("_a") - F.col("_b")))
    unmatched = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"), unmatched.alias("n_unmatched"), gap.alias("max_abs_diff"),
        ((unmatched == 0) & (F.coalesce(gap, F.lit(0.0)) <= tolerance)).alias("matches"),
    )


def blend(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(m) for m, w in weights.items()])
