"""Queries over folds, fitted statistics, forecasts, ensembles and models."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.catalog.ctes import sql
from loadweave.catalog.registry import query, rounded
from loadweave.catalog.tables import FOLDS, daily
from loadweave.config import DAILY, FEATURES, FEATURES_V3
from loadweave.functions import metrics
from loadweave.operators import ensemble, features as feat, folds, forecast
from loadweave.plans import experiment as lab
from loadweave.session import materialise, scratch_path
from loadweave.sources.sinks import log_run

KEYS = list(DAILY.keys)
ON = [*KEYS, "fold_id"]
MODELS = ["constant", "persistence", "trend"]
FLAGS = ["is_extreme_heat_event", "is_extreme_cold_event", "is_holiday_x_extreme", "is_high_precip_event"]


def train_rows(spark, sf) -> DataFrame:
    return daily(spark, sf).train


def naive_and_trend(train: DataFrame) -> DataFrame:
    return forecast.simple_oof(train, FOLDS, DAILY)


@query("fold_sizes", sql(
    "select fold_id, 'train' as role, count(*) as n_rows, min(timestamp) as first_ts, max(timestamp) as last_ts from ftrain group by 1 "
    "union all select fold_id, 'val', count(*), min(timestamp), max(timestamp) from fval group by 1", "ftrain", "fval", "hol"))
def fold_sizes(spark, sf):
    return folds.fold_sizes(train_rows(spark, sf), FOLDS)


@query("fold_roles", sql(
    "select series_id, timestamp, fold_id, 'train' as role from ftrain union all "
    "select series_id, timestamp, fold_id, 'val' from fval", "ftrain", "fval", "hol"))
def fold_roles(spark, sf):
    return folds.fold_roles(train_rows(spark, sf).select("series_id", "timestamp"), FOLDS)


@query("fold_thresholds", sql(
    "select series_id, fold_id, round(heat, 6) as heat, round(cold, 6) as cold, round(precip, 6) as precip from fthr",
    "fthr", "hol"))
def fold_thresholds(spark, sf):
    fits = folds.fit_by_fold(train_rows(spark, sf), FOLDS, KEYS, feat.threshold_stats())
    return rounded(fits, 6, "heat", "cold", "precip")


@query("extreme_flags", sql(
    "select v.series_id, v.timestamp, v.fold_id, coalesce(cast(tmax > heat as int), 0) as is_extreme_heat_event, "
    "coalesce(cast(tmin < cold as int), 0) as is_extreme_cold_event, is_holiday * greatest(coalesce(cast(tmax > heat as int), 0), "
    "coalesce(cast(tmin < cold as int), 0)) as is_holiday_x_extreme, coalesce(cast(precip_mm > precip as int), 0) as is_high_precip_event "
    "from fval v join fthr t on t.series_id = v.series_id and t.fold_id = v.fold_id", "fval", "fthr", "hol"))
def extreme_flags(spark, sf):
    train = train_rows(spark, sf)
    val = folds.fold_roles(train, FOLDS, roles=("val",))
    out = feat.apply_fold_features(val, train, FOLDS, KEYS, [feat.EXTREME_EVENTS])
    return out.select("series_id", "timestamp", "fold_id", *FLAGS)


_FREQ = ("fq as (select series_id, fold_id, holiday_name, count(*)::double / sum(count(*)) over (partition by series_id, fold_id) "
         "as holiday_freq from ftrain where holiday_name is not null group by 1, 2, 3) ")


@query("holiday_freq_map", sql(
    _FREQ + "select series_id, fold_id, holiday_name, round(holiday_freq, 9) as holiday_freq from fq", "ftrain", "hol"
).replace(") fq as", "), fq as"))
def holiday_freq_map(spark, sf):
    return rounded(feat.fit_holiday_freq_by_fold(train_rows(spark, sf), FOLDS, KEYS), 9, "holiday_freq")


@query("holiday_freq_feature", sql(
    _FREQ + "select v.series_id, timestamp, v.fold_id, round(coalesce(holiday_freq, 0.0), 9) as holiday_freq from fval v "
    "left join fq on fq.series_id = v.series_id and fq.fold_id = v.fold_id and fq.holiday_name = v.holiday_name", "ftrain", "fval", "hol"
).replace(") fq as", "), fq as"))
def holiday_freq_feature(spark, sf):
    train = train_rows(spark, sf)
    val = folds.fold_roles(train, FOLDS, roles=("val",))
    out = feat.apply_fold_features(val, train, FOLDS, KEYS, [feat.HOLIDAY_FREQ])
    return rounded(out.select("series_id", "timestamp", "fold_id", "holiday_freq"), 9, "holiday_freq")


@query("fold_feature_chain", sql(
    _FREQ + "select v.series_id, v.timestamp, v.fold_id, coalesce(cast(tmax > heat as int), 0) as is_extreme_heat_event, "
    "round(coalesce(holiday_freq, 0.0), 9) as holiday_freq from fval v join fthr t on t.series_id = v.series_id and t.fold_id = v.fold_id "
    "left join fq on fq.series_id = v.series_id and fq.fold_id = v.fold_id and fq.holiday_name = v.holiday_name", "ftrain", "fval", "fthr", "hol"
).replace(") fq as", "), fq as"))
def fold_feature_chain(spark, sf):
    """Two fitted features, one behind the other, on the validation rows of the bit-masked fold table."""
    table = lab.prepare_folds(train_rows(spark, sf), FOLDS, DAILY, ["is_extreme_heat_event", "holiday_freq"],
                              [feat.EXTREME_EVENTS, feat.HOLIDAY_FREQ], trend=False)
    rows = reduce(DataFrame.unionByName, [table.part(f, "val") for f in FOLDS])
    return rounded(rows.select(*DAILY.order, "fold_id", F.col("is_extreme_heat_event").cast("int").alias("is_extreme_heat_event"),
                               "holiday_freq"), 9, "holiday_freq")


SCALED = ["temp_c", "humidity_pct", "load_lag_24", "load_lag_168", "dayofweek"]
_STATS = "st as (select series_id, fold_id, " + ", ".join(
    f"avg({c}) as mean_{c}, stddev_pop({c}) as std_{c}" for c in SCALED) + " from ftrain group by 1, 2) "


@query("fold_scaler_stats", sql(
    _STATS + "select series_id, fold_id, " + ", ".join(f"round(mean_{c}, 4) as mean_{c}, round(std_{c}, 4) as std_{c}" for c in SCALED)
    + " from st", "ftrain", "hol").replace(") st as", "), st as"))
def fold_scaler_stats(spark, sf):
    fits = folds.fit_by_fold(train_rows(spark, sf), FOLDS, KEYS, forecast.scaler_stats(SCALED))
    return rounded(fits, 4, *[f"{s}_{c}" for c in SCALED for s in ("mean", "std")])


@query("scaled_features", sql(
    _STATS + "select v.series_id, timestamp, v.fold_id, " + ", ".join(
        f"round(({c} - mean_{c}) / case when std_{c} = 0 then 1 else std_{c} end, 6) as {c}" for c in SCALED)
    + " from fval v join st on st.series_id = v.series_id and st.fold_id = v.fold_id", "ftrain", "fval", "hol").replace(") st as", "), st as"))
def scaled_features(spark, sf):
    train = train_rows(spark, sf)
    fits = folds.fit_by_fold(train, FOLDS, KEYS, forecast.scaler_stats(SCALED))
    val = folds.fold_roles(train, FOLDS, roles=("val",)).join(fits, ON)
    return val.select("series_id", "timestamp", "fold_id", *[F.round(forecast.scaled(c), 6).alias(c) for c in SCALED])


_OOF = "select series_id, timestamp, model, fold_id, y_true, round(y_pred, 4) as y_pred from oof"


@query("naive_baselines_oof", sql(_OOF + " where model <> 'trend'", "oof", "hol"))
def naive_baselines_oof(spark, sf):
    return rounded(forecast.naive_baselines(train_rows(spark, sf), FOLDS, DAILY), 4, "y_pred")


@query("trend_fit", sql(
    "select series_id, fold_id, round(slope, 3) as slope, round(intercept, 3) as intercept from ftrend", "ftrend", "hol"))
def trend_fit(spark, sf):
    return rounded(forecast.fit_trend_by_fold(train_rows(spark, sf), FOLDS, DAILY), 3, "slope", "intercept")


@query("trend_oof", sql(_OOF + " where model = 'trend'", "oof", "hol"))
def trend_oof(spark, sf):
    return rounded(forecast.trend_oof(train_rows(spark, sf), FOLDS, DAILY), 4, "y_pred")


@query("overlapping_folds_oof", sql(
    "select v.series_id, timestamp, 'trend' as model, cast(max(v.fold_id) as int) as fold_id, any_value(actual_load_mw) as y_true, "
    "round(arg_max(slope * trend_idx + intercept, v.fold_id), 4) as y_pred from (select t.*, fold_id from dtrain t join folds "
    "on timestamp between val_start and val_end + interval 180 day) v join ftrend r on r.series_id = v.series_id "
    "and r.fold_id = v.fold_id group by 1, 2", "dtrain", "folds", "ftrend", "hol"))
def overlapping_folds_oof(spark, sf):
    """Validation ranges that run into the next fold: the later fold's forecast stands."""
    longer = [replace(f, val_end=f.val_end + timedelta(days=180)) for f in FOLDS]
    oof = forecast.trend_oof(train_rows(spark, sf), longer, DAILY)
    return rounded(forecast.last_fold_wins(oof, DAILY, longer), 4, "y_pred")


_METRICS = ("count(*) as n_rows, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 4) as rmse, "
            "round(avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) * 100, 6) as mape")


@query("baseline_metrics", sql(f"select model, fold_id, {_METRICS} from oof group by 1, 2", "oof", "hol"))
def baseline_metrics(spark, sf):
    out = forecast.oof_metrics(naive_and_trend(train_rows(spark, sf)), ("model", "fold_id"))
    return rounded(rounded(out, 4, "rmse"), 6, "mape")


_CUT = "cut as (select model, quantile_cont(y_true, 0.95) as cutoff from oof group by 1) "
_PEAK = "round(avg(case when y_true >= cutoff then abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16) end) * 100, 6)"


@query("model_comparison", sql(
    _CUT + f"select oof.model, {_METRICS}, {_PEAK} as peak_mape, round(any_value(cutoff), 4) as cutoff from oof "
    "join cut on cut.model = oof.model group by 1", "oof", "hol").replace(") cut as", "), cut as"))
def model_comparison(spark, sf):
    oof = materialise(naive_and_trend(train_rows(spark, sf)), "oof")
    out = forecast.compare_models(oof).orderBy("peak_mape")
    return rounded(rounded(out, 4, "rmse", "cutoff"), 6, "mape", "peak_mape")


@query("best_model", sql(
    "select arg_min(model, rmse) as best, round(min(rmse), 4) as rmse from (select model, "
    "sqrt(avg((y_true - y_pred) * (y_true - y_pred))) as rmse from oof group by 1)", "oof", "hol"))
def best_model(spark, sf):
    out = forecast.oof_metrics(naive_and_trend(train_rows(spark, sf)))
    return out.agg(F.min_by("model", "rmse").alias("best"), F.round(F.min("rmse"), 4).alias("rmse"))


@query("residual_corr", sql(
    "select model_a, model_b, round(c, 6) as corr, n_rows from (select count(*) as n_rows, " + ", ".join(
        f"corr(y_true - {a}, y_true - {b}) as c{i}{j}" for i, a in enumerate(MODELS) for j, b in enumerate(MODELS))
    + " from oofw), lateral (values " + ", ".join(
        f"('{a}', '{b}', c{i}{j})" for i, a in enumerate(MODELS) for j, b in enumerate(MODELS)) + ") v(model_a, model_b, c)",
    "oofw", "hol"))
def residual_corr(spark, sf):
    wide = forecast.simple_wide(train_rows(spark, sf), FOLDS, DAILY, MODELS)
    return rounded(forecast.residual_correlation(wide, MODELS), 6, "corr")


_TRI = [(i, j) for i in range(3) for j in range(i, 3)]


@query("error_gram", sql(
    "select model_a, model_b, round(s / n_rows / 1e6, 4) as mean_ee, n_rows from (select count(*) as n_rows, " + ", ".join(
        f"sum(({MODELS[i]} - y_true) * ({MODELS[j]} - y_true)) as s{i}{j}" for i, j in _TRI)
    + " from oofw), lateral (values " + ", ".join(f"('{MODELS[i]}', '{MODELS[j]}', s{i}{j})" for i, j in _TRI)
    + ") v(model_a, model_b, s)", "oofw", "hol"))
def error_gram(spark, sf):
    wide = forecast.simple_wide(train_rows(spark, sf), FOLDS, DAILY, MODELS)
    out = ensemble.error_gram(wide, MODELS)
    return out.select("model_a", "model_b", F.round(F.col("sum_ee") / F.col("n_rows") / 1e6, 4).alias("mean_ee"), "n_rows")


@query("ensemble_blend", sql(
    "select series_id, timestamp, y_true, round(0.2 * constant + 0.3 * persistence + 0.5 * trend, 4) as y_pred from oofw", "oofw", "hol"))
def ensemble_blend(spark, sf):
    wide = forecast.simple_wide(train_rows(spark, sf), FOLDS, DAILY, MODELS)
    mix = forecast.blend({"constant": 0.2, "persistence": 0.3, "trend": 0.5})
    return wide.select("series_id", "timestamp", "y_true", F.round(mix, 4).alias("y_pred"))


def _weights(spark, ens: ensemble.Ensemble) -> DataFrame:
    rows = [(m, float(w), float(ens.solo[m]), float(ens.score)) for m, w in ens.weights.items()]
    out = spark.createDataFrame(rows, "model string, weight double, solo_rmse double, score double")
    return rounded(out, 4, "weight", "solo_rmse", "score")


def _mix_rmse(w0: str, w1: str, w2: str) -> str:
    w = (w0, w1, w2)
    terms = " + ".join(f"{1 if i == j else 2} * ({w[i]}) * ({w[j]}) * s{i}{j}" for i, j in _TRI)
    return f"sqrt(greatest({terms}, 0) / n)"


_SOLO = ("e as (select count(*) as n, " + ", ".join(
    f"sum(({MODELS[i]} - y_true) * ({MODELS[j]} - y_true)) as s{i}{j}" for i, j in _TRI) + " from oofw), "
    "v(i, name, c0, c1, c2) as (values " + ", ".join(
        f"({i}, '{m}', {', '.join(str(float(i == j)) + '::double' for j in range(3))})" for i, m in enumerate(MODELS)) + "), "
    f"solo as (select v.*, {_mix_rmse('c0', 'c1', 'c2')} as r from v, e), "
    "opening as (select * from solo order by r, i limit 1), ")
_VOTED = "(s.c{0} * s.k + v.c{0}) / (s.k + 1)"
_VOTE = _SOLO + (
    "steps as (select 1 as k, c0, c1, c2, r from opening union all select k, c0, c1, c2, r from (select *, row_number() over (order by r, i) as rn "
    "from (select s.k + 1 as k, " + ", ".join(f"{_VOTED.format(j)} as c{j}" for j in range(3)) + f", {_mix_rmse(*map(_VOTED.format, range(3)))} as r, "
    "s.r as was, v.i from steps s, e, v where s.k <= 50)) where rn = 1 and r < was - 1e-6), "
    "last as (select * from steps order by k desc limit 1) ")
_MIXED = "(1 - a) * s.c{0} + a * v.c{0}"
_ALPHA = _SOLO + (
    "steps as (select 1 as k, c0, c1, c2, r from opening union all select k, c0, c1, c2, r from (select *, row_number() over (order by r, i, a) as rn "
    "from (select s.k + 1 as k, " + ", ".join(f"{_MIXED.format(j)} as c{j}" for j in range(3)) + f", {_mix_rmse(*map(_MIXED.format, range(3)))} as r, "
    "s.r as was, v.i, a from steps s, e, v, (select -1 + g * 0.01::double as a from range(201) t(g)))) "
    "where rn = 1 and was - r >= 1e-6), last as (select * from steps order by k desc limit 1) ")
_WEIGHT = "case i when 0 then last.c0 when 1 then last.c1 else last.c2 end"
_WEIGHTS = (f"select name as model, round({_WEIGHT}, 4) as weight, round(solo.r, 4) as solo_rmse, round(last.r, 4) as score "
            f"from solo, last where {_WEIGHT} <> 0")


def _searched(parts: str, body: str, *more: str) -> str:
    return sql(", " + parts + body, "oofw", "hol", *more).replace(") , e as", "), e as").replace("with ", "with recursive ", 1)


@query("alpha_scores", sql(
    "select a / 10.0::double as alpha, round(sqrt(avg(pow(y_true - ((1 - a / 10.0::double) * trend + a / 10.0::double * persistence), 2))), 4) as rmse, "
    "round(avg(abs(y_true - ((1 - a / 10.0::double) * trend + a / 10.0::double * persistence))), 4) as mae from oofw, range(11) t(a) group by 1",
    "oofw", "hol"))
def alpha_scores(spark, sf):
    """Two measures of every mix of two models, each measure in one aggregation."""
    wide = materialise(forecast.simple_wide(train_rows(spark, sf), FOLDS, DAILY, MODELS), "wide")
    shares = [i / 10 for i in range(11)]
    mixes = [{"trend": 1 - a, "persistence": a} for a in shares]
    scores = zip(shares, ensemble.spark_scorer(wide, metrics.rmse)(mixes), ensemble.spark_scorer(wide, metrics.mae)(mixes))
    return rounded(spark.createDataFrame(list(scores), "alpha double, rmse double, mae double"), 4, "rmse", "mae")


@query("hill_climb_vote", _searched(_VOTE, _WEIGHTS))
def hill_climb_vote(spark, sf):
    """Equal-vote ensemble found from the error matrix."""
    wide = forecast.simple_wide(train_rows(spark, sf), FOLDS, DAILY, MODELS)
    return _weights(spark, ensemble.vote_ensemble(ensemble.Gram.collect(wide, MODELS)))


@query("hill_climb_alpha", _searched(_ALPHA, _WEIGHTS))
def hill_climb_alpha(spark, sf):
    """Share-by-share ensemble found from the error matrix, negative weights allowed."""
    wide = forecast.simple_wide(train_rows(spark, sf), FOLDS, DAILY, MODELS)
    gram = ensemble.Gram.collect(wide, MODELS)
    return _weights(spark, ensemble.blend_ensemble(ensemble.gram_scorer(gram), MODELS, negative_weights=True))


@query("hill_climb_oof", _searched(_VOTE, "select series_id, timestamp, y_true, round(last.c0 * constant + last.c1 * persistence + "
                                   "last.c2 * trend, 4) as y_pred from oofw, last"))
def hill_climb_oof(spark, sf):
    """Out-of-fold forecasts of the mix that the vote search finds."""
    wide = materialise(forecast.simple_wide(train_rows(spark, sf), FOLDS, DAILY, MODELS), "wide")
    found = ensemble.vote_ensemble(ensemble.Gram.collect(wide, MODELS))
    return wide.select("series_id", "timestamp", "y_true", F.round(found.column(), 4).alias("y_pred"))


_PEAK_ERROR = "avg(abs(y_true - (c0 * constant + c1 * persistence + c2 * trend))) as r"
_PEAK = (
    "pk as materialized (select * from oofw where y_true >= (select quantile_cont(y_true, 1 - 0.1::double) from oofw)), "
    "v(i, name, c0, c1, c2) as (values " + ", ".join(
        f"({i}, '{m}', {', '.join(str(float(i == j)) + '::double' for j in range(3))})" for i, m in enumerate(MODELS)) + "), "
    f"solo as (select i, c0, c1, c2, {_PEAK_ERROR} from v, pk group by all), opening as (select * from solo order by r, i limit 1), "
    "steps as (select 1 as k, c0, c1, c2, r from opening union all select k, c0, c1, c2, r from (select *, row_number() over (order by r, i, a) as rn "
    f"from (select k, c0, c1, c2, was, i, a, {_PEAK_ERROR} from (select s.k + 1 as k, " + ", ".join(
        f"{_MIXED.format(j)} as c{j}" for j in range(3)) + ", s.r as was, v.i, a from steps s, v, (select g / 20.0::double as a from range(21) t(g))), pk "
    "group by all)) where rn = 1 and was - r >= 1e-6), last as (select * from steps order by k desc limit 1) ")
_BLENDED = "round(last.c0 * {} + last.c1 * {} + last.c2 * {}, 4) as y_pred"


@query("hill_climb_peak", _searched(
    _PEAK, "select 'oof' as part, series_id, timestamp, y_true, " + _BLENDED.format("constant", "persistence", "trend") + " from oofw, last "
    "union all select 'test', t.series_id, timestamp, actual_load_mw, " + _BLENDED.format("s.mean_load", "load_lag_24", "(s.slope * trend_idx + s.intercept)")
    + " from dtest t join (select series_id, avg(actual_load_mw) as mean_load, regr_slope(actual_load_mw, trend_idx) as slope, "
    "regr_intercept(actual_load_mw, trend_idx) as intercept from dtrain group by 1) s on s.series_id = t.series_id, last", "dtest"
    ).replace(") , pk as", "), pk as"))
def hill_climb_peak(spark, sf):
    """The mix with the least mean error on peak rows: its forecasts out of fold, and of the test rows by models fitted on all train rows."""
    d = daily(spark, sf)
    wide = materialise(forecast.simple_wide(d.train, FOLDS, DAILY, MODELS), "wide")
    score = ensemble.mix_scorer(ensemble.peak_rows(wide, 0.1), MODELS, lambda y, p: F.abs(y - p))
    found = ensemble.blend_ensemble(score, MODELS, alphas=[i / 20 for i in range(21)])
    last = folds.Fold(0, datetime(1900, 1, 1), d.split.train_end, d.split.test_start, datetime(9999, 1, 1))
    final = forecast.simple_wide(d.train.unionByName(d.test), [last], DAILY, MODELS)
    parts = [df.select(F.lit(part).alias("part"), "series_id", "timestamp", "y_true", F.round(found.column(), 4).alias("y_pred"))
             for part, df in (("oof", wide), ("test", final))]
    return parts[0].unionByName(parts[1])


_KNN_X = " + ".join(
    f"pow((v.{c} - mean_{c}) / case when std_{c} = 0 then 1 else std_{c} end - (t.{c} - mean_{c}) / case when std_{c} = 0 then 1 else std_{c} end, 2)"
    for c in SCALED)


@query("knn_residual", sql(
    _STATS + ", pairs as (select v.series_id, v.fold_id, v.timestamp, v.actual_load_mw as y_true, v.trend_idx as tv, "
    f"sqrt({_KNN_X}) as d, t.actual_load_mw - (slope * t.trend_idx + intercept) as res, slope, intercept, t.timestamp as tt "
    "from fval v join ftrain t on t.series_id = v.series_id and t.fold_id = v.fold_id join st on st.series_id = v.series_id "
    "and st.fold_id = v.fold_id join ftrend r on r.series_id = v.series_id and r.fold_id = v.fold_id), "
    "near as (select * from pairs qualify row_number() over (partition by series_id, fold_id, timestamp order by d, tt) <= 15) "
    "select series_id, timestamp, 'knn' as model, fold_id, y_true, round(any_value(slope * tv + intercept) + "
    "coalesce(avg(res) filter (where d = 0), sum(res / d) filter (where d > 0) / sum(1 / d) filter (where d > 0)), 3) as y_pred "
    "from near group by series_id, timestamp, fold_id, y_true", "ftrain", "fval", "ftrend", "hol").replace(") st as", "), st as"))
def knn_residual(spark, sf):
    """Trend plus the residuals of the 15 nearest train rows, for all folds at once."""
    table = lab.prepare_folds(train_rows(spark, sf), FOLDS, DAILY, SCALED, scale=True)
    return rounded(lab.knn_cross_validate(table, "knn", 15), 3, "y_pred")


@query("knn_hashed_recall", sql(
    "n as (select series_id, fold_id, count(*) as n_train from ftrain group by all) "
    "select v.series_id, v.fold_id, count(*) as n_queries, cast(sum(least(15, n_train)) as bigint) as n_neighbours, true as enough "
    "from fval v join n on n.series_id = v.series_id and n.fold_id = v.fold_id group by all", "ftrain", "fval", "hol").replace(") n as", "), n as"))
def knn_hashed_recall(spark, sf):
    """Neighbours by random projections beside the exact ones: at least nine in ten are found in every series and fold."""
    table = lab.prepare_folds(train_rows(spark, sf), FOLDS, DAILY, SCALED, scale=True)
    return lab.knn_recall(table, 15, leaf=128).withColumn("enough", F.col("recall") >= 0.9).drop("recall")


@query("linear_residual_cv", sql(
    _STATS + ", z as (select t.series_id, t.fold_id, t.timestamp, (load_lag_168 - mean_load_lag_168) / std_load_lag_168 as z, "
    "actual_load_mw - (slope * trend_idx + intercept) as res from ftrain t join st on st.series_id = t.series_id and st.fold_id = t.fold_id "
    "join ftrend r on r.series_id = t.series_id and r.fold_id = t.fold_id), "
    "b as (select fold_id, regr_slope(res, z) as b1, regr_intercept(res, z) as b0 from z group by 1) "
    "select v.series_id, v.timestamp, 'linear' as model, v.fold_id, actual_load_mw as y_true, round(slope * trend_idx + intercept + b0 + "
    "b1 * (load_lag_168 - mean_load_lag_168) / std_load_lag_168, 2) as y_pred from fval v join st on st.series_id = v.series_id and "
    "st.fold_id = v.fold_id join ftrend r on r.series_id = v.series_id and r.fold_id = v.fold_id join b on b.fold_id = v.fold_id",
    "ftrain", "fval", "ftrend", "hol").replace(") st as", "), st as"))
def linear_residual_cv(spark, sf):
    """Trend plus a linear model of the residual, fitted per fold by Spark ML."""
    table = lab.prepare_folds(train_rows(spark, sf), FOLDS, DAILY, ["load_lag_168"], scale=True)
    return rounded(lab.cross_validate(table, lab.linear_model, "linear"), 2, "y_pred")


@query("run_log", sql(f"select model as run_name, {_METRICS} from oof group by 1", "oof", "hol"))
def run_log(spark, sf):
    """One appended record per model, read back."""
    path = scratch_path(spark, "runs")
    for m in forecast.oof_metrics(naive_and_trend(train_rows(spark, sf))).collect():  # one row per model
        log_run(spark, path, m["model"], {"features": "none"}, {k: m[k] for k in ("n_rows", "rmse", "mape")})
    value = lambda k: F.col("metrics")[k]
    return spark.read.parquet(path).select("run_name", value("n_rows").cast("long").alias("n_rows"),
                                           F.round(value("rmse"), 4).alias("rmse"), F.round(value("mape"), 6).alias("mape"))


# --- Models and searches whose numbers SQL can give: linear in one or two features ---------------
_RES = ("b as (select fold_id, regr_slope(actual_load_mw, load_lag_168) as b1, regr_intercept(actual_load_mw, load_lag_168) as b0 "
        "from ftrain group by 1) ")


@query("linear_raw_cv", sql(
    _RES + "select v.series_id, v.timestamp, 'linear' as model, v.fold_id, actual_load_mw as y_true, round(b0 + b1 * load_lag_168, 2) as y_pred "
    "from fval v join b on b.fold_id = v.fold_id", "ftrain", "fval", "hol").replace(") b as", "), b as"))
def linear_raw_cv(spark, sf):
    """A linear model of the load itself, without trend or scale, fitted per fold."""
    table = lab.prepare_folds(train_rows(spark, sf), FOLDS, DAILY, ["load_lag_168"], trend=False)
    return rounded(lab.cross_validate(table, lab.linear_model, "linear"), 2, "y_pred")


@query("fold_details", sql(
    "select series_id, timestamp, (timezone('America/Chicago', timezone('UTC', timestamp))) as timestamp_central, model, fold_id, y_true, "
    "round(y_pred, 4) as y_pred, round(y_true - y_pred, 4) as residual from oof where model = 'trend'", "oof", "hol"))
def fold_details(spark, sf):
    """Residual and local time of every validated row."""
    return rounded(lab.fold_details(forecast.trend_oof(train_rows(spark, sf), FOLDS, DAILY)), 4, "y_pred", "residual")


_BOOSTED = ("gbt_a", "gbt_b", "gbt_c")

SINGLES = ["load_lag_168", "load_lag_24", "temp_c", "humidity_pct"]
_ONE = ", ".join(f"regr_slope(res, {c}) as s_{c}, regr_intercept(res, {c}) as i_{c}" for c in SINGLES)
_TRAIN_RES = ("z as (select t.*, actual_load_mw - (slope * trend_idx + intercept) as res from ftrain t join ftrend r on r.series_id = t.series_id "
              "and r.fold_id = t.fold_id), ")
_VAL_RES = ("v as (select t.*, actual_load_mw - (slope * trend_idx + intercept) as res from fval t join ftrend r on r.series_id = t.series_id "
            "and r.fold_id = t.fold_id) ")


@query("tuned_models", sql(
    _TRAIN_RES + f"b as (select fold_id, {_ONE} from z group by 1), " + _VAL_RES + "select model, round(rmse, 3) as tuned_oof_rmse, "
    "cast(row_number() over (order by rmse) as int) as place from (select " + ", ".join(
        f"sqrt(avg(pow(res - (i_{c} + s_{c} * {c}), 2))) as {c}" for c in SINGLES)
    + " from v join b on b.fold_id = v.fold_id) w, lateral (values " + ", ".join(f"('{c}', w.{c})" for c in SINGLES) + ") m(model, rmse)",
    "ftrain", "fval", "ftrend", "hol").replace(") z as", "), z as"))
def tuned_models(spark, sf):
    """Studies side by side, the best first: trend plus a linear model in one feature each."""
    train = train_rows(spark, sf)
    studies = []
    for c in SINGLES:
        table = lab.prepare_folds(train, FOLDS, DAILY, [c])
        studies.append(replace(lab.random_search(table, "linear", 1), family=c))
    return rounded(lab.tuned_comparison(spark, studies).drop("params"), 3, "tuned_oof_rmse")


_X = ("x as (select z.*, coalesce(holiday_freq, 0.0) as hf from z left join fq on fq.series_id = z.series_id and fq.fold_id = z.fold_id "
      "and fq.holiday_name = z.holiday_name), "
      "c as (select fold_id, covar_pop(load_lag_168, res) as ay, covar_pop(hf, res) as by_, covar_pop(load_lag_168, hf) as ab, "
      "var_pop(load_lag_168) as aa, var_pop(hf) as bb, avg(load_lag_168) as ma, avg(hf) as mb, avg(res) as my from x group by 1), "
      "k as (select *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as ka, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as kb, "
      "ay / aa as k1 from c), ")


@query("linear_champion", sql(
    _TRAIN_RES + _FREQ.rstrip() + ", " + _X + _VAL_RES.rstrip() + ", w as (select v.*, coalesce(holiday_freq, 0.0) as hf from v left join fq "
    "on fq.series_id = v.series_id and fq.fold_id = v.fold_id and fq.holiday_name = v.holiday_name) "
    "select 'linear' as family, round(a, 3) as cv_rmse, round(h, 3) as holiday_rmse, h < a as use_holiday from (select "
    "sqrt(avg(pow(res - (my + k1 * (load_lag_168 - ma)), 2))) as a, sqrt(avg(pow(res - (my + ka * (load_lag_168 - ma) + kb * (hf - mb)), 2))) as h "
    "from w join k on k.fold_id = w.fold_id)", "ftrain", "fval", "ftrend", "hol").replace(") z as", "), z as"))
def linear_champion(spark, sf):
    """The search's choice of family, and whether the holiday feature lowers its error."""
    train = train_rows(spark, sf)
    table = lab.prepare_folds(train, FOLDS, DAILY, ["load_lag_168"])
    best = lab.choose_champion([lab.random_search(table, "linear", 1)], train, FOLDS, DAILY, ["load_lag_168"], chain=())
    return spark.createDataFrame([(best.family, round(best.oof_rmse, 3), round(best.holiday_rmse, 3), bool(best.use_holiday))],
                                 "family string, cv_rmse double, holiday_rmse double, use_holiday boolean")


# --- Boosted trees at full size, each fit ending where its validation error rises -----------------


@query("ml_linear_cv")
def ml_linear_cv(spark, sf):
    """Linear regression on scaled raw features, no trend."""
    table = lab.prepare_folds(train_rows(spark, sf), FOLDS, DAILY, FEATURES, scale=True, trend=False)
    return lab.fold_rmse(lab.cross_validate(table, lab.linear_model, "linear"))


@query("ml_gbt_cv")
def ml_gbt_cv(spark, sf):
    """Trend plus boosted trees with fold-fitted extreme-event flags."""
    table = lab.prepare_folds(train_rows(spark, sf), FOLDS, DAILY, FEATURES_V3, [feat.EXTREME_EVENTS])
    return lab.fold_rmse(lab.cross_validate(table, lab.boosted_trees, "gbt_a", stop=True))


@query("model_sweep")
def model_sweep(spark, sf):
    """All models over one stored fold table, each logged; compared by peak error."""
    train = train_rows(spark, sf)
    table = lab.prepare_folds(train, FOLDS, DAILY, FEATURES_V3, [feat.EXTREME_EVENTS])
    scaled = lab.prepare_folds(train, FOLDS, DAILY, FEATURES_V3, [feat.EXTREME_EVENTS], scale=True)
    builders = {name: (lambda name=name: lab.BUILDERS[name]({})) for name in lab.BUILDERS}
    oof = lab.model_sweep(table, scaled, builders, runs=scratch_path(spark, "runs"))
    return forecast.compare_models(oof).orderBy("peak_mape")


#: Trials of a search, and how many of them share the fits of one set of structure parameters.
TRIALS, PER_FIT = 40, 10


@query("random_search")
def random_search(spark, sf):
    """Forty trials of each boosted family."""
    table = lab.prepare_folds(train_rows(spark, sf), FOLDS, DAILY, FEATURES_V3, [feat.EXTREME_EVENTS])
    studies = [lab.random_search(table, f, TRIALS, per_fit=PER_FIT, parallel=8) for f in _BOOSTED]
    rows = [(s.family, i, {k: float(x) for k, x in p.items()}, float(v)) for s in studies for i, (p, v) in enumerate(s.trials)]
    return spark.createDataFrame(rows, "family string, trial int, params map<string,double>, rmse double")


@query("champion_select")
def champion_select(spark, sf):
    """Tune all families, pick the best, decide on the holiday feature, fit on all train rows, score the test rows."""
    d = daily(spark, sf, "full")
    table = lab.prepare_folds(d.train, FOLDS, DAILY, FEATURES_V3, [feat.EXTREME_EVENTS])
    studies = [lab.random_search(table, f, TRIALS, per_fit=PER_FIT, parallel=8) for f in _BOOSTED]
    best = lab.choose_champion(studies, d.train, FOLDS, DAILY, FEATURES_V3)
    _, scored = lab.final_fit(d.train, d.test, DAILY, FEATURES_V3, lambda: lab.BUILDERS[best.family](best.params), best.use_holiday)
    return lab.test_metrics(scored).withColumns({
        "family": F.lit(best.family), "cv_rmse": F.lit(best.oof_rmse), "use_holiday": F.lit(best.use_holiday)})
