"""Cross-validation, model sweep, random search and the final fit, on Spark ML."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loadweave.config import SEED, TARGET, Layout
from loadweave.operators import features as feat
from loadweave.operators.folds import Fold
from loadweave.operators.forecast import (
    TREND_STATS, compare_models, fit_trend, fit_trend_by_fold, oof_metrics, oof_select, scaled, scaler_stats, trend_value,
)
from loadweave.operators.hashed_neighbours import nearest_hashed, recall
from loadweave.operators.neighbours import nearest, weighted_vote
from loadweave.session import materialise, scratch_path
from loadweave.sources.sinks import log_run, table_exists

# --- Model builders ---------------------------------------------------------------------------

# The default boosted model has 500 trees, learning rate 0.05, depth 6.
DEFAULT_GBT = {"maxIter": 500, "stepSize": 0.05, "maxDepth": 6}
WHOLE = ("maxIter", "maxDepth", "minInstancesPerNode", "maxBins")


def boosted_trees(params: Mapping[str, float] | None = None) -> GBTRegressor:
    """Gradient-boosted trees; parameters carry Spark's names, a share of columns is a number up to 1."""
    p = {k: int(v) if k in WHOLE else float(v) for k, v in {**DEFAULT_GBT, **(params or {})}.items()}
    share = p.pop("featureSubsetStrategy", 1.0)
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="residual_pred", seed=SEED,
                        featureSubsetStrategy="all" if share >= 1 else str(share), **p)


def linear_model(params: Mapping[str, float] | None = None) -> Estimator:
    return LinearRegression(featuresCol="features", labelCol="label", predictionCol="residual_pred",
                            solver="normal", regParam=0.0, standardization=False)


Builder = Callable[[], Estimator]

# Three boosted presets. They share the default size and differ in how trees are regularised.
PRESETS: dict[str, dict[str, float]] = {
    "gbt_a": {},
    "gbt_b": {"minInstancesPerNode": 20},
    "gbt_c": {"maxBins": 254},
}
BUILDERS: dict[str, Callable[[Mapping[str, float]], Estimator]] = {
    **{name: (lambda params, base=base: boosted_trees({**base, **params})) for name, base in PRESETS.items()},
    "linear": linear_model,
}

# Search ranges (kind, low, high) of the parameters that Spark's trees have.
_SHARED = {"maxIter": ("int", 200, 800), "stepSize": ("log", 0.01, 0.15), "maxDepth": ("int", 3, 10)}
_SHARES = {"subsamplingRate": ("float", 0.6, 1.0), "featureSubsetStrategy": ("float", 0.6, 1.0)}
PARAM_SPACES: dict[str, dict[str, tuple[str, float, float]]] = {
    "gbt_a": {**_SHARED, "minInstancesPerNode": ("int", 1, 20), **_SHARES},
    "gbt_b": {**_SHARED, "minInstancesPerNode": ("int", 5, 100), **_SHARES},
    "gbt_c": {**_SHARED, "maxBins": ("int", 32, 255)},
    "linear": {},
}

# --- Fold table -------------------------------------------------------------------------------


@dataclass
class FoldTable:
    """Rows stored once, with a bit per fold for each role, and the small tables fitted per fold.

    What a fold changes (fitted flags, trend, scale) is an expression over the stored row and that fold's
    fits, made on reading; so the stored table does not grow with the number of folds.
    """

    base: DataFrame
    folds: Sequence[Fold]
    layout: Layout
    features: list[str]
    fits: list[tuple[feat.FoldFeature, DataFrame]]
    trend: DataFrame | None = None
    scale: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    def _bit(self, fold: Fold) -> int:
        return 1 << self.folds.index(fold)

    def _prepared(self, rows: DataFrame, on: Sequence[str], pick: Callable[[DataFrame], DataFrame], scale: bool = True) -> DataFrame:
        out = reduce(lambda df, f: f[0].apply(df, pick(f[1]), on), self.fits, rows)
        if self.trend is None:
            out = out.withColumn("trend", F.lit(None).cast("double")).withColumn("label", F.col(TARGET))
        else:
            out = out.join(pick(self.trend), list(on)).withColumn("trend", trend_value())
            out = out.withColumn("label", F.col(TARGET) - F.col("trend"))
        columns = [F.col(c).cast("double").alias(c) for c in self.features]
        if scale and self.scale is not None:
            out = out.join(pick(self.scale), list(on))
            columns = [scaled(c).alias(c) for c in self.features]
        return out.select(*self.layout.order, TARGET, "trend", "label", *columns, "fold_id", "role")

    def part(self, fold: Fold, *roles: str) -> DataFrame:
        """Rows of one fold: keys, timestamp, target, ``trend`` (null without decomposition), ``label`` (what
        a model learns), the features, fold_id and role."""
        role = F.coalesce(*[F.when(F.col(f"{r}_in").bitwiseAND(self._bit(fold)) != 0, r) for r in roles])
        rows = self.base.withColumns({"fold_id": F.lit(fold.fold_id), "role": role}).where("role is not null")
        return self._prepared(rows, self.layout.keys, lambda t: t.where(F.col("fold_id") == fold.fold_id).drop("fold_id"))

    def expanded(self, role: str, scale: bool = True) -> DataFrame:
        """Rows of all folds in this role, made on reading: a row once per fold."""
        ids = F.array(*[F.when(F.col(f"{role}_in").bitwiseAND(self._bit(f)) != 0, F.lit(f.fold_id)) for f in self.folds])
        rows = self.base.withColumns({"fold_id": F.explode(F.array_compact(ids)), "role": F.lit(role)})
        return self._prepared(rows, [*self.layout.keys, "fold_id"], lambda t: t, scale)


def prepare_folds(df: DataFrame, folds: Sequence[Fold], layout: Layout, features: Sequence[str],
                  chain: Sequence[feat.FoldFeature] = (), scale: bool = False, trend: bool = True) -> FoldTable:
    """Everything fitted per fold is fitted here, once, on that fold's train rows. At most 63 folds."""
    if len(folds) > 63:
        raise ValueError("a fold is a bit of a long: 63 at most")
    t = F.col(layout.ts)

    def mask(test: Callable[[Fold], Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.when(test(f), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(folds)])

    marked = df.withColumns({"train_in": mask(lambda f: f.in_train(t)), "val_in": mask(lambda f: f.in_validation(t))})
    base = materialise(marked.where((F.col("train_in") != 0) | (F.col("val_in") != 0)), "folds")
    fits = [(f, materialise(f.fit(base, folds, layout.keys), f"fit-{f.name}")) for f in chain]
    line = materialise(fit_trend_by_fold(base, folds, layout), "fit-trend") if trend else None
    table = FoldTable(base, folds, layout, list(features), fits, line)
    if scale:
        stats = [fn(lambda c: c).alias(k) for k, fn in scaler_stats(features).items()]
        train = table.expanded("train", scale=False)
        table.scale = materialise(train.groupBy(*layout.keys, "fold_id").agg(*stats), "fit-scale")
    return table


def _inputs(features: Sequence[str]) -> list:
    filled = [f"{c}_filled" for c in features]
    return [Imputer(strategy="mean", inputCols=list(features), outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="features")]


def with_inputs(model: Estimator, features: Sequence[str]) -> Pipeline:
    """The model behind its inputs: a missing feature value counts as the mean of the train rows."""
    return Pipeline(stages=[*_inputs(features), model])


@dataclass
class StagedFit:
    """A fold's model, and the mean squared validation error of its first 1, 2, ... trees."""

    model: PipelineModel
    errors: list[float]
    n_val: int


def staged_fit(table: FoldTable, fold: Fold, build: Builder) -> StagedFit:
    """Fits boosted trees up to their number, or until the validation error rises, and measures every number of
    trees on the way in one pass; so models that differ in their number of trees share this fit. Inputs are
    filled from train rows alone."""
    inputs = Pipeline(stages=_inputs(table.features)).fit(table.part(fold, "train").select(*table.features))
    rows = table.part(fold, "train", "val").where("label is not null").withColumn("held_out", F.col("role") == "val")
    ready = inputs.transform(rows).select("label", "features", "held_out").persist()
    try:
        val = ready.where("held_out")
        n_val = val.count()
        model = build()
        if n_val:
            model = model.copy({model.validationIndicatorCol: "held_out", model.validationTol: 0.0})
        fitted = model.fit(ready)
        errors = fitted.evaluateEachIteration(val, "squared") if n_val else []
    finally:
        ready.unpersist()
    return StagedFit(PipelineModel([*inputs.stages, fitted]), list(errors), n_val)


def _each_fold(table: FoldTable, run: Callable, items: Sequence, parallel: int) -> list:
    """Fits are submitted side by side, so the cluster is not idle between the many short jobs of one."""
    with ThreadPool(max(1, min(parallel, len(items)))) as pool:
        return pool.map(inheritable_thread_target(table.spark)(run), items, chunksize=1)


def cross_validate(table: FoldTable, build: Builder, model: str, parallel: int = 4, stop: bool = False) -> DataFrame:
    """Out-of-fold forecasts: one distributed fit per fold, trend added back. With ``stop`` boosted trees
    end where their validation error does not fall any more (``staged_fit``)."""
    def forecast(fold: Fold) -> DataFrame:
        if stop and isinstance(build(), GBTRegressor):
            fitted = staged_fit(table, fold, build).model
        else:
            fitted = with_inputs(build(), table.features).fit(table.part(fold, "train").select("label", *table.features))
        val = fitted.transform(table.part(fold, "val"))
        pred = F.coalesce(F.col("trend"), F.lit(0.0)) + F.col("residual_pred")
        return oof_select(val, table.layout, model, pred)

    return reduce(DataFrame.unionByName, _each_fold(table, forecast, table.folds, parallel))


def _knn_sides(table: FoldTable) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train and validation rows of all folds with the ids that a neighbour search asks for, and its groups."""
    group = [*table.layout.keys, "fold_id"]
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in (*group, table.layout.ts)])
    train, val = (table.expanded(r).withColumn("_tid", F.col(table.layout.ts).cast("string")).withColumn("_key", key)
                  for r in ("train", "val"))
    return train, val, group


def knn_cross_validate(table: FoldTable, model: str = "knn", k: int = 15, search: Callable[..., DataFrame] = nearest) -> DataFrame:
    """The nearest-neighbour model over the same table: all folds in one job. Use a scaled table; ``search`` is
    exact, or ``nearest_hashed`` where train rows are too many for that."""
    train, val, group = _knn_sides(table)
    votes = weighted_vote(search(train, val, group, table.features, k, "_tid", "_key", "label"))
    joined = val.join(votes.withColumnRenamed("_qid", "_key"), "_key")
    pred = F.coalesce(F.col("trend"), F.lit(0.0)) + F.col("prediction")
    return oof_select(joined, table.layout, model, pred)


def knn_recall(table: FoldTable, k: int = 15, **hashed) -> DataFrame:
    """Per series and fold: how many rows asked, how many exact neighbours they have and the share of them that the
    hashed search finds."""
    train, val, group = _knn_sides(table)
    ask = (group, table.features, k, "_tid", "_key", "label")
    hits = recall(nearest_hashed(train, val, *ask, **hashed), nearest(train, val, *ask))
    return val.select(*group, F.col("_key").alias("_qid")).join(hits, "_qid").groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("n_exact").alias("n_neighbours"), (F.sum("n_found") / F.sum("n_exact")).alias("recall"))


def fold_details(oof: DataFrame, zone: str | None = None) -> DataFrame:
    """Residual and local time of every validated row, as kept for error analysis."""
    from loadweave.config import LOCAL_ZONE
    from loadweave.functions.timefn import to_local
    return oof.withColumn("residual", F.col("y_true") - F.col("y_pred")).withColumn(
        "timestamp_central", to_local(F.col("timestamp"), zone or LOCAL_ZONE))


def fold_rmse(oof: DataFrame) -> DataFrame:
    return oof_metrics(oof, ("model", "fold_id"))


# --- Sweep and search -------------------------------------------------------------------------


def model_sweep(table: FoldTable, scaled_table: FoldTable | None, builders: Mapping[str, Builder],
                k: int | None = 15, runs: str | None = None) -> DataFrame:
    """Forecasts of every model in one long table, stored once; optionally one run record each."""
    parts = [cross_validate(table, build, name, stop=True) for name, build in builders.items()]
    if scaled_table is not None and k:
        parts.append(knn_cross_validate(scaled_table, "knn", k))
    oof = materialise(reduce(DataFrame.unionByName, parts), "oof")
    if runs:
        for r in oof_metrics(oof).collect():  # one row per model
            log_run(oof.sparkSession, runs, r["model"], {"features": ",".join(table.features)},
                    {"cv_oof_rmse": r["rmse"], "cv_oof_mape": r["mape"]})
    return oof


def trial_table(spark: SparkSession, family: str, n_trials: int = 40, seed: int = SEED,
                space: Mapping[str, tuple[str, float, float]] | None = None, per_fit: int = 1) -> DataFrame:
    """Seeded random draws from a family's parameter ranges, one row per trial: 52 bits of the MD5 of
    ``seed:family:parameter:number``.

    ``per_fit`` trials in a row share all parameters but the number of trees, so one staged fit serves them."""
    columns = []
    for name, (kind, low, high) in (PARAM_SPACES[family] if space is None else space).items():
        number = F.col("id") if name == "maxIter" else F.floor(F.col("id") / per_fit)
        drawn = F.md5(F.concat_ws(":", F.lit(seed), F.lit(family), F.lit(name), number).cast("binary"))
        u = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
        if kind == "int":
            value = F.lit(low) + F.floor(u * (high - low + 1))
        elif kind == "log":
            value = F.exp(F.lit(math.log(low)) + u * (math.log(high) - math.log(low)))
        else:
            value = F.lit(low) + u * (high - low)
        columns.append(value.cast("double").alias(name))
    return spark.range(n_trials).select(F.lit(family).alias("family"), F.col("id").cast("int").alias("trial"), *columns)


LEDGER = "family string, params string, fold_id int, trees int, errors array<double>, n_val long, seconds double"


def _name(params: Mapping[str, float]) -> str:
    """What one fit serves: all parameters but the number of trees, as text."""
    return json.dumps({k: repr(float(v)) for k, v in sorted(params.items()) if k != "maxIter"})


def _fold_errors(table: FoldTable, fold: Fold, family: str, params: Mapping[str, float]) -> tuple[list[float], int]:
    """Mean squared validation error of each number of trees (one number for other models), and rows."""
    if isinstance(BUILDERS[family](params), GBTRegressor):
        fit = staged_fit(table, fold, lambda: BUILDERS[family](params))
        return fit.errors, fit.n_val
    fitted = with_inputs(BUILDERS[family](params), table.features).fit(table.part(fold, "train").select("label", *table.features))
    gap = F.col("label") - F.col("residual_pred")
    row = fitted.transform(table.part(fold, "val").where("label is not null")).agg(
        F.avg(gap * gap).alias("e"), F.count(F.lit(1)).alias("n")).first()
    return ([row["e"]] if row["n"] else []), row["n"]


def _at(errors: Sequence[float], trees: float | None) -> float:
    """The error of a number of trees; beyond the place where a fit stopped it is that of the stop."""
    return errors[-1 if trees is None else min(int(trees), len(errors)) - 1]


def run_trials(table: FoldTable, family: str, trials: Sequence[Mapping[str, float]], ledger: str, parallel: int = 4) -> list[float]:
    """Out-of-fold RMSE of each trial.

    A fit per fold and set of structure parameters, as far as the ledger at ``ledger`` does not hold it yet; each
    is entered as soon as it ends. So a search that was stopped goes on where it was, and a wider search pays only
    for what is new. One ledger belongs to one fold table. Entries are a row per fit.
    """
    spark = table.spark
    most: dict[str, dict[str, float]] = {}
    for p in trials:
        held = most.setdefault(_name(p), dict(p))
        if p.get("maxIter", 0) > held.get("maxIter", 0):
            held["maxIter"] = p["maxIter"]
    wanted = spark.createDataFrame([(family, name, f.fold_id, int(p.get("maxIter", 1))) for name, p in most.items() for f in table.folds],
                                   "family string, params string, fold_id int, trees int")
    if table_exists(spark, ledger):
        # an entry serves unless it holds all the trees it was asked for and more are wanted now
        done = spark.read.schema(LEDGER).parquet(ledger).select(
            "family", "params", "fold_id", F.when(F.size("errors") < F.col("trees"), F.lit(1 << 30)).otherwise(F.col("trees")).alias("reach"))
        wanted = wanted.join(done, (wanted.family == done.family) & (wanted.params == done.params)
                             & (wanted.fold_id == done.fold_id) & (done.reach >= wanted.trees), "left_anti")
    folds = {f.fold_id: f for f in table.folds}

    def run(row: Row) -> None:
        start = time.perf_counter()
        errors, n_val = _fold_errors(table, folds[row["fold_id"]], family, most[row["params"]])
        entry = (family, row["params"], row["fold_id"], row["trees"], [float(e) for e in errors], n_val, time.perf_counter() - start)
        # a folder of its own: two appends to one folder at a time would clear each other's temporary files
        spark.createDataFrame([entry], LEDGER).coalesce(1).write.parquet(f"{ledger}/fit={uuid.uuid4().hex}")

    _each_fold(table, run, wanted.orderBy("params", "fold_id").collect(), parallel)  # one row per fit
    entries: dict[str, dict[int, Row]] = {}
    for row in spark.read.schema(LEDGER).parquet(ledger).where(F.col("family") == family).collect():
        best = entries.setdefault(row["params"], {})
        if row["fold_id"] not in best or row["trees"] > best[row["fold_id"]]["trees"]:
            best[row["fold_id"]] = row
    values = []
    for p in trials:
        rows = [entries[_name(p)][f] for f in folds if entries[_name(p)][f]["n_val"]]
        total = sum(r["n_val"] * _at(r["errors"], p.get("maxIter")) for r in rows)
        n = sum(r["n_val"] for r in rows)
        values.append(math.sqrt(total / n) if n else math.nan)
    return values


@dataclass
class Study:
    family: str
    best_params: dict[str, float]
    best_value: float
    trials: list[tuple[dict[str, float], float]]


def random_search(table: FoldTable, family: str, n_trials: int = 40, seed: int = SEED,
                  space: Mapping[str, tuple[str, float, float]] | None = None, parallel: int = 4,
                  ledger: str | None = None, per_fit: int = 1) -> Study:
    """Lowest out-of-fold RMSE over random parameter draws (ties: the earlier trial); all trials share the
    fold table, and fits run side by side, ``parallel`` at a time. See ``run_trials`` for the ledger."""
    spark = table.spark
    rows = trial_table(spark, family, n_trials, seed, space, per_fit).orderBy("trial").collect()  # one row per trial
    draws = [{k: v for k, v in row.asDict().items() if k not in ("family", "trial")} for row in rows]
    values = run_trials(table, family, draws, ledger or scratch_path(spark, "ledger"), parallel)
    trials = list(zip(draws, values))
    params, value = min(trials, key=lambda t: t[1])
    return Study(family, params, value, trials)


def tuned_comparison(spark: SparkSession, studies: Sequence[Study]) -> DataFrame:
    """The best trial of each study, lowest error first."""
    rows = [(s.family, float(s.best_value), json.dumps(s.best_params), i + 1)
            for i, s in enumerate(sorted(studies, key=lambda s: s.best_value))]
    return spark.createDataFrame(rows, "model string, tuned_oof_rmse double, params string, place int").orderBy("place")


@dataclass
class Champion:
    family: str
    params: dict[str, float]
    oof_rmse: float
    holiday_rmse: float
    use_holiday: bool


def choose_champion(studies: Sequence[Study], df: DataFrame, folds: Sequence[Fold], layout: Layout,
                    features: Sequence[str], chain: Sequence[feat.FoldFeature] = (feat.EXTREME_EVENTS,),
                    parallel: int = 4, scale: bool = False) -> Champion:
    """Best tuned family; the holiday feature joins only if it strictly lowers RMSE. The number of trees becomes
    the one at which the longest fold stopped, if none used up the trial's."""
    best = min(studies, key=lambda s: s.best_value)
    table = prepare_folds(df, folds, layout, [*features, "holiday_freq"], (*chain, feat.HOLIDAY_FREQ), scale=scale)
    ledger = scratch_path(table.spark, "ledger")
    with_holiday = run_trials(table, best.family, [best.best_params], ledger, parallel)[0]
    params = dict(best.best_params)
    if "maxIter" in params:
        held = table.spark.read.schema(LEDGER).parquet(ledger).agg(F.max(F.size("errors"))).first()[0]
        params["maxIter"] = float(max(1, min(params["maxIter"], held)))
    return Champion(best.family, params, best.best_value, with_holiday, with_holiday < best.best_value)


# --- Final fit --------------------------------------------------------------------------------


def fit_state(train: DataFrame, origin: DataFrame, layout: Layout, use_holiday: bool) -> DataFrame:
    """Per series: trend line, thresholds, trend origin and (if used) holiday shares."""
    keys = list(layout.keys)
    fits = {**TREND_STATS, **feat.threshold_stats()}
    state = (
        train.groupBy(*keys).agg(*[fn(lambda c: c).alias(k) for k, fn in fits.items()])
        .join(origin.select(*keys, F.col("first_ts").alias("trend_origin")), keys)
    )
    if not use_holiday:
        return state.withColumn("holiday_freq_map", F.lit(None).cast("map<string,double>"))
    maps = feat.fit_holiday_freq(train, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("holiday_name", "holiday_freq"))).alias("holiday_freq_map"))
    return state.join(maps, keys, "left")


def final_fit(train: DataFrame, test: DataFrame, layout: Layout, features: Sequence[str], build: Builder,
              use_holiday: bool, model: str = "champion") -> tuple[PipelineModel, DataFrame]:
    """Fit on all train rows; forecast the test rows as ``(keys, timestamp, model, y_true, y_pred)``."""
    keys = list(layout.keys)
    chain = [(feat.fit_thresholds(train, keys), feat.apply_thresholds)]
    columns = list(features)
    if use_holiday:
        chain.append((feat.fit_holiday_freq(train, keys), feat.apply_holiday_freq))
        columns.append("holiday_freq")
    trend = fit_trend(train, keys)

    def prepared(df: DataFrame) -> DataFrame:
        out = reduce(lambda d, step: step[1](d, step[0], keys), chain, df).join(trend, keys)
        return out.withColumn("trend", trend_value()).withColumn("label", F.col(TARGET) - F.col("trend"))

    pipeline = with_inputs(build(), columns).fit(materialise(prepared(train).select("label", *columns), "final"))
    scored = pipeline.transform(prepared(test)).select(
        *layout.order, F.lit(model).alias("model"), F.col(TARGET).alias("y_true"),
        (F.col("trend") + F.col("residual_pred")).alias("y_pred"))
    return pipeline, scored


def test_metrics(scored: DataFrame) -> DataFrame:
    """Measures of the forecasts, which are stored first: several passes read them."""
    return compare_models(materialise(scored, "scored"))
