from dataclasses import replace
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.config import FEATURES_V3, HOURLY, SEED
from loadweave.functions import metrics
from loadweave.operators import ensemble, features as feat, folds, forecast, hashed_neighbours, neighbours
from loadweave.operators.neighbours import nearest, weighted_vote
from loadweave.plans import experiment as lab

rng = np.random.default_rng(11)


def test_fold_boundaries():
    got = folds.expanding_folds()
    first, last = got[0], got[-1]
    assert [str(x) for x in (first.tr_start, first.tr_end, first.val_start, first.val_end)] == [
        "2016-01-08 00:00:00", "2020-07-30 05:00:00", "2020-08-06 06:00:00", "2021-08-06 05:00:00"]
    assert str(last.tr_end) == "2024-07-30 05:00:00" and str(last.val_end) == "2025-08-06 05:00:00" and len(got) == 5
    assert not folds.validation_overlaps(got)
    for f in got:
        assert (f.val_start - f.tr_end).total_seconds() >= 7 * 86400


def test_split_purges_before_local_midnight(spark, hourly):
    df = hourly([("a", h, h) for h in range(24 * 20)], start="2025-08-01")
    split = folds.chronological_split(df)
    assert str(split.test_start) == "2025-08-13 05:00:00" and str(split.train_end) == "2025-08-06 05:00:00"
    assert split.train.agg(F.max("timestamp")).first()[0] == split.train_end
    assert split.test.agg(F.min("timestamp")).first()[0] == split.test_start


FOLDS = folds.expanding_folds("2020-01-01 00:00:00", "2021-01-01 00:00:00", 2, 7, 86400)


def daily(spark):
    ts = pd.date_range("2020-01-01", "2022-12-31", freq="D")
    frames = []
    for s, lift in (("a", 0.0), ("b", 50.0)):
        p = pd.DataFrame({"series_id": s, "timestamp": ts})
        n = len(p)
        p["trend_idx"] = np.arange(n) / 365
        for c in ("temp_c", "humidity_pct", "precip_mm", "tmax", "tmin", "tavg", "load_lag_24", "load_lag_168",
                  "temp_c_roll_std_72", "temp_change_vs_lag24"):
            p[c] = rng.normal(10, 3, n)
        for c in ("hour", "dayofweek", "month", "is_weekend", "is_holiday"):
            p[c] = rng.integers(0, 2, n)
        p["hour_x_temp"] = p["hour"] * p["temp_c"]
        p["holiday_name"] = rng.choice(["X", "Y", None], n, p=[0.1, 0.1, 0.8])
        p["actual_load_mw"] = 100 + lift + 5 * p["trend_idx"] + 2 * p["temp_c"] + rng.normal(0, 1, n)
        frames.append(p)
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def data(spark):
    return daily(spark)


def train_part(pdf, fold, s):
    return pdf[(pdf.series_id == s) & pdf.timestamp.between(fold.tr_start, fold.tr_end)]


def val_part(pdf, fold, s):
    return pdf[(pdf.series_id == s) & pdf.timestamp.between(fold.val_start, fold.val_end)]


def test_fold_fits_use_train_rows_only(spark, data):
    pdf, df = data
    fits = folds.fit_by_fold(df, FOLDS, ["series_id"], {**feat.threshold_stats(), **forecast.TREND_STATS})
    for r in fits.collect():
        part = train_part(pdf, FOLDS[r["fold_id"] - 1], r["series_id"])
        assert np.isclose(r["heat"], part["tmax"].quantile(0.95)) and np.isclose(r["cold"], part["tmin"].quantile(0.05))
        np.testing.assert_allclose([r["slope"], r["intercept"]], np.polyfit(part["trend_idx"], part["actual_load_mw"], 1))
    sizes = {(r["fold_id"], r["role"]): r["n_rows"] for r in folds.fold_sizes(df, FOLDS).collect()}
    assert sizes[1, "train"] == 2 * len(train_part(pdf, FOLDS[0], "a")) and sizes[2, "val"] == 2 * 365


def test_flags_treat_unknown_as_zero(spark):
    df = spark.createDataFrame([(None, -5.0, 1, None), (40.0, None, 1, 9.0), (40.0, 0.0, 0, 0.0)],
                               "tmax double, tmin double, is_holiday int, precip_mm double")
    out = df.select([c.alias(n) for n, c in feat.extreme_event_columns(F.lit(35.0), F.lit(-1.0), F.lit(5.0)).items()])
    assert [tuple(r) for r in out.collect()] == [(0, 1, 1, 0), (1, 0, 1, 1), (1, 0, 0, 0)]


def test_holiday_shares_exclude_ordinary_days(spark, data):
    pdf, df = data
    got = {(r["series_id"], r["fold_id"], r["holiday_name"]): r["holiday_freq"]
           for r in feat.fit_holiday_freq_by_fold(df, FOLDS, ["series_id"]).collect()}
    want = train_part(pdf, FOLDS[1], "b")["holiday_name"].value_counts(normalize=True)
    assert np.isclose(got["b", 2, "X"], want["X"])
    rows = spark.createDataFrame([("b", 2, "X"), ("b", 2, "unseen"), ("b", 2, None)], "series_id string, fold_id int, holiday_name string")
    fitted = feat.fit_holiday_freq_by_fold(df, FOLDS, ["series_id"])
    out = feat.apply_holiday_freq(rows, fitted, ["series_id", "fold_id"]).collect()
    assert sorted(r["holiday_freq"] for r in out) == [0.0, 0.0, pytest.approx(want["X"])]


def test_baselines_and_trend(spark, data):
    pdf, df = data
    oof = forecast.naive_baselines(df, FOLDS, HOURLY).unionByName(forecast.trend_oof(df, FOLDS, HOURLY))
    got = oof.where("series_id = 'a' and fold_id = 1").toPandas().sort_values("timestamp")
    tr, va = train_part(pdf, FOLDS[0], "a"), val_part(pdf, FOLDS[0], "a")
    by = {m: g["y_pred"].to_numpy() for m, g in got.groupby("model")}
    np.testing.assert_allclose(by["constant"], tr["actual_load_mw"].mean())
    np.testing.assert_allclose(by["persistence"], va["load_lag_24"])
    np.testing.assert_allclose(by["trend"], np.polyval(np.polyfit(tr["trend_idx"], tr["actual_load_mw"], 1), va["trend_idx"]))


def test_last_fold_wins_where_ranges_overlap(spark):
    rows = [("a", pd.Timestamp("2024-01-01").to_pydatetime(), "m", f, 1.0, float(f)) for f in (1, 2)]
    oof = spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, model string, fold_id int, y_true double, y_pred double")
    assert forecast.last_fold_wins(oof, HOURLY).first()["y_pred"] == 2.0
    assert forecast.last_fold_wins(oof, HOURLY, FOLDS).count() == 2


def test_metrics(spark):
    y, p = rng.normal(100, 20, 500), rng.normal(100, 20, 500)
    y[0] = 0.0
    oof = spark.createDataFrame(pd.DataFrame({"model": "m", "y_true": y, "y_pred": p}))
    got = forecast.compare_models(oof).first()
    ape = np.abs(y - p) / np.maximum(np.abs(y), np.finfo(float).eps)
    peak = y >= np.quantile(y, 0.95)
    np.testing.assert_allclose([got["rmse"], got["mape"], got["peak_mape"]],
                               [np.sqrt(np.mean((y - p) ** 2)), ape.mean() * 100, ape[peak].mean() * 100])


MODELS = ["m1", "m2", "m3"]


@pytest.fixture(scope="module")
def three(spark):
    y = rng.normal(0, 1, 2000)
    pdf = pd.DataFrame({"y_true": y, "m1": y + rng.normal(0, 1, 2000), "m2": y + rng.normal(0.1, 0.9, 2000), "m3": y * 0.5})
    return pdf, spark.createDataFrame(pdf).persist()


def direct(pdf, w):
    return np.sqrt(np.mean((sum(v * pdf[k] for k, v in w.items()) - pdf["y_true"]) ** 2))


def test_gram_rmse_is_the_direct_rmse(three):
    pdf, df = three
    gram = ensemble.Gram.collect(df, MODELS)
    for w in ({"m1": 1.0}, {"m1": 0.2, "m2": 0.5, "m3": 0.3}, {"m1": 1.4, "m3": -0.4}):
        assert np.isclose(gram.rmse(w), direct(pdf, w), rtol=1e-12)


def test_vote_ensemble_equals_a_direct_search(three):
    pdf, df = three
    got = ensemble.vote_ensemble(ensemble.Gram.collect(df, MODELS))
    chosen = [min(MODELS, key=lambda m: direct(pdf, {m: 1}))]
    best = direct(pdf, {chosen[0]: 1})
    for _ in range(50):
        def mix(m):
            names = [*chosen, m]
            return np.sqrt(np.mean((sum(pdf[k] for k in names) / len(names) - pdf["y_true"]) ** 2))
        m = min(MODELS, key=mix)
        if not mix(m) < best - 1e-6:
            break
        best = mix(m)
        chosen.append(m)
    assert got.selected == chosen and np.isclose(got.score, best)
    assert np.isclose(sum(got.weights.values()), 1)


@pytest.mark.parametrize("negative", [False, True])
def test_blend_ensemble(three, negative):
    pdf, df = three
    gram = ensemble.gram_scorer(ensemble.Gram.collect(df, MODELS))
    a = ensemble.blend_ensemble(gram, MODELS, negative_weights=negative)
    assert np.isclose(a.score, direct(pdf, a.weights)) and a.score <= min(a.solo.values())
    assert all(x > y for x, y in zip(a.history, a.history[1:]))
    b = ensemble.blend_ensemble(ensemble.spark_scorer(df, metrics.rmse), MODELS, max_models=2,
                                alphas=[0, 0.25, 0.5], negative_weights=negative)
    c = ensemble.blend_ensemble(gram, MODELS, max_models=2, alphas=[0, 0.25, 0.5], negative_weights=negative)
    assert b.selected == c.selected and np.isclose(b.score, c.score) and len(b.selected) == 2
    mae = ensemble.blend_ensemble(ensemble.spark_scorer(df, metrics.mae), MODELS, max_models=2, alphas=[0, 0.5])
    assert mae.score <= min(mae.solo.values())


def test_mixes_scored_in_one_aggregation(spark, three):
    _, df = three
    mixes = [{m: w for m, w in zip(MODELS, row)} for row in ([1.0, 0, 0], [0.3, 0.7, 0], [0, -0.5, 1.5])]
    one = ensemble.mix_scorer(df, MODELS, lambda y, p: F.abs(y - p))
    assert one(mixes) == pytest.approx(ensemble.spark_scorer(df, metrics.mae)(mixes))
    with pytest.raises(ValueError):
        ensemble.mix_scorer(df.limit(0), MODELS, lambda y, p: F.abs(y - p))(mixes)
    actual = np.sort([r["y_true"] for r in df.collect()])
    peak = sorted(r["y_true"] for r in ensemble.peak_rows(df, 0.25).collect())
    assert peak == [y for y in actual if y >= np.quantile(actual, 0.75)] and 0 < len(peak) < len(actual)
    assert ensemble.peak_rows(df.limit(0)).count() == 0


def test_negative_shares_need_a_held_model(three):
    _, df = three
    gram = ensemble.gram_scorer(ensemble.Gram.collect(df, MODELS))
    got = ensemble.blend_ensemble(gram, MODELS, alphas=[-0.3, -0.1, 0, 0.2])
    assert min(got.weights.values()) >= 0


@pytest.mark.parametrize("pivots,piece", [(1, 10_000), (9, 40), (9, 10_000)])
def test_neighbours_equal_brute_force(spark, pivots, piece):
    n, m, k = 300, 60, 5
    x = rng.normal(size=(n, 3))
    x[: n // 3] = x[0]  # a third of the rows are one and the same point
    q = np.vstack([rng.normal(size=(m - 1, 3)), x[:1]])
    y = rng.normal(size=n)
    cols = ["f1", "f2", "f3"]
    train = pd.DataFrame(x, columns=cols).assign(g=np.where(np.arange(n) % 5, "a", "b"), y=y, tid=[f"{i:04d}" for i in range(n)])
    query = pd.DataFrame(q, columns=cols).assign(g=np.where(np.arange(m) % 2, "a", "b"), qid=[f"q{i}" for i in range(m)])
    found = nearest(spark.createDataFrame(train), spark.createDataFrame(query), ["g"], cols, k, "tid", "qid", "y", pivots, piece)
    got = found.toPandas()
    votes = {r["_qid"]: r["prediction"] for r in weighted_vote(found).collect()}
    assert len(votes) == m
    for _, row in query.iterrows():
        part = train[train.g == row.g].copy()
        part["d"] = np.sqrt(((part[cols].to_numpy() - row[cols].to_numpy(float)) ** 2).sum(axis=1))
        best = part.sort_values(["d", "tid"]).head(k)
        mine = got[got._qid == row.qid].sort_values("_rank")
        assert mine._tid.tolist() == best.tid.tolist()
        exact = best[best.d == 0]
        want = exact.y.mean() if len(exact) else np.average(best.y, weights=1 / best.d)
        assert np.isclose(votes[row.qid], want)


def test_linear_cv_matches_least_squares(spark, data):
    pdf, df = data
    names = ["temp_c", "load_lag_24", "is_weekend"]
    table = lab.prepare_folds(df, FOLDS, HOURLY, names, scale=True)
    oof = lab.cross_validate(table, lab.linear_model, "linear")
    got = oof.where("series_id = 'a' and fold_id = 2").toPandas().sort_values("timestamp")
    xs, ls = [], []
    for s in ("a", "b"):
        tr = train_part(pdf, FOLDS[1], s)
        trend = np.polyfit(tr.trend_idx, tr.actual_load_mw, 1)
        xs.append(((tr[names] - tr[names].mean()) / tr[names].std(ddof=0)).to_numpy())
        ls.append((tr.actual_load_mw - np.polyval(trend, tr.trend_idx)).to_numpy())
    x = np.column_stack([np.vstack(xs), np.ones(sum(map(len, ls)))])
    beta = np.linalg.lstsq(x, np.concatenate(ls), rcond=None)[0]
    tr, va = train_part(pdf, FOLDS[1], "a"), val_part(pdf, FOLDS[1], "a")
    z = ((va[names] - tr[names].mean()) / tr[names].std(ddof=0)).to_numpy()
    want = np.polyval(np.polyfit(tr.trend_idx, tr.actual_load_mw, 1), va.trend_idx) + z @ beta[:-1] + beta[-1]
    np.testing.assert_allclose(got["y_pred"], want, rtol=1e-8)
    detail = lab.fold_details(oof).first()
    assert np.isclose(detail["residual"], detail["y_true"] - detail["y_pred"])


def test_missing_features_count_as_the_train_mean(spark, data):
    pdf, df = data
    names = ["temp_c", "load_lag_24"]
    holed = df.withColumn("temp_c", F.when(F.dayofmonth("timestamp") != 3, F.col("temp_c")))
    for build in (lab.linear_model, lambda: lab.boosted_trees({"maxIter": 2, "maxDepth": 2})):
        raw = lab.prepare_folds(holed, FOLDS[:1], HOURLY, names)
        mean = raw.part(FOLDS[0], "train").agg(F.avg("temp_c")).first()[0]
        filled = lab.prepare_folds(holed.fillna({"temp_c": mean}), FOLDS[:1], HOURLY, names)
        got, want = (lab.cross_validate(t, build, "m").orderBy("series_id", "timestamp").toPandas() for t in (raw, filled))
        assert got.y_pred.notna().all()
        np.testing.assert_allclose(got.y_pred, want.y_pred)


def test_neighbours_visit_few_rows_as_data_grow(spark):
    """With the default number of pivots the cells shrink as rows grow, so a query is held against few of them."""
    shares = []
    for n in (1_000, 16_000):
        x = np.random.default_rng(3).uniform(size=(n, 2))
        train = spark.createDataFrame(pd.DataFrame({"g": 1, "_qid": [f"{i}" for i in range(n)], "_x": x.tolist()}))
        centres = x[: int(n ** 0.5)]
        home = neighbours._home_cells(train, centres)
        cells = home.groupBy("g", "_cell").agg(F.count("*").alias("_n"), F.min("_r").alias("_rmin"), F.max("_r").alias("_rmax"))
        bounded = train.limit(50).withColumn("_bound", F.lit((5 / n) ** 0.5))
        kinds = [neighbours._plan_visits(bounded, cells, centres, ["g"], 5, first, 20_000) for first in (True, False)]
        seen = kinds[0].unionByName(kinds[1]).join(cells, ["g", "_cell"]).agg(F.sum("_n")).first()[0]
        shares.append(seen / (50 * n))
    assert shares[1] < shares[0] / 2 and shares[1] < 0.1


def test_hashed_neighbours(spark):
    """Visits of a query stay as they are while rows grow; most neighbours are found, each query gets k, ties and repeats do no harm."""
    cols, k, seen = ["f1", "f2", "f3", "f4"], 10, []
    for n in (2_000, 32_000):
        x = np.random.default_rng(5).normal(size=(n, 4))
        x[: n // 3] = x[0]  # a third of the rows are one and the same point
        train = pd.DataFrame(x, columns=cols).assign(g="a", y=x[:, 0], tid=[f"{i:06d}" for i in range(n)])
        query = train.iloc[::n // 100].assign(qid=lambda d: "q" + d.tid)
        query = pd.concat([query, query.iloc[:1].assign(f1=99.0, qid="far"), query.iloc[:1].assign(g="unknown", qid="none")])
        t, q = spark.createDataFrame(train), spark.createDataFrame(query)
        found = hashed_neighbours.nearest_hashed(t, q, ["g"], cols, k, "tid", "qid", "y").persist()
        counts = found.groupBy("_qid").count().toPandas().set_index("_qid")["count"]
        assert (counts == k).all() and len(counts) == len(query) - 1 and "none" not in counts.index
        hits = hashed_neighbours.recall(found, nearest(t, q, ["g"], cols, k, "tid", "qid", "y")).agg(F.sum("n_found") / F.sum("n_exact"))
        assert hits.first()[0] >= 0.9
        assert found.where("_qid = 'q000000'").agg(F.max("_tid"), F.max("_d")).first()[:] == (f"{k - 1:06d}", 0.0)
        rows = t.select("g", F.array(*cols).alias("_x"), F.lit(True).alias("_train")).distinct()
        cells = hashed_neighbours.place(rows, ["g"], 4, 3, 256, 4).groupBy("_table", "_cell").count()
        seen.append(cells.agg(F.max("count")).first()[0])
        found.unpersist()
    assert max(seen) <= 256
    few = spark.createDataFrame(train.head(3)), spark.createDataFrame(query.head(1))
    assert hashed_neighbours.nearest_hashed(*few, ["g"], cols, k, "tid", "qid", "y").count() == 3
    none = t.limit(0)
    assert hashed_neighbours.nearest_hashed(none, q, ["g"], cols, k, "tid", "qid", "y").count() == 0


def test_trial_draws(spark):
    for family in ("gbt_a", "gbt_b", "gbt_c"):
        a, b = (lab.trial_table(spark, family, 40).toPandas() for _ in range(2))
        pd.testing.assert_frame_equal(a, b)
        for name, (kind, lo, hi) in lab.PARAM_SPACES[family].items():
            assert a[name].between(lo, hi).all() and (kind != "int" or (a[name] % 1 == 0).all())
            assert a[name].nunique() > 5
    # the same draws in another engine's SQL
    import duckdb
    for name, (kind, lo, hi) in lab.PARAM_SPACES["gbt_a"].items():
        number = "t" if name == "maxIter" else "t // 10"
        u = f"(cast('0x' || substr(md5('{SEED}:gbt_a:{name}:' || ({number})), 1, 13) as bigint) / {float(1 << 52)!r})"
        value = {"int": f"{lo} + floor({u} * {hi - lo + 1})", "float": f"{lo} + {u} * ({hi} - {lo})",
                 "log": f"exp(ln({lo}) + {u} * (ln({hi}) - ln({lo})))"}[kind]
        want = [r[0] for r in duckdb.sql(f"select {value} from range(40) r(t) order by t").fetchall()]
        np.testing.assert_allclose(lab.trial_table(spark, "gbt_a", 40, per_fit=10).orderBy("trial").toPandas()[name], np.array(want, float))
    shared = lab.trial_table(spark, "gbt_a", 40, per_fit=10).toPandas()
    assert shared["stepSize"].nunique() == 4 and shared["maxIter"].nunique() > 20


SPACE = {"maxIter": ("int", 2, 6), "maxDepth": ("int", 2, 3), "stepSize": ("log", 0.1, 0.5)}


def test_one_fit_gives_the_error_of_every_tree_count(spark, data):
    _, df = data
    table = lab.prepare_folds(df, FOLDS[:2], HOURLY, FEATURES_V3, [feat.EXTREME_EVENTS])
    build = lambda n: lambda: lab.boosted_trees({"maxIter": n, "maxDepth": 3, "stepSize": 0.3})
    whole = lab.staged_fit(table, FOLDS[1], build(6))
    assert 1 <= len(whole.errors) <= 6 and all(a >= b for a, b in zip(whole.errors, whole.errors[1:]))
    for n in range(1, len(whole.errors) + 1):
        fitted = lab.with_inputs(build(n)(), table.features).fit(table.part(FOLDS[1], "train").select("label", *table.features))
        gap = F.col("label") - F.col("residual_pred")
        direct = fitted.transform(table.part(FOLDS[1], "val")).agg(F.avg(gap * gap)).first()[0]
        np.testing.assert_allclose(whole.errors[n - 1], direct, rtol=1e-9)


def test_search_and_champion(spark, data):
    _, df = data
    table = lab.prepare_folds(df, FOLDS[:2], HOURLY, FEATURES_V3, [feat.EXTREME_EVENTS])
    study = lab.random_search(table, "gbt_a", 4, space=SPACE, per_fit=2)
    assert study.best_value == min(v for _, v in study.trials)
    for params, value in study.trials[:2]:
        oof = lab.cross_validate(table, lambda: lab.boosted_trees(params), "gbt_a", stop=True)
        assert np.isclose(forecast.oof_metrics(oof).first()["rmse"], value)
    linear = lab.random_search(table, "linear", 3)
    assert np.isclose(linear.best_value, forecast.oof_metrics(lab.cross_validate(table, lab.linear_model, "linear")).first()["rmse"])
    best = lab.choose_champion([study, linear], df, FOLDS[:2], HOURLY, FEATURES_V3)
    assert best.family == min((study, linear), key=lambda s: s.best_value).family
    assert best.use_holiday == (best.holiday_rmse < best.oof_rmse)


def test_a_search_that_was_stopped_goes_on(spark, data, tmp_path, monkeypatch):
    _, df = data
    table = lab.prepare_folds(df, FOLDS[:2], HOURLY, ["temp_c", "load_lag_24"])
    ledger, fits, real = str(tmp_path / "ledger"), [], lab.staged_fit

    def counted(table, fold, build):
        if len(fits) == limit:
            raise RuntimeError("the driver is gone")
        fits.append(fold.fold_id)
        return real(table, fold, build)

    monkeypatch.setattr(lab, "staged_fit", counted)
    limit = 3
    with pytest.raises(RuntimeError):
        lab.random_search(table, "gbt_a", 4, space=SPACE, parallel=1, ledger=ledger, per_fit=2)
    limit = 99
    resumed = lab.random_search(table, "gbt_a", 4, space=SPACE, parallel=1, ledger=ledger, per_fit=2)
    assert len(fits) == 4  # two structures in two folds: none of them twice
    again = lab.random_search(table, "gbt_a", 4, space=SPACE, parallel=1, ledger=ledger, per_fit=2)
    assert len(fits) == 4 and again.trials == resumed.trials
    fresh = lab.random_search(table, "gbt_a", 4, space=SPACE, per_fit=2)
    np.testing.assert_allclose([v for _, v in fresh.trials], [v for _, v in resumed.trials])


def test_the_fold_table_does_not_grow_with_folds(spark, data):
    _, df = data
    first = FOLDS[0]
    many = [replace(first, fold_id=i) for i in range(1, 41)]
    sizes = [sum(Path(f.removeprefix("file://")).stat().st_size for f in lab.prepare_folds(df, folds, HOURLY, ["temp_c"]).base.inputFiles())
             for folds in (many[:2], many)]
    assert sizes[1] < 1.1 * sizes[0]
    table = lab.prepare_folds(df, many, HOURLY, ["temp_c"])
    assert table.expanded("val").count() == 40 * table.part(many[7], "val").count()
    with pytest.raises(ValueError):
        lab.prepare_folds(df, [first] * 64, HOURLY, ["temp_c"])
