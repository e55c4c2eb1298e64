import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.config import GATE_COLUMNS
from loadweave.functions.scalar import equal_width_bin, interpolate, linspace, nan_to_null, normalise
from loadweave.operators import profile, quality
from loadweave.operators.quantiles import exact_quantiles

rng = np.random.default_rng(3)


@pytest.mark.parametrize("accuracy,slices", [(10_000, 2048), (50, 4), (20, 1)])
def test_quantiles_are_exact(spark, accuracy, slices):
    n = 4000
    hot = np.where(rng.random(n) < 0.4, 5.0, rng.lognormal(1, 2, n))  # one value holds a third of the rows
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]), "x": hot, "y": rng.normal(size=n)})
    pdf.loc[::17, "y"] = np.nan
    df = nan_to_null(spark.createDataFrame(pdf)).repartition(7)
    wanted = {"x05": ("x", 0.05), "x95": ("x", 0.95), "x50": ("x", 0.5), "y33": ("y", 0.333), "y0": ("y", 0.0), "y1": ("y", 1.0)}
    for few in (True, False):
        got = exact_quantiles(df, ["g"], wanted, accuracy, slices, few).toPandas().set_index("g").sort_index()
        for name, (c, q) in wanted.items():
            np.testing.assert_allclose(got[name], pdf.groupby("g")[c].quantile(q).sort_index(), rtol=1e-12)


def test_missing_values_are_null_not_nan(spark):
    df = nan_to_null(spark.createDataFrame(pd.DataFrame({"a": [1.0, np.nan], "s": ["x", "y"]})))
    assert df.where(F.col("a").isNull()).count() == 1 and df.agg(F.max("a")).first()[0] == 1.0


def test_small_functions(spark):
    assert linspace(-1, 1, 201)[100] == 0 and np.allclose(linspace(0, 1, 101), np.linspace(0, 1, 101))
    assert normalise([0, 0]) == [0, 0] and normalise([1, 3]) == [0.25, 0.75]
    df = spark.range(-2, 13).select(F.col("id").cast("double").alias("x"))
    got = [r[0] for r in df.select(interpolate(F.col("x"), {0: 1, 4: 9, 10: 3})).collect()]
    np.testing.assert_allclose(got, np.interp(range(-2, 13), [0, 4, 10], [1, 9, 3]))


def gate(spark, rows):
    return spark.createDataFrame(rows, "timestamp string, actual_load_mw double, temp_c double, humidity_pct double, precip_mm double")


GOOD = ("2024-01-01 00:00:00+00:00", 7000.0, 20.0, 50.0, 0.0)


def failed(df, **kw):
    return [(r["expectation"], r["column_name"]) for r in
            quality.evaluate(df, quality.gate_suite(rows=kw.pop("rows", 1))).where("not success").collect()]


def test_gate_passes_and_each_check_fails_alone(spark):
    assert failed(gate(spark, [GOOD])) == []
    assert len(quality.gate_suite()) == 13
    bad = [
        (("2024-01-01 00:00:00+05:30", *GOOD[1:]), [("matches", "timestamp")]),
        ((GOOD[0], 499.9, *GOOD[2:]), [("between", "actual_load_mw")]),
        ((GOOD[0], 7000.0, 50.1, *GOOD[3:]), [("between", "temp_c")]),
        ((*GOOD[:3], 100.5, 0.0), [("between", "humidity_pct")]),
        ((*GOOD[:4], -0.1), [("between", "precip_mm")]),
        ((*GOOD[:4], float("nan")), [("between", "precip_mm")]),
        ((*GOOD[:4], None), [("not_null", "precip_mm")]),
    ]
    for row, want in bad:
        assert failed(gate(spark, [row])) == want
    assert failed(gate(spark, [GOOD, GOOD])) == [("row_count", None)]
    bounds = [c.params for c in quality.gate_suite() if c.kind == "row_count"][0]
    assert bounds == {"min": 89907, "max": 95468}


def test_gate_reports_shape_and_never_raises(spark, tmp_path):
    df = gate(spark, [GOOD])
    assert set(failed(df.drop("temp_c"))) == {
        ("column_count", None), ("column_set", None), ("not_null", "temp_c"), ("between", "temp_c")}
    renamed = df.toDF("a", "b", "c", "d", "e")
    assert quality.rename_if_same_width(renamed, GATE_COLUMNS).columns == GATE_COLUMNS
    assert quality.rename_if_same_width(renamed.drop("a"), GATE_COLUMNS).columns == ["b", "c", "d", "e"]
    ok, results = quality.validate(df, quality.gate_suite(rows=1))
    assert ok and results.count() == 13
    assert quality.validate(renamed, quality.gate_suite(rows=1), positional=True)[0]
    assert not quality.validate(renamed, quality.gate_suite(rows=1))[0]
    assert quality.run_gate(spark, str(tmp_path / "none.csv")) is False
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "g"))
    assert quality.run_gate(spark, str(tmp_path / "g"), quality.gate_suite(rows=1))
    assert not quality.run_gate(spark, str(tmp_path / "g"))
    assert len(quality.joined_suite()) == 3 + 9 + 4 + 1


def test_output_problems(spark):
    df = spark.createDataFrame([(1.0, "x", 2.0), (None, "y", 3.0)], "a double, b string, trend_idx double")
    found = {tuple(r) for r in quality.output_problems(df, ["a", "c"]).collect()}
    assert found == {("null", "a", 1), ("absent", "c", None), ("surplus", "b", None), ("text", "b", None)}
    assert quality.output_problems(df.select("trend_idx"), []).isEmpty()


def frame(spark, n=600):
    pdf = pd.DataFrame({
        "wide": rng.normal(0, 3, n), "few": rng.integers(0, 6, n) * 1.0, "const": 2.0,
        "kind": rng.choice(["hot", "cold", "mild"], n, p=[0.6, 0.3, 0.1]), "y": rng.normal(100, 5, n)})
    pdf["edge"] = np.linspace(0, 1, 26)[rng.integers(0, 26, n)]
    pdf.loc[0, "wide"] = np.nan
    pdf.loc[1, "wide"] = np.inf
    return pdf, spark.createDataFrame(pdf)


def test_profile_matches_numpy(spark):
    pdf, df = frame(spark)
    got = profile.numeric_profile(df, ["wide", "few", "edge", "const"], "y", n_bins=10).toPandas()
    for c in ("wide", "edge"):
        part = got[got.feature == c].sort_values("bin_lo")
        ok = np.isfinite(pdf[c])
        x, y = pdf.loc[ok, c].to_numpy(), pdf.loc[ok, "y"].to_numpy()
        bins = np.linspace(x.min(), x.max(), 11)
        assert part["n_rows"].tolist() == np.histogram(x, bins)[0].tolist()
        where = np.digitize(x, bins) - 1
        np.testing.assert_allclose(part["mean_target"], [y[where == j].mean() for j in range(10)])
    few = got[got.feature == "few"].sort_values("bin_lo")
    assert (few["mode"] == "value").all() and few["n_rows"].tolist() == pdf["few"].value_counts().sort_index().tolist()
    assert len(got[got.feature == "const"]) == 1
    both = profile.feature_profile(nan_to_null(df), ["few", "kind"], "y")
    assert both.where("feature = 'kind'").count() == 3


def test_bins_agree_with_their_edges(spark):
    x = np.linspace(0.1, 0.7, 61)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = [r[0] for r in df.select(equal_width_bin(F.col("x"), F.lit(0.1), F.lit(0.7), 6)).collect()]
    edges = 0.1 + np.arange(6) * ((0.7 - 0.1) / 6)
    assert got == [6 if v == 0.7 else int(np.searchsorted(edges, v, side="right") - 1) for v in x]


def test_category_order(spark):
    _, df = frame(spark)
    order = lambda o: [r["category"] for r in profile.category_profile(df, "kind", "y", o).collect()]
    assert order(["mild", "absent"]) == ["mild", "hot", "cold"] and order(None) == ["cold", "hot", "mild"]


def test_distributions_share_bins(spark):
    pdf, df = frame(spark)
    df = df.where(~F.isnan("wide") & (F.abs("wide") < 1e9))
    a, b = df.limit(400), df.where("kind <> 'mild'")
    got = profile.train_test_distribution(a, b, ["few", "kind", "const", "nope"], 5).toPandas()
    assert set(got.feature) == {"few", "kind", "const"} and len(got[got.feature == "const"]) == 1
    mild = got[got.category == "mild"].iloc[0]
    assert mild["n_test"] == 0 and mild["n_train"] > 0
    hist = profile.target_histogram(df, "y", 100).toPandas()
    y = df.select("y").toPandas()["y"]
    assert hist.sort_values("bin")["n_rows"].tolist() == np.histogram(y, 100)[0].tolist()


def test_describe_matches_pandas(spark):
    pdf, df = frame(spark)
    got = profile.describe(df, ["y", "few"]).toPandas().set_index("column_name")
    want = pdf[["y", "few"]].describe().T.loc[got.index]
    np.testing.assert_allclose(got.to_numpy(float), want[["count", "mean", "std", "min", "25%", "50%", "75%", "max"]].to_numpy())
