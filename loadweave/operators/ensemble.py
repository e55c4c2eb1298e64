"""Greedy ensembles of out-of-fold forecasts.

For weights that sum to one, the blend's squared error is ``w' E w`` with ``E[i, j]`` the sum over
rows of error_i * error_j. One Spark pass yields the small matrix ``E``; the greedy search then works
on it alone, whatever the number of rows. Other measures are evaluated by Spark, one job per round.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.config import PEAK_SHARE
from loadweave.functions.scalar import linspace, normalise
from loadweave.operators.forecast import blend
from loadweave.operators.quantiles import exact_quantiles


def error_gram(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Sums of products of errors for each pair of models, plus the row count."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]]
    err = {m: F.col(m) - F.col("y_true") for m in models}
    sums = wide.agg(*[F.sum(err[a] * err[b]).alias(f"s_{i}") for i, (a, b) in enumerate(pairs)],
                    F.count(F.lit(1)).alias("n_rows"))
    cells = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"s_{i}").alias("sum_ee"))
             for i, (a, b) in enumerate(pairs)]
    return sums.select(F.inline(F.array(*cells)), "n_rows")


@dataclass
class Gram:
    """The collected matrix: k * (k + 1) / 2 numbers for k models."""

    models: list[str]
    cell: dict[tuple[str, str], float]
    n: int

    @classmethod
    def collect(cls, wide: DataFrame, models: Sequence[str]) -> Gram:
        rows = error_gram(wide, models).collect()
        if not rows[0]["n_rows"]:
            raise ValueError("no row is forecast by every model")
        cell = {}
        for r in rows:
            cell[r["model_a"], r["model_b"]] = cell[r["model_b"], r["model_a"]] = r["sum_ee"]
        return cls(list(models), cell, rows[0]["n_rows"])

    def rmse(self, weights: dict[str, float]) -> float:
        used = [(m, w) for m, w in weights.items() if w]
        total = sum(wa * wb * self.cell[a, b] for a, wa in used for b, wb in used)
        return math.sqrt(max(total, 0.0) / self.n)


@dataclass
class Ensemble:
    weights: dict[str, float]
    selected: list[str]
    history: list[float] = field(default_factory=list)
    solo: dict[str, float] = field(default_factory=dict)
    score: float | None = None

    def column(self) -> Column:
        return blend(self.weights)


def vote_ensemble(gram: Gram, rounds: int = 50, tol: float = 1e-6) -> Ensemble:
    """Add one equal vote at a time, with replacement, while RMSE still falls by more than ``tol``."""
    solo = {m: gram.rmse({m: 1.0}) for m in gram.models}
    selected = [min(solo, key=solo.get)]
    history = [solo[selected[0]]]
    for _ in range(rounds):
        size = len(selected) + 1
        trials = {m: gram.rmse({k: v / size for k, v in Counter([*selected, m]).items()}) for m in gram.models}
        best = min(trials, key=trials.get)
        if not trials[best] < history[-1] - tol:
            break
        selected.append(best)
        history.append(trials[best])
    weights = {m: c / len(selected) for m, c in Counter(selected).most_common()}
    return Ensemble(weights, selected, history, solo, history[-1])


Scorer = Callable[[list[dict[str, float]]], list[float]]


def spark_scorer(wide: DataFrame, metric: Callable[[Column, Column], Column], batch: int = 200) -> Scorer:
    """Scores many weightings with one aggregation per batch; the rows are read, never copied."""
    def score(candidates: list[dict[str, float]]) -> list[float]:
        out: list[float] = []
        for at in range(0, len(candidates), batch):
            part = candidates[at:at + batch]
            row = wide.agg(*[metric(F.col("y_true"), blend(w)).alias(f"m{i}") for i, w in enumerate(part)]).first()
            out.extend(row)
        return out
    return score


def mix_scorer(wide: DataFrame, models: Sequence[str], error: Callable[[Column, Column], Column]) -> Scorer:
    """Scores any number of weightings by the mean of ``error`` over the rows, in one aggregation. The weights
    are one array in the plan and each row's errors another, so the plan doesn't grow with the candidates."""
    def score(candidates: list[dict[str, float]]) -> list[float]:
        held = json.dumps([[float(w.get(m, 0.0)) for m in models] for w in candidates])
        mixes = F.from_json(F.lit(held), "array<array<double>>")
        errors = F.transform(mixes, lambda w: error(F.col("y_true"), reduce(
            lambda a, b: a + b, [w[i] * F.col(m) for i, m in enumerate(models)])))
        rows = wide.select(F.posexplode(errors).alias("mix", "e")).groupBy("mix").agg(F.avg("e").alias("score")).collect()
        if len(rows) != len(candidates):
            raise ValueError("no row is forecast by every model")
        return [r["score"] for r in sorted(rows)]
    return score


def peak_rows(wide: DataFrame, share: float = PEAK_SHARE) -> DataFrame:
    """Rows whose actual value is among the highest ``share`` of all, by the exact quantile."""
    cut = exact_quantiles(wide.select("y_true", F.lit(0).alias("all")), ["all"], {"cutoff": ("y_true", 1 - share)}, few_groups=True).first()
    return wide.where(F.col("y_true") >= F.lit(cut["cutoff"])) if cut else wide


def blend_ensemble(score: Scorer, models: Sequence[str], max_models: int | None = None, tolerance: float = 1e-6,
                   negative_weights: bool = False, alphas: Sequence[float] | None = None) -> Ensemble:
    """Repeatedly mix in the one model and share that lower the score most.

    A step takes ``(1 - a) * current + a * model``. Without ``negative_weights``, a share below zero
    is tried only for a model already in the mix, and only down to its current weight.
    """
    models = list(models)
    grid = list(alphas) if alphas is not None else (
        linspace(-1, 1, 201) if negative_weights else linspace(0, 1, 101))
    solo = dict(zip(models, score([{m: 1.0} for m in models])))
    first = min(solo, key=solo.get)
    weights, selected, history = {first: 1.0}, [first], [solo[first]]
    while max_models is None or len(selected) < max_models:
        steps = []
        for m in models:
            held = weights.get(m, 0.0)
            for a in grid:
                if negative_weights or a >= 0 or (held > 0 and a >= -held):
                    mixed = {k: (1 - a) * w for k, w in weights.items()}
                    mixed[m] = mixed.get(m, 0.0) + a
                    steps.append((m, mixed))
        scores = score([w for _, w in steps])
        best = min(range(len(steps)), key=scores.__getitem__)
        if not scores[best] < history[-1] or history[-1] - scores[best] < tolerance:
            break
        name, mixed = steps[best]
        weights = dict(zip(mixed, normalise(list(mixed.values()))))
        selected.append(name)
        history.append(scores[best])
    weights = dict(zip(weights, normalise(list(weights.values()))))
    return Ensemble(weights, selected, history, solo, score([weights])[0])


def gram_scorer(gram: Gram) -> Scorer:
    return lambda candidates: [gram.rmse(w) for w in candidates]
