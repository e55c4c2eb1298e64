"""Train/test splits and expanding-window folds with a purge between train and validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.config import FIRST_TRAIN, FIRST_VALIDATION, N_FOLDS, PURGE_DAYS, TEST_START_LOCAL
from loadweave.functions.timefn import local_midnight_utc, ntz

Masked = Callable[[Column], Column]


@dataclass(frozen=True)
class Fold:
    """Both ends of each range are inclusive."""

    fold_id: int
    tr_start: datetime
    tr_end: datetime
    val_start: datetime
    val_end: datetime

    def in_train(self, ts: Column) -> Column:
        return ts.between(ntz(self.tr_start), ntz(self.tr_end))

    def in_validation(self, ts: Column) -> Column:
        return ts.between(ntz(self.val_start), ntz(self.val_end))


def expanding_folds(first_train: str = FIRST_TRAIN, first_validation: str = FIRST_VALIDATION,
                    n: int = N_FOLDS, purge_days: int = PURGE_DAYS, step: int = 3600) -> list[Fold]:
    """A common train start, one validation year per fold, a purge before each of them."""
    start = datetime.fromisoformat(first_train)
    first = datetime.fromisoformat(first_validation)
    one = timedelta(seconds=step)
    folds = []
    for i in range(n):
        val, nxt = first.replace(year=first.year + i), first.replace(year=first.year + i + 1)
        folds.append(Fold(i + 1, start, val - timedelta(days=purge_days) - one, val, nxt - one))
    return folds


def validation_overlaps(folds: Sequence[Fold]) -> bool:
    ordered = sorted(folds, key=lambda f: f.val_start)
    return any(a.val_end >= b.val_start for a, b in zip(ordered, ordered[1:]))


def fold_roles(df: DataFrame, folds: Sequence[Fold], ts: str = "timestamp",
               roles: Sequence[str] = ("train", "val")) -> DataFrame:
    """Each row once per fold and role it plays. The folds are literals in the plan, so this is a
    narrow generator: no join, no shuffle."""
    t = F.col(ts)
    tagged = [
        F.when(test, F.struct(F.lit(f.fold_id).alias("fold_id"), F.lit(role).alias("role")))
        for f in folds
        for role, test in (("train", f.in_train(t)), ("val", f.in_validation(t))) if role in roles
    ]
    return df.select("*", F.inline(F.filter(F.array(*tagged), lambda s: s.isNotNull())))


def fold_sizes(df: DataFrame, folds: Sequence[Fold], keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    return (
        fold_roles(df, folds, ts).groupBy(*keys, "fold_id", "role")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    )


def fit_by_fold(df: DataFrame, folds: Sequence[Fold], keys: Sequence[str],
                stats: Mapping[str, Callable[[Masked], Column]], ts: str = "timestamp") -> DataFrame:
    """Aggregates over every fold's train rows, in one pass over the input.

    Train ranges are nested, so copying rows per fold would multiply the shuffle. Instead each
    statistic is written once per fold over masked columns, and the wide result is turned into one
    row per (keys, fold). ``stats`` maps a name to a function of the mask, e.g.
    ``{"mean": lambda m: F.avg(m(F.col("y")))}``.
    """
    per_fold = []
    for f in folds:
        inside = f.in_train(F.col(ts))
        mask = lambda c, inside=inside: F.when(inside, c)
        per_fold.append(F.struct(F.lit(f.fold_id).alias("fold_id"), *[fn(mask).alias(k) for k, fn in stats.items()]))
    grouped = df.groupBy(*keys).agg(F.array(*per_fold).alias("_fits"))
    return grouped.select(*keys, F.inline("_fits"))


@dataclass(frozen=True)
class Split:
    train: DataFrame
    test: DataFrame
    train_end: datetime
    test_start: datetime


def chronological_split(df: DataFrame, purge_days: float = PURGE_DAYS, test_start_local: str = TEST_START_LOCAL,
                        ts: str = "timestamp") -> Split:
    """Test from a local midnight on; train up to a purge before it."""
    test_start = local_midnight_utc(test_start_local)
    return split_at(df, test_start - timedelta(days=purge_days), test_start, ts)


def split_at(df: DataFrame, train_end: datetime, test_start: datetime, ts: str = "timestamp") -> Split:
    """Explicit inclusive bounds, e.g. an unpurged split for exploration."""
    t = F.col(ts)
    return Split(df.where(t <= ntz(train_end)), df.where(t >= ntz(test_start)), train_end, test_start)
