"""Exact k-nearest-neighbour regression without comparing every pair.

Train rows are put into cells around pivot rows, as many as the root of the largest group. A query first looks at its
nearest cells that hold k rows; the k-th distance found there bounds the rest of the search. By the
triangle inequality, a cell whose nearest possible row lies beyond that bound cannot matter and is
not visited. Cells and the queries visiting them are split into pieces of limited size, so one hot
cell spreads over many tasks, and each piece returns at most k rows per query.

The pruning follows published work on k-nearest-neighbour joins over Voronoi cells (Lu et al.,
"Efficient Processing of k Nearest Neighbor Joins using MapReduce", VLDB 2012).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loadweave.session import materialise

PIECE = 20_000
CHUNK = 256


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j][:, None] - b[:, j][None, :]) ** 2
    return np.sqrt(total)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _pick_pivots(train: DataFrame, n: int) -> np.ndarray:
    """``n`` rows, chosen by hash: any choice gives the same answer."""
    rows = (
        train.select("_x").distinct().withColumn("_h", F.xxhash64("_x")).orderBy("_h").limit(n).collect()
    )
    return np.array([r["_x"] for r in rows], dtype=float)


def _home_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    @F.pandas_udf("struct<_cell: int, _r: double>")
    def assign(x: pd.Series) -> pd.DataFrame:
        parts = []
        for start in range(0, len(x), CHUNK):
            d = _distances(_matrix(x.iloc[start:start + CHUNK]), pivots)
            cell = d.argmin(axis=1)
            parts.append(pd.DataFrame({"_cell": cell.astype("int32"), "_r": d[np.arange(len(d)), cell]}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"_cell": [], "_r": []})

    return df.withColumn("_a", assign("_x")).select("*", "_a._cell", "_a._r").drop("_a")


def _plan_visits(queries: DataFrame, cells: DataFrame, pivots: np.ndarray, group: Sequence[str], k: int, first: bool,
                 piece: int) -> DataFrame:
    """Cells each query must look at: the nearest holding k rows, or those the bound leaves over.

    A group's queries are cut into pieces; each piece gets the group's cell table once.
    """
    kept = [*group, "_qid", "_x"]
    pieces = queries.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("_np"))
    query_parts = queries.join(pieces, group).withColumn("_p", F.pmod(F.xxhash64("_qid"), F.col("_np")).cast("int"))
    cell_parts = cells.join(pieces, group).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_np") - 1)))

    def choose(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if part.empty or known.empty:
            return pd.DataFrame(columns=[*kept, "_cell"])
        known = known.sort_values("_cell")
        ids, counts, inner, outer = (known[c].to_numpy() for c in ("_cell", "_n", "_rmin", "_rmax"))
        found = []
        for start in range(0, len(part), CHUNK):
            rows = part.iloc[start:start + CHUNK]
            d = _distances(_matrix(rows["_x"]), pivots)
            away = d[:, ids]
            near = np.argsort(away, axis=1, kind="stable")
            enough = (np.cumsum(counts[near], axis=1) < min(k, counts.sum())).sum(axis=1)
            chosen = np.zeros(away.shape, dtype=bool)
            np.put_along_axis(chosen, near, np.arange(len(ids)) <= enough[:, None], axis=1)
            if not first:
                home = d.min(axis=1)[:, None]
                least = np.maximum(np.maximum(away - outer, inner - away), np.maximum((away - home) / 2, 0.0))
                # A relative margin keeps rounding from pruning a row that ties with the bound.
                limit = rows["_bound"].to_numpy()[:, None] * (1 + 1e-9) + 1e-12
                chosen = (least <= limit) & ~chosen
            at, cell = np.nonzero(chosen)
            found.append(rows[kept].iloc[at].assign(_cell=ids[cell]))
        return pd.concat(found)

    schema = StructType([*queries.select(*kept).schema.fields, StructField("_cell", IntegerType())])
    at = [*group, "_p"]
    # Fresh column ids: both sides stem from the same tables, which a cogroup by name cannot tell apart.
    left, right = query_parts.toDF(*query_parts.columns), cell_parts.toDF(*cell_parts.columns)
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(choose, schema)


def _search(train: DataFrame, visits: DataFrame, group: Sequence[str], k: int, piece: int) -> DataFrame:
    """Best k rows per (query, piece of a cell)."""
    at = [*group, "_cell"]
    sizes = (
        train.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).join(
            visits.groupBy(*at).agg(F.count(F.lit(1)).alias("_m")), at)
        .select(*at, F.ceil(F.col("_n") / piece).cast("int").alias("_tp"),
                F.ceil(F.col("_m") / piece).cast("int").alias("_qp"))
    )
    split = [*at, "_t", "_q"]
    train_parts = (
        train.join(sizes, at)
        .withColumn("_t", F.pmod(F.xxhash64("_tid"), F.col("_tp")).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_qp") - 1)))
        .select(*split, "_tid", "_x", "_y")
    )
    query_parts = (
        visits.join(sizes, at)
        .withColumn("_q", F.pmod(F.xxhash64("_qid"), F.col("_qp")).cast("int"))
        .withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_tp") - 1)))
        .select(*split, "_qid", "_x")
    )

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["_qid", "_tid", "_d", "_y"]
        if queries.empty or rows.empty:
            return pd.DataFrame(columns=columns)
        tid, y = rows["_tid"].to_numpy(), rows["_y"].to_numpy()
        order = np.argsort(tid, kind="stable")  # ties in distance go to the smaller id
        tid, y, x = tid[order], y[order], _matrix(rows["_x"])[order]
        found = []
        for start in range(0, len(queries), CHUNK):
            part = queries.iloc[start:start + CHUNK]
            d = _distances(_matrix(part["_x"]), x)
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            found.append(pd.DataFrame({
                "_qid": np.repeat(part["_qid"].to_numpy(), top.shape[1]),
                "_tid": tid[top].ravel(),
                "_d": np.take_along_axis(d, top, axis=1).ravel(),
                "_y": y[top].ravel(),
            }))
        return pd.concat(found)[columns]

    # Fresh column ids: both sides stem from the same tables, which a cogroup by name cannot tell apart.
    left, right = query_parts.toDF(*query_parts.columns), train_parts.toDF(*train_parts.columns)
    return left.groupBy(*split).cogroup(right.groupBy(*split)).applyInPandas(
        best, "_qid string, _tid string, _d double, _y double")


def nearest(train: DataFrame, queries: DataFrame, group: Sequence[str], features: Sequence[str], k: int,
            train_id: str, query_id: str, label: str, pivots: int | None = None, piece: int = PIECE) -> DataFrame:
    """The k nearest train rows of each query within its group: ``(_qid, _tid, _d, _y, _rank)``.

    Ids are text, unique within the frame for queries, unique within a group for train rows. The
    number of pivots is the root of the largest group's size, so that finding a row's cell and searching
    it cost alike; they are the only rows the driver sees. Steps that are read more than once are stored.
    """
    group = list(group)
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("_x")
    train = train.select(*group, F.col(train_id).cast("string").alias("_tid"), x, F.col(label).alias("_y"))
    queries = queries.select(*group, F.col(query_id).cast("string").alias("_qid"), x)
    if pivots is None:
        largest = train.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        pivots = max(1, math.isqrt(largest))
    # Of rows at one and the same point only the k with the smallest ids can ever be chosen. The rank
    # limit is applied before the shuffle too, so a point shared by many rows shrinks to k per task.
    same_point = Window.partitionBy(*group, "_x").orderBy("_tid")
    train = train.withColumn("_rn", F.row_number().over(same_point)).where(F.col("_rn") <= k).drop("_rn")
    centres = _pick_pivots(train, pivots)
    placed = materialise(_home_cells(train, centres), "placed")
    cells = materialise(placed.groupBy(*group, "_cell").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_rmin"), F.max("_r").alias("_rmax")), "cells")
    placed = placed.drop("_r")

    def top(df: DataFrame) -> DataFrame:
        ranked = Window.partitionBy("_qid").orderBy("_d", "_tid")
        return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= k)

    first = materialise(_plan_visits(queries, cells, centres, group, k, True, piece), "visits")
    opening = top(_search(placed, first, group, k, piece))
    if len(centres) == 1:
        return opening
    opening = materialise(opening.drop("_rank"), "opening")
    bounds = opening.groupBy("_qid").agg(F.max("_d").alias("_bound"))
    rest = _plan_visits(queries.join(bounds, "_qid"), cells, centres, group, k, False, piece)
    return top(opening.unionByName(_search(placed, materialise(rest, "visits"), group, k, piece)))


def weighted_vote(found: DataFrame) -> DataFrame:
    """Distance-weighted mean label per query; exact matches, if any, decide alone."""
    exact = F.col("_d") == 0
    return found.groupBy("_qid").agg(
        F.coalesce(
            F.avg(F.when(exact, F.col("_y"))),
            F.sum(F.when(~exact, F.col("_y") / F.col("_d"))) / F.sum(F.when(~exact, 1.0 / F.col("_d"))),
        ).alias("prediction"))
