"""Approximate nearest neighbours in cells of random projections, for tables on which the exact search is too dear.

Each of several tables cuts the train rows of a group anew: a cell of over ``leaf`` rows is split at quantiles of
a random projection, again and again, until its parts are small. A query falls into one cell of each table and is
held against the rows there, so it visits at most about ``tables * leaf`` of them however many there are. Cells hold
alike many rows wherever these crowd; only queries can, and those of one cell are split into pieces.

Cells follow random projection trees (Dasgupta and Freund, "Random projection trees and low dimensional manifolds",
STOC 2008), split level by level: a level is one aggregation with mergeable sketches and one join with its cuts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadweave.config import SEED
from loadweave.operators.neighbours import PIECE, _search
from loadweave.session import materialise

#: Levels beyond those that even cuts need, as the quantiles are approximate.
SLACK = 4


def _along(directions: np.ndarray) -> Column:
    """The projection of a row on the direction of its table."""
    own = F.element_at(F.lit(directions.tolist()), F.col("_table") + 1)
    return F.aggregate(F.zip_with("_x", own, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)


def place(rows: DataFrame, group: Sequence[str], features: int, tables: int, leaf: int, arity: int, seed: int = SEED) -> DataFrame:
    """Rows with ``_x`` and ``_train``, once for each ``_table``, with the ``_cell`` they fall into. Only train rows make cuts.

    Cuts are stored level by level and rows are placed again from them: what is stored grows with the cells, not
    with rows times levels.
    """
    group, rng = list(group), np.random.default_rng(seed)
    largest = rows.where("_train").groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    levels = math.ceil(math.log(max(largest / leaf, 1), arity)) + SLACK if largest > leaf else 0
    at = [*group, "_table", "_cell"]
    shares = [(i + 1) / arity for i in range(arity - 1)]
    placed = rows.withColumn("_table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn("_cell", F.lit(0).cast("long"))
    for _ in range(levels):
        placed = placed.withColumn("_p", _along(rng.normal(size=(tables, features))))
        # a cut at the greatest value would leave a cell without train rows behind it
        found = (placed.where("_train").groupBy(*at)
                 .agg(F.count(F.lit(1)).alias("_n"), F.max("_p").alias("_most"), F.percentile_approx("_p", shares, 1000).alias("_cuts"))
                 .where(F.col("_n") > leaf)
                 .select(*at, F.filter("_cuts", lambda c: c < F.col("_most")).alias("_cuts")))
        cuts = materialise(found, "cuts")
        if cuts.isEmpty():
            return placed.drop("_p")
        part = F.col("_cell") * arity + 1 + F.size(F.filter("_cuts", lambda c: c < F.col("_p")))
        placed = placed.join(cuts, at, "left").withColumn("_cell", F.coalesce(part, "_cell")).drop("_p", "_cuts")
    return placed


def nearest_hashed(train: DataFrame, queries: DataFrame, group: Sequence[str], features: Sequence[str], k: int, train_id: str,
                   query_id: str, label: str, tables: int = 10, leaf: int = 256, arity: int = 4, piece: int = PIECE) -> DataFrame:
    """As :func:`neighbours.nearest`, but a neighbour that shares no cell with its query is missed: the distances are
    exact, the choice is not. ``recall`` measures it; more tables or larger leaves raise it.

    Every query of a group with train rows gets k of them, or all if there are fewer. Rows are stored once a table.
    """
    group = list(group)
    leaf = max(leaf, 2 * arity * k)  # so that parts of a split cell hold k rows
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("_x")
    known = train.select(*group, F.col(train_id).cast("string").alias("_id"), x, F.col(label).cast("double").alias("_y"))
    # of rows at one point only the k with the smallest ids can be chosen
    same_point = Window.partitionBy(*group, "_x").orderBy("_id")
    known = known.withColumn("_rn", F.row_number().over(same_point)).where(F.col("_rn") <= k).drop("_rn")
    asked = queries.select(*group, F.col(query_id).cast("string").alias("_id"), x, F.lit(None).cast("double").alias("_y"))
    rows = materialise(known.withColumn("_train", F.lit(True)).unionByName(asked.withColumn("_train", F.lit(False))), "rows")
    placed = materialise(place(rows, group, len(features), tables, leaf, arity), "placed", "_train")
    held = placed.where("_train").drop("_train").withColumnRenamed("_id", "_tid")
    visits = placed.where("not _train").drop("_train", "_y").withColumnRenamed("_id", "_qid")
    found = _search(held, visits, [*group, "_table"], k, piece)
    once = found.groupBy("_qid", "_tid").agg(F.first("_d").alias("_d"), F.first("_y").alias("_y"))
    ranked = Window.partitionBy("_qid").orderBy("_d", "_tid")
    return once.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: the exact neighbours ``n_exact`` and how many of them were found, ``n_found``. A row as near as the farthest
    exact one counts, so that ties are no misses."""
    reach = exact.groupBy("_qid").agg(F.count(F.lit(1)).alias("n_exact"), F.max("_d").alias("_reach"))
    hits = reach.join(found.select("_qid", "_d"), "_qid", "left")
    within = F.count_if(F.col("_d") <= F.col("_reach") * (1 + 1e-12))
    return hits.groupBy("_qid").agg(F.first("n_exact").alias("n_exact"), within.alias("n_found"))
