"""Exact top-k by inner product, pruned by norms and by rotated partial sums.

Candidates are dealt into chunks by descending length. The longest, as many as a chunk takes, give each query a first bound:
its k-th best score there, and the id up to which equal scores still count. A chunk whose longest vector times the query's length stays below the bound
can't hold a better one, so a query block meets only the chunks that are long enough. Inside a chunk,
vectors and queries are rotated to the axes of the candidates' second moments (an SVD of the d x d matrix
that one aggregation sums up), the first axes give a partial score, and what the rest can add is at most
the product of the residual lengths (Cauchy-Schwarz). Only pairs that may still reach the bound are scored,
in integers. Blocks of queries meet chunks of candidates through a join on block numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadweave.llm.common import small_batches as few_rows
from loadweave.session import materialise

#: Candidates in a chunk, queries in a block, candidates scored between two updates of the bounds.
CHUNK, BLOCK, STEP = 8192, 2048, 1024
#: Rounding of the rotated sums stays far below this share of the product of the lengths.
SLACK = 1e-9
ANY_ID = np.iinfo(np.int64).max
PACKED = "part int, number int, n int, longest double, ids binary, vectors binary"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(float) ** 2).sum(1)) * (1 + 1e-12)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can leave the whole numbers a double holds."""
    if len(queries) and len(vectors) and _norms(queries).max() * _norms(vectors).max() < 2.0**52:
        return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    return queries @ vectors.T


def _pack(rows: DataFrame, width: int, size: int, order: list[Column]) -> DataFrame:
    """(id, vector) rows, sorted and packed to rows of up to ``size`` vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, vectors = TaskContext.get().partitionId(), 0, [], []

        def close() -> pa.RecordBatch:
            matrix = np.concatenate(vectors)
            return pa.record_batch({
                "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()),
                "n": pa.array([len(matrix)], pa.int32()), "longest": pa.array([_norms(matrix).max()]),
                "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()), "vectors": pa.array([matrix.tobytes()], pa.binary())})

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, size - sum(map(len, ids)))
                at += some.num_rows
                ids.append(some.column("id").to_numpy(zero_copy_only=False).astype("<i8"))
                vectors.append(_matrix(some.column("vector"), width).astype("<i8"))
                if sum(map(len, ids)) == size:
                    yield close()
                    number, ids, vectors = number + 1, [], []
        if ids:
            yield close()

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "vector").mapInArrow(run, PACKED)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vectors, n) rows to one sum of outer products per task."""
    total = 0.0
    for batch in batches:
        for n, raw in zip(batch.column("n").to_pylist(), batch.column("vectors").to_pylist()):
            vectors = np.frombuffer(raw, "<i8").reshape(n, -1).astype(float)
            total = total + vectors.T @ vectors
    if not isinstance(total, float):
        yield pa.record_batch({"at": np.arange(total.size), "value": total.ravel()})


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _tie(bound: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The largest id with which a score that equals the bound still counts; any, where a double may hold unlike scores."""
    return np.where(np.abs(bound) < 2.0**53, ids, ANY_ID)


def search_chunk(queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, tie: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
                 turn: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each query's k best of a chunk (longest first) that come before its bound, or reach it with an id up to
    ``tie``; fewer if fewer do."""
    turned_q, turned_v = queries.astype(float) @ turn, vectors.astype(float) @ turn
    lead = max(1, turn.shape[0] // 4)
    norm_q, norm_v = _norms(queries), _norms(vectors)
    rest_q = np.sqrt((turned_q[:, lead:] ** 2).sum(1))
    rest_v = np.sqrt((turned_v[:, lead:] ** 2).sum(1))
    bound, tie = bound.copy(), tie.copy()
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    for start in range(0, len(vectors), STEP):
        some = slice(start, start + STEP)
        slack = SLACK * norm_q * norm_v[some].max() + 1e-6
        live = np.flatnonzero(norm_q * norm_v[some].max() + slack >= bound)
        if not len(live):
            break  # later vectors are no longer than these
        most = turned_q[live, :lead] @ turned_v[some, :lead].T + rest_q[live, None] * rest_v[some] + slack[live, None]
        open_pairs = most >= bound[live, None]
        wanted = np.flatnonzero(open_pairs.any(0))
        if not len(wanted):
            continue
        scores = _scores(queries[live], vectors[some][wanted])
        own, least = ids[some][wanted], bound[live, None]
        reach = open_pairs[:, wanted] & ((scores > least) | ((scores == least) & (own <= tie[live, None]))) & (own != query_ids[live, None])
        for row in np.flatnonzero(reach.any(1)):
            q, found = live[row], np.flatnonzero(reach[row])
            best[q] = _best(np.append(best[q][0], ids[some][wanted[found]]), np.append(best[q][1], scores[row, found]), k)
            # all that were admitted come before the bound, so the k-th of them is a better one
            if len(best[q][0]) == k:
                bound[q] = best[q][1][-1]
                tie[q] = _tie(bound[q], best[q][0][-1])
    return best


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20, key: str = "vec_id", vector: str = "vector",
          chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank from 1, key, score): each query's ``k`` largest inner products over the integer
    ``vectors``, ties to the smaller key; fewer rows if there are fewer candidates.

    A row with the query's own key is no candidate for it. Null keys and vectors take no part; shorter
    vectors count as filled up with zeros; queries that repeat a key are one query (the largest vector),
    candidates that repeat one are candidates each. Scores are exact while they fit a long. Other columns
    are not read; no rows give no rows.
    """
    def plain(df: DataFrame) -> DataFrame:
        return (df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("vector"))
                .where("id is not null and vector is not null"))

    candidates, asked = plain(vectors), plain(queries)
    width = max(r[0] or 0 for r in (candidates.agg(F.max(F.size("vector"))).first(), asked.agg(F.max(F.size("vector"))).first()))
    spark = vectors.sparkSession
    out = f"query_id long, rank int, {key} long, score long"
    if not width:
        return spark.createDataFrame([], out)
    length = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    chunks = materialise(_pack(candidates.withColumn("length", length), width, chunk, [F.desc("length"), F.col("id")]), "chunks")
    sums = chunks.select("n", "vectors").mapInArrow(_moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    moments = np.zeros(width * width)
    moments[sums["at"].to_numpy()] = sums["value"].to_numpy()
    turn = np.linalg.svd(moments.reshape(width, width))[0]
    # the longest vectors: chunks are short where the table is cut into many parts, so as many as make up a full one
    by_length = chunks.orderBy(F.desc("longest"), "part", "number")
    sizes = [r["n"] for r in by_length.select("longest", "part", "number", "n").limit(chunk).collect()]
    enough = int(np.searchsorted(np.cumsum(sizes), chunk)) + 1
    first = by_length.limit(enough).select("ids", "vectors").collect()  # fewer than two full chunks
    lead_ids, lead = (np.frombuffer(b"".join(r[c] for r in first), "<i8") for c in ("ids", "vectors"))
    lead = lead.reshape(-1, width)
    start = spark.sparkContext.broadcast((lead_ids, lead, turn))  # these and a d x d matrix

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds to each query its bound, and the shortest candidate that could still matter."""
        lead_ids, lead, turn = start.value
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            vectors = _matrix(batch.column("vector"), width)
            none = np.full(len(ids), -np.inf)
            best = search_chunk(vectors, ids, none, np.full(len(ids), ANY_ID), lead, lead_ids, turn, k)
            bound = np.array([s[-1] if len(s) == k else -np.inf for _, s in best], float)
            tie = _tie(bound, np.array([i[-1] if len(i) == k else ANY_ID for i, _ in best], np.int64))
            norm = _norms(vectors)
            need = np.where(bound > 0, bound / np.where(norm > 0, norm, 1), 0.0) * (1 - 1e-9)
            yield pa.record_batch({"id": ids, "vector": batch.column("vector"), "bound": bound, "tie": tie, "need": need})

    once = asked.groupBy("id").agg(F.max("vector").alias("vector"))
    bounded = materialise(once.mapInArrow(bounds, "id long, vector array<long>, bound double, tie long, need double"), "queries")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                part = {c: some.column(c).to_numpy(zero_copy_only=False) for c in ("id", "bound", "tie", "need")}
                yield pa.record_batch({
                    "need": pa.array([part["need"].min()]), "n_queries": pa.array([some.num_rows], pa.int32()),
                    "query_ids": pa.array([part["id"].astype("<i8").tobytes()], pa.binary()),
                    "bounds": pa.array([part["bound"].tobytes()], pa.binary()),
                    "ties": pa.array([part["tie"].astype("<i8").tobytes()], pa.binary()),
                    "queries": pa.array([_matrix(some.column("vector"), width).astype("<i8").tobytes()], pa.binary())})

    # queries that need equally long candidates share a block
    grouped = bounded.repartitionByRange("need", "id").sortWithinPartitions("need", "id")
    packed = materialise(grouped.mapInArrow(blocks, "need double, n_queries int, query_ids binary, bounds binary, ties binary, queries binary")
                         .withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    needs = packed.select("need", "block").orderBy("need").toArrow()  # two numbers per BLOCK queries
    if not needs.num_rows:
        return spark.createDataFrame([], out)
    ordered = spark.sparkContext.broadcast((needs["need"].to_numpy(), needs["block"].to_numpy()))

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that need no longer candidates than a chunk has: the first of them by need."""
        need, block = ordered.value
        for batch in batches:
            for part, number, most in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "longest"))):
                own = block[:np.searchsorted(need, most, "right")]
                yield pa.record_batch({"part": np.full(len(own), part, np.int32), "number": np.full(len(own), number, np.int32), "block": own})

    pairs = chunks.select("part", "number", "longest").mapInArrow(meetings, "part int, number int, block long")
    met = pairs.join(chunks.select("part", "number", "n", "ids", "vectors"), ["part", "number"]).join(packed.drop("need"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = start.value[2]
        for batch in batches:
            for i in range(batch.num_rows):
                n, ids, vectors, n_queries, query_ids, bound, tie, queries = (
                    batch.column(c)[i].as_py() for c in ("n", "ids", "vectors", "n_queries", "query_ids", "bounds", "ties", "queries"))
                query_ids = np.frombuffer(query_ids, "<i8")
                best = search_chunk(np.frombuffer(queries, "<i8").reshape(n_queries, width), query_ids, np.frombuffer(bound), np.frombuffer(tie, "<i8"),
                                    np.frombuffer(vectors, "<i8").reshape(n, width), np.frombuffer(ids, "<i8"), turn, k)
                yield pa.record_batch({"query_id": np.repeat(query_ids, [len(b[0]) for b in best]),
                                       "id": np.concatenate([b[0] for b in best]), "score": np.concatenate([b[1] for b in best])})

    found = (met.select("n", "ids", "vectors", "n_queries", "query_ids", "bounds", "ties", "queries").transform(few_rows)
             .mapInArrow(run, "query_id long, id long, score long"))
    # ranks are cut before the shuffle, too, so a query sends k rows from a task
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
