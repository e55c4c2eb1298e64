"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature says that an n-gram of the lower-cased UTF-8 text (4 or 6 bytes) occurs; n-grams are hashed to
``2 ** BITS`` buckets. The buckets that tell the classes apart best (log-likelihood ratio) are kept, each
is scaled by its log-count ratio, and Spark's logistic regression is fitted on the scaled features. The
fit sees at most ``train_rows`` labelled rows, those with the smallest hash of their id: a documented
bound of the fit. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import mix, multipliers, slices, small_batches, utf8
from loadweave.session import materialise

BITS = 20
LENGTHS = (4, 6)
FACTORS = multipliers(max(LENGTHS) + 1, seed=23)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buckets(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text number, bucket) pairs. ``wanted`` maps a bucket to a feature number or -1;
    with it, pairs hold feature numbers and other buckets are left out."""
    raw, offsets = utf8(column)
    raw = LOWER[raw].astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    total, found = np.zeros(len(raw), np.uint64), []
    with np.errstate(over="ignore"):
        for n in range(1, max(LENGTHS) + 1):
            total = total[: len(raw) - n + 1] + raw[n - 1:] * FACTORS[n]
            if n in LENGTHS and len(total):
                bucket = (mix(total + np.uint64(n) * FACTORS[0]) >> np.uint64(64 - BITS)).astype(np.int64)
                inside = owner[: len(total)] == owner[n - 1:]
                if wanted is not None:
                    bucket = wanted[bucket]
                    inside &= bucket >= 0
                found.append((owner[: len(total)][inside] << BITS) | bucket[inside])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    feature: np.ndarray
    weight: np.ndarray
    intercept: float

    def scores(self, column: pa.Array) -> np.ndarray:
        owner, feature = buckets(column, self.feature)
        logit = np.bincount(owner, self.weight[feature], len(column)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            owner, bucket = buckets(part.column("text"))
            offsets = np.searchsorted(owner, np.arange(part.num_rows + 1))
            yield pa.record_batch({"label": part.column("label"), "found": pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(bucket, pa.int32()))})


def _likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Twice the log-likelihood ratio of 'the feature's rate depends on the class'."""
    def part(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = (pos + neg) / (n_pos + n_neg)
    return 2 * (part(pos, n_pos, pos / n_pos) + part(neg, n_neg, neg / n_neg)
                - part(pos, n_pos, both) - part(neg, n_neg, both))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
        train_rows: int = 8_000, features: int = 16_384, smoothing: float = 1.0, penalty: float = 1e-3) -> Model:
    """Learns from labelled rows; null labels and ids are left out, repeated labels of an id count once
    (the larger). With one class only, or none, every score is the share of label 1 (0 if unlabelled)."""
    drawn = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
             .groupBy(F.col(key).alias("id")).agg(F.max(label).cast("double").alias("label"))
             .orderBy(F.xxhash64("id"), "id").limit(train_rows))
    # at most train_rows pairs of numbers, so small enough to send to every task
    rows = (docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id")
            .select("label", "text"))
    seen = materialise(rows.transform(small_batches).mapInArrow(_featurise, "label double, found array<int>"), "toxic-features")
    n_pos, n_all = seen.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if n_pos in (0, n_all):
        share = np.clip(n_pos / max(n_all, 1), 1e-9, 1 - 1e-9)
        return Model(np.full(1 << BITS, -1), np.zeros(1), float(np.log(share / (1 - share))))
    counts = (seen.select("label", F.explode("found").alias("bucket"))
              .groupBy("bucket").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).where("n > 2").toArrow())
    bucket, pos, n = (counts[c].to_numpy() for c in ("bucket", "pos", "n"))
    order = np.lexsort((bucket, -_likelihood_ratio(pos, n - pos, int(n_pos), int(n_all - n_pos))))[:features]
    bucket, pos, neg = bucket[order], pos[order] + smoothing, (n - pos)[order] + smoothing
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    place = np.full(1 << BITS, -1, np.int64)
    place[bucket] = np.arange(len(bucket))

    @F.udf(VectorUDT())
    def scaled(found):
        at = np.sort(place[np.asarray(found, np.int64)]) if found else np.zeros(0, np.int64)
        at = at[at >= 0]
        return SparseVector(len(ratio), at, ratio[at])

    train = materialise(seen.select("label", scaled("found").alias("features")), "toxic-scaled")
    fitted = LogisticRegression(regParam=penalty, standardization=False, maxIter=60, tol=1e-5).fit(train)
    return Model(place, np.asarray(fitted.coefficients.toArray()) * ratio, float(fitted.intercept))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted), a row for each row of ``docs``. A null or empty text has no features and
    gets the score of the intercept; repeated rows give repeated results; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value = shared.value.scores(part.column("text"))
                yield pa.record_batch({"id": part.column("id"), "score": value,
                                       "predicted": pa.array(value >= 0.5).cast(pa.int32())})

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.transform(small_batches).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", key)
