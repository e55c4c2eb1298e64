"""Line de-duplication over levelled, sorted runs of line hashes.

A run is a bucketed, sorted table of (hash, owner): lines met so far and the document that keeps them.
Documents come in batches of ascending id. A batch's lines, one row per hash, are merge-joined with all runs; what
no run has is new and becomes a run of its own at level 0. ``fanout`` runs of one level are merged to one run
of the next, so the number of runs grows with the logarithm of the number of batches. Runs are bucketed
by hash, so a batch is shuffled once and the runs not at all.

Hashes have 128 bits. Only hashes and ids are shuffled; texts move once, to meet the lines they lose.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.llm.common import slices, small_batches
from loadweave.session import materialise, scratch_path

MIN_CHARS = 10
HASH = ["h1", "h2"]


def line_key(line: bytes) -> bytes | None:
    """White space at both ends off, A-Z lower-cased; None if it has under MIN_CHARS code points."""
    key = line.strip().lower()  # on bytes both touch ASCII alone
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    return key


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to the distinct line hashes of each document."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for part in slices(batch, "text"):
            owners, found = [], []
            for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                if doc is None or not text:
                    continue
                own = {digest(k) for k in map(line_key, text.encode().split(b"\n")) if k is not None}
                owners.append(np.full(len(own), doc, np.int64))
                found += own
            pair = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.record_batch({"doc": pa.array(np.concatenate([np.zeros(0, np.int64), *owners]), pa.int64()),
                                   "h1": pa.array(pair[:, 0].copy(), pa.int64()), "h2": pa.array(pair[:, 1].copy(), pa.int64())})


class Runs:
    """The levelled runs of one store."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[str] = []

    def all(self) -> list[DataFrame]:
        return [run for level in sorted(self.levels) for run in self.levels[level]]

    def _store(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", scratch_path(self.spark, "line-run"))
         .saveAsTable(name))
        self.tables.append(name)
        return self.spark.table(name)

    def look_up(self, keys: DataFrame) -> DataFrame:
        """``keys``, a row per hash, with ``known``: the owner that a run has for it, or null."""
        for i, run in enumerate(self.all()):
            keys = keys.join(run.select(*HASH, F.col("owner").alias(f"__{i}")), HASH, "left")
        owners = [F.col(c) for c in keys.columns if c.startswith("__")]
        return keys.withColumn("known", F.coalesce(F.lit(None).cast("long"), *owners)).drop(*(f"__{i}" for i in range(len(owners))))

    def add(self, rows: DataFrame) -> None:
        """Stores (h1, h2, owner) rows, new to all runs, as a run at level 0."""
        self.levels.setdefault(0, []).append(self._store(rows))

    def compact(self) -> None:
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            merged = self._store(reduce(DataFrame.unionByName, self.levels.pop(level)).repartition(self.buckets, *HASH))
            self.levels.setdefault(level + 1, []).append(merged)
            level += 1

    def forget(self) -> None:
        """Drops the names; results may still read the files, which go with the scratch folder."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")


def lost_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc, h1, h2): the line hashes that a document loses because one of a smaller id has them."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = reduce(lambda n, cut: n + (F.col("doc") > cut).cast("int"), sorted(set(cuts)), F.lit(0))
    path, lost = scratch_path(spark, "lines"), scratch_path(spark, "lost-lines")
    (rows.transform(small_batches).mapInArrow(_line_hashes, "doc long, h1 long, h2 long").withColumn("batch", batch)
     .write.partitionBy("batch").parquet(path))
    lines = spark.read.schema("doc long, h1 long, h2 long, batch int").parquet(path)
    runs = Runs(spark, fanout)
    for number in range(len(set(cuts)) + 1):
        own = lines.where(F.col("batch") == number).drop("batch")
        # one row per hash before any join, however many documents share a line
        keys = runs.look_up(own.groupBy(*HASH).agg(F.min("doc").alias("owner"), F.count("*").alias("n")))
        shared = materialise(keys.where("known is not null or n > 1").select(*HASH, F.coalesce("known", "owner").alias("owner")), "shared-lines")
        runs.add(keys.where("known is null").select(*HASH, "owner"))
        # not bucketed on either side, so a line that crowds one task is split at run time
        own.join(shared, HASH).where("owner < doc").select("doc", *HASH).write.mode("append").parquet(lost)
        runs.compact()
    runs.forget()
    return spark.read.schema("doc long, h1 long, h2 long").parquet(lost)


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", batches: int = 4, fanout: int = 2) -> DataFrame:
    """All columns of ``docs`` with ``text`` rebuilt, and ``n_lines`` (before) and ``n_dropped``.

    A line whose key has MIN_CHARS code points or more is dropped in all documents but the one with the
    smallest id that has it, which keeps all its copies; shorter lines stay. Rows that repeat an id are
    one document. A null text or an empty one is one empty line, and comes back empty; a row without an
    id is left as it is and owns nothing. Columns called n_lines or n_dropped are replaced.
    """
    rest = docs.drop("n_lines", "n_dropped")
    lost = lost_lines(docs, key=key, text=text, batches=batches, fanout=fanout)
    # a document's lost lines are no more than its lines
    gone = lost.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct(*HASH)).alias("__lost"))
    names = rest.columns
    joined = rest.join(gone, F.col(key).cast("long") == F.col("__doc"), "left").drop("__doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, text):
                texts, n_lines, n_dropped = [], [], []
                for value, lost in zip(part.column(text).to_pylist(), part.column("__lost")):
                    lines = (value or "").encode().split(b"\n")
                    kept = lines
                    if lost.is_valid and len(lost):
                        pair = lost.values
                        flat = np.stack([pair.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1).astype("<i8").tobytes()
                        out = {flat[i:i + 16] for i in range(0, len(flat), 16)}
                        keys = [(line, line_key(line)) for line in lines]
                        kept = [line for line, k in keys if k is None or digest(k) not in out]
                    texts.append(b"\n".join(kept).decode())
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                columns = {c: part.column(c) for c in names} | {
                    text: pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()),
                    "n_dropped": pa.array(n_dropped, pa.int64())}
                yield pa.record_batch(columns)

    schema = rest.withColumns({"n_lines": F.lit(None).cast("long"), "n_dropped": F.lit(None).cast("long")}).schema
    return joined.transform(small_batches).mapInArrow(run, schema)
