"""Helpers shared by the training-data operators: reading, slicing Arrow batches, vectorised hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.session import materialise

#: Text handled at once inside a task; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows, and about the bytes, sent to a Python worker at once: a row may hold a long text.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends no more than BATCH_LIMITS at once to Python."""
    conf = df.sparkSession.conf
    for key, most in BATCH_LIMITS.items():
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, most)
    return df


def numbered(docs: DataFrame, row: str, name: str) -> DataFrame:
    """``docs`` with a number per row, written once and read back. Numbers given while reading follow the cut
    of the input into partitions, which changes with the executors alive; stored ones stay."""
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), name)


def tidy(run: Callable, forget: Callable[[], None] = lambda: None) -> Callable:
    """``run``, which gives memory back at the end of a task: a worker serves other operators after it."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass
    return wrapped


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about ``limit`` bytes; rows stay whole."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets; a null is an empty text."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset:filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def multipliers(n: int, seed: int = 11) -> np.ndarray:
    """n odd 64-bit factors of a linear hash."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class HashArray:
    """Sorted 64-bit keys, found through a table of where each leading bit pattern starts."""

    def __init__(self, keys: np.ndarray):
        assert len(keys) < 2 or (keys[1:] > keys[:-1]).all(), "keys must be sorted and distinct"
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(1, min(22, int(len(keys)).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, or -1."""
        at = self.start[(wanted >> self.shift).astype(np.int64)]
        found = self.keys[at]
        todo = np.flatnonzero(found < wanted)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < wanted[todo]]
        at[(self.keys[at] != wanted) | (at == len(self.keys) - 1)] = -1
        return at


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of runs given by n + 1 offsets along the first axis; an empty run is 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=np.float64)
    return out
