"""Near-duplicates by SimHash fingerprints and the generalised pigeonhole principle.

Fingerprints of 64 bits link if they differ in at most ``distance`` bits. Bits that correlate are grouped
into parts, and each part i gets a threshold t_i so that the thresholds sum to distance - parts + 1: two
fingerprints within the distance then agree to within t_i on some part (a part at -1 is never probed).
Dynamic programming picks the thresholds with the least estimated work: probes sent, and candidates met,
by the pair counts of a sample. Each fingerprint probes its parts' buckets and candidates are verified.

A bucket with more than ``BUCKET`` fingerprints isn't paired up. Its fingerprints instead name all values
within ``distance / 2`` bits of themselves: two within ``distance`` share such a value, and no value has
more neighbours than the ball around it, so the links of a crowd cost a constant per member. Copies share
a fingerprint and are one member.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import slices, small_batches
from loadweave.session import materialise

SEED = 42
#: Fingerprints of a bucket that are compared pair by pair.
BUCKET = 64
SAMPLE = 2048


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words, A-Z lower-cased, joined by spaces; the whole if it has fewer."""
    found = text.lower().split()  # on bytes both keep to ASCII
    if not found:
        return []
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1:].tolist())]


def _fingerprints(texts: list[str | None], words: int) -> np.ndarray:
    hashes = [shingle_hashes(t.encode(), words) if t else [] for t in texts]
    size = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        flat = np.concatenate([np.array(h, "<u8") for h in hashes if h])
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(size[full]) - size[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > size[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fingerprint as a signed long), a row for each row; a text without words has fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch({"id": part.column("id"), "fp": _fingerprints(
                    part.column("text").to_pylist(), words).view(np.int64)})

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.transform(small_batches).mapInArrow(run, f"id {kind}, fp long").withColumnsRenamed({"id": key, "fp": "fingerprint"})


@dataclass(frozen=True)
class Part:
    mask: int
    threshold: int

    def flips(self) -> list[int]:
        """What to flip to reach each value within the threshold, as signed longs."""
        bits = [1 << b for b in range(64) if self.mask >> b & 1]
        found = [sum(c) for n in range(self.threshold + 1) for c in combinations(bits, n)]
        return [_signed(f) for f in found]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _grouped_bits(sample: np.ndarray, parts: int) -> list[int]:
    """Masks of ``parts`` groups of bits of near-equal number, each filled with the bit that correlates most
    with those already in it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits.std(0)
    centred = (bits - bits.mean(0)) / np.where(spread > 0, spread, 1)
    tied = np.abs(centred.T @ centred)
    left, masks = set(range(64)), []
    for i in range(parts):
        size = 64 // parts + (i < 64 % parts)
        own = [max(left, key=lambda b: (tied[b, list(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (tied[b, own].sum(), -b))
            own.append(best)
            left.discard(best)
        masks.append(sum(1 << b for b in own))
    return masks


def plan(sample: np.ndarray, n: int, distance: int) -> list[Part]:
    """Parts and thresholds of least estimated work for ``n`` distinct fingerprints, from a sample."""
    best: tuple[float, list[Part]] | None = None
    apart = sample[:, None] ^ sample[None, :]
    pairs = max(1, len(sample) * (len(sample) - 1))
    for count in range(2, distance + 2):
        masks = _grouped_bits(sample, count)
        cost = []
        for mask in masks:
            width = mask.bit_count()
            near = np.bincount(np.bitwise_count(apart & np.uint64(mask)).ravel(), minlength=65)
            near[0] -= len(sample)
            row = {-1: 0.0}
            for t in range(distance + 1):
                share = (near[: t + 1].sum() + 1) / (pairs + 2.0 ** min(width, 60))
                row[t] = n * (1.0 + sum(comb(width, k) for k in range(t + 1))) + n * n / 2 * share
            cost.append(row)
        # least cost of the first parts by the sum of their thresholds
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (paid, chosen) in state.items():
                for t, price in row.items():
                    if total + t not in step or paid + price < step[total + t][0]:
                        step[total + t] = paid + price, [*chosen, t]
            state = step
        paid, chosen = state[distance - count + 1]
        if best is None or paid < best[0]:
            best = paid, [Part(m, t) for m, t in zip(masks, chosen) if t >= 0]
    return best[1]


def links(distinct: DataFrame, parts: list[Part], distance: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b) with a < b, distinct fingerprints within ``distance``; of a crowded bucket, enough of them to
    connect all that are."""
    def signatures(probes: bool) -> DataFrame:
        return distinct.select(F.col("fp"), F.inline(F.array(*(
            F.struct(F.lit(i).alias("part"), (F.col("fp").bitwiseAND(F.lit(_signed(p.mask)))).bitwiseXOR(F.lit(flip)).alias("value"))
            for i, p in enumerate(parts) for flip in (p.flips() if probes else [0])))))

    where = ["part", "value"]
    index, probe = signatures(False), signatures(True)
    crowded = materialise(index.groupBy(*where).count().where(F.col("count") > bucket).select(*where), "crowded")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    paired = (index.join(crowded, where, "left_anti").withColumnRenamed("fp", "a")
              .join(probe.join(crowded, where, "left_anti").withColumnRenamed("fp", "b"), where)
              .where((F.col("a") < F.col("b")) & near).select("a", "b"))
    ball = [_signed(sum(1 << b for b in c)) for n in range((distance + 1) // 2 + 1) for c in combinations(range(64), n)]
    crowd = probe.join(crowded, where, "left_semi").select("fp").distinct()
    shared = (crowd.select("fp", F.explode(F.array(*(F.lit(f) for f in ball))).alias("flip"))
              .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
              .agg(F.array_sort(F.collect_set("fp")).alias("around")).where(F.size("around") > 1)
              .select(F.col("around")[0].alias("a"), F.explode(F.slice("around", 2, 1 << 20)).alias("b")))
    if distance % 2:
        shared = shared.where(near)
    return paired.unionByName(shared).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the (a, b) edges is connected to.

    Star contraction: each round hangs all larger neighbours of a node, then all smaller ones, on its least
    neighbour, until only stars are left. A round's edges are written to the shared folder.
    """
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    state = None
    flat = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(least(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        large = materialise(large, "large-star")
        small = (large.join(least(large), "u")
                 .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
                 .where("u <> v").distinct())
        flat = materialise(small, "small-star")
        now = flat.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        flat.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2,
               bucket: int = BUCKET) -> DataFrame:
    """(key, fingerprint, component_id), a row for each row of ``docs``: the smallest key that a chain of
    links reaches, its own included.

    Null and empty texts and those without words have fingerprint 0 and are linked like others. Rows that
    repeat an id are linked by each of their texts. A null id takes part; a component of null ids alone
    has a null id. Other columns are not read.
    """
    prints = materialise(fingerprints(docs, key=key, text=text, words=words).withColumnRenamed("fingerprint", "fp"), "prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min(key).alias("first")), "distinct-prints")
    sample = np.array([r["fp"] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    parts = plan(sample.view(np.uint64), distinct.count(), distance)
    roots = connected(links(distinct.select("fp"), parts, distance, bucket))
    own = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = own.groupBy("root").agg(F.min("first").alias("component_id"))
    return (prints.join(own.join(named, "root").select("fp", "component_id"), "fp")
            .select(key, F.col("fp").alias("fingerprint"), "component_id"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2,
               bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs``, all columns, but for those of a component whose id is not its smallest."""
    found = components(docs, key=key, text=text, words=words, distance=distance, bucket=bucket)
    later = found.where(F.col("component_id") < F.col(key)).select(key).distinct()
    return docs.join(later, key, "left_anti").select(*docs.columns)
