"""Near copies by exact Jaccard similarity of shingle sets, without all pairs.

Two sets of similarity t or more share one of the first ``n - ceil(t * n) + 1`` members of each, in any
order that all sets follow. The order here puts rare shingles first, by the number of documents that have
each: shingles of one document alone fill most prefixes and meet no one, so they are never dealt. To count,
sets are dealt by parts of the hash range as 32-bit keys; only keys met twice go back to their documents.
Where a shared shingle stands in both sets bounds what they share; a pair must pass that in some bucket.

Pairs within a bucket of one shingle grow with its square, so each member is first compared with the
bucket's least only. Buckets whose members are then in one component need nothing more; of the others,
pairs across components are compared, each verified on the whole sets. They meet by the lengths that the
shingle's place in each set allows the other, in bands: crowds of texts that all differ by too many shingles
of their own are told apart before they are paired. Equal sets are one member. Links of SimHash
fingerprints can be added; they count like similar pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import slices, small_batches, tidy
from loadweave.llm.simhash import components, connected, shingle_hashes
from loadweave.session import materialise

#: Parts of the hash range whose members are counted, to bound what two sets can share.
PARTS = 256
#: Documents, and about the shingles, that are dealt at once.
SAMPLE, DEAL = 4096, 1 << 20
#: About the bytes of text whose shingles are counted by one task.
PART_BYTES = 8 << 20
#: Bands of length, in equal ratios, from a set to the longest that may be similar to it.
BANDS = 4


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text.encode(), words) if text else [], np.uint64))


def _dealt(words: int, parts: int, most: int):
    """Rows of documents, and the keys of their shingle sets by parts of the hash range. A deal is named by
    its place in the job, which both shuffles belong to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        rows, sets, size = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            deal, size, own = task << 32 | number, [len(s) for s in sets], np.concatenate(sets)
            named = {
                "place": pa.array(range(len(sets)), pa.int32()), "row": pa.concat_arrays([r.column("row") for r in rows]),
                "id": pa.concat_arrays([r.column("id") for r in rows]), "n": pa.array(size, pa.int32()),
                "counts": pa.array([_counts(s) for s in sets], pa.binary()),
                "member": pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))}
            # these only pass through; any part will do
            yield pa.record_batch({"deal": pa.array([deal] * len(sets), pa.int64()), "part": pa.array([(task + number) % parts] * len(sets), pa.int32())}
                                  | named | {c: pa.nulls(len(sets), pa.binary()) for c in ("places", "keys", "met")})
            part = ((own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, first = part[order], np.flatnonzero(np.diff(part[order], prepend=-1))
            cut = lambda values: pa.array([x.tobytes() for x in np.split(values[order], first[1:])][:len(first)], pa.binary())
            yield pa.record_batch({"deal": pa.array([deal] * len(first), pa.int64()), "part": pa.array(part[first], pa.int32())}
                                  | {c: pa.nulls(len(first), v.type) for c, v in named.items()}
                                  | {"places": cut(np.repeat(np.arange(len(sets)).astype("<u2"), size)), "keys": cut(own.astype("<u4")),
                                     "met": pa.nulls(len(first), pa.binary())})

        for batch in batches:
            for whole in slices(batch, "text"):
                for at in range(0, whole.num_rows, most):
                    part = whole.slice(at, most)
                    found = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                    if sets and (len(sets) + len(found) > most or size > DEAL):
                        yield from close()
                        rows, sets, size, number = [], [], 0, number + 1
                    rows.append(part.select(["row", "id"]))
                    sets += found
                    size += sum(map(len, found))
        if sets:
            yield from close()
    return run


def _met_twice(part: pa.Table) -> pa.Table:
    """The rows of documents as they are, and of the dealt keys those that come more than once, with how often."""
    dealt = part.filter(part.column("keys").is_valid())
    blobs = dealt.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(blobs), "<u4")
    places = np.frombuffer(b"".join(dealt.column("places").to_pylist()), "<u2")
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    met = np.minimum(times, 65_535).astype("<u2")[which]
    keep = met > 1
    ends = np.cumsum([len(b) // 4 for b in blobs], dtype=np.int64)
    cut = np.concatenate([[0], np.cumsum(keep)])[ends][:-1]  # where each row's kept keys end
    for name, values in (("places", places), ("keys", keys), ("met", met)):
        kept = pa.array([x.tobytes() for x in np.split(values[keep], cut)][:len(blobs)], pa.binary())
        dealt = dealt.set_column(dealt.schema.get_field_index(name), name, kept)
    found = dealt.filter(pc.greater(pc.binary_length(dealt.column("keys")), 0))
    return pa.concat_tables([part.filter(part.column("keys").is_null()), found])


def _prefixes(similarity: float):
    """Of one deal: each document, with the shingles of its prefix that other documents have, in order, and how
    many of its set stand before them."""
    def run(deal: pa.Table) -> pa.Table:
        docs = deal.filter(deal.column("keys").is_null()).sort_by("place")
        dealt = deal.filter(deal.column("keys").is_valid())
        n = docs.column("n").to_numpy()
        flat = [np.frombuffer(b"".join(dealt.column(c).to_pylist()), kind) for c, kind in (("places", "<u2"), ("keys", "<u4"), ("met", "<u2"))]
        part = np.repeat(dealt.column("part").to_numpy(), [len(b) // 4 for b in dealt.column("keys").to_pylist()])
        order = np.lexsort((flat[1], part, flat[2], flat[0]))
        place, key, part = flat[0][order].astype(np.int64), flat[1][order].astype(np.int64), part[order].astype(np.int64)
        shared = np.bincount(place, minlength=len(n))
        alone = n - shared
        at = alone[place] + np.arange(len(place)) - (np.cumsum(shared) - shared)[place]
        keep = at < (n - np.ceil(similarity * n - 1e-9) + 1)[place]
        ends = np.cumsum(np.bincount(place[keep], minlength=len(n)))
        return pa.table({c: docs.column(c) for c in ("row", "id", "n", "counts", "member")} | {
            "alone": pa.array(alone, pa.int32()),
            "prefix": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array((part << 32 | key)[keep], pa.int64()))})
    return run


def _prints(rows: DataFrame, words: int, similarity: float, most: int) -> DataFrame:
    """(row, id, n, counts, member, alone, prefix) of each row."""
    kind = rows.schema["id"].dataType.simpleString()
    text = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    fields = f"row string, id {kind}, n int, counts binary, member long"
    dealt = f"deal long, part int, place int, {fields}, places binary, keys binary, met binary"
    return (rows.transform(small_batches).mapInArrow(tidy(_dealt(words, text // PART_BYTES + 1, min(most, 65_536))), dealt)
            .groupBy("part").applyInArrow(_met_twice, dealt)
            .groupBy("deal").applyInArrow(_prefixes(similarity), f"{fields}, alone int, prefix array<long>"))


def _counts(own: np.ndarray) -> bytes | None:
    """Members in each part of the hash range; none where a count does not fit a byte."""
    counts = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=PARTS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _possible(similarity: float):
    """Pairs whose counts allow the similarity: two sets share at most the lesser count of each part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [batch.column(f"counts_{s}").to_pylist() for s in "ab"]
            known = np.array([a is not None and b is not None for a, b in zip(*counted)], bool)
            a, b = (np.frombuffer(b"".join(c or bytes(PARTS) for c in side), np.uint8).reshape(-1, PARTS) for side in counted)
            most = np.minimum(a, b).sum(1, dtype=np.int64)
            both = sum(batch.column(f"n_{s}").to_numpy(zero_copy_only=False) for s in "ab")
            keep = ~known | (most >= similarity * (both - most))
            yield batch.select(["a", "b", "row_a", "row_b"]).filter(pa.array(keep))
    return run


def _verified(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_a = None, None  # pairs of one text often follow each other
        for batch in batches:
            for part in slices(batch, "text_b"):
                kept = []
                for a, text_a, text_b in zip(part.column("a").to_pylist(), part.column("text_a").to_pylist(), part.column("text_b").to_pylist()):
                    if a != last:
                        last, of_a = a, shingle_set(text_a, words)
                    of_b = shingle_set(text_b, words)
                    shared = len(np.intersect1d(of_a, of_b, assume_unique=True))
                    kept.append(shared >= similarity * (len(of_a) + len(of_b) - shared))
                yield part.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
    return run


def _similar(pairs: DataFrame, rows: DataFrame, firsts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (a, b) whose whole sets are similar. Only texts of pairs that length and counts allow are read again and sent."""
    sides = [firsts.select(*(F.col(c).alias(f"{c}_{s}") for c in ("member", "row", "n", "counts"))).withColumnRenamed(f"member_{s}", s)
             for s in "ab"]
    long_enough = pairs.join(sides[0], "a").join(sides[1], "b").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    asked = materialise(long_enough.transform(small_batches).mapInArrow(
        tidy(_possible(similarity)), "a long, b long, row_a string, row_b string"), "asked")
    of_a = (rows.select(F.col("row").alias("row_a"), F.col("text").alias("text_a"))
            .join(materialise(asked.select("row_a").distinct(), "asked-rows"), "row_a", "left_semi"))
    of_b = asked.join(rows.select(F.col("row").alias("row_b"), F.col("text").alias("text_b")), "row_b")
    both = of_b.join(of_a, "row_a").select("a", "b", "text_a", "text_b")
    return both.transform(small_batches).mapInArrow(tidy(_verified(words, similarity)), "a long, b long")


def _roots(links: DataFrame) -> DataFrame:
    return materialise(connected(links).select(F.col("node").alias("member"), "root"), "roots")


def _same_print(rows: DataFrame, prints: DataFrame, distance: int) -> DataFrame:
    """(a, b): members of one component of SimHash fingerprints, each with the component's least."""
    found = components(rows.select("row", "text"), key="row", distance=distance).select("row", "component_id").distinct()
    own = materialise(prints.select("row", "member").distinct().join(found, "row").select("component_id", "member").distinct(), "printed")
    least = own.groupBy("component_id").agg(F.min("member").alias("a"), F.max("member").alias("most")).where("a < most")
    return own.join(least, "component_id").where("a < member").select("a", F.col("member").alias("b")).distinct()


def _longest(similarity: float) -> Column:
    """The longest set that one of n members may be similar to, if their first shared shingle stands after ``at`` of
    them: neither has more to share than the rest of it."""
    return F.floor((F.col("n") - F.col("at")) * (1 + similarity) / similarity - F.col("n") + 1e-4)


def _across(placed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): members of two components that a shingle in the prefixes of both may make similar.

    The shorter set meets the bands of length from its own up to ``most``, the longer those from ``similarity`` times its
    own up to the lesser of its own and ``most``; sets meet by shingle and the bands of both lengths. So sets whose
    rest rules each other out do not meet, however many share the shingle."""
    width = max(-math.log(similarity) / BANDS, 0.01)
    band = lambda length: F.floor(F.log(length) / width)
    n, most, shortest = F.col("n"), F.col("most"), F.greatest(F.ceil(similarity * F.col("n") - 1e-4), F.lit(1))

    def pieces(rows: DataFrame, low: Column, high: Column, side: str) -> DataFrame:
        own = (rows.select("shingle", "root", "member", "n", "most", low.alias("low"), high.alias("high"))
               .groupBy("shingle", "low", "high", "root", F.pmod(F.xxhash64("member"), F.lit(16)).alias("piece"))
               .agg(F.collect_list(F.struct("member", "n", "most")).alias("own"), F.min("n").alias("n"), F.max("most").alias("most")))
        return own.select("shingle", "low", "high", *(F.col(c).alias(f"{c}_{side}") for c in ("root", "own", "n", "most")))

    short = pieces(placed.where(most >= n), band(n), F.explode(F.sequence(band(n), band(most))), "a")
    long = pieces(placed.where(most >= shortest), F.explode(F.sequence(band(shortest), band(F.least(n, most)))), band(n), "b")
    met = short.join(long, ["shingle", "low", "high"]).where("root_a <> root_b and n_b <= most_a and n_a <= most_b")
    return (met.select(F.explode("own_a").alias("x"), "own_b").select("x", F.explode("own_b").alias("y"))
            .where("x.n <= y.n and y.n <= x.most and x.n <= y.most")
            .select(F.least("x.member", "y.member").alias("a"), F.greatest("x.member", "y.member").alias("b")).distinct())


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8,
               sample: int = SAMPLE, distance: int | None = None) -> DataFrame:
    """One row, that of the smallest id, of each group that a chain of links connects: pairs of ``similarity`` and,
    if ``distance`` is given, SimHash fingerprints (``simhash.components``) that differ in at most so many bits.

    Groups are of rows, not ids: of rows that repeat an id, each is kept or goes by its own text. A null id
    counts as larger than any other; of rows of one id the one whose text has the smaller MD5 stays. Texts without words are copies
    of each other. ``sample`` is the most documents whose shingles are dealt at once.
    """
    # a row is named by what it holds, which no loss of executors changes; rows alike in id and text share a name
    named = F.md5(F.concat(F.coalesce(F.concat(F.lit("+"), F.col(key).cast("string")), F.lit("-")),
                           F.coalesce(F.concat(F.lit("\n+"), F.col(text)), F.lit("\n-"))).cast("binary"))
    rows = docs.select(named.alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    prints = materialise(_prints(rows, words, similarity, sample), "prefixes")
    firsts = materialise(prints.where("n > 0").groupBy("member").agg(
        F.min("row").alias("row"), F.min("n").alias("n"), F.first("counts").alias("counts")), "firsts")
    dealt = (prints.where("n > 0").select("member", "n", "alone", F.posexplode("prefix").alias("at", "shingle"))
             .groupBy("shingle", "member").agg(F.min("n").alias("n"), F.min(F.col("alone") + F.col("at")).alias("at")))
    dealt = materialise(dealt, "dealt")
    met = dealt.groupBy("shingle").agg(F.min("member").alias("least"), F.max("member").alias("most")).where("least < most")
    shared = materialise(dealt.join(met.select("shingle", "least"), "shingle"), "shared")
    starred = materialise(shared.where("least < member").select(F.col("least").alias("a"), F.col("member").alias("b")).distinct(), "starred")
    links = _similar(starred, rows, firsts, words, similarity)
    if distance is not None:
        links = links.unionByName(_same_print(rows, prints, distance))
    links = materialise(links, "links")

    # what the stars leave apart: pairs of a bucket across components, of bands of length that its shingle allows
    placed = (shared.select("shingle", "member", "n", _longest(similarity).alias("most")).join(_roots(links), "member", "left")
              .withColumn("root", F.coalesce("root", "member")).repartition("shingle"))
    mixed = (placed.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max(F.col("most") >= F.col("n")).alias("some"))
             .where("x < y and some").select("shingle"))
    across = _across(materialise(placed.join(mixed, "shingle"), "mixed"), similarity)
    apart = materialise(across.join(starred, ["a", "b"], "left_anti"), "across")
    roots = _roots(links.unionByName(_similar(apart, rows, firsts, words, similarity)))

    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    kept = materialise(prints.select("row", "id", "member").groupBy("row").agg(
        F.first("id").alias("id"), F.first("member").alias("member"), F.count(F.lit(1)).alias("times"))
        .join(roots, "member", "left").withColumn("root", F.coalesce("root", "member"))
        .groupBy("root").agg(first, F.min_by("times", F.struct(F.col("id").isNull(), "id", "row")).alias("times"))
        .select(F.col("first.row").alias("__row"), "times"), "kept")
    whole = docs.withColumn("__row", named)
    once = whole.join(kept.where("times = 1").select("__row"), "__row", "left_semi")
    # of rows alike in id and text one stays; only these are brought together
    alike = whole.join(kept.where("times > 1").select("__row"), "__row", "left_semi").dropDuplicates(["__row"])
    return once.unionByName(alike).select(*docs.columns)
