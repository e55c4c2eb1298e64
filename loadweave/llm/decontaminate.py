"""Benchmark decontamination by suffix arrays over the training text.

Texts are words. A block of documents is a shard: its suffixes are sorted by prefix doubling, every benchmark
suffix is looked up in that order by binary search, which gives all places of its window, and where these begin a
match it is followed to its end: the longest verbatim match there. A shard's words outside the benchmark's vocabulary
end a suffix, as no match can cross them; stretches shorter than any window are left out. Shards are searched where
they lie: no shuffle.

The benchmark goes to every task, in parts of at most ``PART_BYTES``, one at a time; each part is a pass over the
documents, stored, and the passes are joined by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loadweave.llm.common import HashArray, mix, numbered, slices, small_batches, utf8
from loadweave.session import materialise

WINDOW = 10
PART_BYTES = 32 << 20
SHARD_BYTES = 4 << 20
#: What a byte adds to a word; 0 is no part of one.
LETTER = np.zeros(256, np.uint64)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    LETTER[_b] = _b
LETTER[0x41:0x5B] = LETTER[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for_n = [np.full(2 * n, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
            for powers in for_n:
                powers[0] = 1
            _POWERS[:] = [np.multiply.accumulate(powers) for powers in for_n]
    return _POWERS[0], _POWERS[1]


def words(column: pa.Array, letter: np.ndarray = LETTER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the n + 1 offsets of the texts among them."""
    raw, offsets = utf8(column)
    value = letter[raw]
    inside = value > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value * up[: len(raw)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE >> 1))
    return hashes, np.searchsorted(starts, offsets)


class SuffixArray:
    """The suffixes of a shard, ordered by their first ``depth`` words or more. A suffix goes on for ``run`` words,
    none where that is 0; where it ends comes before any word."""

    def __init__(self, ids: np.ndarray, run: np.ndarray, depth: int):
        self.ids, self.run = ids, run
        places = np.flatnonzero(run)
        order = np.argsort(ids[places], kind="stable")
        self.at = places[order]
        rank = np.zeros(len(ids) + 1, np.int64)
        index = np.arange(len(self.at))
        rank[self.at] = 1 + np.searchsorted(ids[self.at], ids[self.at])
        known = 1
        while known < depth and len(index):
            # groups that are still alike, with a suffix that goes on
            ranks = rank[self.at]
            first = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
            size = np.diff(np.append(first, len(ranks)))
            alike = (size > 1) & (np.maximum.reduceat(run[self.at], first) > known)
            index = np.flatnonzero(np.repeat(alike, size))
            at, own = self.at[index], ranks[index]
            then = np.where(run[at] > known, rank[np.minimum(at + known, len(ids))], 0)
            order = np.lexsort((then, own))
            at, then = at[order], then[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (then[1:] != then[:-1])
            self.at[index] = at
            rank[at] = 1 + index[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            known *= 2

    def find(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds, in the order, of the suffixes that begin with the ``length`` words of ``text`` at each start."""
        words = self.ids[self.at]
        least, most = (np.searchsorted(words, text[starts], side) for side in ("left", "right"))
        low = self._bound(text, starts, length, least, most, False)
        return low, self._bound(text, starts, length, low, most, True)

    def _bound(self, text, starts, length, least, most, after: bool) -> np.ndarray:
        low, high = least.copy(), most.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            side = self._compare(self.at[middle], text, starts[todo], length)
            right = (side < 0) | ((side == 0) & after)
            low[todo[right]] = middle[right] + 1
            high[todo[~right]] = middle[~right]
            todo = todo[low[todo] < high[todo]]
        return low

    def _compare(self, places: np.ndarray, text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Whether the suffix at each place comes before (-1) the wanted words, after them (1), or begins with them (0)."""
        out, todo, run = np.zeros(len(places), np.int64), np.arange(len(places)), self.run[places]
        for step in range(1, length):  # first words are alike
            word = np.where(run[todo] > step, self.ids[np.minimum(places[todo] + step, len(self.ids) - 1)], -1)
            out[todo] = np.sign(word - text[starts[todo] + step])
            todo = todo[out[todo] == 0]
            if not len(todo):
                break
        return out


class Benchmark:
    """The words of a part of the benchmark, and which windows it has."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.names = [i for i, _ in items]
        hashes, self.offsets = words(pa.array([t for _, t in items], pa.large_string()))
        keys, self.text = np.unique(hashes, return_inverse=True)
        self.vocabulary = HashArray(keys)
        size = np.diff(self.offsets)
        self.longest = int(size.max(initial=0))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: starts, items
        for length in np.unique(np.minimum(size[size > 0], WINDOW)):
            own = np.flatnonzero(np.minimum(size, WINDOW) == length)
            starts = [np.arange(self.offsets[i], self.offsets[i + 1] - length + 1) for i in own]
            self.windows[int(length)] = np.concatenate(starts), np.repeat(own, [len(s) for s in starts])

    def search(self, column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[dict]]:
        """For each text: its words, the places hit, and per item its longest match (place in the item's
        text, place in the document, words)."""
        hashes, bounds = words(column)
        n_words, n = np.diff(bounds), len(column)
        hits: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        matches: list[dict] = [{} for _ in range(n)]
        if not len(hashes) or not self.windows:
            return n_words, hits, matches
        ids = self.vocabulary.find(hashes).astype(np.int64)
        # how many known words follow each place without a gap, inside its text
        stop = np.where(ids < 0, np.arange(len(ids)), len(ids))
        ends = np.minimum.accumulate(stop[::-1])[::-1]
        run = np.minimum(ends, np.repeat(bounds[1:], n_words)) - np.arange(len(ids))
        # a stretch of known words begins where the run does not go on from the place before
        fresh = np.append(True, run[1:] != run[:-1] - 1)
        whole = run[np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))]
        suffixes = SuffixArray(ids, np.where(whole >= min(self.windows), run, 0), self.longest)
        covered = np.zeros(len(ids) + 1, np.int64)
        pairs = []
        for length, (starts, items) in self.windows.items():
            low, high = suffixes.find(self.text, starts, length)
            count = high - low
            test = np.repeat(np.arange(len(starts)), count)
            at = suffixes.at[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + length, -1)
            pairs.append((at, starts[test], items[test], np.full(len(at), length)))
        at, start, item, span = map(np.concatenate, zip(*pairs))
        hit = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        edges = np.searchsorted(hit, bounds)
        for d in np.flatnonzero(np.diff(edges)):
            hits[d] = hit[edges[d]:edges[d + 1]] - bounds[d]
        # places that a match begins at: the words before differ, or item or text begin there
        doc = np.searchsorted(bounds, at, "right") - 1
        begins = (at == bounds[doc]) | (start == self.offsets[item]) | (ids[at - 1] != self.text[start - 1])
        at, start, item, span, doc = (x[begins] for x in (at, start, item, span, doc))
        todo = np.arange(len(at))
        most = np.minimum(run[at], self.offsets[item + 1] - start)
        while len(todo := todo[span[todo] < most[todo]]):
            todo = todo[ids[at[todo] + span[todo]] == self.text[start[todo] + span[todo]]]
            span[todo] += 1
        order = np.lexsort((at, start, -span, item, doc))  # of an item's matches the longest comes first
        own, of = doc[order], item[order]
        for i in order[np.append(True, (own[1:] != own[:-1]) | (of[1:] != of[:-1]))[:len(order)]]:
            matches[doc[i]][item[i]] = (int(start[i] - self.offsets[item[i]]), int(at[i] - bounds[doc[i]]), int(span[i]))
        return n_words, hits, matches


FOUND = ("n_words long, hit array<int>, items array<{item}>, "
         "matches array<struct<item:{item},item_word:int,doc_word:int,n_words:int>>")


def _parts(benchmark: DataFrame, item: str, text: str, part_bytes: int) -> list[DataFrame]:
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // part_bytes))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i) for i in range(n)]


def _gather(part: DataFrame) -> Benchmark:
    return Benchmark([(r["item"], r["text"]) for r in part.collect()])


def search(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, n_words, hit, items, matches), a row for each row of ``docs``.

    ``hit`` has the places of words inside any occurrence of a window of WINDOW benchmark words (an item of
    fewer words is one window), ``items`` the items with such windows, ``matches`` per item the longest
    verbatim match and where it lies. Null and empty texts have no words; an empty benchmark hits nothing;
    repeated rows give repeated results. Items repeated under one id are one item.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [docs.schema[key], benchmark.schema[item]]}
    parts = _parts(benchmark, item, item_text, part_bytes)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    # several passes meet again by row, so its number must be the same in each
    rows = numbered(rows, "row", "numbered") if len(parts) > 1 else rows.withColumn("row", F.lit(0).cast("long"))
    schema = f"row long, id {kinds[key]}, " + FOUND.format(item=kinds[item])
    kind = to_arrow_type(benchmark.schema[item].dataType)
    if len(parts) == 1:
        return _search_part(rows, _gather(parts[0]), schema, kind).drop("row").withColumnRenamed("id", key)
    # one part at a time on the driver and in the tasks
    passes = [materialise(_search_part(rows, _gather(part), schema, kind), "part") for part in parts]
    union = reduce(DataFrame.unionByName, passes)
    return (union.groupBy("row").agg(
        F.first("id").alias(key), F.first("n_words").alias("n_words"),
        *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hit", "items")),
        F.flatten(F.collect_list("matches")).alias("matches")).drop("row"))


def _search_part(rows: DataFrame, part: Benchmark, schema: str, item: pa.DataType) -> DataFrame:
    place = pa.struct([("item", item), *((c, pa.int32()) for c in ("item_word", "doc_word", "n_words"))])
    shared = rows.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            for some in slices(batch, "text", SHARD_BYTES):
                n_words, hits, matches = bench.search(some.column("text"))
                named = [{bench.names[i]: m for i, m in sorted(found.items(), key=lambda x: x[1][2])} for found in matches]
                yield pa.record_batch({
                    "row": some.column("row"), "id": some.column("id"), "n_words": pa.array(n_words, pa.int64()),
                    "hit": pa.array(hits, pa.list_(pa.int32())),
                    "items": pa.array([list(m) for m in named], pa.list_(item)),
                    "matches": pa.array([[dict(zip(place.names, (i, *m))) for i, m in found.items()] for found in named],
                                        pa.list_(place))})

    return rows.transform(small_batches).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id",
               item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark window; a pass per part."""
    for part in _parts(benchmark, item, item_text, part_bytes):
        docs = _keep_part(docs, _gather(part), text)
    return docs


def _keep_part(docs: DataFrame, part: Benchmark, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text, SHARD_BYTES):
                hits = shared.value.search(some.column(text))[1]
                yield some.filter(pa.array([not len(h) for h in hits], pa.bool_()))

    return docs.transform(small_batches).mapInArrow(run, docs.schema)
