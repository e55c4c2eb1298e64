"""Language-model scores from a hierarchical Pitman-Yor model.

A word follows a context; a context's restaurant seats the words seen after it, and all share one parent,
the root restaurant, whose base is uniform over the vocabulary and one unknown word. Contexts are the
previous words, hashed to ``2 ** CONTEXT_BITS`` restaurants, so that the numbers of customers and tables of
all restaurants are a table of fixed size that every task can hold. What is seated in them (all pairs of
context and word in the training texts) grows with the corpus and stays distributed.

Training counts pairs per task, shuffles them packed by bucket of words, and merges each bucket. A Gibbs
sweep then draws, for each pair, at how many tables its customers sit, given all other seating: the
restaurants' tables as of the sweep before, the parent's probability as of this one. Draws are seeded by
bucket and sweep, so a sweep is replayed rather than stored. Up to EXACT customers the draw is from the
exact conditional (generalised Stirling numbers); beyond, customers are seated in doubling blocks. After
the burn-in, each sweep is a sample; a word's probability is the average over samples.

Words that hold a large share of all tokens have their pairs spread over all buckets, and their sums meet
on the driver (a few numbers per such word). Scoring sends each document's pairs to their buckets and
adds up what comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import HashArray, mix, numbered, segment_sums, slices, small_batches
from loadweave.llm.decontaminate import words
from loadweave.session import materialise

CONTEXT_BITS = 14
EXACT = 64
BLOCK_BYTES = 4 << 20
#: Pairs a task gathers before it sends them, and buckets per shuffle partition.
GATHERED, FINER = 4_000_000, 4
END = np.uint64(0x5EED0F7E57000001)
#: Every byte but white space is part of a word; A-Z count as a-z.
LETTER = np.arange(1, 257, dtype=np.uint64)
LETTER[[0x20, *range(0x09, 0x0E)]] = 0
LETTER[0x41:0x5B] = LETTER[0x61:0x7B]
CELLS = "bucket int, kind int, block long, words binary, sizes binary, contexts binary, counts binary, rows binary, docs binary"


@dataclass
class Seating:
    """What one sweep starts from: tables and customers of all restaurants."""

    tables: np.ndarray  # per context
    root_customers: float
    root_tables: float
    hot: np.ndarray  # parent probability of each hot word


@dataclass
class Model:
    buckets: int
    hot_words: np.ndarray
    discount: float
    strength: float
    root_discount: float
    root_strength: float
    customers: np.ndarray = field(default_factory=lambda: np.zeros(1 << CONTEXT_BITS))
    tokens: int = 0
    vocabulary: int = 0
    hot_counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sweeps: list[Seating] = field(default_factory=list)  # what each sweep starts from
    burn_in: int = 1

    @property
    def base(self) -> float:
        return 1.0 / (self.vocabulary + 1)

    def parent(self, customers, tables, root_customers: float, root_tables: float):
        """Root probability of words from their customers and tables there."""
        new = (self.root_strength + self.root_discount * root_tables) * self.base
        return (np.maximum(customers - self.root_discount * tables, 0) + new) / (self.root_strength + root_customers)


# --- packing ---------------------------------------------------------------------------------------------------

def _squeeze(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, kind).tobytes())


def _expand(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    fresh = np.ones(len(sorted_values), bool)
    fresh[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(fresh)


def token_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, each closed by END; the context of each; the n + 1 offsets."""
    hashes, bounds = words(column, LETTER)
    n = len(bounds) - 1
    out = np.full(len(hashes) + n, END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(bounds))] = hashes
    bounds = bounds + np.arange(n + 1)
    before = np.full(len(out), END, np.uint64)
    before[1:] = out[:-1]  # a text's first word follows the end of another, or nothing: END both
    return out, (mix(before) >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64), bounds


def _bucket(word: np.ndarray, context: np.ndarray, hot: HashArray, buckets: int) -> np.ndarray:
    spread = np.where(hot.find(word) >= 0, mix(word + context.astype(np.uint64) + np.uint64(1)), word)
    return (spread % np.uint64(buckets)).astype(np.int64)


def _packed(bucket: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray, kind: int,
            rows: np.ndarray | None = None, docs: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row per bucket, for values sorted by bucket and word. With ``rows``, a value is a posting of the
    row it names, and ``docs`` are the rows' documents."""
    starts = _runs(bucket)
    for a, b in zip(starts, np.append(starts[1:], len(bucket))):
        first = _runs(word[a:b])
        own, ids = (np.unique(rows[a:b], return_inverse=True) if rows is not None else (None, None))
        yield pa.record_batch({
            "bucket": pa.array([bucket[a]], pa.int32()), "kind": pa.array([kind], pa.int32()),
            "block": pa.array([-1 if docs is None else docs[0]], pa.int64()),
            "words": pa.array([_squeeze(word[a:b][first], "<u8")], pa.binary()),
            "sizes": pa.array([_squeeze(np.diff(np.append(first, b - a)), "<u4")], pa.binary()),
            "contexts": pa.array([_squeeze(context[a:b], "<u2")], pa.binary()),
            "counts": pa.array([_squeeze(count[a:b], "<u4")], pa.binary()),
            "rows": pa.array([_squeeze(ids, "<u4") if rows is not None else None], pa.binary()),
            "docs": pa.array([_squeeze(docs[own], "<i8") if rows is not None else None], pa.binary())})


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [batch.column(c)[i].as_py() for c in ("words", "sizes", "contexts", "counts")]
    word, size, context, count = map(_expand, raw, ("<u8", "<u4", "<u2", "<u4"))
    return np.repeat(word, size), context.astype(np.int64), count.astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, count) by word and context, each pair once."""
    word, context, count = map(np.concatenate, zip(*parts))
    order = np.lexsort((context, word))
    word, context, count = word[order], context[order], count[order]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
    starts = np.flatnonzero(fresh)
    return word[starts], context[starts], np.add.reduceat(count, starts) if len(starts) else count


# --- counting --------------------------------------------------------------------------------------------------

def _count_pairs(hot_words: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = HashArray(hot_words)
        parts, held = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            word, context, count = _summed(parts)
            bucket = _bucket(word, context, hot, buckets)
            order = np.argsort(bucket, kind="stable")
            yield from _packed(bucket[order], word[order], context[order], count[order], 0)

        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                word, context, _ = token_stream(part.column("text"))
                parts.append(_summed([(word, context, np.ones(len(word), np.int64))]))
                held += len(parts[-1][0])
                if held > GATHERED:
                    yield from send()
                    parts, held = [], 0
        if parts:
            yield from send()
    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(bucket, pair tables) from rows sorted by bucket."""
    now, tables = None, []
    for batch in batches:
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            if tables and bucket != now:
                yield now, tables
                tables = []
            now = bucket
            tables.append(_unpacked(batch, i))
    if tables:
        yield now, tables


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, tables in _by_bucket(batches):
        word, context, count = _summed(tables)
        yield from _packed(np.full(len(word), bucket), word, context, count, 0)


def _dealt(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "bucket").sortWithinPartitions("kind", "block", "bucket")


# --- seating ---------------------------------------------------------------------------------------------------

def stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways to seat c customers at t tables, [c, t]."""
    log = np.full((n + 1, n + 1), -np.inf)
    log[1, 1] = 0.0
    for c in range(1, n):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, log[c, t] + np.log(np.maximum(c - t * discount, 1e-300)), -np.inf)
        log[c + 1, t] = np.logaddexp(stay, log[c, t - 1])
    return log


def draw_tables(count: np.ndarray, weight: np.ndarray, discount: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each pair, from its customers and the weight of opening a new one."""
    out = np.minimum(count, 1)
    order = np.argsort(np.minimum(count, EXACT + 1), kind="stable")
    clipped = np.minimum(count, EXACT + 1)[order]
    starts = _runs(clipped)
    for a, b in zip(starts, np.append(starts[1:], len(clipped))):
        c = clipped[a]
        if c < 2 or c > EXACT:
            continue
        for at in range(a, b, max(1, (1 << 20) // int(c))):
            own = order[at:min(b, at + max(1, (1 << 20) // int(c)))]
            log = table[c, 1:c + 1] + np.log(np.maximum(weight[own], 1e-300))[:, None] * np.arange(1, c + 1)
            mass = np.cumsum(np.exp(log - log.max(1, keepdims=True)), axis=1)
            out[own] = 1 + (rng.random((len(own), 1)) * mass[:, -1:] > mass).sum(1)
    many = np.flatnonzero(count > EXACT)
    if len(many):
        seated, tables = np.ones(len(many)), np.ones(len(many))
        while (seated < count[many]).any():
            block = np.minimum(np.maximum(1, np.floor(seated)), count[many] - seated)
            chance = weight[many] / (weight[many] + np.maximum(seated + block / 2 - discount * tables, 1e-9))
            tables = tables + rng.binomial(block.astype(np.int64), np.clip(chance, 0, 1))
            seated = seated + block
        out[many] = tables.astype(np.int64)
    return out


@dataclass
class Seated:
    """A bucket's pairs, and per sweep their tables and their words' customers and tables at the root."""

    word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    first: np.ndarray  # where each distinct word's pairs start
    hot: np.ndarray  # each distinct word's place among the hot words, or -1
    sweeps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def seat(model: Model, bucket: int, word: np.ndarray, context: np.ndarray, count: np.ndarray) -> Seated:
    """Replays all sweeps of a bucket."""
    first = _runs(word)
    bounds = np.append(first, len(word))
    hot = HashArray(model.hot_words).find(word[first])
    tables = np.minimum(count, 1)
    out = Seated(word, context, count, first, hot, [])
    inner, outer = stirling(model.discount), stirling(model.root_discount)
    for number, state in enumerate(model.sweeps):
        rng = np.random.default_rng([number, bucket])
        customers = segment_sums(tables, bounds)
        root = out.sweeps[-1][2] if out.sweeps else np.minimum(customers, 1)
        parent = model.parent(customers, root, state.root_customers, state.root_tables)
        parent = np.where(hot >= 0, state.hot[hot] if len(state.hot) else parent, parent)
        weight = (model.strength + model.discount * state.tables[context]) * np.repeat(parent, np.diff(bounds))
        tables = draw_tables(count, weight, model.discount, inner, rng)
        customers = segment_sums(tables, bounds).astype(np.int64)
        new = np.full(len(first), (model.root_strength + model.root_discount * state.root_tables) * model.base)
        root = draw_tables(customers, new, model.root_discount, outer, rng)
        out.sweeps.append((tables, customers, root))
    return out


def _totals(shared):
    """Sums of the last sweep of all buckets, or of the counts before any: rows (kind, at, value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums = {k: np.zeros(1 << CONTEXT_BITS) for k in ("customers", "tables")}
        hot = {k: np.zeros(len(model.hot_words)) for k in ("hot_count", "hot_tables")}
        rest = np.zeros(3)  # words that are not hot, their customers and tables at the root
        for bucket, pairs in _by_bucket(batches):
            word, context, count = _summed(pairs)
            seated = seat(model, bucket, word, context, count)
            bounds = np.append(seated.first, len(word))
            tables, customers, root = seated.sweeps[-1] if seated.sweeps else (
                np.minimum(count, 1), segment_sums(np.minimum(count, 1), bounds), np.ones(len(seated.first)))
            np.add.at(sums["customers"], context, count)
            np.add.at(sums["tables"], context, tables)
            own = seated.hot >= 0
            np.add.at(hot["hot_count"], seated.hot[own], segment_sums(count, bounds)[own])
            np.add.at(hot["hot_tables"], seated.hot[own], customers[own])
            rest += (~own).sum(), customers[~own].sum(), root[~own].sum()
        for kind, values in {**sums, **hot, "rest": rest}.items():
            at = np.flatnonzero(values)
            yield pa.record_batch({"kind": pa.array([kind] * len(at), pa.string()), "at": pa.array(at, pa.int32()), "value": values[at]})
    return run


def _gather(cells: DataFrame, model: Model) -> dict[str, np.ndarray]:
    shared = cells.sparkSession.sparkContext.broadcast(model)
    # two numbers per context and a few per hot word, however large the corpus
    sums = (cells.sortWithinPartitions("bucket").transform(small_batches).mapInArrow(_totals(shared), "kind string, at int, value double")
            .groupBy("kind", "at").agg(F.sum("value").alias("value")).toArrow().to_pydict())
    out = {"customers": np.zeros(1 << CONTEXT_BITS), "tables": np.zeros(1 << CONTEXT_BITS), "rest": np.zeros(3),
           "hot_count": np.zeros(len(model.hot_words)), "hot_tables": np.zeros(len(model.hot_words))}
    for kind, at, value in zip(sums["kind"], sums["at"], sums["value"]):
        out[kind][at] = value
    return out


def _hot_words(rows: DataFrame, buckets: int, sample_rows: int) -> np.ndarray:
    """Words that hold over a quarter of a bucket's fair share of a bounded sample's tokens. They decide
    where pairs lie, not what is counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                word, n = np.unique(token_stream(part.column("text"))[0], return_counts=True)
                often = n * 4 * buckets > n.sum()
                yield pa.record_batch({"word": word[often].view(np.int64), "n": n[often]})

    sample = rows.select("text").orderBy(F.xxhash64("text")).limit(sample_rows).transform(small_batches)
    found = sample.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return np.unique(found["word"].to_numpy().view(np.uint64))


def fit(texts: DataFrame, *, text: str = "text", discount: float = 0.8, strength: float = 5.0, root_discount: float = 0.6,
        root_strength: float = 20.0, burn_in: int = 1, samples: int = 2, sample_rows: int = 500) -> tuple[Model, DataFrame]:
    """The model's bounded part, and the stored table of pairs by bucket. Null texts count as empty ones,
    each of which is one end. ``sample_rows`` bounds the rows that tell which words to spread."""
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * FINER
    rows = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    model = Model(buckets, _hot_words(rows, buckets, sample_rows), discount, strength, root_discount, root_strength, burn_in=burn_in)
    sent = rows.transform(small_batches).mapInArrow(_count_pairs(model.hot_words, buckets), CELLS)
    cells = materialise(_dealt(sent, partitions).mapInArrow(_merge, CELLS), "pairs")
    sums = _gather(cells, model)
    model.customers, model.hot_counts = sums["customers"], sums["hot_count"]
    model.tokens = int(sums["customers"].sum())
    model.vocabulary = int(sums["rest"][0] + (sums["hot_count"] > 0).sum())
    for number in range(burn_in + samples):
        model.sweeps.append(_state(model, sums, number))
        sums = _gather(cells, model)
    model.sweeps.append(_state(model, sums, burn_in + samples))
    return model, cells


def _state(model: Model, sums: dict[str, np.ndarray], number: int) -> Seating:
    """Restaurant sums for the next sweep; the hot words' root tables are drawn here."""
    rng = np.random.default_rng([number, 1 << 31])
    before = model.sweeps[-1].root_tables if model.sweeps else float(model.vocabulary)
    customers = sums["hot_tables"].astype(np.int64)
    new = np.full(len(customers), (model.root_strength + model.root_discount * before) * model.base)
    root = draw_tables(customers, new, model.root_discount, stirling(model.root_discount), rng) if number else np.minimum(customers, 1)
    total, tables = float(sums["rest"][1] + customers.sum()), float(sums["rest"][2] + root.sum())
    return Seating(sums["tables"], total, tables, model.parent(customers, root, total, tables))


# --- scoring ---------------------------------------------------------------------------------------------------

def _postings(hot_words: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = HashArray(hot_words)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                word, context, bounds = token_stream(part.column("text"))
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                bucket = _bucket(word, context, hot, buckets)
                order = np.lexsort((doc, context, word, bucket))
                word, context, doc, bucket = word[order], context[order], doc[order], bucket[order]
                fresh = np.ones(len(word), bool)
                fresh[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(fresh)
                yield from _packed(bucket[at], word[at], context[at], np.diff(np.append(at, len(word))), 1, doc[at],
                                   part.column("row").to_numpy(zero_copy_only=False))
    return run


class Lookup:
    """What scoring reads of a bucket: each pair's and each word's share of the probability, per sample."""

    def __init__(self, model: Model, seated: Seated):
        bounds = np.append(seated.first, len(seated.word))
        self.words = seated.word[seated.first]
        # words are numbered in order, so (number, context) is sorted
        self.pairs = np.repeat(np.arange(len(self.words)), np.diff(bounds)) * (1 << CONTEXT_BITS) + seated.context
        self.seen = np.append(segment_sums(seated.count, bounds), 0.0)
        self.samples = []
        for (tables, customers, root), after in list(zip(seated.sweeps, model.sweeps[1:]))[model.burn_in:]:
            parent = model.parent(np.append(customers, 0), np.append(root, 0), after.root_customers, after.root_tables)
            own = np.flatnonzero(seated.hot >= 0)
            parent[own] = after.hot[seated.hot[own]]
            self.samples.append((np.append(np.maximum(seated.count - model.discount * tables, 0.0), 0.0), parent))
        own = np.flatnonzero(seated.hot >= 0)
        self.seen[own] = model.hot_counts[seated.hot[own]]

    def find(self, model: Model, hot: HashArray, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count of each word, log10 of its average predictive probability after its context)."""
        place = np.searchsorted(self.words, word)
        known = np.append(self.words, END)[place] == word if len(self.words) else np.zeros(len(word), bool)
        known &= place < len(self.words)
        place = np.where(known, place, len(self.words))
        wanted = place * (1 << CONTEXT_BITS) + context
        pair = np.searchsorted(self.pairs, wanted)
        met = known & (np.append(self.pairs, -1)[pair] == wanted)
        pair = np.where(met, pair, len(self.pairs))
        # a hot word's pairs lie in many buckets: this one may have none of them
        spread = np.flatnonzero(~known & (hot.find(word) >= 0))
        at = hot.find(word[spread])
        seen = self.seen[place]
        seen[spread] = model.hot_counts[at]
        total = np.zeros(len(word))
        for (kept, by_word), after in zip(self.samples, model.sweeps[model.burn_in + 1:]):
            parent = by_word[place]
            parent[spread] = after.hot[at]
            total += kept[pair] + (model.strength + model.discount * after.tables[context]) * parent
        total /= model.strength + model.customers[context]
        return seen, np.log10(total / max(1, len(self.samples)))


BACK = "block long, docs binary, tokens binary, known binary, base binary, score binary"


def _score_blocks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition, pair tables first and then postings by block, to one row per block."""
        model: Model = shared.value
        hot = HashArray(model.hot_words)
        replay = Model(**{**model.__dict__, "sweeps": model.sweeps[:-1]})
        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        tables: dict[int, Lookup] = {}
        block, found = None, []

        def close() -> pa.RecordBatch:
            docs, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            sums = [np.bincount(at, np.concatenate([f[i] for f in found])) for i in range(1, 5)]
            return pa.record_batch({"block": pa.array([block], pa.int64()), **{
                name: pa.array([_squeeze(v, kind)], pa.binary())
                for name, kind, v in zip(("docs", "tokens", "known", "base", "score"), ("<i8", "<u4", "<u4", "<f8", "<f8"), (docs, *sums))}})

        for batch in batches:
            for i, (bucket, kind, now) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "block")))):
                word, context, n = _unpacked(batch, i)
                if kind == 0:
                    tables[bucket] = Lookup(model, seat(replay, bucket, word, context, n))
                    continue
                if found and now != block:
                    yield close()
                    found = []
                block = now
                if bucket not in tables:
                    tables[bucket] = Lookup(model, seat(replay, bucket, *nothing))
                row, docs = _expand(batch.column("rows")[i].as_py(), "<u4"), _expand(batch.column("docs")[i].as_py(), "<i8")
                seen, log_p = tables[bucket].find(model, hot, word, context)
                base = np.log10((seen + 1) / (model.tokens + model.vocabulary + 1))
                found.append((docs, *(np.bincount(row, v, len(docs)) for v in (n, n * (seen > 0), n * base, n * log_p))))
        if found:
            yield close()
    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block to one row per document; a block holds some thousand documents."""
    block, found = None, []

    def close() -> pa.RecordBatch:
        docs, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([f[i] for f in found])) for i in range(1, 5)]
        return pa.record_batch({"row": docs, "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64),
                                "base_score": sums[2], "score": sums[3]})

    for batch in batches:
        for i, now in enumerate(batch.column("block").to_pylist()):
            if found and now != block:
                yield close()
                found = []
            block = now
            found.append(tuple(_expand(batch.column(c)[i].as_py(), kind) for c, kind in (
                ("docs", "<i8"), ("tokens", "<u4"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8"))))
    if found:
        yield close()


def score(docs: DataFrame, model: Model, cells: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score), a row for each row of ``docs``.

    ``score`` is the log10 probability of the whole text and its end, ``base_score`` that of the add-one
    unigram. A null text is an empty one: its end alone. Repeated rows give repeated results. A model of
    no training text gives every word the same chance, 1. Other columns are not read.
    """
    # numbers that name rows, for ids may be null or repeat; stored, as postings and ids are read apart
    rows = numbered(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "row", "scored")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    sent = rows.select("row", "text").transform(small_batches).mapInArrow(_postings(model.hot_words, model.buckets), CELLS)
    partitions = max(1, model.buckets // FINER)
    back = _dealt(cells.unionByName(sent), partitions).mapInArrow(_score_blocks(shared), BACK)
    sums = (back.repartition(partitions, "block").sortWithinPartitions("block")
            .mapInArrow(_sum_blocks, "row long, n_tokens long, n_known long, base_score double, score double"))
    return sums.join(rows.select("row", "id"), "row").select(F.col("id").alias(key), "n_tokens", "n_known", "base_score", "score")
