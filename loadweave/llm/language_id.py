"""Language identification: one interpolated Kneser-Ney character model per language.

Letters are lower-cased, everything else is a word boundary. A word is predicted letter by letter and
then its end, from up to ``ORDER - 1`` characters back to the boundary before it, so a text's score
depends on that text alone. The models share sorted hash arrays: a row holds the log probability of one
n-gram in every language. A text belongs to the language with the lowest cross-entropy per character;
it is rejected if that entropy lies far outside what the language's own texts show at that length.

The models learn from a hash sample of whole texts of about ``train_chars`` characters per language (a
documented bound of the fit; counts inside the sample are distributed), a second sample calibrates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import HashArray, mix, multipliers, segment_sums, slices, small_batches, utf8

ORDER = 5
SPACE = 32
UNDETERMINED = "und"
#: Code points from here on hold no letters.
LETTERS_END = 0x32400
FACTORS = multipliers(ORDER + 1)
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to lower-case letter, or a space; built once per worker."""
    if not _FOLD:
        fold = np.full(0x110000, SPACE, np.uint32)
        for point in range(LETTERS_END):
            letter = chr(point)
            if letter.isalpha():
                lower = letter.lower()
                fold[point] = ord(lower) if len(lower) == 1 else point
        _FOLD.append(fold)
    return _FOLD[0]


def letter_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts with one space after each word, the place of each in its word (1 for the
    first letter), and the n + 1 offsets of the texts in the stream."""
    raw, offsets = utf8(column)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    codes = np.full(len(points) + len(starts) - 1, SPACE, np.uint32)  # a space closes each text
    texts = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    codes[np.arange(len(points)) + texts] = _fold()[points]
    bounds = starts + np.arange(len(starts))
    letter = codes != SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    codes = codes[keep]
    index = np.arange(len(codes))
    ends = np.where(codes == SPACE, index, -1)
    before = np.maximum.accumulate(np.concatenate([[-1], ends[:-1]])) if len(codes) else ends
    return codes, index - before, bounds


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER, the hash of the n characters ending at each place. Places whose gram reaches
    over the word's start hold no meaning."""
    out, total = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            shifted = np.full(len(codes), SPACE, np.uint64)
            shifted[n - 1:] = codes[:len(codes) - n + 1]
            total = total + (shifted + np.uint64(1)) * FACTORS[n]
            out.append(mix(total + np.uint64(n) * FACTORS[0]))
    return out


def _with_edge(codes: np.ndarray) -> np.ndarray:
    """A space before the first word, which follows no other."""
    return np.concatenate([np.array([SPACE], np.uint32), codes])


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n): counts of the n-grams of 1..ORDER characters inside words."""
    for batch in batches:
        for part in slices(batch, "text"):
            langs = np.asarray(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                rows = pa.array(np.flatnonzero(langs == lang))
                codes, place, _ = letter_stream(part.column("text").take(rows))
                codes, place = _with_edge(codes), np.concatenate([[0], place])
                grams, counts = [], []
                for n, hashes in enumerate(gram_hashes(codes), 1):
                    at = np.flatnonzero(place >= max(1, n - 1))
                    _, first, count = np.unique(hashes[at], return_index=True, return_counts=True)
                    ends = at[first]
                    flat = codes[ends[:, None] + np.arange(1 - n, 1)].astype("<u4").tobytes().decode("utf-32-le")
                    grams += [flat[i:i + n] for i in range(0, len(flat), n)]
                    counts.append(count)
                if grams:
                    yield pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams,
                                           "n": pa.array(np.concatenate(counts), pa.int64())})


@dataclass
class Model:
    """Log probabilities and log back-off weights per language; calibration of confidence and rejection."""

    langs: list[str]
    grams: list[HashArray]
    log_p: list[np.ndarray]
    contexts: list[HashArray]
    log_weight: list[np.ndarray]
    unseen: np.ndarray
    beta: float = 1.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    noise: np.ndarray | None = None
    limit: float = np.inf

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character in each language (texts x languages), and the characters."""
        codes, place, bounds = letter_stream(column)
        size = np.diff(bounds)
        if not len(codes) or not self.langs:
            return np.zeros((len(size), len(self.langs))), size
        hashes = [h[1:] for h in gram_hashes(_with_edge(codes))]
        edge = [h[:-1] for h in gram_hashes(_with_edge(codes))]
        score = np.zeros((len(codes), len(self.langs)), np.float32)
        longest = np.minimum(place + 1, ORDER)
        todo = np.zeros(0, np.int64)
        for n in range(ORDER, 0, -1):
            todo = np.concatenate([todo, np.flatnonzero(longest == n)])
            at = self.grams[n - 1].find(hashes[n - 1][todo])
            hit = at >= 0
            score[todo[hit]] += self.log_p[n - 1][at[hit]]
            todo = todo[~hit]
            if n > 1 and len(todo):
                ctx = self.contexts[n - 2].find(edge[n - 2][todo])
                known = ctx >= 0
                score[todo[known]] += self.log_weight[n - 2][ctx[known]]
        score[todo] += self.unseen
        return -segment_sums(score, bounds) / np.maximum(size, 1)[:, None], size

    def decide(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: none), confidence, its cross-entropy, and whether the text is rejected."""
        entropy, size = self.entropies(column)
        if not self.langs:
            none = np.zeros(len(size))
            return none.astype(int) - 1, none, none, np.ones(len(size), bool)
        best = entropy.argmin(1)
        lowest = entropy[np.arange(len(best)), best]
        margin = self.beta * np.sqrt(size)[:, None] * (entropy - lowest[:, None])
        sure = 1 / np.exp(-margin).sum(1)
        odd = np.zeros(len(best), bool)
        if self.centre is not None:
            scale = np.sqrt(self.spread[best] + self.noise[best] / np.maximum(size, 1))
            odd = (lowest - self.centre[best]) / scale > self.limit
        empty = size == 0
        return np.where(empty, -1, best), np.where(empty, 0.0, sure), np.where(empty, 0.0, lowest), odd | empty


def _sorted(keys: np.ndarray) -> tuple[HashArray, np.ndarray]:
    order = np.argsort(keys)
    return HashArray(keys[order]), order


def kneser_ney(langs: list[str], lang: np.ndarray, grams: list[str], counts: np.ndarray) -> Model:
    """Interpolated Kneser-Ney over n-gram counts. The longest grams and those at a word's start have
    their own counts; all others count the distinct characters before them."""
    width = len(langs)
    lengths = np.array([len(g) for g in grams], int)
    model = Model(langs, [], [], [], [], np.zeros(width))
    keys_of, suffix_of, count_of, codes_of = [], [], [], []
    for n in range(1, ORDER + 1):
        rows = np.flatnonzero(lengths == n)
        codes = np.frombuffer("".join(grams[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(-1, n)
        with np.errstate(over="ignore"):
            sums = [((codes[:, n - j].astype(np.uint64) + np.uint64(1)) * FACTORS[j]) for j in range(1, n + 1)]
            key = mix(sum(sums, np.zeros(len(rows), np.uint64)) + np.uint64(n) * FACTORS[0])
            tail = mix(sum(sums[:-1], np.zeros(len(rows), np.uint64)) + np.uint64(n - 1) * FACTORS[0])
        keys, first, which = np.unique(key, return_index=True, return_inverse=True)
        table = np.zeros((len(keys), width))
        table[which, lang[rows]] = counts[rows]
        keys_of.append(keys)
        suffix_of.append(tail[first])
        count_of.append(table)
        codes_of.append(codes[first])
    alphabet = len(keys_of[0])
    p = np.full((1, width), 1.0 / (alphabet + 1))
    for n in range(1, ORDER + 1):
        own = count_of[n - 1].copy()
        if n < ORDER:
            # one more character in front: how many different ones
            into = np.searchsorted(keys_of[n - 1], suffix_of[n])
            follow = np.zeros_like(own)
            np.add.at(follow, into, (count_of[n] > 0).astype(float))
            inner = codes_of[n - 1][:, 0] != SPACE if n > 1 else np.ones(len(own), bool)
            own[inner] = np.where(own[inner] > 0, np.maximum(follow[inner], 1.0), 0.0)
        ones, twos = (own == 1).sum(0), (own == 2).sum(0)
        discount = np.where(ones + 2 * twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.05, 0.95)
        if n == 1:
            context = np.zeros(len(own), int)
            context_keys = np.zeros(1, np.uint64)
        else:
            codes = codes_of[n - 1]
            with np.errstate(over="ignore"):
                head = sum(((codes[:, n - 1 - j].astype(np.uint64) + np.uint64(1)) * FACTORS[j] for j in range(1, n)),
                           np.zeros(len(codes), np.uint64))
                head = mix(head + np.uint64(n - 1) * FACTORS[0])
            context_keys, context = np.unique(head, return_inverse=True)
        total = np.zeros((len(context_keys), width))
        types = np.zeros_like(total)
        np.add.at(total, context, own)
        np.add.at(types, context, (own > 0).astype(float))
        seen = total > 0
        weight = np.where(seen, discount * types / np.where(seen, total, 1), 1.0)
        if n == 1:
            lower = np.broadcast_to(p, own.shape)
            model.unseen = np.log(weight[0] * p[0])
        else:
            lower = p[np.searchsorted(keys_of[n - 2], suffix_of[n - 1])]
            model.contexts.append(HashArray(context_keys))
            model.log_weight.append(np.log(weight).astype(np.float32))
        first = np.where(seen[context], np.maximum(own - discount, 0) / np.where(seen[context], total[context], 1), 0.0)
        p = first + weight[context] * lower
        model.grams.append(HashArray(keys_of[n - 1]))
        model.log_p.append(np.log(p).astype(np.float32))
    return model


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", train_chars: int = 1_000_000,
        reject_quantile: float = 0.995, reject_slack: float = 3.0) -> Model:
    """Learns from rows with a text and a language. ``train_chars`` bounds the characters sampled per
    language. A text is rejected beyond ``reject_slack`` times the distance from its language's usual
    entropy that all but ``1 - reject_quantile`` of the calibration texts keep to."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["chars"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], [], [], [], [], np.zeros(0))
    share = {k: min(0.8, train_chars / max(v, 1)) for k, v in totals.items()}
    shares = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumns({"u": unit, "share": F.element_at(shares, F.col("lang"))})
    counted = (drawn.where("u < share").select("lang", "text")
               .transform(small_batches).mapInArrow(count_grams, "lang string, gram string, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())
    place = {k: i for i, k in enumerate(langs)}
    model = kneser_ney(langs, np.array([place[x] for x in counted["lang"].to_pylist()], int),
                       counted["gram"].to_pylist(), counted["n"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                entropy, size = shared.value.entropies(part.column("text"))
                yield pa.record_batch({"lang": part.column("lang"), "size": pa.array(size, pa.int64()),
                                       "entropy": pa.array(list(entropy), pa.list_(pa.float64()))})

    held = (drawn.where("u >= share and u < share * 1.25").select("lang", "text")
            .transform(small_batches).mapInArrow(measure, "lang string, size long, entropy array<double>").toArrow())
    keep = held["size"].to_numpy() > 0
    _calibrate(model, np.array([place[x] for x in held["lang"].to_pylist()], int)[keep], held["size"].to_numpy()[keep],
               np.array(held["entropy"].to_pylist(), float).reshape(-1, len(langs))[keep], reject_quantile, reject_slack)
    return model


def _calibrate(model: Model, lang: np.ndarray, size: np.ndarray, entropy: np.ndarray, quantile: float, slack: float) -> None:
    if not len(lang):
        return
    own = entropy[np.arange(len(lang)), lang]
    grid = np.geomspace(0.05, 20, 40)
    gap = np.sqrt(size)[:, None] * (entropy - own[:, None])
    model.beta = float(grid[np.argmin([np.log(np.exp(np.clip(-b * gap, -500, 500)).sum(1)).mean() for b in grid])])
    width = len(model.langs)
    centre, spread, noise = np.zeros(width), np.full(width, 1e-3), np.ones(width)
    everything = np.median(own)
    for i in range(width):
        mine = own[lang == i]
        centre[i] = np.median(mine) if len(mine) else everything
        # the square of the distance falls with length as spread + noise / size
        if len(mine) > 10:
            inverse, square = 1 / size[lang == i], (mine - centre[i]) ** 2
            square = np.minimum(square, np.quantile(square, 0.99))
            slope = np.polyfit(inverse, square, 1)
            noise[i], spread[i] = max(slope[0], 0.05), max(slope[1], 1e-3)
    model.centre, model.spread, model.noise = centre, spread, noise
    away = np.abs(own - centre[lang]) / np.sqrt(spread[lang] + noise[lang] / size)
    model.limit = float(slack * max(np.quantile(away, quantile), 3.0))


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, entropy, rejected), a row for each row of ``docs``, in one narrow pass.

    A null text, an empty one or one without letters is ``und`` with score 0, and is rejected. Repeated
    rows give repeated results; other columns are not read. With no learned language all is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.langs, UNDETERMINED], object)
        for batch in batches:
            for part in slices(batch, "text"):
                best, sure, entropy, odd = shared.value.decide(part.column("text"))
                yield pa.record_batch({
                    "id": part.column("id"), "lang_pred": pa.array(names[best], pa.string()),
                    "score": sure, "entropy": entropy, "rejected": odd})

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.transform(small_batches).mapInArrow(run, f"id {kind}, lang_pred string, score double, entropy double, rejected boolean") \
        .withColumnRenamed("id", key)


def keep_identified(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(~shared.value.decide(part.column(text))[3]))

    return docs.transform(small_batches).mapInArrow(run, docs.schema)
