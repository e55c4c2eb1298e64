"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

The BPE result of a piece is the one token sequence in which each token is its own encoding and each
neighbouring pair is compatible: no merge across their border would have come before the merges that
built them. An Aho-Corasick automaton gives the longest token at each place; the encoder takes it if it
is compatible with the token before, tries shorter ones if not, and steps back from places that lead
nowhere, marking them, so each place is left at most once and the time is linear in the piece.

Pieces recur, so a worker keeps the ids of recent short ones in a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import slices, small_batches, tidy
from loadweave.llm.pieces import Splitter, byte_letters

#: Pieces in each of a worker's two tables of recent ones, and the longest that is kept.
KEPT, KEPT_LENGTH = 120_000, 64
END = "\n"  # stands for the end-of-word mark; no byte letter is a line feed


class Bpe:
    def __init__(self, path: str):
        self.split = Splitter(path)
        model = self.split.model
        mark = model["end_of_word_suffix"] or ""
        self.shown = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.split.special.items()}

        def inner(token: str) -> str:
            return token[:-len(mark)] + END if mark and token.endswith(mark) and token != mark else token

        self.text = {i: inner(t) for t, i in model["vocab"].items()}
        self.id = {t: i for i, t in self.text.items()}
        self.letters = byte_letters()  # by Latin-1 letter, which stands for the byte
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right, whole = self.id[inner(a)], self.id[inner(b)], self.id[inner(a + b)]
            self.merged.setdefault((left, right), (rank, whole))
            if whole not in self.halves:
                self.halves[whole], self.rank[whole] = (left, right), rank
        self.compatible: dict[tuple[int, int], bool] = {}
        # A token that other merges would have split differently never appears in an encoding.
        own = {i for i in self.text if i not in self.halves}
        for token, (left, right) in sorted(self.halves.items(), key=lambda x: self.rank[x[0]]):
            if left in own and right in own and self.pair_fits(left, right, before=self.rank[token]):
                own.add(token)
        self.length = {i: len(self.text[i]) for i in own}
        self.longest = ahocorasick.Automaton()
        for i in own:
            self.longest.add_word(self.text[i], (i, len(self.text[i]) - 1))
        self.longest.make_automaton()
        self.own = own
        self.prefix: dict[int, int | None] = {}
        self.known: dict[str | int, tuple[int, ...]] = {}
        self.older: dict[str | int, tuple[int, ...]] = {}
        pieces = [(self.shown[i] + " ").encode() if i in self.shown else b"" for i in range(max(self.shown) + 1)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)

    def pair_fits(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether two neighbouring tokens stay apart: going back through the merges that built them, latest
        first, no pair across the border merges earlier than the step that hides it."""
        limit = 1 << 60 if before is None else before
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint[0] < limit:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = min(limit, a), self.halves[left][1]
            else:  # of two equal merges the left one comes first
                limit, right = min(limit, b + 1), self.halves[right][0]

    def _shorter(self, token: int) -> int | None:
        if token not in self.prefix:
            text = self.text[token]
            self.prefix[token] = next((self.id[text[:n]] for n in range(len(text) - 1, 0, -1)
                                       if self.id.get(text[:n], -1) in self.own), None)
        return self.prefix[token]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode().decode("latin-1").translate(self.letters) + END
        whole = self.id.get(text)
        if whole in self.own:
            return (whole,)
        best: list[int | None] = [None] * (len(text) + 1)
        for last, (token, back) in self.longest.iter(text):
            best[last - back] = token  # matches come by their end, so the longest comes last
        length, compatible, out = self.length, self.compatible, []
        dead, goal = set(), len(text)
        at, token, before = 0, best[0], None
        while at < goal:
            while token is not None:
                to = at + length[token]
                if to not in dead:
                    if before is None:
                        break
                    fits = compatible.get((before, token))
                    if fits is None:
                        fits = self._fits(before, token)
                    if fits:
                        break
                token = self._shorter(token)
            if token is not None:
                out.append(token)
                at, before, token = to, token, best[to]
            elif before is None:
                raise ValueError("the vocabulary lacks a byte")
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else None
        return tuple(out)

    def _fits(self, left: int, right: int) -> bool:
        if len(self.compatible) > 10 * KEPT:
            self.compatible.clear()
        fits = self.compatible[left, right] = self.pair_fits(left, right)
        return fits

    def encode(self, text: str) -> list[tuple[int, ...]]:
        """The ids of a text, piece by piece."""
        pieces = self.split.pieces(text)
        new = set(pieces).difference(self.known)
        if len(self.known) + len(new) > KEPT:
            # pieces still in use come back from the older table
            self.older, self.known = self.known, {}
            new = set(pieces)
        older, known = self.older, self.known
        for p in new:
            known[p] = older.get(p) or ((p,) if isinstance(p, int) else self.encode_piece(p))
        out = [known[p] for p in pieces]
        for p in new:
            if not isinstance(p, int) and len(p) > KEPT_LENGTH:
                del known[p]
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts in a row and their n + 1 offsets, for ids in a row with n + 1 bounds.
        Tokens are shown joined by one space; ids outside the vocabulary show nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.offsets) - 1), ids, 0) if len(ids) else ids
        start, size = self.offsets[ids], np.diff(self.offsets)[ids]
        ends = np.cumsum(size, dtype=np.int64)
        raw = self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
        cuts = np.concatenate([[0], ends])[bounds]
        keep = np.ones(len(raw), bool)
        keep[cuts[1:][np.diff(cuts) > 0] - 1] = False  # no space behind a text's last token
        return raw[keep], np.concatenate([[0], np.cumsum(keep)])[cuts]


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def forget(path: str) -> None:
    """Drops the pieces and pairs kept so far, not the vocabulary."""
    bpe = _LOADED.get(path)
    if bpe is not None:
        bpe.known, bpe.older, bpe.compatible = {}, {}, {}


def _ids(bpe: Bpe, texts: pa.Array) -> pa.ListArray:
    flat, sizes = [np.zeros(0, np.int32)], [0]
    for value in texts.to_pylist():
        flat.append(np.fromiter(chain.from_iterable(bpe.encode(value) if value else ()), np.int32))
        sizes.append(len(flat[-1]))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(flat), pa.int32()))


def _texts(bpe: Bpe, lists: pa.ListArray) -> pa.Array:
    lists = lists.fill_null([])
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    raw, cuts = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False), bounds)
    return pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(cuts.astype(np.int64)),
                                            pa.py_buffer(np.ascontiguousarray(raw))).cast(pa.string())


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None,
           give_back: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``ids``, the token ids of the whole text (null and empty: none); with
    ``decoded`` a column of what they decode to as well.

    One narrow pass. ``path`` names the tokenizer file on every machine. Columns of these names already
    there are replaced. Special tokens written in a text are encoded as such. ``give_back`` drops the tables of pieces at the
    end of each task, for jobs that go on with other operators in the same workers; the next task learns them again.
    """
    rest = docs.drop(ids, *([decoded] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, text):
                new = [_ids(bpe, part.column(text))]
                if decoded:
                    new.append(_texts(bpe, new[0]))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, ids, decoded][:len(part.columns) + len(new)])

    schema = rest.withColumn(ids, F.lit(None).cast("array<int>"))
    schema = (schema.withColumn(decoded, F.lit(None).cast("string")) if decoded else schema).schema
    return rest.transform(small_batches).mapInArrow(tidy(run, lambda: forget(path)) if give_back else run, schema)


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns and ``decoded``, the text of the ids (null and empty: the empty text)."""
    rest = encoded.drop(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(bpe, part.column(ids))], [*part.schema.names, decoded])

    return rest.transform(small_batches).mapInArrow(run, rest.withColumn(decoded, F.lit(None).cast("string")).schema)
