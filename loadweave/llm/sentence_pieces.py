"""SentencePiece encoding that keeps, for every piece, the bytes of the text it came from.

The model file's normaliser is applied here: at each place the longest prefix known to its compiled character
map (a double-array trie) is replaced, blanks are escaped, and every byte of the result remembers the place
in the source of the characters that made it. The normalised text is cut where no piece of the
vocabulary can lie across, equal stretches are merged once, and the running byte lengths of the pieces, looked
up in the alignment, give their source spans. A character without a piece becomes byte pieces; all but
the last of them have empty spans.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import slices, small_batches, utf8

BLANK = "▁"
UNKNOWN, CONTROL, USER, BYTE = 2, 3, 4, 6
#: Stretches kept in each of two generations, and the longest that is kept.
KEPT, KEPT_LENGTH = 200_000, 64


# --- The model file ----------------------------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, object, bytes]]:
    """(number, value, its bytes with the key) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        start = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at:at + size], at + size
        else:
            raise ValueError("not a model file")
        yield key >> 3, value, data[start:at]


def read_character_map(blob: bytes) -> dict[str, str]:
    """The replacements of a compiled character map: a trie's size, its units, then zero-ended texts.

    A unit of the trie holds a label in its low byte (a value if the top bit is set), whether a value
    hangs below it in bit 8, and the distance to its children in the bits from 10, times 256 if bit 9 is set.
    """
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4)
    texts = blob[4 + size:]

    def children(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    out = {}
    todo = [(children(int(units[0])), b"")]
    while todo:
        at, prefix = todo.pop()
        places = at ^ np.arange(1, 256)
        fits = places < len(units)
        labels = np.flatnonzero(fits & ((units[np.where(fits, places, 0)] & 0x800000FF) == np.arange(1, 256))) + 1
        for label in labels.tolist():
            unit = int(units[at ^ label])
            below, key = (at ^ label) ^ children(unit), prefix + bytes([label])
            if unit & 0x100:
                start = int(units[below]) & 0x7FFFFFFF
                out[key.decode()] = texts[start:texts.index(b"\0", start)].decode()
            todo.append((below, key))
    return out


class Normaliser:
    """A normaliser specification: character map, prefix blank, removal of extra blanks, escaping."""

    def __init__(self, spec: bytes):
        self.prefix, self.trim, self.escape = True, True, True
        self.map: dict[str, str] = {}
        for number, value, _ in fields(spec):
            if number == 2:
                self.map = read_character_map(value)
            elif number in (3, 4, 5):
                setattr(self, {3: "prefix", 4: "trim", 5: "escape"}[number], bool(value))
        self.longest = max(map(len, self.map), default=0)
        # where a replacement may start: a key of one character, or the first two of a longer one
        single = {k for k in self.map if len(k) == 1}
        pairs: dict[str, set[str]] = {}
        for k in self.map:
            if len(k) > 1:
                pairs.setdefault(k[1], set()).add(k[0])
        if self.map:
            any_of = "[{}]".format
            parts = [any_of("".join(map(re.escape, sorted(single))))] if single else []
            if pairs:
                firsts = "".join(map(re.escape, sorted(set().union(*pairs.values()))))
                parts.append(f"[{firsts}](?=[{''.join(map(re.escape, sorted(pairs)))}])")
            self.start = re.compile("|".join(parts))

    def _mapped(self, text: str) -> tuple[str, np.ndarray]:
        """The text after longest-prefix replacement, and the source character of each character."""
        out, origin, at = [], [], 0
        hit = self.start.search(text)
        while hit:
            i = hit.start()
            size = next((n for n in range(min(self.longest, len(text) - i), 0, -1) if text[i:i + n] in self.map), 0)
            if size:
                made = self.map[text[i:i + size]]
                out += [text[at:i], made]
                origin += [np.arange(at, i), np.full(len(made), i)]
                at = i + size
            hit = self.start.search(text, i + max(size, 1))
        return "".join(out) + text[at:], np.concatenate([*origin, np.arange(at, len(text))])

    def one(self, text: str) -> tuple[str, np.ndarray]:
        """A normalised text, and for each of its bytes the source byte; the end has an entry of its own."""
        points = _points(text)
        place = np.concatenate([[0], np.cumsum(_widths(points))])
        changed, origin = self._mapped(text) if self.map else (text, np.arange(len(text)))
        points = _points(changed)
        end, first = place[-1], 0
        if self.trim:
            blank = points == 0x20
            # the prefix blank lies behind the blanks that are dropped in front
            alone = (origin == np.arange(len(origin))) & (np.append(origin[1:], -1) != origin)
            first = int(np.argmin(np.append(blank & alone, False)))
            keep = ~(blank & np.concatenate([[True], blank[:-1]])) if len(points) else np.zeros(0, bool)
            points, origin = points[keep], origin[keep]
            others = np.flatnonzero((points != 0x20) & ((points != ord(BLANK)) | (not self.escape)))
            size = others[-1] + 1 if len(others) else 0
            end = place[origin[size]] if size < len(points) else end
            points, origin = points[:size], origin[:size]
        if not len(points):
            return "", np.array([0])
        if self.prefix:
            points, origin = np.concatenate([[0x20], points]), np.concatenate([[first], origin])
        if self.escape:
            points = np.where(points == 0x20, ord(BLANK), points)
        normal = points.astype("<u4").tobytes().decode("utf-32-le")
        return normal, np.append(np.repeat(place[origin], _widths(points)), end)

    def all(self, texts: list[str], raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Normalised texts, and their alignments (with an end each) in a row."""
        if self.map or self.trim:
            both = [self.one(t) for t in texts]
            return [b[0] for b in both], np.concatenate([b[1] for b in both] or [np.zeros(0, np.int64)])
        # without map and trimming only blanks change, so all texts are aligned at once
        normal = [t.replace(" ", BLANK) for t in texts] if self.escape else list(texts)
        wide = 3 if self.escape else 1
        if self.prefix:
            mark = BLANK if self.escape else " "
            normal = [mark + t if t else t for t in normal]
        start, size = offsets[:-1], np.diff(offsets)
        place = np.arange(len(raw))
        lead = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, place, 0)) if len(raw) else place
        times = np.where(raw == 0x20, wide, 1)
        times[start[size > 0]] += wide if self.prefix else 0
        ends = np.concatenate([[0], np.cumsum(times)])[offsets[1:]]
        local = np.repeat(lead - np.repeat(start, size), times)
        return normal, np.insert(local, ends, size)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _widths(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


# --- Encoding and decoding ---------------------------------------------------------------------


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("loadweave-one-each", _one_each)


class Pieces:
    """A model with byte pieces: normaliser, vocabulary tables and merges."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = file.read()
        spec, rest, vocabulary, trainer = b"", [], [], {}
        for number, value, whole in fields(model):
            if number == 1:
                entry = {n: v for n, v, _ in fields(value)}
                vocabulary.append((entry.get(1, b"").decode(), entry.get(3, 1)))
            elif number == 2:
                trainer = {n: v for n, v, _ in fields(value)}
            if number == 3:
                spec = value
            else:
                rest.append(whole)
        if not trainer.get(35) or trainer.get(24) or any(kind == USER for _, kind in vocabulary):
            raise ValueError("only models with byte pieces, blanks in front and no pieces of the user's own are read")
        self.normaliser = Normaliser(spec)
        # the library merges text that is normalised already: every switch of its normaliser is off
        self.library = sentencepiece.SentencePieceProcessor()
        self.library.LoadFromSerializedProto(b"".join(rest) + b"\x1a\x06\x18\x00\x20\x00\x28\x00")
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        shown, sizes = [], []
        for name, kind in vocabulary:
            byte = bytes([int(name[3:5], 16)]) if kind == BYTE else None
            shown.append(byte or {CONTROL: b"", UNKNOWN: trainer.get(44, " ⁇ ".encode())}.get(
                kind, name.replace(BLANK, " ").encode()))
            sizes.append(0 if kind in (CONTROL, UNKNOWN) else 1 if byte else len(name.encode()))
        self.sizes = np.array(sizes, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in shown])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(shown), np.uint8)
        self.opens = np.array([kind == 1 and name.startswith(BLANK) for name, kind in vocabulary])
        whole = any(BLANK in name.lstrip(BLANK) for name, _ in vocabulary)
        self.cut = re.compile("(?s).+" if whole else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merged(self, normal: str) -> bytes:
        stretches = self.cut(normal)
        new = set(stretches).difference(self.known)
        if len(self.known) + len(new) > KEPT:
            # stretches still in use come back from the older table
            self.older, self.known = self.known, {}
            new = set(stretches)
        known, older = self.known, self.older
        fresh = []
        for s in new:
            found = older.get(s)
            if found is None:
                fresh.append(s)
            else:
                known[s] = found
        for s, ids in zip(fresh, self.library.encode(fresh, num_threads=1) if fresh else ()):
            known[s] = np.array(ids, "<u4").tobytes()
        out = b"".join([known[s] for s in stretches])
        for s in fresh:
            if len(s) > KEPT_LENGTH:
                del known[s]
        return out

    def encode(self, texts: pa.Array, add_begin: bool, add_end: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of each text as bytes, and for all of them in a row where their spans begin and end."""
        raw, offsets = utf8(texts)
        normal, align = self.normaliser.all([t or "" for t in texts.to_pylist()], raw, offsets)
        first, last = (np.array([i], "<u4").tobytes() if on else b"" for i, on in ((self.begin, add_begin), (self.end, add_end)))
        coded = [first + self._merged(t) + last for t in normal]
        size = self.sizes[np.frombuffer(b"".join(coded), "<u4")]
        # every text's alignment has one entry more than its normalised text has bytes
        ends = np.cumsum(size) + np.repeat(np.arange(len(coded)), [len(c) // 4 for c in coded])
        return coded, align[ends - size], align[ends]

    def decode(self, coded: list[bytes]) -> pa.Array:
        """The texts of ids: control pieces show nothing, one blank in front goes, a byte that is part of
        no character shows as U+FFFD. Ids outside the vocabulary show nothing."""
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
        known = ids < len(self.sizes)
        ids = np.where(known, ids, 0)
        start, size = self.offsets[ids], np.where(known, np.diff(self.offsets)[ids], 0)
        bounds = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int64)
        # the first visible piece of a text loses the blank that stands for its beginning
        visible = np.concatenate([np.flatnonzero(size), [len(size)]])
        head = visible[np.searchsorted(visible, bounds[:-1])]
        head = head[head < bounds[1:]]
        if self.normaliser.prefix or self.normaliser.trim:
            head = head[self.opens[ids[head]]]
            start[head] += 1
            size[head] -= 1
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = self.blob[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
        cuts = ends[bounds]
        try:
            raw.tobytes().decode()
            if ((raw[cuts[:-1][np.diff(cuts) > 0]] & 0xC0) == 0x80).any():
                raise ValueError
        except ValueError:
            return pa.array([raw[a:b].tobytes().decode(errors="loadweave-one-each") for a, b in zip(cuts[:-1], cuts[1:])], pa.string())
        return pa.LargeStringArray.from_buffers(len(coded), pa.py_buffer(cuts.astype(np.int64)),
                                                pa.py_buffer(np.ascontiguousarray(raw))).cast(pa.string())


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """One model per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", begins: str = "begins", ends: str = "ends",
           decoded: str | None = None, add_begin: bool = True, add_end: bool = True) -> DataFrame:
    """All columns of ``docs``; ``ids``, unsigned 32-bit little-endian ids of the whole text in a row of bytes;
    ``begins`` and ``ends``, the source bytes of each piece; with ``decoded`` what the ids decode to.

    Null and empty texts hold only the ids of begin and end. Repeated rows each give a row. Columns of
    these names already there are replaced. ``path`` names the model file on every machine. One narrow pass.
    """
    names = [ids, begins, ends, *([decoded] if decoded else [])]
    if text in names:
        raise ValueError(f"{text} is the name of a result")
    rest = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in slices(batch, text):
                coded, first, last = model.encode(part.column(text), add_begin, add_end)
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]), pa.int32())
                new = [_binary(coded), *[pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (first, last)]]
                if decoded:
                    new.append(model.decode(coded))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])

    kinds = ["binary", "array<int>", "array<int>", "string"]
    schema = rest.withColumns({n: F.lit(None).cast(t) for n, t in zip(names, kinds)}).schema
    return rest.transform(small_batches).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns and ``decoded``, the text of the ids in ``ids`` (null and empty: the empty text)."""
    rest = encoded.drop(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = model.decode([i or b"" for i in part.column(ids).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, decoded])

    return rest.transform(small_batches).mapInArrow(run, rest.withColumn(decoded, F.lit(None).cast("string")).schema)
