"""Fill-in-the-middle: a text is cut at two unit ends, and its middle is moved behind prefix and suffix.

Unit ends are found in 64-bit words. The texts of a slice lie behind each other and are read as words of
eight bytes; arithmetic on whole words sets the top bit of every byte that ends a unit, the bits are counted
per word and summed. The word of the k-th end is then found by binary search in these sums, and the byte
inside it from the running count of its eight bytes, again held in one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import slices, small_batches, utf8

ONES, HIGH, LOW = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
#: Marks of prefix, suffix and middle. A text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long"}


def as_words(raw: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, with eight to fifteen zero bytes behind them."""
    padded = np.zeros((len(raw) // 8 + 2) * 8, np.uint8)
    padded[:len(raw)] = raw
    return padded.view("<u8")


def equal_marks(words: np.ndarray, byte: int) -> np.ndarray:
    """The top bit of every byte equal to ``byte``."""
    x = words ^ (ONES * np.uint64(byte))
    return ~(((x & LOW) + LOW) | x | LOW)


def lead_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that starts a code point: all but 10xxxxxx."""
    return (~words | (words << np.uint64(1))) & HIGH


def ending_marks(words: np.ndarray, unit: str) -> np.ndarray:
    """The top bit of every byte that ends a unit: a line feed, or the byte before a code point's first."""
    if unit == "line":
        return equal_marks(words, 0x0A)
    if unit != "char":
        raise ValueError(f"unit is line or char, not {unit}")
    lead = lead_marks(words)
    return (lead >> np.uint64(8)) | (np.append(lead[1:], np.uint64(0)) << np.uint64(56))


class Marked:
    """Counts and finds marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each place."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (np.uint64(8) * inside)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th marked byte, from 0."""
        word = np.searchsorted(self.before, k, "right") - 1
        rest = (k - self.before[word]).astype(np.uint64)
        with np.errstate(over="ignore"):
            running = (self.marks[word] >> np.uint64(7)) * ONES  # byte i: marks in bytes 0 to i
            behind = ((rest * ONES | HIGH) - running) & HIGH  # bytes whose count is at most the rest
        return word * 8 + np.bitwise_count(behind)


def cut(raw: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray,
        unit: str = "line") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, the two cuts as byte places in ``raw``, and code points before and between them.

    Texts lie in ``raw`` between n + 1 ``offsets``. The cuts lie behind ``first % (n + 1)`` and
    ``second % (n + 1)`` units, the smaller first."""
    words = as_words(raw)
    ends, leads = Marked(ending_marks(words, unit)), Marked(lead_marks(words))
    start, stop = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    base = ends.rank(start)
    closed = ends.rank(stop) - base
    last = raw[np.maximum(stop - 1, 0)] if len(raw) else np.zeros(len(stop), np.uint8)
    n = closed + ((stop > start) & (last != 0x0A) if unit == "line" else 0)

    def place(k: np.ndarray) -> np.ndarray:
        inner = (k > 0) & (k <= closed)
        out = np.where(k > 0, stop, start)
        out[inner] = ends.select(base[inner] + k[inner] - 1) + 1
        return out

    a, b = first % (n + 1), second % (n + 1)
    p, m = place(np.minimum(a, b)), place(np.maximum(a, b))
    counts = [leads.rank(x) for x in (start, p, m)]
    return n, p, m, counts[1] - counts[0], counts[2] - counts[1]


def _group(column: Column, i: int) -> Column:
    return F.conv(F.substring(column, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, *, key: str = "doc_id", text: str = "text", output: str = "output", unit: str = "line",
              seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """All columns of ``docs`` and n (units of the text), form, prefix_chars, middle_chars and ``output``.

    The first four 8-digit groups of the SHA-256 of ``seed:key`` draw the two cuts, whether the text is
    changed at all (``percent`` of texts) and the order: psm puts prefix, suffix, middle behind their marks,
    spm suffix, prefix, middle. A text that is empty or holds a mark stays as it is, in form plain, with null
    counts. A null text is empty; a null key counts as the empty text; repeated rows each give a row, alike.
    Columns of these names already there are replaced. One narrow pass over whole texts.
    """
    names = [*ADDED, output]
    rest = docs.drop(*[c for c in names if c not in (key, text)])
    clash = [c for c in names if c in (key, text)]
    if clash:
        raise ValueError(f"input columns {clash} have names of the result")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    value = F.coalesce(F.col(text), F.lit(""))
    held = value.contains(PREFIX) | value.contains(SUFFIX) | value.contains(MIDDLE)
    form = (F.when((value == "") | held | (_group(digest, 2) % 100 >= percent), "plain")
            .when(_group(digest, 3) % 100 < spm_percent, "spm").otherwise("psm"))
    at = {c: f"_{c}_{i}" for i, c in enumerate(["form", "first", "second"])}
    while set(at.values()) & set(docs.columns):
        at = {k: f"_{v}" for k, v in at.items()}
    ready = rest.withColumns({at["form"]: form, at["first"]: _group(digest, 0), at["second"]: _group(digest, 1)})
    n_rest = len(rest.columns)
    marks = {"p": PREFIX.encode(), "s": SUFFIX.encode(), "m": MIDDLE.encode()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                raw, offsets = utf8(part.column(text))
                forms = part.column(at["form"]).to_pylist()
                first, second = (part.column(at[c]).to_numpy(zero_copy_only=False) for c in ("first", "second"))
                n, p, m, p_chars, m_chars = cut(raw, offsets, first, second, unit)
                whole, out = raw.tobytes(), []
                for kind, s, a, b, e in zip(forms, offsets[:-1].tolist(), p.tolist(), m.tolist(), offsets[1:].tolist()):
                    if kind == "plain":
                        out.append(whole[s:e])
                        continue
                    piece = {"p": whole[s:a], "m": whole[a:b], "s": whole[b:e]}
                    out.append(b"".join(marks[c] + piece[c] for c in kind))
                plain = np.array([kind == "plain" for kind in forms], bool)
                new = [pa.array(n, pa.int64()), part.column(at["form"]), pa.array(p_chars, pa.int64(), mask=plain),
                       pa.array(m_chars, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_rest], *new], [*part.schema.names[:n_rest], *names])

    schema = rest.withColumns({**{c: F.lit(None).cast(t) for c, t in ADDED.items()}, output: F.lit(None).cast("string")}).schema
    return ready.transform(small_batches).mapInArrow(run, schema)


def restore(changed: DataFrame, *, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """All columns and ``restored``, the text that ``output`` was made of. Only ``output`` and ``form`` are
    read; a text with marks is in form plain, so the marks of the other forms occur once each."""
    part = F.split(F.col(output), "<[PSM]>")
    text = (F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
            .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output)))
    return changed.withColumn(restored, text)
