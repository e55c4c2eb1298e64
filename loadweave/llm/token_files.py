"""Token ids in bit-plane files.

A segment holds whole documents in order: a header, an index of its documents, an index of its blocks,
and the blocks. A block is a fixed number of ids turned into bit planes (plane b holds bit b of each id)
or byte planes; each plane is compressed with Zstandard by itself, planes above the highest bit in use
are left out. A reader needs only the planes of the blocks it wants. Segments are the binary rows of a
Parquet folder, with shard, number, and counts beside them, so that any file system Spark knows can hold
them; shards follow the order of the ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loadweave.llm.common import slices, small_batches
from loadweave.llm.pieces import Splitter, byte_letters

MAGIC = b"IDPLANES"
HEADER = struct.Struct("<8sBBIIQIII")  # magic, version, bits per plane, block, documents, ids, blocks, index bytes, crc
PLANE = struct.Struct("<QI")
#: Ids in a block, and in a segment before it is closed.
BLOCK, SEGMENT = 65_536, 262_144
#: Pieces in a generation, and the longest that is kept.
KEPT, KEPT_LENGTH = 300_000, 64
STORED = "shard int, segment int, n_docs long, n_ids long, before long, body binary"


def split_planes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Planes of a block of unsigned 32-bit ids, lowest first, up to the highest in use."""
    used = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, :max(1, -(-used // 8))]
    if bits == 8:
        return list(np.ascontiguousarray(raw.T))
    flat = np.unpackbits(raw, axis=1, bitorder="little", count=used)
    return list(np.packbits(np.ascontiguousarray(flat.T), axis=1, bitorder="little"))


def join_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    raw = np.zeros((4, n), np.uint8)
    if bits == 8:
        for i, plane in enumerate(planes):
            raw[i] = np.frombuffer(plane, np.uint8)
    else:
        for i, plane in enumerate(planes):
            raw[i // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << (i % 8)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def pack_segment(doc_ids: list, sizes: list[int], ids: np.ndarray, bits: int = 1, block: int = BLOCK) -> bytes:
    """One segment's bytes. A null document id is kept apart in a mask."""
    press = zstandard.ZstdCompressor(level=1)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = press.compress(known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
                          + np.array(sizes, "<u8").tobytes())
    index, data, at = [struct.pack("<I", len(docs)), docs], [], 0
    for start in range(0, len(ids), block):
        planes = [press.compress(p.tobytes()) for p in split_planes(ids[start:start + block], bits)]
        index.append(struct.pack("<B", len(planes)))
        for plane in planes:
            index.append(PLANE.pack(at, len(plane)))
            at += len(plane)
        data += planes
    head, body = b"".join(index), b"".join(data)
    blocks = -(-len(ids) // block)
    return HEADER.pack(MAGIC, 1, bits, block, len(doc_ids), len(ids), blocks, len(head), zlib.crc32(head + body)) + head + body


def unpack_segment(body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids) of a segment; a damaged one raises ValueError."""
    magic, version, bits, block, n_docs, n_ids, n_blocks, index_bytes, crc = HEADER.unpack_from(body)
    if magic != MAGIC or version != 1 or zlib.crc32(body[HEADER.size:]) != crc:
        raise ValueError("not a whole segment of token ids")
    unpress = zstandard.ZstdDecompressor()
    at = HEADER.size
    size = struct.unpack_from("<I", body, at)[0]
    docs = unpress.decompress(body[at + 4:at + 4 + size]) if n_docs else b""
    known = np.frombuffer(docs, np.uint8, n_docs)
    doc_ids = [d if k else None for k, d in zip(known, np.frombuffer(docs, "<i8", n_docs, n_docs).tolist())]
    sizes = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    at, data, out = at + 4 + size, HEADER.size + index_bytes, []
    for i in range(n_blocks):
        planes = []
        count = body[at]
        at += 1
        for _ in range(count):
            start, length = PLANE.unpack_from(body, at)
            at += PLANE.size
            planes.append(unpress.decompress(body[data + start:data + start + length]))
        out.append(join_planes(planes, min(block, n_ids - i * block), bits))
    return doc_ids, sizes, np.concatenate(out) if out else np.zeros(0, "<u4")


class Generation(dict):
    """Numbers of pieces, and the ids of all of them in a row. A piece asked for and not held gets the next
    number and waits in ``new`` for its ids."""

    def __init__(self):
        super().__init__()
        self.new: list[str | int] = []
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, "<u4")

    def __missing__(self, piece: str | int) -> int:
        self[piece] = at = len(self.bounds) - 1 + len(self.new)
        self.new.append(piece)
        return at

    def fill(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Gives the waiting pieces their ids. Long pieces are forgotten; their numbers stay taken."""
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        for p in self.new:
            if not isinstance(p, int) and len(p) > KEPT_LENGTH:
                del self[p]
        self.new = []

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, their ids in a row)."""
        start, sizes = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(sizes)
        return sizes, self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - sizes), sizes)]


class Encoder:
    """Ids by the tokenizers library, called for pieces not met lately: a generation of pieces holds up to
    KEPT, and the one before it is kept beside it."""

    def __init__(self, path: str):
        self.split = Splitter(path)
        # texts are cut here, so the library only has to merge
        self.library = Tokenizer(Tokenizer.from_file(path).model)
        self.letters = byte_letters()
        self.known, self.older = Generation(), Generation()

    def _merge(self, pieces: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, their ids in a row)."""
        words = ["" if isinstance(p, int) else p if p.isascii() and p.isprintable() else
                 p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        found = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
        sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))
        special = np.flatnonzero([isinstance(p, int) for p in pieces])
        ends = np.cumsum(sizes)
        ids = np.insert(np.array(found.ids, "<u4"), ends[special], [pieces[i] for i in special])
        sizes[special] = 1
        return sizes, ids

    def _numbers(self, pieces: Iterable[str | int], n: int) -> np.ndarray:
        """The numbers of n pieces in ``known``."""
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, n)
        new = self.known.new
        if new:
            before = np.fromiter((self.older.get(p, -1) for p in new), np.int64, len(new))
            met, unmet = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
            parts = [self.older.take(before[met]), self._merge([new[i] for i in unmet])]
            mixed = Generation()
            mixed.fill(*map(np.concatenate, zip(*parts)))
            place = np.empty(len(new), np.int64)
            place[np.concatenate([met, unmet])] = np.arange(len(new))
            self.known.fill(*mixed.take(place))
        return at

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each whole text, the ids of all in a row). A null text is empty."""
        if len(self.known.bounds) > KEPT or len(self.known.ids) > 8 * KEPT:
            self.known, self.older = Generation(), self.known
        raw = [self.split.latin(t or "") for t in texts]
        latin = np.array([r is not None for r in raw], bool)
        # Latin-1 texts are cut at once, and each distinct piece looked up once; others are cut one by one
        own, pieces = self.split.cut_latin([r for r in raw if r is not None])
        coded = pieces.dictionary_encode()
        _, ends, body = coded.dictionary.buffers()
        ends, whole = np.frombuffer(ends, np.int32)[:len(coded.dictionary) + 1].tolist(), str(body or b"", "latin-1")
        distinct = [whole[a:b] for a, b in zip(ends, ends[1:])]
        cut = [self.split.pieces(t) for t, r in zip(texts, raw) if r is None]
        counts = np.empty(len(texts), np.int64)
        counts[latin], counts[~latin] = own, [len(c) for c in cut]
        found = self._numbers(chain(distinct, *cut), len(distinct) + int(counts[~latin].sum()))
        at, of_latin = np.empty(int(counts.sum()), np.int64), np.repeat(latin, counts)
        at[of_latin], at[~of_latin] = found[coded.indices.to_numpy()], found[len(distinct):]
        sizes, ids = self.known.take(at)
        return np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]), ids


_LOADED: dict[str, Encoder] = {}


def write_ids(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 1, key: str = "doc_id", text: str = "text",
              bits: int = 1) -> None:
    """Encodes whole texts, closes each with ``end_id`` and writes them to ``folder`` in ascending order of
    ``key`` (nulls first, ties by text). A null text is empty and so holds only the end. Documents are
    dealt by ranges of the key; each range is a shard. ``bits`` is 1 for bit planes, 8 for byte planes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _LOADED.setdefault(tokenizer, None) or Encoder(tokenizer)
        _LOADED[tokenizer] = encoder
        shard = TaskContext.get().partitionId()
        doc_ids, sizes, coded, n, segment, before = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            body = pack_segment(doc_ids, sizes, np.concatenate(coded), bits)
            return pa.record_batch({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()),
                "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([n], pa.int64()),
                "before": pa.array([before], pa.int64()), "body": pa.array([body], pa.binary())})

        for batch in batches:
            for part in slices(batch, "text"):
                found, ids = encoder.encode(part.column("text").to_pylist())
                ids = np.insert(ids, np.cumsum(found), end_id)
                at = 0
                for doc, size in zip(part.column("id").to_pylist(), (found + 1).tolist()):
                    doc_ids.append(doc)
                    sizes.append(size)
                    coded.append(ids[at:at + size])
                    at, n = at + size, n + size
                    if n >= SEGMENT:
                        yield close()
                        doc_ids, sizes, coded, n, segment, before = [], [], [], 0, segment + 1, before + n
        if doc_ids:
            yield close()

    ordered = (docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
               .repartitionByRange("id").sortWithinPartitions("id", "text"))
    ordered.transform(small_batches).mapInArrow(run, STORED).write.option("compression", "none").parquet(folder)


def read_ids(spark: SparkSession, folder: str, *, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) from the files of ``write_ids``: the ids of all documents before it, and its own
    as unsigned 32-bit little-endian bytes. An empty folder's table gives no rows."""
    stored = spark.read.schema(STORED).parquet(folder)
    # one row per shard, and shards are shuffle partitions, so few whatever the input
    sums = sorted((r["shard"], r["n"]) for r in stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = {}, 0
    for shard, n in sums:
        bases[shard], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, before, body = (batch.column(c)[i].as_py() for c in ("shard", "before", "body"))
                doc_ids, sizes, ids = unpack_segment(body)
                ends = np.cumsum(sizes)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
                    None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64)),
                    pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]).cast(pa.binary())
                yield pa.record_batch({"id": pa.array(doc_ids, pa.int64()),
                                       "start": pa.array(bases[shard] + before + ends - sizes, pa.int64()), "ids": raw})

    return (stored.select("shard", "before", "body").transform(small_batches).mapInArrow(run, "id long, start long, ids binary")
            .withColumnRenamed("id", key))
