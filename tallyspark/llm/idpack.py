"""Token ids in fixed-width bit-packed files with block offsets, for vectorised numpy reading.

Layout, all integers little-endian: blocks of `BLOCK` ids, each id in `bits` bits from the lowest bit
upwards; then the byte offset of every block, the documents' ids with a null mark, and their first
positions; then a trailer of 48 bytes (magic, bits, ids, documents, position of the index). Eight ids
fill whole bytes, so every block begins on a byte and any id can be read by itself.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import written
from .tokens import chunks, worker_encoder

BLOCK = 1 << 16
MAGIC = b"IDPACK01"
TRAILER = "<8sQQQQ8x"
TRAILER_BYTES = struct.calcsize(TRAILER)
READ_IDS = 1 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, padded with zeros to a multiple of eight ids."""
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for byte in range((bits + shift + 7) // 8):
            out[:, first + byte] |= ((value >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, bits: int, at: np.ndarray) -> np.ndarray:
    """The ids at positions `at` of packed data, in any order."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    first = (at.astype(np.int64) * bits) >> 3
    value = np.zeros(len(at), np.uint64)
    for byte in range((bits + 14) // 8):
        value |= raw[first + byte].astype(np.uint64) << np.uint64(8 * byte)
    shift = (at.astype(np.uint64) * np.uint64(bits)) & np.uint64(7)
    return ((value >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Streams documents into one file; memory holds a block and the index. The file appears when closed."""

    def __init__(self, uri: str, bits: int) -> None:
        self.uri, self.bits = uri, bits
        self.fs, self.path = _at(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.rest, self.waiting = [], 0
        self.blocks, self.ids, self.starts = [], [], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        held = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint32)
        for i in range(0, n, BLOCK):
            self.blocks.append(self.out.tell())
            self.out.write(pack(held[i : min(i + BLOCK, n)], self.bits))
        self.rest, self.waiting = [held[n:]], len(held) - n

    def close(self) -> tuple[int, int]:
        self._flush(self.waiting)
        index = self.out.tell()
        null = np.array([i is None for i in self.ids], np.uint8)
        for part in (np.array(self.blocks, "<u8"), np.array([i or 0 for i in self.ids], "<i8"), null, np.array(self.starts, "<u8")):
            self.out.write(part.tobytes())
        self.out.write(struct.pack(TRAILER, MAGIC, self.bits, self.starts[-1], len(self.ids), index))
        self.out.close()
        self.fs.move(self.temporary, self.path)  # a repeated task replaces its own file
        return len(self.ids), self.starts[-1]


class Reader:
    def __init__(self, uri: str) -> None:
        fs, path = _at(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.n_ids, self.n_docs, index = struct.unpack(TRAILER, self.file.read_at(TRAILER_BYTES, size - TRAILER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"not an id file: {uri}")
        blocks = -(-self.n_ids // BLOCK)
        data = self.file.read_at(size - TRAILER_BYTES - index, index)
        self.blocks = np.append(np.frombuffer(data, "<u8", blocks), index).astype(np.int64)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, 8 * blocks)
        self.null = np.frombuffer(data, np.uint8, self.n_docs, 8 * (blocks + self.n_docs)).astype(bool)
        self.starts = np.frombuffer(data[8 * blocks + 9 * self.n_docs :], "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of positions start..stop-1; reads only the blocks that hold them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        data = self.file.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        return unpack(data, self.bits, np.arange(start - first * BLOCK, stop - first * BLOCK))

    def checksums(self):
        """(document, unsigned crc32 of its little-endian 32-bit ids), about READ_IDS ids in memory."""
        doc = 0
        while doc < self.n_docs:
            stop = max(doc + 1, int(np.searchsorted(self.starts, self.starts[doc] + READ_IDS, "right")) - 1)
            begin, end = int(self.starts[doc]), int(self.starts[stop])
            if stop == doc + 1:
                crc = 0
                for i in range(begin, end, READ_IDS):
                    crc = zlib.crc32(self.ids(i, min(end, i + READ_IDS)).astype("<u4").tobytes(), crc)
                yield doc, crc
            else:
                held = memoryview(self.ids(begin, end).astype("<u4").tobytes())
                for d in range(doc, stop):
                    yield d, zlib.crc32(held[4 * (int(self.starts[d]) - begin) : 4 * (int(self.starts[d + 1]) - begin)])
            doc = stop


def write_ids(docs: DataFrame, tokenizer: str, end: int, path: str, files: int) -> DataFrame:
    """Encode every text and write the ids in ascending doc_id order, one packed file per range of ids.

    Returns the manifest: file, uri, docs, tokens, bits. Nulls sort first, a null text has only the end
    id, repeated ids follow each other. Bounds of the ranges come from the ids alone, so each text is
    encoded once.
    """
    marks = [i / files for i in range(1, files)]
    bounds = docs.agg(F.percentile_approx("doc_id", marks or [0.5], 10_000).alias("b")).first()["b"] or []
    bounds = np.unique(np.array(bounds if marks else [], np.int64))

    def encode(batches):
        encoder = worker_encoder(tokenizer)
        width = "<u2" if encoder.vocabulary <= 1 << 16 else "<u4"
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            packed = [e.astype(width).tobytes() for part in chunks(texts) for e in encoder.encode(part, end)]
            file = [0 if i is None else int(np.searchsorted(bounds, i, "left")) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(file, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "file", "ids"]
            )

    def write(batches):
        writer, current, out, bits, width = None, None, [], None, None

        def close():
            n_docs, n_ids = writer.close()
            out.append((current, writer.uri, n_docs, n_ids, bits))

        for batch in batches:
            if bits is None:
                size = worker_encoder(tokenizer).vocabulary
                bits, width = max(1, (max(size - 1, end)).bit_length()), "<u2" if size <= 1 << 16 else "<u4"
            for doc_id, file, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "file", "ids")), strict=True):
                if file != current:
                    if writer:
                        close()
                    writer, current = Writer(f"{path}/{file:06d}.ids", bits), file
                writer.add(doc_id, np.frombuffer(ids, width))
        if writer:
            close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("file", "uri", "docs", "tokens", "bits"), r, strict=True)) for r in out],
            pa.schema([("file", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bits", pa.int32())]),
        )

    rows = docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, file int, ids binary")
    ordered = rows.repartitionById(files, F.col("file")).sortWithinPartitions("file", "doc_id", "ids")
    return written(ordered.mapInArrow(write, "file int, uri string, docs long, tokens long, bits int"))


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, uri."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("uri", before.alias("before"))

    def read(batches):
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("before").to_pylist(), strict=True):
                reader = Reader(uri)
                found = np.fromiter((c for _, c in reader.checksums()), np.int64, reader.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids, pa.int64(), mask=reader.null),
                        pa.array(reader.starts[:-1] + first, pa.int64()),
                        pa.array(np.diff(reader.starts), pa.int64()),
                        pa.array(found, pa.int64()),
                        pa.array([uri] * reader.n_docs, pa.string()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "uri"],
                )

    tasks = manifest.sparkSession.sparkContext.defaultParallelism
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, uri string"
    return files.repartition(max(tasks, int(manifest.count()))).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, end: int, path: str | None = None) -> DataFrame:
    """Write all documents' ids and read them back; see `write_ids` and `read_ids`."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/llm-ids-{uuid.uuid4().hex}"
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    _make(path)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_ids(write_ids(docs, tokenizer, end, path, files))


def _make(path: str) -> None:
    fs, at = _at(path)
    fs.create_dir(at, recursive=True)
