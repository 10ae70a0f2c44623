"""Token ids in binary files of directly addressable codes.

An id is split into 8-bit chunks, lowest first.  Level k holds chunk k of every id that has one, and a bitmap that tells
which of them continue on level k + 1; a rank directory counts the set bits before every 512th, so an id's place on the next
level is one lookup and one popcount.  Any token, or any document's tokens, is read without decoding what lies before.

Files hold documents in ascending doc_id order (null first, equal ids by text).  Spark range-partitions and sorts the rows;
each task writes the segments of its range under names that no other attempt uses, and only files named in the committed
manifest are ever read.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.scratch import shared_dir, stored
from plenum.llm.tokens import encoder, vocabulary_path

MAGIC = b"PLDAC001"
CHUNK_BITS = 8
BLOCK = 512
#: A segment is closed at the first document that reaches this many ids.
SEGMENT_IDS = 2_000_000
MANIFEST = "part int, segment int, path string, n_docs long, n_ids long"


def _levels(ids: np.ndarray) -> Iterator[tuple[bytes, bytes, bytes, int]]:
    while True:
        more = ids >> CHUNK_BITS
        goes_on = more != 0
        padded = np.zeros(-(-max(len(ids), 1) // BLOCK) * BLOCK, bool)
        padded[: len(ids)] = goes_on
        directory = np.concatenate(([0], np.cumsum(padded.reshape(-1, BLOCK).sum(1)))).astype("<u8")
        yield (ids & 0xFF).astype(np.uint8).tobytes(), np.packbits(padded, bitorder="little").tobytes(), directory.tobytes(), len(ids)
        ids = more[goes_on]
        if not len(ids):
            return


def to_bytes(doc_ids: list[int | None], starts: list[int], ids: np.ndarray) -> bytes:
    """One segment: its documents' ids and starts, then the levels."""
    levels = list(_levels(ids.astype(np.uint32)))
    out = [MAGIC, struct.pack("<QQI", len(doc_ids), len(ids), len(levels))]
    out += [np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([*starts, len(ids)], "<u8").tobytes()]
    for chunks, bits, directory, n in levels:
        out += [struct.pack("<Q", n), chunks, bits, directory]
    return b"".join(out)


class Segment:
    """Random access to a segment's ids."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = len(MAGIC)
        n_docs, self.n_ids, n_levels = struct.unpack_from("<QQI", raw, at)
        at += 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, kind, n, at)
            at += x.nbytes
            return x

        nulls, ids = take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [None if z else int(d) for z, d in zip(nulls, ids, strict=True)]
        self.starts = take("<u8", n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-max(n, 1) // BLOCK)
            self.levels.append((take("u1", n), take("u1", blocks * BLOCK // 8), take("<u8", blocks + 1)))

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Set bits before position i."""
        block = i // BLOCK
        first = block * BLOCK // 8
        inside = np.unpackbits(bits[first : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(directory[block]) + int(inside.sum())

    def between(self, a: int, b: int) -> np.ndarray:
        """Ids a up to b, exclusive, as unsigned 32-bit integers."""
        out = np.zeros(b - a, np.uint32)
        where = np.arange(b - a)
        for k, (chunks, bits, directory) in enumerate(self.levels):
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            on = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where = where[on]
            if not len(where):
                break
            a = self._rank(bits, directory, a)
            b = a + len(where)
        return out

    def token(self, i: int) -> int:
        return int(self.between(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.between(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, path: str, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """Encode every whole text and write segments below ``path``; returns the committed manifest, a row per file.

    Null and empty texts hold the end id alone.  Repeated rows are written as often as they occur.  An empty table gives no
    file and an empty manifest.  Columns other than doc_id and ``text`` are not read.
    """
    vocabulary = vocabulary or vocabulary_path()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, store = TaskContext.get().partitionId(), None
        encode = encoder(vocabulary).encode
        doc_ids, starts, held, size, made = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, starts, held, size, made, store
            if store is None:
                store = fs.FileSystem.from_uri(path)
                store[0].create_dir(store[1], recursive=True)
            name = f"{part:06d}-{made:05d}-{uuid.uuid4().hex}.dac"
            with store[0].open_output_stream(f"{store[1]}/{name}") as f:
                f.write(to_bytes(doc_ids, starts, np.frombuffer(b"".join(held), "<u4")))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([made], pa.int32()), "path": [name], "n_docs": [len(doc_ids)], "n_ids": [size]})
            doc_ids, starts, held, size, made = [], [], [], 0, made + 1
            return row

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(t.as_py())
                doc_ids.append(d)
                starts.append(size)
                held.append(ids)
                size += len(ids) // 4
                if size >= SEGMENT_IDS:
                    yield close()
        if doc_ids:
            yield close()

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(rows.mapInArrow(segments, MANIFEST), "manifest")


def read(manifest: DataFrame, path: str) -> DataFrame:
    """A row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (binary)."""
    before = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}") as f:
                    segment = Segment(f.read())
                ids = [segment.document(k).astype("<u4").tobytes() for k in range(len(segment.doc_ids))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(segment.doc_ids, pa.int64()),
                    "start": pa.array(segment.starts[:-1].astype(np.int64) + base),
                    "n_tokens": pa.array(np.diff(segment.starts).astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                })

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "before").repartition(n, "path").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` to a new shared folder and read every document back from the files."""
    path = shared_dir(docs.sparkSession)
    return read(write(docs, path, vocabulary), path)
