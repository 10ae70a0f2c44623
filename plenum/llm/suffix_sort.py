"""Repeated byte strings by a depth-limited radix sort of the suffixes.

A byte is removed if a string of THRESHOLD bytes that covers it also starts anywhere else.  So suffixes need an order through
their first THRESHOLD bytes only (a suffix's window), and the groups that are equal through them are the repeated strings.
Passes deal suffixes by digits, the most significant first; what is alone in its group leaves.

* A pass of depth d compares, for each window, the d bytes at one place of it: where its least digest of d bytes lies, the
  leftmost of several.  The place depends on the window's bytes alone, so equal windows have equal d bytes there.  Neighbours
  mostly share the place, so a run of suffixes is dealt as one entry: its d bytes' digest, and the digest of all its bytes.
* Runs alone with their d bytes have no partner and leave.  If all runs with the same d bytes have the same bytes throughout,
  they are equal through the threshold and leave as repeated.  The others go on to the next pass, with their bytes but
  without the rest of their texts.
* Depths rise to the threshold.  In the last pass every suffix is an entry of its own under 128 bits of digest: its groups are
  exactly the repeated windows.

Runs of a chunk of texts are reduced to one entry per digit before they are shuffled, so a passage that very many documents
share has one row per chunk.  Between passes only narrow entries and undecided runs travel; whole texts do so once, at the end.
Digests are polynomials over 64-bit words by prefix sums, so that any string's takes constant time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.scratch import over_cores, stored

#: Bytes of a repeated string.
THRESHOLD = 200
#: Bytes of text in a chunk (a longer text is a chunk of its own), and suffixes that are hashed at a time.
CHUNK = 4 << 20
BLOCK = 1 << 19

STATE = "chunk long, doc array<int>, at array<long>, size array<long>, raw binary"
CHUNKS = f"{STATE}, ids array<long>"
STEPPED = f"{STATE}, span_doc array<int>, first array<long>, last array<long>"
ENTRIES = "digit long, chunk long, bytes long, n long"
FOUND = "doc_id long, n_bytes long, spans array<struct<first:long,last:long>>, kept binary"

_PLACE = np.uint64((1 << 20) - 1)
_NOWHERE = np.uint64(0xFFFFFFFFFFFFFFFF)


def depths(threshold: int) -> list[int]:
    """How many bytes the passes compare, up to the threshold."""
    out, gap = [], threshold // 2
    while gap > 2:
        out.append(threshold - gap)
        gap //= 3
    return [*out, threshold]


class _Sums:
    """Digests of the strings of a buffer from prefix sums; ``seed`` gives the polynomial."""

    def __init__(self, seed: int, longest: int) -> None:
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(0, 1 << 64, 256, np.uint64)
        base = int(rng.integers(0, 1 << 64, dtype=np.uint64)) | 5  # odd
        self.powers, self.inverse = (self._powers(b, longest + 1) for b in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def over(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.bytes[raw] * self.powers[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _mixed((sums[last] - sums[first]) * self.inverse[first] + (last - first).astype(np.uint64))

    def all_of(self, sums: np.ndarray, length: int) -> np.ndarray:
        """The digests of all strings of one length."""
        n = len(sums) - length
        return _mixed((sums[length:] - sums[:n]) * self.inverse[:n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each ``n`` values in a row."""
    width = 1
    while 2 * width <= n:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    return np.minimum(values[: len(values) - (n - width)], values[n - width :]) if n > width else values


_sums: dict[tuple[int, int], _Sums] = {}


def _polynomial(seed: int, threshold: int) -> _Sums:
    return _sums.setdefault((seed, threshold), _Sums(seed, BLOCK + threshold))


def runs(raw: np.ndarray, sizes: np.ndarray, depth: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes of the pieces that ``raw`` is made of: first, last (exclusive), digit and digest of their bytes.

    Suffixes with fewer than ``threshold`` bytes left in their piece are in no run.
    """
    begins = np.cumsum(sizes) - sizes
    whole = sizes >= threshold
    steps = np.zeros(len(raw) + 1, np.int8)
    steps[begins[whole]] = 1
    np.add.at(steps, (begins + sizes)[whole] - threshold + 1, -1)
    inside = np.cumsum(steps, dtype=np.int8)[:-1].astype(bool)
    sums = _polynomial(1, threshold)
    out = []
    for b in range(0, len(raw) - threshold + 1, BLOCK):
        part = raw[b : b + BLOCK + threshold - 1]
        s = sums.over(part)
        digests = sums.all_of(s, depth)
        here = _least((digests & ~_PLACE) | np.arange(len(digests), dtype=np.uint64), threshold - depth + 1)
        here[~inside[b : b + len(here)]] = _NOWHERE
        first = np.concatenate(([0], np.flatnonzero(here[1:] != here[:-1]) + 1))
        last = np.append(first[1:], len(here))
        on = here[first] != _NOWHERE
        first, last = first[on], last[on]
        digit = digests[(here[first] & _PLACE).astype(np.int64)]
        if depth < threshold:
            all_bytes = sums.of(s, first, last + threshold - 1)
        else:
            other = _polynomial(2, threshold)
            all_bytes = other.all_of(other.over(part), threshold)[first]
        out.append((first + b, last + b, digit, all_bytes))
    if not out:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["raw"]), np.uint8), np.array(row["size"], np.int64)


def _chunked(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents (doc_id, text as bytes) to CHUNKS of ``most`` bytes or a little more."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, texts, size, made
            raw = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            row = {"chunk": (part << 32) + made, "doc": [*range(len(ids))], "at": [0] * len(ids), "size": [*map(len, texts)], "raw": raw, "ids": ids}
            ids, texts, size, made = [], [], 0, made + 1
            return _rows([row], CHUNKS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= most:
                    yield close()
        if ids:
            yield close()

    return gather


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_KINDS["array<struct<first:long,last:long>>"] = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ", 1) for x in text.split(", "))])


def _rows(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _schema(schema))


def _entries(depth: int, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """STATE to ENTRIES: an entry per digit of a chunk with the number of its runs, negative if they differ in their bytes."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for i in range(len(batch)) for row in batch.slice(i, 1).to_pylist()):
            _, _, digit, all_bytes = runs(*_opened(row), depth, threshold)
            if not len(digit):
                continue
            order = np.argsort(digit)
            digit, all_bytes = digit[order], all_bytes[order]
            last = depth == threshold
            if last:
                order = np.lexsort((all_bytes, digit))
                digit, all_bytes = digit[order], all_bytes[order]
            new = np.flatnonzero(np.concatenate(([True], (digit[1:] != digit[:-1]) | (last & (all_bytes[1:] != all_bytes[:-1])))))
            n = np.diff(new, append=len(digit))
            differ = np.minimum.reduceat(all_bytes, new) != np.maximum.reduceat(all_bytes, new)
            columns = (digit[new].view(np.int64), np.full(len(new), row["chunk"]), all_bytes[new].view(np.int64), np.where(differ, -n, n))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_schema(ENTRIES))

    return enter


def _verdicts(entries: DataFrame, last: bool) -> DataFrame:
    """Digits that occur twice or more, for each chunk that has them: ``chunk, digit, bytes, differ``."""
    group = Window.partitionBy("digit", "bytes") if last else Window.partitionBy("digit")
    differ = (F.min("bytes").over(group) != F.max("bytes").over(group)) | (F.min("n").over(group) < 0)
    found = entries.select("chunk", "digit", "bytes", F.sum(F.abs("n")).over(group).alias("runs"), differ.alias("differ"))
    return found.filter("runs > 1").select("chunk", "digit", "bytes", "differ")


def _stepped(depth: int, threshold: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A chunk's STATE and verdicts to its repeated windows as spans, and its undecided runs as pieces."""

    def step(state: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not (state.num_rows and verdicts.num_rows):
            return pa.Table.from_batches([], _schema(STEPPED))
        row = state.to_pylist()[0]
        raw, sizes = _opened(row)
        first, last, digit, all_bytes = runs(raw, sizes, depth, threshold)
        known = verdicts.column("digit").to_numpy().view(np.uint64)
        if depth == threshold:
            pair = np.dtype([("digit", np.uint64), ("bytes", np.uint64)])
            known = np.rec.fromarrays([known, verdicts.column("bytes").to_numpy().view(np.uint64)], dtype=pair)
            digit = np.rec.fromarrays([digit, all_bytes], dtype=pair)
        differ = verdicts.column("differ").to_numpy(zero_copy_only=False)
        order = np.argsort(known)
        known, differ = known[order], differ[order]
        at = np.minimum(np.searchsorted(known, digit), len(known) - 1)
        found = known[at] == digit
        begins = np.cumsum(sizes) - sizes
        doc, offset = np.array(row["doc"], np.int32), np.array(row["at"], np.int64) - begins

        def strings(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Piece, begin and end of the bytes under these runs; runs that follow each other are one."""
            a, b = first[on], last[on]
            piece = np.searchsorted(begins + sizes, a, side="right")
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != b[:-1]) | (piece[1:] != piece[:-1])
            heads = np.flatnonzero(new)
            return piece[heads], a[heads], b[np.append(heads[1:], len(a)) - 1] + threshold - 1 if len(a) else a

        out = {"chunk": row["chunk"]}
        piece, a, b = strings(found & ~differ[at])
        out |= {"span_doc": doc[piece], "first": a + offset[piece], "last": b + offset[piece]}
        piece, a, b = strings(found & differ[at])
        left = b"".join(raw[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True))
        out |= {"doc": doc[piece], "at": a + offset[piece], "size": b - a, "raw": zstandard.ZstdCompressor(level=1).compress(left) if left else None}
        return pa.Table.from_batches([_rows([out], STEPPED)])

    return step


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, those that overlap or touch joined."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1]))) if len(first) else np.empty(0, np.int64)
    return first[new], reach[np.append(new[1:], len(first)) - 1] if len(first) else reach


def _cut(chunk: pa.Table, spans: pa.Table) -> pa.Table:
    """A chunk's documents with what is removed and what is left of them."""
    out = []
    for row in chunk.to_pylist():
        raw = memoryview(zstandard.ZstdDecompressor().decompress(row["raw"]))
        doc, first, last = (np.concatenate([np.array(x, np.int64) for x in spans.column(c).to_pylist()] or [np.empty(0, np.int64)]) for c in ("span_doc", "first", "last"))
        order = np.argsort(doc, kind="stable")
        doc, first, last = doc[order], first[order], last[order]
        edges = np.searchsorted(doc, np.arange(len(row["ids"]) + 1))
        begin = 0
        for i, (doc_id, size) in enumerate(zip(row["ids"], row["size"], strict=True)):
            a, b = (x.tolist() for x in merged(first[edges[i] : edges[i + 1]], last[edges[i] : edges[i + 1]]))
            kept = b"".join(raw[begin + x : begin + y] for x, y in zip([0, *b], [*a, size], strict=True))
            out.append({"doc_id": doc_id, "n_bytes": size, "spans": [{"first": x, "last": y} for x, y in zip(a, b, strict=True)], "kept": kept})
            begin += size
    return pa.Table.from_batches([_rows(out, FOUND)])


def repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, n_bytes, ``spans`` of removed bytes (maximal, end exclusive) and ``kept``, the bytes left.

    Null texts are empty; texts under ``threshold`` bytes stay whole; repeated rows and rows with equal or null ids are separate
    documents, so their long texts are removed; an empty table gives no rows.  Other columns are not read.
    """
    if not 1 <= threshold <= BLOCK:
        raise ValueError(f"the threshold must lie between 1 and {BLOCK}")
    texts = over_cores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    chunks = stored(texts.mapInArrow(_chunked(CHUNK), CHUNKS), "chunks")
    state, spans = chunks.drop("ids"), []
    for depth in depths(threshold):
        verdicts = _verdicts(state.mapInArrow(_entries(depth, threshold), ENTRIES), depth == threshold)
        found = stored(state.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(_stepped(depth, threshold), STEPPED), f"depth_{depth}")
        spans.append(found.filter(F.size("first") > 0).select("chunk", "span_doc", "first", "last"))
        state = found.filter("raw is not null").select("chunk", "doc", "at", "size", "raw")
    return chunks.groupBy("chunk").cogroup(reduce(DataFrame.unionByName, spans).groupBy("chunk")).applyInArrow(_cut, FOUND)
