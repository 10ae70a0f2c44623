"""Packing: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``SIZE`` ids.  The driver sees only the histogram of piece lengths (SIZE numbers).
Lengths are placed longest first, each into the pack pattern that is shortest so far, whole counts at a time; a length that
fits no pattern opens new packs.  Every placing either uses a pattern up or finishes the length, so a length adds at most one
pattern to those that live: at most SIZE + 1 patterns, each with fewer than sqrt(2 * SIZE) different lengths.  That bounds
the table of slots that is joined back, whatever the input's size.  Pieces join it by their rank among equal lengths.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.scratch import over_cores, stored
from plenum.llm.tokens import encoder, vocabulary_path

SIZE = 4096
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, chunk long, nth long"


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns as (packs of this pattern, ((length, times), ...)), every piece in exactly one slot."""
    by_height: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    heights: list[int] = []

    def put(height: int, count: int, pattern: tuple[tuple[int, int], ...]) -> None:
        if height not in by_height:
            by_height[height] = []
            heapq.heappush(heights, height)
        by_height[height].append((count, pattern))

    full = []
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left = histogram[length]
        while left:
            if heights and heights[0] + length <= size:
                height = heights[0]
                count, pattern = by_height[height].pop()
                if not by_height[height]:
                    del by_height[height]
                    heapq.heappop(heights)
                times = max(1, min((size - height) // length, left // count))
                used = min(count, left // times)
                if used < count:
                    put(height, count - used, pattern)
            else:
                height, pattern = 0, ()
                times = min(size // length, left)
                used = left // times
            left -= used * times
            made = (*pattern, (length, times))
            if height + length * times == size:
                full.append((used, made))
            else:
                put(height + length * times, used, made)
    return full + [x for h in sorted(by_height) for x in by_height[h]]


def slots(found: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence_id, offset, times): ranks run pack by pack, then by place."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for packs, pattern in found:
        offset = 0
        for length, times in pattern:
            first = taken.get(length, 0)
            taken[length] = first + packs * times
            out.append((length, first, taken[length], sequence, offset, times))
            offset += length * times
        sequence += packs
    return out


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """Every document's ids cut into pieces, stored; ``nth`` counts a length's pieces within ``chunk``, a writing task."""
    vocabulary = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(t.as_py())
                n = len(ids) // 4
                for at in range(0, n, size):
                    length = min(size, n - at)
                    rows.append((d, at, length, n, ids[4 * at : 4 * (at + length)], chunk, int(seen[length])))
                    seen[length] += 1
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary(), "chunk": pa.int64(), "nth": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return stored(over_cores(rows).mapInArrow(cut, PIECES), "pieces")


def packed(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit), sequence_id, offset.

    Null and empty texts hold the end id alone.  Rows are packed as often as they occur, also with null or equal doc_id.  An
    empty table gives no rows.  Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    cut = pieces(docs, size, vocabulary)
    per_chunk = cut.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(per_chunk.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    histogram = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    table = spark.createDataFrame(slots(patterns(histogram, size)), "length long, first long, upto long, sequence long, place long, times long")
    # A chunk's pieces of one length are a run of ranks; the runs, not the pieces, meet the slots' intervals.
    runs = (
        bases.join(F.broadcast(table), "length")
        .filter((F.col("base") < F.col("upto")) & (F.col("base") + F.col("n") > F.col("first")))
        .groupBy("length", "chunk", "base")
        .agg(F.sort_array(F.collect_list(F.struct("first", "upto", "sequence", "place", "times"))).alias("slots"))
    )
    rank = F.col("base") + F.col("nth")
    slot = F.filter("slots", lambda s: (s["first"] <= rank) & (rank < s["upto"]))[0]
    at = rank - F.col("slot.first")
    return (
        cut.join(runs, ["length", "chunk"])
        .withColumn("slot", slot)
        .select(
            "doc_id", "start", "length", "doc_tokens", "ids",
            (F.col("slot.sequence") + F.floor(at / F.col("slot.times"))).cast("long").alias("sequence_id"),
            (F.col("slot.place") + at % F.col("slot.times") * F.col("length")).cast("long").alias("offset"),
        )
    )
