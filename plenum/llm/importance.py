"""Resampling towards a target distribution, with exact importance weights by bit-sliced aggregation.

Features are word n-grams, hashed into BUCKETS.  A bucket's gain compares its share of the target's features with its share of the
documents'; a document's weight is the mean gain of its features.  Gains are whole numbers, kept as signed bit planes: plane k
has a bit for each bucket whose gain has bit k, one set of planes for positive and one for negative gains.  A document's bucket
counts become planes of BUCKETS bits, too, and the sum of its gains is that of 2 ** (j + k) times the bits that are left when
its plane j meets the gains' plane k.  Whatever a text's length, that is a few words of 64 bits for each pair of planes.

Documents are drawn without replacement by Gumbel noise from a hash of their id: the highest scores (weight and noise) win.  Scores
are whole numbers in a range that the gains bound, so totals per score are a small table; ranks are such a total and a place
among the rows of the same score, a few in ten thousand of all at most.
"""

from collections.abc import Callable, Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.scratch import KEY, emitted, key_of, over_cores, stored

# Buckets, words in the longest feature, scale of gains and noise, least words, percent drawn, seed of the noise.
BUCKETS = 10000
WORDS = 1
SCALE = 1000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"

#: Texts whose counts are sliced at a time, features that this may be at most, and words whose buckets a worker keeps.
BATCH = 64
BATCH_FEATURES = 1 << 20
KEPT_WORDS = 200_000
#: Equal rows that are numbered at a time.
LOT = 1 << 16

_APART = bytes(x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_APART).split()


class _Buckets(dict):
    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[feature] = bucket = crc32(feature) % BUCKETS
        return bucket


_buckets = _Buckets()


def features(text: bytes | None, longest: int = WORDS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each run of 1 to ``longest`` of them."""
    found = words(text or b"")
    runs = [found, *([b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)] for n in range(2, longest + 1))]
    total = sum(map(len, runs))
    return len(found), np.fromiter((_buckets[f] for run in runs for f in run), np.int32, total)


def _totals(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(features(text.as_py(), longest)[1], minlength=BUCKETS)
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(counts[on], pa.int64())], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, longest: int = WORDS) -> np.ndarray:
    """How many features of all texts (column ``text``, binary) each bucket has; BUCKETS numbers, whatever the table's size."""
    rows = texts.select("text").mapInArrow(_totals(longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A whole number per bucket: SCALE times the logarithm of its share of the target over its share of the source, smoothed by 1."""
    all_source, all_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([floor(SCALE * log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def planes(numbers: np.ndarray) -> np.ndarray:
    """Bit planes of rows of numbers that are not negative: (plane, row, 64-bit word)."""
    n, width = numbers.shape
    out = np.zeros((int(numbers.max(initial=0)).bit_length(), n, -(-width // 64) * 8), np.uint8)
    for j in range(len(out)):
        out[j, :, : -(-width // 8)] = np.packbits((numbers >> j & 1).astype(np.uint8), axis=1)
    return out.view(np.uint64)


def weighed(counts: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Exact sums of gains for rows of bucket counts, from the planes of both."""
    total = np.zeros(len(counts), np.int64)
    for j, mine in enumerate(planes(counts)):
        for sign, sliced in ((1, positive), (-1, negative)):
            for k, gain in enumerate(sliced):
                total += sign * (np.bitwise_count(mine & gain).sum(axis=1, dtype=np.int64) << (j + k))
    return total


def _weights(gain: np.ndarray, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    positive, negative = planes(np.maximum(gain, 0)[None]), planes(np.maximum(-gain, 0)[None])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, sums, held = [], [], [], []

            def close() -> None:
                at = np.repeat(np.arange(len(held)), [*map(len, held)]) * BUCKETS
                counts = np.bincount(at + np.concatenate(held), minlength=len(held) * BUCKETS).reshape(len(held), BUCKETS)
                sums.append(weighed(counts, positive, negative))
                held.clear()

            for text in batch.column(0):
                n, found = features(text.as_py(), longest)
                n_words.append(n)
                n_features.append(len(found))
                held.append(found)
                if len(held) == BATCH or sum(map(len, held)) >= BATCH_FEATURES:
                    close()
            if held:
                close()
            n = np.array(n_features, np.int64)
            mean = np.concatenate([np.empty(0, np.int64), *sums]) // np.maximum(n, 1)
            rest = dict(zip(batch.schema.names[1:], batch.columns[1:], strict=True))
            yield pa.RecordBatch.from_pydict(rest | {"n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(n), "weight": pa.array(mean)})

    return weigh


def noise(doc_id: Column) -> Column:
    """Gumbel noise of scale SCALE from a hash of the id, floored; null hashes as an empty id."""
    mark = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``scored`` (doc_id, n_words, score and others) with ``rank`` (1, 2, ...) of the drawn rows.

    Of the rows with LEAST_WORDS words the highest scores are drawn, ties by doc_id (null last), then by the other columns.  Rows
    equal in all columns are one row with a number until they are ranked.
    """
    fits = F.col("n_words") >= LEAST_WORDS
    falling = Window.orderBy(F.desc("score"))
    totals = scored.filter(fits).groupBy("score").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    draws = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("draws")
    totals = totals.select("score", before, draws, F.lit(True).alias("fits")).filter("before < draws")
    rows = scored.groupBy(*scored.columns).agg(F.count("*").alias("times")).withColumn("fits", fits)
    rest = [c for c in scored.columns if c not in ("doc_id", "score")]
    order = Window.partitionBy("score", "fits").orderBy(F.asc_nulls_last("doc_id"), *rest).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.sum("times").over(order), F.lit(0))).join(totals, ["score", "fits"], "left")
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / LOT))))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.col("lot") * LOT + 1, F.least("times", (F.col("lot") + 1) * LOT))))
    rank = F.col("before") + F.col("earlier") + F.col("nth")
    return rows.select(*scored.columns, F.when(rank <= F.col("draws"), rank).alias("rank"))


def _scored(docs: DataFrame, target: DataFrame, keys: list[str], longest: int) -> DataFrame:
    raw = F.col("text").cast("binary").alias("text")
    texts = over_cores(docs.select(raw, F.col("doc_id").cast("long").alias("doc_id"), *keys))
    gain = gains(bucket_counts(texts, longest), bucket_counts(target.select(raw), longest))
    columns = ", ".join(["doc_id long", *(f"{k} long" for k in keys), "n_words long", "n_features long", "weight long"])
    weights = stored(texts.mapInArrow(_weights(gain, longest), columns), "weights")
    return weights.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def resampled(docs: DataFrame, target: DataFrame, longest: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    Null and empty texts have no features, weight 0 and are never drawn; rows with the same id share their noise and are drawn one by
    one; an empty target has no features, so that rare buckets gain; an empty table gives no rows.  Other columns are not read.
    """
    return ranked(_scored(docs, target, [], longest), percent)


def drawn(docs: DataFrame, target: DataFrame, longest: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The drawn rows of ``docs``, columns unchanged, each as often as it is drawn."""
    keyed = docs.select(*key_of(docs), "doc_id", "text")
    ranks = ranked(_scored(keyed, target, KEY, longest), percent)
    return emitted(docs, ranks.withColumn("drawn", F.col("rank").isNotNull()), "drawn")
