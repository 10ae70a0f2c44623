"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of labelled texts per language, each task summing its own rows first.  The matrix of
log-probabilities (languages x buckets) and the log-priors are broadcast.  Texts are counted many at a time as rows of one sparse
matrix (row starts, buckets, counts), and its product with the log-probabilities scores them.
"""

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.scratch import free_name, over_cores

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Labelled texts used for fitting (about).
TRAINING_DOCS = 50_000
#: No language is left out; a model of more (256 MB as broadcast) is an error.
MAX_LANGUAGES = 2048
#: Characters that are counted together; a long text needs no more memory than a short one.
STEP = 1 << 18
UNKNOWN = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


class Model(NamedTuple):
    """Languages, their log-probabilities by bucket, and the logarithms of their shares of the labelled texts."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray


class Sparse(NamedTuple):
    """Counts by row and bucket: row i has the cells from starts[i] up to starts[i + 1]."""

    starts: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray


def _cells(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    return row * BUCKETS + (h % np.uint32(BUCKETS)).astype(np.int64)


def _counted(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row * BUCKETS + bucket, count) of the n-grams of texts, STEP characters at a time; n-grams lie within one text."""
    widest = max(ORDERS)
    every, lengths = "".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    for at in range(0, len(every), STEP):
        codes = np.frombuffer(every[at : at + STEP + widest - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        row = np.searchsorted(ends, np.arange(at, at + len(codes)), "right")
        starts, h, found = min(STEP, len(every) - at), np.full(len(codes), 0x9E3779B1, np.uint32), []
        for k in range(min(widest, len(codes))):
            n = len(codes) - k
            h = (h[:n] ^ codes[k:]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            if k + 1 in ORDERS:
                inside = row[:n][:starts] == row[k:][:starts]
                found.append(_cells(row[:n][:starts][inside], h[:starts][inside]))
        yield np.unique(np.concatenate(found), return_counts=True)


def counted(texts: Iterable[str]) -> Sparse:
    """Counts of the hashed n-grams of whole texts, lower-cased, white space runs as one space."""
    texts = [f" {' '.join(t.lower().split())} " for t in texts]
    cells, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        cells, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return cells, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    for part in _counted(texts):
        held.append(part)
        if len(held) == 16:  # a long text has a row of BUCKETS cells at most
            held = [summed(held)]
    if held:
        cells, counts = summed(held)
    return Sparse(np.searchsorted(cells, np.arange(len(texts) + 1) * BUCKETS), cells % BUCKETS, counts)


def batches_of(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and texts of those with a letter, about STEP characters at a time."""
    at, held, size = [], [], 0
    for i, t in enumerate(texts):
        if has_letter(t):
            at.append(i)
            held.append(t)
            size += len(t)
            if size >= STEP:
                yield at, held
                at, held, size = [], [], 0
    if held:
        yield at, held


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Model of rows with a label and a letter.

    Of more than TRAINING_DOCS rows, an even sample by the key's hash is used.  Without any row there is no language.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = min(1.0, TRAINING_DOCS / max(1, rows.select(lang).count()))
    by_hash = F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key))
    rows = rows.filter(F.pmod(by_hash, F.lit(1_000_000)) < int(share * 1_000_000)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, texts in batches_of(t.as_py() for t in batch.column(1)):
                found = counted(texts)
                for k, i in enumerate(at):
                    mine = slice(found.starts[k], found.starts[k + 1])
                    np.add.at(by.setdefault(names[i], np.zeros(BUCKETS, np.int64)), found.buckets[mine], found.counts[mine])
                    docs[names[i]] = docs.get(names[i], 0) + 1
        for name, counts in by.items():
            on = np.flatnonzero(counts)
            # bucket -1 has the number of texts
            yield pa.RecordBatch.from_pydict({"lang": [name] * (len(on) + 1), "bucket": pa.array([-1, *on], pa.int64()), "n": pa.array([docs[name], *counts[on]], pa.int64())})

    # A task gives a language at most BUCKETS cells; they are summed per bucket before they are listed.
    totals = (
        over_cores(rows).mapInArrow(sums, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    )
    found = sorted(totals.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r.lang)
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    logp, docs = np.empty((len(found), BUCKETS), np.float32), np.zeros(len(found))
    for i, r in enumerate(found):
        counts = np.full(BUCKETS, SMOOTHING, np.float64)
        for bucket, n in r.cells:
            if bucket < 0:
                docs[i] = n
            else:
                counts[bucket] += n
        logp[i] = np.log(counts / counts.sum())
    return Model([r.lang for r in found], logp, np.log(docs / docs.sum()) if found else docs)


def scores(texts: Iterable[str | None], model: Model) -> list[tuple[str, float]]:
    """The most probable language of each text and its posterior; UNKNOWN and 0 for null, texts without a letter, or no model."""
    texts = list(texts)
    out = [(UNKNOWN, 0.0)] * len(texts)
    for at, letters in batches_of(texts) if model.langs else ():
        found = counted(letters)
        # The sparse product, a language at a time; every text here has a letter, so no row is empty.
        likely = np.stack([np.add.reduceat(logp[found.buckets].astype(np.float64) * found.counts, found.starts[:-1]) for logp in model.logp]) + model.prior[:, None]
        best = likely.argmax(0)
        sure = 1 / np.exp(np.clip(likely - likely[best, np.arange(len(at))], -700, 0)).sum(0)
        for i, b, s in zip(at, best.tolist(), sure.tolist(), strict=True):
            out[i] = (model.langs[b], s)
    return out


def predicted(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with one column ``into``, a struct of lang_pred and score, from whole texts and nothing else.

    A column of that name stays, and the new one gets an underscore behind its own.
    """
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf(RESULT)
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(scores((t if isinstance(t, str) else None for t in texts), Model(*sent.value)), columns=RESULT.names)

    return over_cores(docs).withColumn(free_name(into, docs.columns), scored(F.col(text)))
