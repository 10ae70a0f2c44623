"""Quality rules: compression bands.

Zstandard ratios (raw bytes over compressed bytes) of the whole document and of chunks of two sizes reject text that is too
repetitive (ratio above a limit) or incompressible (below one).  Short texts compress little and long ones more, so the
limits belong to length classes.
"""

import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.scratch import free_name, over_cores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
LEVEL = 3
#: Sizes of the chunks; a text under two chunks of a size has none of that size, and a rest belongs to the last chunk.
CHUNK_BYTES = (1024, 8192)
#: Share of a document's chunks of one size that may lie outside the band of their length.
BAD_CHUNK_SHARE = 0.2
#: Fixed values: (bytes up to, lowest ratio, highest ratio).  In half octaves, about 2 % outside the range of the 86 175 rows of
#: check_l that are labelled as good and pass the base rules, and of their chunks.  Under 45 and over 65 536 bytes there are too
#: few (2 and 5), so these two classes are wider.
BANDS = (
    (45, 0.65, 1.10), (64, 0.81, 1.11), (91, 0.86, 1.31), (128, 0.89, 1.33), (181, 1.01, 1.57), (256, 1.08, 1.66),
    (362, 1.21, 1.75), (512, 1.27, 1.80), (724, 1.38, 1.93), (1024, 1.48, 2.14), (1448, 1.57, 2.13), (2048, 1.69, 2.21),
    (2896, 1.75, 2.25), (4096, 1.84, 2.30), (5793, 1.91, 2.35), (8192, 1.96, 2.42), (11585, 2.10, 2.45), (16384, 2.14, 2.48),
    (23170, 2.20, 2.52), (32768, 2.21, 2.55), (46341, 2.26, 2.59), (65536, 2.30, 2.61), (None, 2.30, 3.00),
)
FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("ratio", T.DoubleType())]
    + [T.StructField("n_chunks", T.LongType()), T.StructField("n_bad_chunks", T.LongType()), T.StructField("kept", T.BooleanType())]
)


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for upto, low, high in BANDS if upto is None or n_bytes <= upto)


def repeated_words(words: list[str]) -> int:
    """Number of words that lie in a WINDOW-word window which occurs twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    rank = ids[:n]  # exact ranks of growing windows: no hash can collide
    for k in range(1, WINDOW):
        rank = np.unique(rank * len(codes) + ids[k : k + n], return_inverse=True)[1]
    again = np.bincount(rank)[rank] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    covered[starts] += 1  # starts are distinct
    covered[starts + WINDOW] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def outside(raw: bytes, size: int, packer: zstandard.ZstdCompressor) -> tuple[int, int]:
    """Number of chunks of a size, and of those outside the band of their length; every byte lies in one of them."""
    n, bad = len(raw) // size, 0
    if n < 2:
        return 0, 0
    for k in range(n):
        part = raw[k * size : (k + 1) * size if k < n - 1 else len(raw)]
        low, high = band(len(part))
        bad += not low <= len(part) / len(packer.compress(part)) <= high
    return n, bad


def measure(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    """The values of FIELDS for one whole text; null has no words and fails."""
    text = text or ""
    words = WORD.findall(text)
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    raw = text.encode("utf-8", "surrogatepass")
    ratio = len(raw) / len(packer.compress(raw)) if raw else 0.0
    low, high = band(len(raw))
    tested = [outside(raw, size, packer) for size in CHUNK_BYTES]
    chunks, bad = map(sum, zip(*tested, strict=True))
    kept = not failed and low <= ratio <= high and all(k <= BAD_CHUNK_SHARE * n for n, k in tested)
    return (len(words), sum(map(len, words)), len(SYMBOL.findall(text)), duplicate_lines(text), repeats, failed, ratio, chunks, bad, kept)


@F.pandas_udf(FIELDS)
def _measured(texts: pd.Series) -> pd.DataFrame:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    return pd.DataFrame([measure(t if isinstance(t, str) else None, packer) for t in texts], columns=FIELDS.names)


def quality(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with one column ``into`` (a struct of FIELDS).

    Nulls and empty texts count as no words: base_failed, not kept.  Rows are independent: repeated rows get equal values.
    A column of that name stays, and the new one gets an underscore behind its own.
    """
    return over_cores(docs).withColumn(free_name(into, docs.columns), _measured(F.col(text)))


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose text the rules keep."""
    return over_cores(docs).filter(_measured(F.col(text))["kept"])
