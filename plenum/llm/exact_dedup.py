"""Exact duplicates by a tree-merge of sorted digest runs, with DataFrame operations only.

Rows are dealt over FAN_IN ** levels places by a hash of their identifier, and each place sorts its entries by digest and merges
equal ones: a sorted run.  An entry is the digest, the smallest identifier and a count.  Then partners exchange parts of their
runs, as in a binomial reduction: in round k the FAN_IN places whose numbers differ in digit k only deal their runs among
themselves by digit k of the digest, and each merges the FAN_IN parts that it gets.  After the last round a place holds one
range of digests of all rows.  Every place works in every round, no place ever holds more than its share, and of a digest that
a third of all rows have at most FAN_IN entries meet.  Entries merge, at every level, only if digest, length in bytes and a
second hash of the text all agree; what stays is the smallest identifier of those.  The groups then go back down the same
tree, so each arrives in every run that has it once, and never in one task with all its rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.scratch import KEY, ROW, emitted, key_of, stored

FAN_IN = 16
SPACE = r"[\x20\x09-\x0D]+"
ENTRY = ["digest", "n_bytes", "second"]


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _keys(rows: DataFrame, text: str, n_runs: int, carried: list[str]) -> DataFrame:
    same = rows.select(F.col("doc_id"), F.col(ROW), *carried, normalised(F.col(text)).alias("same"))
    return same.select(
        "doc_id",
        ROW,
        *carried,
        F.unhex(F.sha2(F.col("same").cast("binary"), 256)).alias("digest"),
        F.octet_length("same").alias("n_bytes"),
        F.xxhash64("same").alias("second"),
        F.pmod(F.xxhash64("doc_id", ROW), F.lit(n_runs)).alias("place0"),
    )


def n_levels(rows: DataFrame) -> int:
    levels = 1
    while FAN_IN**levels < int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        levels += 1
    return levels


def _digit(digest: str, k: int) -> Column:
    """Digit k (from 1, base FAN_IN) of the number by which a digest is placed; all of its entries agree on it."""
    return F.pmod(F.shiftright(F.xxhash64(digest), (FAN_IN.bit_length() - 1) * (k - 1)), F.lit(FAN_IN))


def _merged(entries: DataFrame, place: str, entry: list[str], first: Column, size: Column, merges: int) -> DataFrame:
    """Each place's parts sorted and merged into one run: the partitioning and the order are those of the grouping."""
    runs = entries.repartition(merges, place).sortWithinPartitions(place, *entry)
    return runs.groupBy(place, *entry).agg(F.min(first).alias("first"), F.sum(size).alias("group_size"))


def tree_merge(keys: DataFrame, entry: list[str], first: Column, levels: int) -> DataFrame:
    """Groups of two rows or more as (place0, *entry, first, group_size), once in each run that has a row of the group.

    ``keys`` has ``place0`` below FAN_IN ** levels; ``first`` is what the least row of a group is told by.
    """
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = [stored(_merged(keys, "place0", entry, first, F.lit(1).cast("long"), tasks), "runs")]
    for k in range(1, levels + 1):
        unit = FAN_IN ** (k - 1)
        old = F.pmod(F.floor(F.col(f"place{k - 1}") / unit), F.lit(FAN_IN))
        dealt = runs[-1].withColumn(f"place{k}", F.col(f"place{k - 1}") + (_digit(entry[0], k) - old) * unit)
        runs[-1] = dealt
        runs.append(_merged(dealt, f"place{k}", entry, F.col("first"), F.col("group_size"), tasks))
    won = runs[-1].filter("group_size > 1")
    for k in range(levels, 0, -1):
        won = runs[k - 1].select(f"place{k}", f"place{k - 1}", *entry).join(won, [f"place{k}", *entry]).select(f"place{k - 1}", *entry, "first", "group_size")
    return won


def decided(rows: DataFrame, text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """A row per row of ``rows`` (which carries ROW): doc_id, ROW, digest, keep_id, group_size, kept, and columns ``carried``.

    Of equal texts the row with the smallest doc_id is kept, null ids last; among rows with the same id, one.
    """
    levels = n_levels(rows)
    carried = carried or []
    keys = stored(_keys(rows, text, FAN_IN**levels, carried), "digests")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col(ROW).alias("keep_row"))
    won = tree_merge(keys, ENTRY, first, levels)
    return keys.join(won, ["place0", *ENTRY], "left").select(
        "doc_id",
        ROW,
        *carried,
        "digest",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first.keep_row") == F.col(ROW))).alias("kept"),
    )


def exact_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones; repeated rows are one group of which one row is kept; an empty table gives no rows.  Columns
    other than doc_id and ``text`` are not read.
    """
    rows = docs.select("doc_id", F.col(text).alias("text")).withColumn(ROW, F.monotonically_increasing_id())
    out = decided(rows)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that stay."""
    rows = docs.select(*key_of(docs), "doc_id", F.col(text).alias("text")).withColumn(ROW, F.monotonically_increasing_id())
    return emitted(docs, decided(rows, carried=KEY), "kept")
