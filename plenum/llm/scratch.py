"""Intermediate tables in the folder that the driver and all executors share.

A table written here cuts lineage and survives the loss of any executor: Spark's committer publishes whole files, and later
jobs read them like any input.  The folder is ``spark.checkpoint.dir``; where that is unset a run on this machine alone gets a
folder of its own, and any other run an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_plenum_row"
KEY = ["_plenum_k1", "_plenum_k2"]
#: Spark's setting for removing the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new, not yet existing folder below the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plenum-")
        spark.sparkContext.setCheckpointDir(base)
    _made.append(f"{base.rstrip('/')}/plenum-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> int:
    """Delete the folders that this process has made so far; for use once its results are written. Returns how many there were."""
    gone = 0
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, _made):
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    _made.clear()
    return gone


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Once the table is whole nothing reads the shuffle files behind it, so they go at once and not at some later collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def over_cores(df: DataFrame) -> DataFrame:
    """``df``, dealt anew if it comes in fewer partitions than there are cores: a small table's texts may all be in one row group.

    A table of more partitions is left as it is, so that no text is shuffled before it is worked on.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def spread(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join for a ``left`` in which a key may have very many rows, by way of its distinct keys per run (column ``run``)."""
    return left.join(left.select("run", *on).distinct().join(right, on), ["run", *on])


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores behind it if one of ``taken`` has that name."""
    while wanted.lower() in {x.lower() for x in taken}:
        wanted += "_"
    return wanted


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def every(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]


def key_of(df: DataFrame) -> list[Column]:
    """KEY: two hashes over all columns, nulls told apart; rows that differ in a column have different ones.

    Maps cannot be hashed, so they count as JSON; two maps with the same entries in another order then differ.
    """
    values = [F.to_json(F.struct(c)) if _has_map(f.dataType) else c for c, f in zip(every(df), df.schema.fields, strict=True)]
    return [F.xxhash64(F.lit(i), *values, *[c.isNull() for c in every(df)]).alias(k) for i, k in enumerate(KEY)]


def emitted(df: DataFrame, decisions: DataFrame, times: str) -> DataFrame:
    """The rows of ``df``, columns unchanged, each as often as ``decisions`` (a row per row: KEY and ``times``) says.

    Equal rows share their number, so one of them stands for all and is repeated.  The narrow side (three numbers a row) is
    hashed and ``df`` streams past it, at every size alike: texts are shuffled once and neither sorted nor stored.  Rows that
    occur very often are a skewed key of the streaming side, which adaptive execution splits; they are reduced to one within
    each task before they meet.
    """
    wanted = decisions.groupBy(*KEY).agg(F.sum(F.col(times).cast("long")).alias("_plenum_wanted"), F.count("*").alias("_plenum_rows"))
    wanted = stored(wanted.filter("_plenum_wanted > 0"), "wanted")
    # Of ``df`` one column, so that no name of its own can clash.
    joined = df.select(F.struct(*every(df)).alias("_plenum_all"), *key_of(df)).join(wanted.hint("shuffle_hash"), KEY)
    most = wanted.agg(F.max("_plenum_rows").alias("rows"), F.max("_plenum_wanted").alias("wanted")).first()
    if (most.rows or 0) > 1:
        often = joined.filter("_plenum_rows > 1").groupBy(*KEY).agg(F.first("_plenum_all").alias("_plenum_all"), F.first("_plenum_wanted").alias("_plenum_wanted"))
        joined = joined.filter("_plenum_rows = 1").select("_plenum_all", "_plenum_wanted").unionByName(often.select("_plenum_all", "_plenum_wanted"))
    if (most.wanted or 0) > 1:
        joined = joined.withColumn("_plenum_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_plenum_wanted")))
    return joined.select("_plenum_all.*")
