"""Micro-batch upserts that keep history: of complete rosters into versions of a table, of changes into the folders that they touch."""

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.operators.relational import first_per, merge_keeping


def merging(spark: SparkSession, path: str, key: str, order: str, enriched: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: the last row per key of a batch is merged into the newest version below ``path``.

    A version is written before readers see it, and a batch that is replayed writes its own version again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = first_per(batch, [key], F.col(order).desc())
        columns = [c for c in batch.columns]
        if batch_id:
            old = spark.read.parquet(f"{path}/version={batch_id - 1}").select(columns)
            fresh = merge_keeping(old, fresh.select(columns), key, enriched)
        else:
            fresh = fresh.select(columns).withColumn("historisk", F.lit(False))
        fresh.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return merge


def merging_changes(spark: SparkSession, path: str, key: str, order: str, enriched: Sequence[str], gone: str, folders: int = 256) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: a batch of changes is merged into the table at ``path``, whose rows lie in folders by key.

    The last change per key counts: new values win, nulls of ``enriched`` columns fall back to the old ones, and a row whose ``gone`` is
    true stays as it was, with ``historisk``.  Only folders with changed keys are read and written anew; Spark puts each in place
    when all are written.  A batch that is merged again changes nothing, so one that failed half-way may be repeated.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        folder = F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")
        fresh = first_per(batch, [key], F.col(order).desc(), F.xxhash64(*batch.columns)).withColumn("mapp", folder).persist()
        try:
            touched = [r.mapp for r in fresh.select("mapp").distinct().collect()]  # at most ``folders`` numbers
            if not touched:
                return
            values = [c for c in batch.columns if c not in (key, gone)]
            schema = T.StructType([f for f in batch.schema if f.name != gone]).add("historisk", "boolean").add("mapp", "integer")
            try:
                old = spark.read.schema(schema).parquet(path).filter(F.col("mapp").isin(touched))
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
                old = fresh.limit(0).select(key, *values, F.lit(False).alias("historisk"), "mapp")
            a, b = old.alias("a"), fresh.alias("b")
            joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
            leaves = F.coalesce(F.col(f"b.{gone}"), F.lit(False))
            known = F.col(f"a.{key}").isNotNull()
            stays = F.col(f"b.{key}").isNull() | (leaves & known)
            value = lambda c: F.when(stays, F.col(f"a.{c}")).otherwise(F.coalesce(f"b.{c}", f"a.{c}") if c in enriched else F.col(f"b.{c}")).alias(c)
            history = F.when(F.col(f"b.{key}").isNull(), F.col("a.historisk")).otherwise(leaves).alias("historisk")
            out = joined.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *map(value, values), history, F.coalesce("b.mapp", "a.mapp").alias("mapp"))
            out.repartition("mapp").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mapp").parquet(path)
        finally:
            fresh.unpersist()

    return merge
