"""Tables that a later step reads again, in the folder that the driver and all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new, not yet existing folder below ``spark.checkpoint.dir``; without that setting only a local run has one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plenum-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/plenum-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: it has no lineage and is the same on every read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
