"""Writers: graph files, guarded replacement, enrichment in place, rebuilt snapshots of several tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators.relational import guarded


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two folders of JSON lines that readers of any size of graph can take."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, one JSON document ``{"nodes": […], "edges": […]}``, for a single meeting's or report's small graph."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges"), {"pretty": "true"}).alias("value"))


def replace_guarded(fresh: DataFrame, path: str, least_share: float = 0.9) -> None:
    """Replace the table at ``path`` by ``fresh``, unless that loses more than a tenth of its rows.

    ``fresh`` is written beside the table and counted there, so it may read from the table itself; then the folders are renamed.
    If a step fails, the old table is where it was, or beside it as ``<path>.old``.
    """
    spark = fresh.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    here, new, old = (hadoop.Path(f"{path.rstrip('/')}{end}") for end in ("", ".new", ".old"))
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh.write.mode("overwrite").parquet(new.toString())
    try:
        guarded(spark.read.parquet(new.toString()).count(), spark.read.parquet(path).count(), least_share)
    except ValueError:
        store.delete(new, True)
        raise
    store.delete(old, True)
    for a, b in ((here, old), (new, here)):
        if not store.rename(a, b):
            raise OSError(f"{a.toString()} could not be renamed")
    store.delete(old, True)


def enrich_in_place(additions: DataFrame, path: str, part: str, key: str) -> None:
    """Set columns of rows of the table at ``path`` (in folders by ``part``) from ``additions`` (key and columns), where they are null.

    Only folders that hold a row to change are written anew, and Spark puts them in place when all are written; the files of the others
    stay as they are, by name and time.  Of several additions to a key the least counts, keys that the table lacks add nothing, and what
    is there already is kept, so a second run changes nothing.
    """
    spark = additions.sparkSession
    columns = [c for c in additions.columns if c != key]
    table = spark.read.option("mergeSchema", True).parquet(path)  # an earlier run may have added columns to some folders
    lacking = F.lit(False)
    for c in columns:
        table = table if c in table.columns else table.withColumn(c, F.lit(None).cast(additions.schema[c].dataType))
        lacking = lacking | (F.col(c).isNull() & F.col(f"_new.{c}").isNotNull())
    new = additions.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_new"))
    joined = table.join(new, key, "left")
    touched = joined.filter(lacking).select(F.col(part).alias("_part")).distinct()
    out = joined.join(touched, F.col(part).eqNullSafe(F.col("_part")), "left_semi")
    out = out.select(*[F.coalesce(c, f"_new.{c}").alias(c) if c in columns else F.col(c) for c in table.columns])
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def faults(tables: dict[str, DataFrame], keys: dict[str, str], references: list[tuple[str, str, str, str]]) -> list[DataFrame]:
    """fel, varde of values that break a rule, for each key that has one: ``fel`` is the place among the keys, then the references.

    A key's values and those that name it are counted together in one shuffle, in which equal ones meet before they are sent.
    """
    out, order = [], list(keys.items())
    for other, key in dict.fromkeys([*order, *((o, k) for _, _, o, k in references)]):
        seen = tables[other].select(F.col(key).alias("varde"), F.lit(1).alias("n"), F.lit(None).cast("int").alias("av"))
        for i, (table, column, *named) in enumerate(references):
            if named == [other, key]:
                seen = seen.union(tables[table].filter(F.col(column).isNotNull()).select(column, F.lit(0), F.lit(len(keys) + i)))
        counted = seen.groupBy("varde").agg(F.sum("n").alias("n"), F.min("av").alias("av"))
        fault = F.when(F.col("n") == 0, F.col("av"))
        if (other, key) in order:
            fault = F.when((F.col("n") > 1) | (F.col("varde").isNull() & (F.col("n") > 0)), order.index((other, key))).otherwise(fault)
        out.append(counted.select(fault.alias("fel"), "varde").filter("fel is not null"))
    return out


def rebuild(tables: dict[str, DataFrame], path: str, keys: dict[str, str], references: list[tuple[str, str, str, str]]) -> None:
    """Replace all ``tables`` below ``path`` at once, if they keep their keys and references; else nothing changes, and it is an error.

    ``keys`` names a table's primary key (not null, unique), ``references`` are (table, column, table, key) with nulls allowed.  The tables are
    written to a folder of their own and checked there.  Its name then goes into the file CURRENT by one
    rename, so readers (``snapshot``) see all tables of the old or all of the new one.
    """
    spark = next(iter(tables.values())).sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    for table, rows in tables.items():
        rows.write.parquet(f"{path}/{name}/{table}")
    back = {table: spark.read.schema(rows.schema).parquet(f"{path}/{name}/{table}") for table, rows in tables.items()}
    found = [rows.agg(F.min(F.struct("fel", "varde")).alias("x")).first().x for rows in faults(back, keys, references)]
    first = min((x for x in found if x is not None), key=lambda x: x.fel, default=None)
    if first is not None and first.fel < len(keys):
        table, key = list(keys.items())[first.fel]
        raise ValueError(f"{table}.{key} is null or repeated: {first.varde!r}")
    if first is not None:
        table, column, other, _ = references[first.fel - len(keys)]
        raise ValueError(f"{table}.{column} names what {other} lacks: {first.varde!r}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fresh, current = (hadoop.Path(f"{path}/{n}") for n in (f"{name}/CURRENT", "CURRENT"))
    files = hadoop.FileContext.getFileContext(current.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(f"{path}/{name}/_name")
    part = next(f for f in _listed(spark, f"{path}/{name}/_name") if f.rsplit("/", 1)[1].startswith("part-"))
    hadoop.Path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(hadoop.Path(part), fresh)
    overwrite = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, current, overwrite)


def _listed(spark: SparkSession, folder: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return [x.getPath().toString() for x in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]


def snapshot(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the newest whole snapshot below ``path``."""
    name = spark.read.text(f"{path}/CURRENT").first().value
    return spark.read.parquet(f"{path}/{name}/{table}")


def tenant(name: str, allowed: frozenset[str]) -> str:
    """A database name, if it is on the list."""
    if name not in allowed:
        raise KeyError(f"no tenant {name!r}")
    return name
