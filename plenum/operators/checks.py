"""Data-quality checks; each returns the rows that break a rule, so an empty result is a pass."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of the text that could not be read as the schema says.
BROKEN = "_trasig"


def _faults(required: dict[str, str | None], of: Column | None = None) -> list[Column]:
    """For each required column (of a struct, if given) its name where it is null or does not match its pattern."""
    value = lambda c: F.col(c) if of is None else of[c]
    return [F.when(value(c).isNull() if p is None else ~F.coalesce(value(c).cast("string").rlike(p), F.lit(False)), F.lit(c)) for c, p in required.items()]


def checked_lines(lines: DataFrame, line: str, schema: str, required: dict[str, str | None]) -> DataFrame:
    """``lines`` with ``post`` (the JSON text as ``schema``) and ``brister``, the reasons why it is not right; none if it is.

    A reason is BROKEN, where the text is no JSON or a value has another type, or the name of a required column that is missing or does
    not match.  Good and bad rows come from one pass; a null line is broken.
    """
    read = F.from_json(line, f"{schema}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    rows = lines.withColumn("_post", read)
    broken = F.col("_post").isNull() | F.col(f"_post.{BROKEN}").isNotNull()
    reasons = F.when(broken, F.array(F.lit(BROKEN))).otherwise(F.array_compact(F.array(*_faults(required, F.col("_post")))))
    return rows.select(*lines.columns, F.col("_post").dropFields(BROKEN).alias("post"), reasons.alias("brister"))


def checked_files(spark: SparkSession, path: str, schema: str, required: dict[str, str | None], whole: bool = False) -> DataFrame:
    """JSON files (a document a line, or ``whole`` files) as ``schema`` with ``brister``, ``fil`` and the text of broken ones."""
    reader = spark.read.schema(f"{schema}, {BROKEN} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("multiLine", whole)
    rows = reader.json(path)
    reasons = F.when(F.col(BROKEN).isNotNull(), F.array(F.lit(BROKEN))).otherwise(F.array_compact(F.array(*_faults(required))))
    return rows.withColumn("brister", reasons).withColumn("fil", F.col("_metadata.file_name"))


def write_checked(checked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write checked rows once, good and bad ones in folders of their own; both are read back."""
    checked.withColumn("godkand", F.size("brister") == 0).write.mode("overwrite").partitionBy("godkand").parquet(path)
    back = checked.sparkSession.read.parquet(path)
    return back.filter("godkand = 'true'").drop("godkand", "brister", BROKEN), back.filter("godkand = 'false'").drop("godkand")


def nonconforming(rows: DataFrame, required: dict[str, str | None]) -> DataFrame:
    """Rows where a required column is null or does not match its pattern (None: any value), with the names of such columns."""
    return rows.withColumn("brister", F.array_compact(F.array(*_faults(required)))).filter(F.size("brister") > 0)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur twice or more, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("antal")).filter("antal > 1")


def below_floor(counts: DataFrame, floors: dict[str, int], name: str = "namn", n: str = "antal") -> DataFrame:
    """Named volumes below their floor; a volume that is not there counts as 0."""
    wanted = counts.sparkSession.createDataFrame(list(floors.items()), f"{name} string, golv long")
    joined = wanted.join(counts.select(name, F.col(n).alias("antal")), name, "left")
    return joined.withColumn("antal", F.coalesce("antal", F.lit(0))).filter("antal < golv")


def differing(rows: DataFrame, total: Column, parts: Column, tolerance: float, relative: bool = False) -> DataFrame:
    """Rows whose parts differ from their total by more than the tolerance, or that share of the total."""
    gap = F.abs(parts - total)
    return rows.filter(gap > F.abs(total) * tolerance if relative else gap > tolerance)


def miscounted(rows: DataFrame, names: str, count: str) -> DataFrame:
    """Rows whose list of names is not as long as the count says."""
    return rows.filter(F.size(names) != F.col(count))
