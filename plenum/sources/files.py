"""Readers for the platform's file formats, as DataFrames."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "struct<id: string, typ: string, label: string, data: variant>"
EDGE = "struct<`from`: string, `to`: string, typ: string, label: string, data: variant>"
GRAPH = f"nodes array<{NODE}>, edges array<{EDGE}>"
ROSTER = (
    "kommun string, antal int, politiker array<struct<id: string, `förnamn`: string, efternamn: string, parti: string, email: string, "
    "uppdrag: array<struct<organisation: string, organisationId: string, roll: string, `från`: string, till: string>>, "
    "mandatperioder: array<struct<period: string, roll: string, `källa`: string>>, historisk: boolean>>"
)
DEBATE = "datum string, titel string, `anföranden` array<struct<talare: string, parti: string, `ärende`: int, `ärendeTitel`: string, text: string, ordning: int, politikerId: string>>"


def documents(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """Whole-file JSON documents with ``fil`` (the file's name); an open part stays VARIANT, so types may differ between files."""
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return reader.json(path).withColumn("fil", F.col("_metadata.file_name"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (last file wins per id, then the last place in it) and edges of all graph files below ``path``."""
    from plenum.operators.relational import first_per

    files = documents(spark, path, GRAPH)
    nodes = files.select("fil", F.posexplode("nodes").alias("plats", "n")).select("fil", "plats", "n.*")
    nodes = first_per(nodes, ["id"], F.col("fil").desc(), F.col("plats").desc()).drop("fil", "plats")
    edges = files.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("from_id"), F.col("e.to").alias("to_id"), "e.typ", "e.label", "e.data")
    return nodes, edges


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON file, or no rows where it is missing."""
    try:
        return documents(spark, path, schema).drop("fil")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema))


def dated_files(spark: SparkSession, path: str, schema: str, prefix: str = "kf-") -> DataFrame:
    """Files named ``<prefix><date>.json`` with the date as a column."""
    rows = documents(spark, path, schema, f"{prefix}*.json")
    day = F.regexp_extract("fil", rf"^{prefix}(\d{{4}}-\d{{2}}-\d{{2}})\.json$", 1)
    return rows.withColumn("fil_datum", day).filter("fil_datum != ''")


def catalogue(spark: SparkSession, path: str, index: str = "index.json") -> DataFrame:
    """An index of documents joined to the texts beside it; entries whose file is missing are left out."""
    schema = "id string, titel string, `källa` string, typ string, `nämnd` string, datum string, fil string, taggar array<string>"
    entries = spark.read.schema(schema).option("multiLine", True).json(f"{path}/{index}")
    texts = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return entries.join(texts.select(F.col("_metadata.file_name").alias("fil"), F.col("value").alias("innehall")), "fil")


def is_invoice_file(first_line, parts: tuple[str, str] = ("verant", "elopp")):
    """Content sniffing: a header that holds two ASCII fragments."""
    return F.contains(first_line, F.lit(parts[0])) & F.contains(first_line, F.lit(parts[1]))


def invoices(spark: SparkSession, path: str) -> DataFrame:
    """fil, förvaltning, leverantör, orgnr, konto, belopp from semicolon files, UTF-8 or Latin-1, with or without a BOM.

    Columns are found by their trimmed names, the amount's by its prefix; files that do not look like invoices and blank lines
    give no rows.  Files are read in splits, line by line, so one of any size is spread over tasks and never a row; what a file
    as a whole tells (its first line, its encoding) is found first, a row per file.
    """
    from plenum.functions.text import number
    from plenum.sources.shared import kept

    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    # One task reads a file's first split in order, so the least number there is the first line's; the same listing has the same splits.
    raw = raw.select(F.col("_metadata.file_path").alias("_fil"), "value", F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("nr"))

    def text(line: str):
        return F.when(F.col("utf8"), F.col(line)).otherwise(F.decode(F.col(line).cast("binary"), "ISO-8859-1"))

    first = F.min(F.when(F.col("nr").isNotNull(), F.struct("nr", "value"))).alias("f")
    heads = raw.groupBy("_fil").agg(first, F.bool_and(F.is_valid_utf8("value")).alias("utf8")).select("_fil", "utf8", F.col("f.nr").alias("forst"), text("f.value").alias("huvud"))
    heads = heads.withColumn("huvud", F.regexp_replace("huvud", r"^\x{FEFF}|\r\z", "")).filter(is_invoice_file(F.col("huvud")))
    names = F.transform(F.split("huvud", ";"), lambda x: F.trim(x))
    heads = kept(heads.select("_fil", F.url_decode(F.replace("_fil", F.lit("+"), F.lit("%2B"))).alias("fil"), "utf8", "forst", names.alias("namn")))
    rows = raw.join(heads, "_fil").filter(F.col("nr").isNull() | (F.col("nr") != F.col("forst")))
    rows = rows.select("fil", "namn", F.regexp_replace(text("value"), r"\r\z", "").alias("rad")).filter(F.trim("rad") != "")
    cells = F.split("rad", ";", -1)

    def cell(name: str):
        return F.trim(F.get(cells, (F.array_position("namn", F.lit(name)) - 1).cast("int")))

    amount = F.get(F.filter(F.arrays_zip(F.col("namn").alias("namn"), cells.alias("cell")), lambda x: x["namn"].startswith("Belopp")), 0)["cell"]
    return rows.select("fil", cell("Förvaltning").alias("förvaltning"), cell("Leverantör").alias("leverantör"), cell("Organisationsnummer").alias("orgnr"), F.coalesce(F.nullif(cell("Kontotext"), F.lit("")), F.lit("Okänt")).alias("konto"), number(amount).alias("belopp"))


def first_handling(spark: SparkSession, path: str, words: str) -> DataFrame:
    """datum, titel, url: per date the first document, over yearly indexes, whose title holds ``words`` in any case."""
    from plenum.operators.relational import first_per

    schema = "`år` int, `sammanträden` array<struct<datum: string, handlingar: array<struct<titel: string, url: string, typ: string>>>>"
    years = documents(spark, path, schema)
    meetings = years.select("`år`", "fil", F.posexplode("sammanträden").alias("m", "s"))
    rows = meetings.select("`år`", "fil", "m", "s.datum", F.posexplode("s.handlingar").alias("p", "h"))
    hits = rows.filter(F.contains(F.lower("h.titel"), F.lit(words.lower())))
    first = first_per(hits, ["datum"], F.col("år"), F.col("fil"), F.col("m"), F.col("p"))
    return first.select("datum", "h.titel", "h.url")


def kpis(spark: SparkSession, path: str) -> DataFrame:
    """kpi, år, värde of a statistics service's replies: the value for both genders together, by year."""
    schema = "values array<struct<kpi: string, period: int, values: array<struct<gender: string, value: double>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("values").alias("v"))
    value = F.get(F.filter("v.values", lambda x: x["gender"] == "T"), 0)["value"]
    return rows.select(F.col("v.kpi").alias("kpi"), F.col("v.period").alias("år"), value.alias("värde"))


def json_stat(spark: SparkSession, path: str) -> DataFrame:
    """år, värde of a JSON-stat reply: the year dimension's index map against the array of values."""
    schema = "dimension struct<Tid: struct<category: struct<index: map<string, int>>>>, value array<double>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    entries = rows.select("value", F.explode("dimension.Tid.category.index").alias("år", "plats"))
    return entries.select("år", F.get("value", F.col("plats")).alias("värde"))


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Downloads that are PDF by their first bytes."""
    return spark.read.format("binaryFile").load(path).filter(F.substring("content", 1, 4) == F.lit(b"%PDF"))
