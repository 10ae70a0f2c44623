"""Relational operators that the platform's loading and serving steps share."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task of a join meets, where the number of tasks follows from the number of rows.
ROWS_A_TASK = 1_000_000


def first_per(df: DataFrame, keys: Sequence[str], *order: Column, take: int = 1) -> DataFrame:
    """The first ``take`` rows per key in a total order (first- or last-writer-wins, DISTINCT ON, top-k per group)."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(spec)).filter(F.col("_nth") <= take).drop("_nth")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal key, and added where there is none."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(old.columns))


def merge_keeping(old: DataFrame, new: DataFrame, key: str, enriched: Sequence[str], gone: str = "historisk") -> DataFrame:
    """Full outer merge: new values win, ``enriched`` ones fall back to the old, rows that vanished stay and are flagged."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    vanished = F.col(f"b.{key}").isNull()
    columns = [F.coalesce(f"b.{key}", f"a.{key}").alias(key)]
    for name in old.columns:
        if name != key:
            fresh = F.coalesce(f"b.{name}", f"a.{name}") if name in enriched else F.when(vanished, F.col(f"a.{name}")).otherwise(F.col(f"b.{name}"))
            columns.append(fresh.alias(name))
    return joined.select(*columns, vanished.alias(gone))


def guarded(new_rows: int, removed_rows: int, least_share: float = 0.9) -> None:
    """Refuse a full replacement that would lose more than a tenth of the rows."""
    if new_rows < least_share * removed_rows:
        raise ValueError(f"{new_rows} new rows would replace {removed_rows}")


def known_ends(edges: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges both of whose ends are nodes: two semi-joins.

    ``rows`` tells about how many edges and nodes there are.  Then a task looks up its edges in a hash table of its share of the ids
    and sorts nothing, and there are so many tasks that the share does not grow with the tables.
    """
    ids = nodes.select("id")
    parts = (rows or 0) // ROWS_A_TASK + 1
    dealt = parts > int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else Spark deals them itself
    for end in ("from_id", "to_id"):
        known = ids.withColumnRenamed("id", end)
        if dealt:
            known = known.repartition(parts, end)  # and Spark deals the edges likewise
        edges = edges.join(known if rows is None else known.hint("shuffle_hash"), end, "left_semi")
    return edges


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The other edges, told by the end that is missing (``missing``; the source if both are)."""
    ids = nodes.select("id")
    no_from = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").withColumn("missing", F.col("from_id"))
    with_from = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    no_to = with_from.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti").withColumn("missing", F.col("to_id"))
    return no_from.unionByName(no_to)


def top_and_rest(df: DataFrame, name: str, value: str, top: int, rest: str = "Övrigt") -> DataFrame:
    """The ``top`` names by value and, if there are more, one row that sums the others; a name has one row."""
    best = df.select(name, value).orderBy(F.col(value).desc(), F.col(name)).limit(top)
    others = df.join(best.select(F.col(name).alias("_name")), F.col(name).eqNullSafe(F.col("_name")), "left_anti")
    total = others.agg(F.sum(value).alias(value), F.count("*").alias("_n")).filter("_n > 0").select(F.lit(rest).alias(name), value)
    return best.unionByName(total)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1, lower numbers count as 1) of a total order."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def matching(df: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """Rows whose columns contain every given text, in any case; empty filters do not count."""
    for column, text in filters.items():
        if text:
            df = df.filter(F.contains(F.lower(F.col(column).cast("string")), F.lit(text.lower())))
    return df


def _prefixes(text: Column, least: int = 1) -> Column:
    return F.when(F.length(text) >= least, F.transform(F.sequence(F.lit(least), F.length(text)), lambda n: F.left(text, n)))


def best_prefix_match(names: DataFrame, name: str, entries: DataFrame, entry: str, place: str, least: int = 10) -> DataFrame:
    """Each name with its first dictionary entry, in dictionary order: equal, or one the other's prefix.

    An entry may start with a name of at least ``least`` characters.  Prefixes are keys, so names and entries meet in two
    equi-joins; a name gives at most one row.
    """
    post = entries.select(F.struct(*entries.columns).alias("_post"), F.col(entry).alias("_e"), F.col(place).alias("_p"))
    each = names.select(name).distinct()
    begun = each.select(name, F.explode(_prefixes(F.col(name))).alias("_e")).join(post, "_e")
    begins = post.select("_post", "_e", "_p", F.explode(_prefixes(F.col("_e"), least)).alias(name)).join(each, name)
    order = F.struct((F.col(name) != F.col("_e")).alias("inexact"), F.col("_p"), F.col("_post"))
    hit = begun.select(name, "_post", "_e", "_p").unionByName(begins.select(name, "_post", "_e", "_p")).groupBy(name).agg(F.min(order).alias("hit"))
    return names.join(hit, name).select(*names.columns, "hit._post.*")


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str, longest: int) -> DataFrame:
    """Rows of ``texts`` and ``parts`` with the part (at most ``longest`` characters, not empty) somewhere in the text.

    For short texts, such as names and lines: their pieces of the lengths that parts have are keys of an equi-join.
    """
    t, k = F.col(text), F.length(part)
    lengths = sorted(r[0] for r in parts.filter(k.between(1, longest)).select(k).distinct().collect())  # at most ``longest`` numbers
    of_length = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n))))
    pieces = F.flatten(F.array_compact(F.array(*map(of_length, lengths)))) if lengths else F.array().cast("array<string>")
    keyed = texts.withColumn("_piece", F.explode(F.array_distinct(pieces)))
    return keyed.join(parts, keyed["_piece"] == parts[part]).drop("_piece")
