"""Property-graph operators over nodes (id, typ, label, ...) and edges (from_id, to_id, typ, label, ...)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.sources.shared import kept


def incident(edges: DataFrame, node_id: str) -> DataFrame:
    """Edges at one node, with the id at their other end and their direction."""
    outgoing = F.col("from_id") == node_id
    return edges.filter(outgoing | (F.col("to_id") == node_id)).select(
        "*", F.when(outgoing, F.col("to_id")).otherwise(F.col("from_id")).alias("other"), F.when(outgoing, F.lit("ut")).otherwise(F.lit("in")).alias("riktning")
    )


def incident_to_set(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch a set of ids: the union of two semi-joins, for an OR of two columns would be a nested loop."""
    out = edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    into = edges.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    only_into = into.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    return out.select(edges.columns).unionByName(only_into.select(edges.columns))


def frontier(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids next to a set, without the set's own: the other ends of edges that begin or end in it."""
    out = edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id"))
    into = edges.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id"))
    return out.union(into).distinct().join(ids.select("id"), "id", "left_anti")


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in a set."""
    half = edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return half.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(edges.columns)


def canonical(nodes: DataFrame, key: str) -> DataFrame:
    """Per key the preferred id: without a year, then an organisation's, then any; among equals the least."""
    rank = F.when(F.col("id").rlike("^nämnd-[^0-9]+$"), 3).when(F.col("id").startswith("org-"), 2).otherwise(1)
    order = Window.partitionBy(key).orderBy(rank.desc(), "id")
    return nodes.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def merged(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after duplicates (``aliases``: alias, id, label) have been merged into canonical nodes.

    Merged nodes go, missing canonical ones are made with the alias's label, edge ends are rewritten, self-loops are dropped and
    equal edges are kept.  A canonical node lists its aliases in order.
    """
    lists = aliases.filter("alias != id").groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.min("label").alias("_made"))
    gone = aliases.filter("alias != id").select(F.col("alias").alias("id")).distinct()
    kept = nodes.join(gone, "id", "left_anti").join(lists.drop("_made"), "id", "left")
    made = lists.join(nodes.select("id"), "id", "left_anti").select("id", F.lit("organisation").alias("typ"), F.col("_made").alias("label"), "aliases")
    to = aliases.filter("alias != id").select("alias", F.col("id").alias("_to")).distinct()
    for end in ("from_id", "to_id"):
        edges = edges.join(to.withColumnRenamed("alias", end), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return kept.unionByName(made, allowMissingColumns=True), edges.filter("from_id != to_id")


def synthesised(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that edges name by a year-less committee slug and that do not exist, with a label made from the slug."""
    ends = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct()
    missing = ends.join(nodes.select("id"), "id", "left_anti").filter(F.col("id").rlike("^nämnd-[^0-9]+$"))
    label = F.initcap(F.translate(F.regexp_replace("id", "^nämnd-", ""), "-_", "  "))
    return missing.select("id", F.lit("organisation").alias("typ"), label.alias("label"), F.lit(True).alias("syntetisk"))


def flattened(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """Rows (id, parent) as (id, depth, path), from the roots (parent null) down, to ``depth`` or to whatever depth there is.

    By doubling: walks of up to n steps from a root, and segments of n steps between any nodes; each round joins both with the
    segments, so a tree of depth d takes as many rounds as d has binary digits.  A node with several parents has a row for each
    walk; a walk never comes to a node twice, so cycles end it, and what hangs on a cycle alone is not reached (``unreached``).
    """
    walks = tree.filter("parent is null").select("id", F.lit(0).alias("depth"), F.array("id").alias("way")).distinct()
    segments = kept(tree.filter("parent is not null and parent != id").select(F.col("parent").alias("top"), "id", F.array("id").alias("way")).distinct())
    walks, steps = kept(walks), 1
    while depth is None or steps <= depth:
        below = segments.select(F.col("top").alias("_top"), F.col("id").alias("_id"), F.col("way").alias("_way"))
        simple = ~F.arrays_overlap("way", "_way")
        longer = kept(walks.join(below, (walks["id"] == below["_top"]) & simple).select(F.col("_id").alias("id"), (F.col("depth") + steps).alias("depth"), F.concat("way", "_way").alias("way")))
        if longer.isEmpty():
            break
        walks = walks.unionByName(longer)
        twice = segments.join(below, (segments["id"] == below["_top"]) & simple & (F.col("_id") != F.col("top")))
        segments, steps = kept(twice.select("top", F.col("_id").alias("id"), F.concat("way", "_way").alias("way"))), 2 * steps
    walks = walks if depth is None else walks.filter(F.col("depth") <= depth)
    return walks.select("id", "depth", F.array_join("way", "/").alias("path"))


def unreached(tree: DataFrame, walks: DataFrame) -> DataFrame:
    """id: nodes that no walk from a root comes to; they lie on a cycle, below one, or below a parent that does not exist."""
    return tree.select("id").distinct().join(walks.select("id"), "id", "left_anti")


def active_items(items: DataFrame, pages: DataFrame) -> DataFrame:
    """``pages`` (path and others) with ``aktiv``: the longest href of ``items`` that is the path or begins it at a slash, or null.

    Slashes at the end do not count, and the start page's href is active on the start page only.  Paths meet hrefs on their own prefixes
    of whole segments.
    """
    bare = lambda c: F.when(c.isNotNull(), F.coalesce(F.nullif(F.regexp_replace(c, "/+$", ""), F.lit("")), F.lit("/")))
    hrefs = items.filter("href is not null").select(bare(F.col("href")).alias("_href")).distinct()
    rows = kept(pages.withColumn("_n", F.monotonically_increasing_id()))
    parts = F.split(bare(F.col("path")), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keys: Column = F.array_distinct(F.when(bare(F.col("path")) == "/", F.array(F.lit("/"))).otherwise(F.filter(prefixes, lambda p: p != "")))
    best = rows.select("_n", F.explode(keys).alias("_href")).join(hrefs, "_href").groupBy("_n").agg(F.max_by("_href", F.length("_href")).alias("aktiv"))
    return rows.join(best, "_n", "left").drop("_n")
