"""Graph queries, loading steps and data quality."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import semantics as S
from plenum.operators import checks as K
from plenum.operators import graph as G
from plenum.operators import relational as R
from plenum.plans.registry import query
from plenum.sources import sinks
from plenum.sources.projection import Civic
from plenum.sources.shared import shared_folder
from plenum.streaming.merge import merging_changes


@query("grf_01_node", "SELECT id, typ, label FROM nodes WHERE id = 'politiker-7'")
def node(c: Civic) -> DataFrame:
    return c.nodes().filter("id = 'politiker-7'").select("id", "typ", "label")


@query("grf_02_one_hop", """
SELECT e.typ, e.riktning, e.other AS id, n.label FROM (SELECT typ, CASE WHEN from_id = 'politiker-7' THEN to_id ELSE from_id END AS other, CASE WHEN from_id = 'politiker-7' THEN 'ut' ELSE 'in' END AS riktning
  FROM edges WHERE from_id = 'politiker-7' OR to_id = 'politiker-7') e JOIN nodes n ON e.other = n.id
""")
def one_hop(c: Civic) -> DataFrame:
    labels = c.nodes().select(F.col("id").alias("other"), "label")
    return G.incident(c.edges().drop("label"), "politiker-7").join(labels, "other").select("typ", "riktning", F.col("other").alias("id"), "label")


@query("grf_03_set_hop", """
, seed AS (SELECT id FROM nodes WHERE datum = '1997-05-28' UNION SELECT 'möte-1997-05-28')
SELECT n.id, n.typ FROM nodes n WHERE n.id IN (SELECT from_id FROM edges WHERE to_id IN (SELECT id FROM seed) UNION SELECT to_id FROM edges WHERE from_id IN (SELECT id FROM seed)) AND n.id NOT IN (SELECT id FROM seed)
""")
def set_hop(c: Civic) -> DataFrame:
    seed = c.nodes().filter("datum = '1997-05-28'").select("id").union(c.spark.range(1).select(F.lit("möte-1997-05-28"))).distinct()
    return G.frontier(c.edges(), seed).join(c.nodes().select("id", "typ"), "id").select("id", "typ")


@query("grf_04_direction", "SELECT CASE WHEN from_id = 'nämnd-nation_3' THEN 'ut' ELSE 'in' END AS riktning, count(*) AS antal FROM edges WHERE from_id = 'nämnd-nation_3' OR to_id = 'nämnd-nation_3' GROUP BY 1")
def direction(c: Civic) -> DataFrame:
    return G.incident(c.edges(), "nämnd-nation_3").groupBy("riktning").agg(F.count("*").alias("antal"))


@query("grf_05_histogram", "SELECT typ, count(*) AS antal FROM edges GROUP BY 1")
def histogram(c: Civic) -> DataFrame:
    return c.edges().groupBy("typ").agg(F.count("*").alias("antal"))


@query("grf_06_roll_call", """
SELECT v.to_id AS id, string_agg(v.from_id || '=' || v.rost, ',' ORDER BY v.from_id || '=' || v.rost) AS roster FROM votes v JOIN paragraphs p ON v.to_id = p.id AND p.beslut = 'bordläggning' GROUP BY 1
""")
def roll_call(c: Civic) -> DataFrame:
    """Roll calls from vote edges; a vote has as many rows as a chamber has seats."""
    rows = c.votes().join(c.paragraphs().filter("beslut = 'bordläggning'").select(F.col("id").alias("to_id")), "to_id")
    return rows.groupBy(F.col("to_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "from_id", "rost"))), ",").alias("roster"))


def committee_aliases(c: Civic) -> DataFrame:
    """alias, id, label: every third committee is a duplicate of the one before, one merges into a node that does not exist."""
    key = F.col("n_nationkey")
    to = F.when(key == 24, "nämnd-ny").otherwise(F.concat(F.lit("nämnd-nation_"), (key - 1).cast("string")))
    return c.table("nation").filter((key % 3 == 2) | (key == 24)).select(F.concat(F.lit("nämnd-"), F.lower("n_name")).alias("alias"), to.alias("id"), F.lit("Ny nämnd").alias("label"))


MERGE_SQL = """
, al AS (SELECT 'nämnd-' || lower(n_name) AS alias, CASE WHEN n_nationkey = 24 THEN 'nämnd-ny' ELSE 'nämnd-nation_' || (n_nationkey - 1) END AS id FROM nation WHERE n_nationkey % 3 = 2 OR n_nationkey = 24)
"""


@query("grf_07_merge_nodes", MERGE_SQL + """
SELECT n.id, n.typ, (SELECT string_agg(alias, ',' ORDER BY alias) FROM al WHERE al.id = n.id) AS alias FROM nodes n WHERE n.typ IN ('organisation', 'möte') AND n.id NOT IN (SELECT alias FROM al)
UNION ALL SELECT 'nämnd-ny', 'organisation', 'nämnd-nation_24'
""")
def merge_nodes(c: Civic) -> DataFrame:
    nodes, _ = G.merged(c.nodes().filter("typ in ('organisation', 'möte')").select("id", "typ", "label"), c.edges(), committee_aliases(c))
    return nodes.select("id", "typ", F.array_join("aliases", ",").alias("alias"))


@query("grf_07_merge_edges", MERGE_SQL + "SELECT coalesce(a.id, e.to_id) AS to_id, e.typ, count(*) AS antal FROM edges e LEFT JOIN al a ON e.to_id = a.alias WHERE e.typ = 'ledamot_i' GROUP BY 1, 2")
def merge_edges(c: Civic) -> DataFrame:
    _, edges = G.merged(c.nodes().filter("typ = 'organisation'").select("id", "typ", "label"), c.edges().filter("typ = 'ledamot_i'"), committee_aliases(c))
    return edges.groupBy("to_id", "typ").agg(F.count("*").alias("antal"))


@query("grf_08_synthesised", """
SELECT DISTINCT 'nämnd-' || CASE user_id % 3 WHEN 0 THEN 'kultur' WHEN 1 THEN 'skola-och-barn' ELSE 'trafik' END AS id,
       CASE user_id % 3 WHEN 0 THEN 'Kultur' WHEN 1 THEN 'Skola Och Barn' ELSE 'Trafik' END AS label FROM events
""", plain=True)
def synthesised(c: Civic) -> DataFrame:
    """Year-less committees that edges name and no node has."""
    slug = F.element_at(F.array(F.lit("kultur"), F.lit("skola-och-barn"), F.lit("trafik")), (F.col("user_id") % 3 + 1).cast("int"))
    extra = c.table("events").select(F.lit("politiker-1").alias("from_id"), F.concat(F.lit("nämnd-"), slug).alias("to_id"))
    return G.synthesised(c.nodes(), extra.union(c.edges().filter("typ = 'ledamot_i'").select("from_id", "to_id"))).select("id", "label")


@query("grf_09_canonical", """
SELECT namn, id FROM (SELECT namn, id, row_number() OVER (PARTITION BY namn ORDER BY CASE WHEN regexp_matches(id, '^nämnd-[^0-9]+$') THEN 3 WHEN id LIKE 'org-%' THEN 2 ELSE 1 END DESC, id) AS n FROM (
  SELECT orsak AS namn, CASE WHEN id LIKE 'ks-%' THEN 'org-' || id WHEN nr IS NULL AND orsak LIKE '1%' THEN 'nämnd-utan' ELSE id END AS id FROM paragraphs)) WHERE n = 1
""")
def canonical(c: Civic) -> DataFrame:
    ids = F.when(F.col("id").startswith("ks-"), F.concat(F.lit("org-"), "id")).when(F.col("nr").isNull() & F.col("orsak").startswith("1"), "nämnd-utan").otherwise(F.col("id"))
    return G.canonical(c.paragraphs().select(F.col("orsak").alias("namn"), ids.alias("id")), "namn").select("namn", "id")


@query("grf_10_memberships", "SELECT kund AS person, 'nämnd-nation_' || c_nationkey AS namnd, arg_min(id, (datum, id)) AS forsta FROM paragraphs JOIN customer ON kund = c_custkey WHERE beslut = 'bifall' GROUP BY 1, 2")
def memberships(c: Civic) -> DataFrame:
    """One edge per person and committee: the first role in roster order."""
    homes = c.table("customer").select(F.col("c_custkey").alias("kund"), F.concat(F.lit("nämnd-nation_"), F.col("c_nationkey").cast("string")).alias("namnd"))
    roles = c.paragraphs().filter("beslut = 'bifall'").join(homes, "kund")
    return R.first_per(roles, ["kund", "namnd"], F.col("datum"), F.col("id")).select(F.col("kund").alias("person"), "namnd", F.col("id").alias("forsta"))


@query("grf_11_company_roles", """
SELECT p.id AS fran, coalesce(s.id, 'bolag-' || lower(p.namn)) AS till, s.id IS NULL AS ny FROM people p LEFT JOIN (SELECT id, lower(namn) AS n FROM people WHERE saldo > 5000) s ON lower(p.namn) = s.n
""")
def company_roles(c: Civic) -> DataFrame:
    """Company roles to known companies by normalised name; an unmatched one becomes a node of its own."""
    known = c.people().filter("saldo > 5000").select(F.lower("namn").alias("n"), F.col("id").alias("traff"))
    rows = c.people().withColumn("n", F.lower("namn")).join(known, "n", "left")
    return rows.select(F.col("id").alias("fran"), F.coalesce("traff", F.concat(F.lit("bolag-"), "n")).alias("till"), F.col("traff").isNull().alias("ny"))


@query("grf_13_speech_edges", "SELECT a.from_id, a.to_id, count(*) AS inlagg, sum(a.langd)::BIGINT AS langd FROM acts a WHERE a.typ = 'talade_i' AND a.langd > 10 AND a.from_id IN (SELECT id FROM people) GROUP BY 1, 2")
def speech_edges(c: Civic) -> DataFrame:
    rows = c.acts().filter("typ = 'talade_i' and langd > 10").join(c.people().select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return rows.groupBy("from_id", "to_id").agg(F.count("*").alias("inlagg"), F.sum("langd").alias("langd"))


@query("grf_14_journey", """
SELECT p.namnd, count(DISTINCT q.id) AS arenden, count(DISTINCT m.id) AS medlemmar FROM people p JOIN votes v ON v.from_id = p.id AND v.rost = 'nej' JOIN paragraphs q ON v.to_id = q.id AND q.beslut = 'bifall'
JOIN people m ON m.namnd = p.namnd WHERE p.parti = 'P1' GROUP BY 1
""")
def journey(c: Civic) -> DataFrame:
    """Person to vote to decision to committee to members; members are counted per committee before they are joined."""
    people = c.people()
    voted = c.votes().filter("rost = 'nej'").join(people.filter("parti = 'P1'").select(F.col("id").alias("from_id"), "namnd"), "from_id")
    decided = voted.join(c.paragraphs().filter("beslut = 'bifall'").select(F.col("id").alias("to_id")), "to_id").groupBy("namnd").agg(F.count_distinct("to_id").alias("arenden"))
    return decided.join(people.groupBy("namnd").agg(F.count_distinct("id").alias("medlemmar")), "namnd")


@query("grf_15_dossier", """
SELECT o.id, count(DISTINCT p.id) AS medlemmar, coalesce(max(i.n), 0) AS fakturor, coalesce(max(i.s), 0) AS summa, max(g.mnkr) AS mnkr, count(DISTINCT p.parti) AS partier
FROM nodes o LEFT JOIN people p ON p.namnd = o.id LEFT JOIN (SELECT namnd, count(*) AS n, floor(sum(belopp) + 0.5) AS s FROM invoices GROUP BY 1) i ON i.namnd = o.id
LEFT JOIN (SELECT namnd, arg_max(mnkr, ar) AS mnkr FROM grants GROUP BY 1) g ON g.namnd = o.id WHERE o.typ = 'organisation' GROUP BY 1
""")
def dossier(c: Civic) -> DataFrame:
    """A department's members, invoices, latest grant and parties: each branch aggregated, then joined."""
    members = c.people().groupBy("namnd").agg(F.count_distinct("id").alias("medlemmar"), F.count_distinct("parti").alias("partier"))
    bills = c.invoices().groupBy("namnd").agg(F.count("*").alias("fakturor"), (S.half_up(F.sum("belopp")) * 1.0).alias("summa"))
    latest = c.grants().groupBy("namnd").agg(F.max_by("mnkr", "ar").alias("mnkr"))
    offices = c.nodes().filter("typ = 'organisation'").select(F.col("id").alias("namnd"))
    out = offices.join(members, "namnd", "left").join(bills, "namnd", "left").join(latest, "namnd", "left")
    return out.select(F.col("namnd").alias("id"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("medlemmar", "partier", "fakturor")], F.coalesce("summa", F.lit(0.0)).alias("summa"), "mnkr")


@query("grf_17_tree", """
WITH RECURSIVE tree AS (
  SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
), walk AS (SELECT id, 0 AS depth, id AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, w.depth + 1, w.path || '/' || t.id FROM tree t JOIN walk w ON t.parent = w.id WHERE w.depth < 2)
SELECT * FROM walk
""", plain=True)
def tree(c: Civic) -> DataFrame:
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    roots = c.table("region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    inner = c.table("nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"))
    leaves = c.table("supplier").select(key("s", "s_suppkey").alias("id"), key("n", "s_nationkey").alias("parent"))
    return G.flattened(roots.unionByName(inner).unionByName(leaves), 2)


def chain(c: Civic) -> DataFrame:
    """id, parent: customers as a tree as deep as their numbers have digits; some are their own parents."""
    key = F.col("c_custkey")
    parent = F.when(key % 101 == 0, key).when(key > 1, F.floor(key / 2))
    return c.table("customer").select(F.concat(F.lit("k"), key.cast("string")).alias("id"), F.concat(F.lit("k"), parent.cast("string")).alias("parent"))


CHAIN = """
WITH RECURSIVE chain AS (SELECT 'k' || c_custkey AS id, 'k' || CASE WHEN c_custkey % 101 = 0 THEN c_custkey WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer),
walk AS (SELECT id, 0 AS depth, id AS path FROM chain WHERE parent IS NULL UNION ALL SELECT t.id, w.depth + 1, w.path || '/' || t.id FROM chain t JOIN walk w ON t.parent = w.id)
"""


@query("grf_17_any_depth", CHAIN + "SELECT * FROM walk", plain=True)
def any_depth(c: Civic) -> DataFrame:
    return G.flattened(chain(c))


@query("grf_17_unreached", CHAIN + "SELECT id FROM chain WHERE id NOT IN (SELECT id FROM walk)", plain=True)
def unreached(c: Civic) -> DataFrame:
    """Nodes on cycles and below them."""
    return G.unreached(chain(c), G.flattened(chain(c)))


@query("grf_17_active", """
WITH items AS (SELECT '/' AS href UNION ALL SELECT '/org/r' || r_regionkey || '/' FROM region UNION ALL SELECT '/org/r' || n_regionkey || '/n' || n_nationkey FROM nation WHERE n_nationkey % 5 > 0),
pages AS (SELECT '/org/r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '//' ELSE '' END AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT '/' UNION ALL SELECT '/orgs' UNION ALL SELECT '/org/r1'),
bare AS (SELECT path, coalesce(nullif(rtrim(path, '/'), ''), '/') AS p FROM pages), h AS (SELECT coalesce(nullif(rtrim(href, '/'), ''), '/') AS h FROM items)
SELECT path, arg_max(h, length(h)) AS aktiv FROM bare LEFT JOIN h ON p = h OR starts_with(p, h || '/') GROUP BY path
""", plain=True)
def active(c: Civic) -> DataFrame:
    """The menu item of each supplier's page: its nation's, or its region's where the nation has none."""
    region = lambda k: F.concat(F.lit("/org/r"), F.col(k).cast("string"))
    nations = c.table("nation").select("n_nationkey", F.concat(region("n_regionkey"), F.lit("/n"), F.col("n_nationkey").cast("string")).alias("href"))
    items = c.table("region").select(F.concat(region("r_regionkey"), F.lit("/")).alias("href")).union(nations.filter("n_nationkey % 5 > 0").select("href")).union(c.spark.createDataFrame([("/",)], "href string"))
    end = F.when(F.col("s_suppkey") % 2 == 0, F.lit("//")).otherwise(F.lit(""))
    pages = c.table("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("href", F.lit("/s"), F.col("s_suppkey").cast("string"), end).alias("path"))
    return G.active_items(items, pages.union(c.spark.createDataFrame([("/",), ("/orgs",), ("/org/r1",)], "path string")))


@query("grf_18_rows_to_graph", """
SELECT 'budget-' || ar AS from_id, namnd AS to_id, 'finansierar' AS typ, mnkr, floor(mnkr / sum(mnkr) OVER (PARTITION BY ar) * 100 * 10 + 0.5) / 10 AS andel FROM grants
""")
def rows_to_graph(c: Civic) -> DataFrame:
    """Budget rows as weighted edges from the year's root."""
    grants = c.grants()
    totals = grants.groupBy("ar").agg(F.sum("mnkr").alias("totalt"))
    return grants.join(totals, "ar").select(F.concat(F.lit("budget-"), F.col("ar").cast("string")).alias("from_id"), F.col("namnd").alias("to_id"), F.lit("finansierar").alias("typ"), "mnkr", S.half_up(F.col("mnkr") / F.col("totalt") * 100, 1).alias("andel"))


# ---- loading --------------------------------------------------------------------------------------------------------------


@query("snk_02_upsert", "SELECT id, label, typ FROM nodes WHERE typ <> 'politiker' UNION ALL SELECT id, namn || ' *', 'politiker' FROM people")
def upsert(c: Civic) -> DataFrame:
    fresh = c.people().select("id", F.concat("namn", F.lit(" *")).alias("label"), F.lit("politiker").alias("typ"))
    return R.upsert(c.nodes().select("id", "label", "typ"), fresh, "id")


@query("snk_02_insert_missing", "SELECT id FROM people UNION SELECT from_id FROM acts")
def insert_missing(c: Civic) -> DataFrame:
    return R.insert_missing(c.people().select("id"), c.acts().select(F.col("from_id").alias("id")).distinct(), "id")


@query("snk_03_json_merge", "SELECT m.id, m.label, CASE WHEN v.datum IS NOT NULL THEN 'sändning-' || m.datum END AS video FROM nodes m LEFT JOIN (SELECT DISTINCT datum FROM acts WHERE typ = 'yrkat') v ON m.datum = v.datum WHERE m.typ = 'möte'")
def json_merge(c: Civic) -> DataFrame:
    """Attributes merged into a node's data, the right side winning."""
    links = c.acts().filter("typ = 'yrkat'").select("datum").distinct().select("datum", F.create_map(F.lit("video"), F.concat(F.lit("sändning-"), "datum")).alias("nytt"))
    meetings = c.nodes().filter("typ = 'möte'").join(links, "datum", "left")
    data = F.map_concat(F.create_map(F.lit("datum"), "datum"), F.coalesce("nytt", F.create_map().cast("map<string,string>")))
    return meetings.select("id", "label", F.try_element_at(data, F.lit("video")).alias("video"))


@query("snk_04_delete", "SELECT id FROM nodes WHERE NOT (typ = 'paragraf' AND beslut = 'avslag')")
def delete(c: Civic) -> DataFrame:
    return c.nodes().filter(~F.coalesce((F.col("typ") == "paragraf") & (F.col("beslut") == "avslag"), F.lit(False))).select("id")


@query("snk_09_merge_keeping", """
SELECT coalesce(n.s_suppkey, o.s_suppkey) AS s_suppkey, CASE WHEN n.s_suppkey IS NULL THEN o.s_name ELSE n.s_name END AS s_name, coalesce(n.s_acctbal, o.s_acctbal) AS s_acctbal, n.s_suppkey IS NULL AS historisk
FROM (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0) o
FULL JOIN (SELECT s_suppkey, s_name || ' ny' AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0) n ON o.s_suppkey = n.s_suppkey
""", plain=True)
def merge_keeping(c: Civic) -> DataFrame:
    base = c.table("supplier").select("s_suppkey", "s_name", "s_acctbal")
    old = base.filter("s_suppkey % 4 != 0")
    new = base.filter("s_suppkey % 5 != 0").select("s_suppkey", F.concat("s_name", F.lit(" ny")).alias("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("s_acctbal"))
    return R.merge_keeping(old, new, "s_suppkey", ["s_acctbal"])


@query("snk_10_envelope", """
SELECT id, '{"id":"' || id || '","typ":"' || typ || '","_links":{"self":{"href":"/v1/nod/' || replace(url_encode(id), '%20', '+') || '"}}}' AS resurs FROM nodes WHERE typ <> 'paragraf'
""")
def envelope(c: Civic) -> DataFrame:
    """A resource with its links, as JSON."""
    link = F.struct(F.struct(F.concat(F.lit("/v1/nod/"), F.url_encode("id")).alias("href")).alias("self"))
    return c.nodes().filter("typ != 'paragraf'").select("id", F.to_json(F.struct("id", "typ", link.alias("_links"))).alias("resurs"))


@query("str_02_changes", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 THEN c_name || ' ny' ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 3 <> 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal, c_custkey % 15 = 0 AS historisk FROM customer
""", plain=True)
def merged_changes(c: Civic) -> DataFrame:
    """A roster and two batches of changes, one of them merged twice: new names, some balances, and customers that left."""
    path, rows = shared_folder(c.spark), c.table("customer").select("c_custkey", "c_name", "c_acctbal")
    merge = merging_changes(c.spark, path, "c_custkey", "ordning", ["c_acctbal"], "borta", 16)
    merge(rows.withColumns({"ordning": F.lit(0), "borta": F.lit(False)}), 0)
    fifth = rows.filter("c_custkey % 5 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, -1.0)).withColumn("c_name", F.concat("c_name", F.lit(" ny")))
    batch = fifth.withColumns({"ordning": F.lit(1), "borta": F.col("c_custkey") % 3 == 0})
    for number in (1, 1):
        merge(batch, number)
    return c.spark.read.parquet(path).select("c_custkey", "c_name", "c_acctbal", "historisk")


@query("snk_08_enriched", "SELECT id, CASE WHEN beslut = 'bordläggning' THEN 'Handling ' || id END AS handling FROM paragraphs")
def enriched(c: Civic) -> DataFrame:
    """Texts of documents added to the paragraphs that were postponed, in a table in folders by month."""
    path = shared_folder(c.spark)
    rows = c.paragraphs().select("id", "beslut", F.concat(F.lit("m"), F.left("datum", F.lit(7))).alias("manad"))
    rows.repartition("manad").write.partitionBy("manad").parquet(path)
    sinks.enrich_in_place(rows.filter("beslut = 'bordläggning'").select("id", F.concat(F.lit("Handling "), "id").alias("handling")), path, "manad", "id")
    return c.spark.read.option("mergeSchema", True).parquet(path).select("id", "handling")


@query("snk_01_rebuild", "SELECT typ, count(*) AS antal FROM edges WHERE from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes) GROUP BY typ")
def rebuilt(c: Civic) -> DataFrame:
    """Nodes and edges as one snapshot; a second one, with edges to nowhere, is refused and leaves the first."""
    path, nodes = shared_folder(c.spark), c.nodes()
    keys, references = {"nodes": "id"}, [("edges", end, "nodes", "id") for end in ("from_id", "to_id")]
    sinks.rebuild({"nodes": nodes, "edges": R.known_ends(c.edges(), nodes, c.graph_rows())}, path, keys, references)
    lost = c.edges().withColumn("to_id", F.concat("to_id", F.lit("-borta")))
    try:
        sinks.rebuild({"nodes": nodes, "edges": lost}, path, keys, references)
    except ValueError:
        return sinks.snapshot(c.spark, path, "edges").groupBy("typ").agg(F.count("*").alias("antal"))
    raise AssertionError("edges to nowhere were not refused")


# ---- quality --------------------------------------------------------------------------------------------------------------


@query("qa_01_dangling", """
SELECT typ, monster, count(*) AS antal FROM (
  SELECT typ, regexp_replace(CASE WHEN from_id NOT IN (SELECT id FROM nodes) THEN from_id ELSE to_id END, '[0-9]+', '*', 'g') AS monster FROM edges
  WHERE from_id NOT IN (SELECT id FROM nodes) OR to_id NOT IN (SELECT id FROM nodes)) GROUP BY 1, 2
""")
def dangling(c: Civic) -> DataFrame:
    rows = R.dangling(c.edges(), c.nodes())
    return rows.groupBy("typ", F.regexp_replace("missing", "[0-9]+", "*").alias("monster")).agg(F.count("*").alias("antal"))


@query("qa_03_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS antal FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", plain=True)
def uniqueness(c: Civic) -> DataFrame:
    return c.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("antal")).filter("antal > 1")


@query("qa_02_conformity", "SELECT id, CASE WHEN nr IS NULL THEN 'nr' ELSE '' END || CASE WHEN id NOT LIKE 'kf-%' THEN 'id' ELSE '' END AS brister FROM paragraphs WHERE nr IS NULL OR id NOT LIKE 'kf-%'")
def conformity(c: Civic) -> DataFrame:
    rows = K.nonconforming(c.paragraphs(), {"nr": None, "id": "^kf-[0-9]+$", "datum": r"^\d{4}-\d{2}-\d{2}$"})
    return rows.select("id", F.array_join("brister", "").alias("brister"))


@query("qa_02_quarantine", """
SELECT id AS nyckel, nr IS NOT NULL AND id LIKE 'kf-%' AND k % 11 <> 0 AND (k % 13 <> 0 OR nr IS NULL) AS godkand,
       CASE WHEN k % 11 = 0 OR (k % 13 = 0 AND nr IS NOT NULL) THEN '_trasig' ELSE CASE WHEN nr IS NULL THEN 'nr' ELSE '' END || CASE WHEN id NOT LIKE 'kf-%' THEN 'id' ELSE '' END END AS brister
FROM (SELECT *, regexp_extract(id, '[0-9]+')::BIGINT AS k FROM paragraphs)
""")
def quarantine(c: Civic) -> DataFrame:
    """Paragraphs as lines of JSON, some cut off and some with a text where a number belongs, read and told apart in one pass."""
    k = F.regexp_extract("id", "[0-9]+", 0).cast("long")
    text = F.to_json(F.struct("id", F.when(k % 13 == 0, F.concat(F.lit("nr "), F.col("nr").cast("string"))).otherwise(F.col("nr").cast("string")).alias("nr"), "datum"))
    number = F.regexp_replace(text, r'"nr":"(\d+)"', '"nr":$1')
    lines = c.paragraphs().select(F.col("id").alias("nyckel"), F.when(k % 11 == 0, F.left(number, F.length(number) - 3)).otherwise(number).alias("rad"))
    rows = K.checked_lines(lines, "rad", "id string, nr int, datum string", {"nr": None, "id": "^kf-[0-9]+$", "datum": r"^\d{4}-\d{2}-\d{2}$"})
    return rows.select("nyckel", (F.size("brister") == 0).alias("godkand"), F.array_join("brister", "").alias("brister"))


@query("qa_04_floors", "SELECT namn, antal, golv FROM (SELECT 'paragraf' AS namn, (SELECT count(*) FROM paragraphs) AS antal, 10000000000 AS golv UNION ALL SELECT 'saknas', 0, 1)")
def floors(c: Civic) -> DataFrame:
    counts = c.nodes().groupBy(F.col("typ").alias("namn")).agg(F.count("*").alias("antal"))
    return K.below_floor(counts, {"paragraf": 10_000_000_000, "möte": 1, "saknas": 1}).select("namn", "antal", "golv")


@query("qa_09_counts", "SELECT to_id, count(*) AS antal FROM votes GROUP BY 1 HAVING count(*) <> 4")
def vote_counts(c: Civic) -> DataFrame:
    rolls = c.votes().groupBy("to_id").agg(F.collect_list("from_id").alias("namn"), F.count("*").alias("antal")).withColumn("sagt", F.lit(4))
    return K.miscounted(rolls, "namn", "sagt").select("to_id", "antal")


@query("src_25_literals", "SELECT p.id, v.namn FROM people p JOIN (VALUES ('P0', 'Norr'), ('P1', 'Söder')) v(parti, namn) ON p.parti = v.parti")
def literals(c: Civic) -> DataFrame:
    """A relation that is written in the code, joined like any other."""
    names = c.spark.createDataFrame([("P0", "Norr"), ("P1", "Söder")], "parti string, namn_ string")
    return c.people().join(names, "parti").select("id", F.col("namn_").alias("namn"))


@query("qa_05_reconciliation", """
SELECT ar, floor(d + 0.5) AS delar, floor(t + 0.5) AS totalt, abs(d - t) / t < 0.05 AS inom FROM (SELECT ar, sum(mnkr) AS d FROM grants GROUP BY 1) JOIN (SELECT year(o_orderdate)::INT AS y, sum(o_totalprice) / 1e6 AS t FROM orders GROUP BY 1) ON ar = y
""")
def reconciliation(c: Civic) -> DataFrame:
    parts = c.grants().groupBy("ar").agg(F.sum("mnkr").alias("d"))
    whole = c.table("orders").groupBy(F.year("o_orderdate").alias("ar")).agg((F.sum("o_totalprice") / 1e6).alias("t"))
    return parts.join(whole, "ar").select("ar", (S.half_up(F.col("d")) * 1.0).alias("delar"), (S.half_up(F.col("t")) * 1.0).alias("totalt"), (F.abs(F.col("d") - F.col("t")) / F.col("t") < 0.05).alias("inom"))


@query("qa_06_identities", """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS dag, count(*) FILTER (WHERE l_returnflag = 'A') + count(*) FILTER (WHERE l_returnflag = 'R') + count(*) FILTER (WHERE l_returnflag = 'N') - count(*) AS rest FROM lineitem GROUP BY 1
""", plain=True)
def identities(c: Civic) -> DataFrame:
    """A total against its named parts; the rest must be 0."""
    parts = sum((F.count_if(F.col("l_returnflag") == k) for k in ("R", "N")), F.count_if(F.col("l_returnflag") == "A"))
    return c.table("lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("dag")).agg((parts - F.count("*")).alias("rest"))


@query("qa_07_subtotals", """
SELECT user_id, segment, floor(sum(value) * 10 + 0.5) / 10 AS summa, count(*) AS rader FROM (
  SELECT user_id, value, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT - CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS segment
  FROM events) WHERE event_type <> 'error' GROUP BY 1, 2
""", plain=True)
def subtotals(c: Civic) -> DataFrame:
    """Rows since the last total row, summed per segment."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_total = F.col("event_type") == "error"
    rows = c.table("events").withColumn("segment", F.count(F.when(is_total, 1)).over(order) - F.when(is_total, 1).otherwise(0))
    return rows.filter(~is_total).groupBy("user_id", "segment").agg(S.half_up(F.sum("value"), 1).alias("summa"), F.count("*").alias("rader"))


@query("qa_08_components", """
SELECT l_orderkey, abs(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) + sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity ELSE 0 END) - sum(l_quantity)) < 0.2 AS stammer FROM lineitem GROUP BY 1
""", plain=True)
def components(c: Civic) -> DataFrame:
    a = F.col("l_returnflag") == "A"
    parts = F.sum(F.when(a, F.col("l_quantity")).otherwise(0)) + F.sum(F.when(~a, F.col("l_quantity")).otherwise(0))
    return c.table("lineitem").groupBy("l_orderkey").agg((F.abs(parts - F.sum("l_quantity")) < 0.2).alias("stammer"))


@query("qa_10_unmapped", "SELECT from_id, count(*) AS antal FROM acts WHERE from_id NOT IN (SELECT id FROM people) GROUP BY 1")
def unmapped(c: Civic) -> DataFrame:
    return c.acts().join(c.people().select(F.col("id").alias("from_id")), "from_id", "left_anti").groupBy("from_id").agg(F.count("*").alias("antal"))
