"""Joins, set operations, sorting and paging."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import semantics as S
from plenum.operators import relational as R
from plenum.plans.registry import query
from plenum.sources.projection import Civic


@query("jon_01_edge_source", "SELECT e.from_id, e.typ, p.parti FROM edges e JOIN nodes p ON e.from_id = p.id AND p.typ = 'politiker' WHERE e.typ = 'yrkat'")
def edge_source(c: Civic) -> DataFrame:
    people = c.nodes().filter("typ = 'politiker'").select(F.col("id").alias("from_id"), "parti")
    return c.edges().filter("typ = 'yrkat'").join(people, "from_id").select("from_id", "typ", "parti")


@query("jon_02_edge_target", "SELECT e.from_id, n.label AS namnd FROM edges e JOIN nodes n ON e.to_id = n.id WHERE e.typ = 'ledamot_i'")
def edge_target(c: Civic) -> DataFrame:
    targets = c.nodes().select(F.col("id").alias("to_id"), F.col("label").alias("namnd"))
    return c.edges().filter("typ = 'ledamot_i'").join(targets, "to_id").select("from_id", "namnd")


@query("jon_03_two_sided", """
SELECT a.label AS fran, b.label AS till, count(*) AS antal FROM edges e JOIN nodes a ON e.from_id = a.id JOIN nodes b ON e.to_id = b.id WHERE e.typ = 'röstade_nej' GROUP BY 1, 2
""")
def two_sided(c: Civic) -> DataFrame:
    ends = c.nodes().select("id", "label")
    a, b = ends.select(F.col("id").alias("from_id"), F.col("label").alias("fran")), ends.select(F.col("id").alias("to_id"), F.col("label").alias("till"))
    return c.edges().filter("typ = 'röstade_nej'").join(a, "from_id").join(b, "to_id").groupBy("fran", "till").agg(F.count("*").alias("antal"))


@query("jon_04_computed_key", "SELECT a.from_id, a.typ, s.s_name AS namn FROM acts a LEFT JOIN supplier s ON regexp_replace(a.from_id, '^politiker-', '') = s.s_suppkey::VARCHAR WHERE a.typ = 'jävsanmälan'")
def computed_key(c: Civic) -> DataFrame:
    names = c.table("supplier").select(F.col("s_suppkey").cast("string").alias("nyckel"), F.col("s_name").alias("namn"))
    acts = c.acts().filter("typ = 'jävsanmälan'").withColumn("nyckel", F.regexp_replace("from_id", "^politiker-", ""))
    return acts.join(names, "nyckel", "left").select("from_id", "typ", "namn")


@query("jon_05_edge_to_edge", """
SELECT y.from_id, y.to_id, count(m.from_id) AS motioner FROM edges y LEFT JOIN edges m ON y.to_id = m.to_id AND m.typ = 'inlämnade_motion' AND m.label = y.label
WHERE y.typ = 'yrkat' GROUP BY 1, 2
""")
def edge_to_edge(c: Civic) -> DataFrame:
    motions = c.edges().filter("typ = 'inlämnade_motion'").groupBy("to_id", "label").agg(F.count("*").alias("n"))
    asks = c.edges().filter("typ = 'yrkat'").join(motions, ["to_id", "label"], "left")
    return asks.groupBy("from_id", "to_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("motioner"))


@query("jon_06_left_not_null", "SELECT v.to_id, p.datum FROM votes v LEFT JOIN paragraphs p ON v.to_id = p.id WHERE p.id IS NOT NULL AND p.beslut = 'avslag'")
def left_not_null(c: Civic) -> DataFrame:
    rows = c.paragraphs().filter("beslut = 'avslag'").select(F.col("id").alias("to_id"), "datum")
    return c.votes().join(rows, "to_id").select("to_id", "datum")


@query("jon_07_lookup_chain", """
SELECT p.id, p.namnd, n.label, g.mnkr FROM people p LEFT JOIN nodes n ON n.id = p.namnd
LEFT JOIN (SELECT namnd, mnkr FROM (SELECT *, row_number() OVER (PARTITION BY namnd ORDER BY ar DESC) AS k FROM grants) WHERE k = 1) g ON g.namnd = p.namnd
""")
def lookup_chain(c: Civic) -> DataFrame:
    labels = c.nodes().filter("typ = 'organisation'").select(F.col("id").alias("namnd"), "label")
    latest = R.first_per(c.grants(), ["namnd"], F.col("ar").desc()).select("namnd", "mnkr")
    return c.people().join(labels, "namnd", "left").join(latest, "namnd", "left").select("id", "namnd", "label", "mnkr")


@query("jon_08_by_name", "SELECT n_name AS namn, max(g.ar)::INT AS ar FROM nation LEFT JOIN grants g ON 'nämnd-' || lower(n_name) = g.namnd GROUP BY 1")
def by_name(c: Civic) -> DataFrame:
    city = c.table("nation").select("n_name", F.concat(F.lit("Stadens "), "n_name").alias("stad"))
    key = F.concat(F.lit("nämnd-"), F.lower(F.regexp_replace("stad", "^Stadens ", "")))
    return city.withColumn("namnd", key).join(c.grants(), "namnd", "left").groupBy(F.col("n_name").alias("namn")).agg(F.max("ar").alias("ar"))


def alias_keys(people: DataFrame, name: str, last_wins: bool = False) -> DataFrame:
    """Every way a name is written (whole, parts turned round, last part), to one person per key by policy."""
    parts = F.split(name, "[ #]")
    keys = F.array(F.lower(name), F.lower(F.concat_ws(", ", F.element_at(parts, -1), parts[0])), F.lower(F.element_at(parts, -1)))
    exploded = people.select("id", "place", F.explode(F.array_distinct(keys)).alias("nyckel"))
    order = F.col("place").desc() if last_wins else F.col("place").asc()
    return R.first_per(exploded, ["nyckel"], order).select("nyckel", "id")


@query("jon_09_alias_lookup", """
SELECT nyckel, arg_min(c_custkey, c_custkey) AS forsta, arg_max(c_custkey, c_custkey) AS sista FROM (
  SELECT c_custkey, unnest([lower(c_name), lower(string_split_regex(c_name, '[ #]')[-1] || ', ' || string_split_regex(c_name, '[ #]')[1]), lower(string_split_regex(c_name, '[ #]')[-1])]) AS nyckel
  FROM (SELECT c_custkey, c_name || ' ' || (c_custkey % 50) AS c_name FROM customer)) GROUP BY 1
""", plain=True)  # fmt: skip
def alias_lookup(c: Civic) -> DataFrame:
    people = c.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("place"), F.concat(F.col("c_name"), F.lit(" "), (F.col("c_custkey") % 50).cast("string")).alias("namn"))
    first, last = alias_keys(people, "namn"), alias_keys(people, "namn", last_wins=True)
    return first.withColumnRenamed("id", "forsta").join(last.withColumnRenamed("id", "sista"), "nyckel")


@query("jon_10_token_subset", """
SELECT p.p_partkey, min(w.p_partkey) AS traff FROM part p JOIN (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part) w
  ON list_has_all(string_split(p.p_name, ' '), w.t) OR list_has_all(w.t, string_split(p.p_name, ' ')) GROUP BY 1
""", plain=True)  # fmt: skip
def token_subset(c: Civic) -> DataFrame:
    """A name and a roster entry match if one's words are all among the other's; the first in roster order counts.

    Both sides are distinct word sets.  A set that lies in another has its rarest word there, too, so they meet on that word.
    """
    parts = c.table("part").select("p_partkey", F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("t"))
    sets = parts.groupBy("t").agg(F.min("p_partkey").alias("traff"))
    words = sets.select("t", "traff", F.explode("t").alias("ord"))
    counts = words.groupBy("ord").agg(F.count("*").alias("n"))
    rarest = words.join(counts, "ord").groupBy("t", "traff").agg(F.min_by("ord", F.struct("n", "ord")).alias("ord"))
    small = rarest.select("ord", F.col("t").alias("s"), F.col("traff").alias("s_traff"))
    inside = words.join(small, "ord").filter(F.size(F.array_except("s", "t")) == 0)
    pairs = inside.select("t", F.col("s_traff").alias("traff")).union(inside.select(F.col("s").alias("t"), "traff"))
    return parts.join(pairs.groupBy("t").agg(F.min("traff").alias("traff")), "t").select("p_partkey", "traff")


@query("jon_11_prefix_overlap", """
SELECT a.id, min(b.id) AS traff, count(*) AS antal FROM (SELECT id, left(regexp_replace(lower(label), '[^a-z0-9å]+', '', 'g'), 13) AS n FROM nodes WHERE typ = 'paragraf') a
JOIN (SELECT id, left(regexp_replace(lower(label), '[^a-z0-9å]+', '', 'g'), 13) AS n FROM nodes WHERE typ IN ('möte', 'paragraf')) b ON a.n = b.n AND length(a.n) >= 13 GROUP BY 1
""")
def prefix_overlap(c: Civic) -> DataFrame:
    """Titles that agree in their first 13 normalised characters: an equi-join on that prefix, counted per prefix first."""
    key = F.left(F.regexp_replace(F.lower("label"), "[^a-z0-9å]+", ""), F.lit(13))
    rows = c.nodes().filter("typ in ('möte', 'paragraf')").select("id", "typ", key.alias("n")).filter(F.length("n") >= 13)
    per = rows.groupBy("n").agg(F.min("id").alias("traff"), F.count("*").alias("antal"))
    return rows.filter("typ = 'paragraf'").join(per, "n").select("id", "traff", "antal")


@query("jon_12_dictionary", """
SELECT a.namn, CASE WHEN bool_or(a.namn = b.e) THEN min(b.k) FILTER (WHERE a.namn = b.e) ELSE min(b.k) END AS plats FROM (SELECT DISTINCT lower(n_name) || ' sydost' AS namn FROM nation) a
JOIN (SELECT lower(n_name) AS e, n_nationkey AS k FROM nation) b ON starts_with(a.namn, b.e) OR (length(a.namn) >= 10 AND starts_with(b.e, a.namn)) GROUP BY 1
""", plain=True)  # fmt: skip
def dictionary(c: Civic) -> DataFrame:
    names = c.table("nation").select(F.concat(F.lower("n_name"), F.lit(" sydost")).alias("namn")).distinct()
    entries = c.table("nation").select(F.lower("n_name").alias("post"), F.col("n_nationkey").alias("plats"))
    return R.best_prefix_match(names, "namn", entries, "post", "plats").select("namn", "plats")


@query("jon_13_containment", """
SELECT a.n_name AS namn, min(b.n_name) AS traff FROM nation a JOIN nation b ON contains(lower(a.n_name), left(lower(b.n_name), 15)) OR contains(lower(b.n_name), left(lower(a.n_name), 15)) GROUP BY 1
""", plain=True)
def containment(c: Civic) -> DataFrame:
    names = c.table("nation").select(F.col("n_name").alias("namn"), F.lower("n_name").alias("liten"))
    parts = names.select(F.col("namn").alias("andra"), F.left("liten", F.lit(15)).alias("del"))
    found = R.containing(names, "liten", parts, "del", 15).select("namn", "andra")
    both = found.union(found.select("andra", "namn"))
    return both.groupBy("namn").agg(F.min("andra").alias("traff"))


@query("jon_14_mentions", """
SELECT d.doc_id, b.item_id, strpos(d.text, b.text) AS plats FROM documents d JOIN benchmark b ON contains(d.text, b.text)
""", plain=True)
def mentions(c: Civic) -> DataFrame:
    """Passages in documents, a hit per pair."""
    from plenum.operators.mentions import mentions as found

    return found(c.table("documents"), "doc_id", "text", c.table("benchmark"), "item_id", "text")


@query("jon_15_watch_list", "SELECT i.orgnr, p.id, count(*) AS fakturor FROM invoices i JOIN people p ON i.leverantor = p.namn AND p.parti = 'P3' GROUP BY 1, 2")
def watch_list(c: Civic) -> DataFrame:
    watched = c.people().filter("parti = 'P3'").select(F.col("namn").alias("leverantor"), "id")
    return c.invoices().join(watched, "leverantor").groupBy("orgnr", "id").agg(F.count("*").alias("fakturor"))


@query("jon_16_disclosed", "SELECT DISTINCT leverantor FROM invoices i WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.namn = i.leverantor AND p.saldo > 5000) AND NOT regexp_matches(leverantor, '[13579]$')")
def disclosed(c: Civic) -> DataFrame:
    known = c.people().filter("saldo > 5000").select(F.col("namn").alias("leverantor"))
    return c.invoices().select("leverantor").distinct().join(known, "leverantor", "left_anti").filter(~F.col("leverantor").rlike("[13579]$"))


@query("jon_17_integrity", "SELECT typ, count(*) AS antal FROM edges WHERE from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes) GROUP BY 1")
def integrity(c: Civic) -> DataFrame:
    return R.known_ends(c.edges(), c.nodes(), c.graph_rows()).groupBy("typ").agg(F.count("*").alias("antal"))


@query("jon_18_party_pairs", """
SELECT a.parti AS a, b.parti AS b, count(*) AS arenden FROM (SELECT DISTINCT to_id, parti FROM party_votes WHERE rost = 'ja') a
JOIN (SELECT DISTINCT to_id, parti FROM party_votes WHERE rost = 'ja') b ON a.to_id = b.to_id AND a.parti < b.parti GROUP BY 1, 2
""")
def party_pairs(c: Civic) -> DataFrame:
    """Unordered pairs; a paragraph has at most as many positions as there are parties."""
    yes = c.party_votes().filter("rost = 'ja'").select("to_id", "parti").distinct()
    a, b = yes.withColumnRenamed("parti", "a"), yes.withColumnRenamed("parti", "b")
    return a.join(b, "to_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("arenden"))


@query("jon_19_absolute_differences", """
SELECT a.parti, floor(sum(abs(a.saldo - b.saldo)) / (2 * count(*) * avg(a.saldo)) * 100 + 0.5) / 100 AS gini FROM people a JOIN people b ON a.parti = b.parti WHERE a.saldo > 0 AND b.saldo > 0 GROUP BY 1
""")
def absolute_differences(c: Civic) -> DataFrame:
    """All pairs' absolute differences by the sorted closed form, without the pairs."""
    ranked = c.people().filter("saldo > 0").withColumn("rank", F.row_number().over(Window.partitionBy("parti").orderBy("saldo", "id")))
    return ranked.groupBy("parti").agg(S.gini("rank", "saldo").alias("gini"))


@query("jon_20_series_lookup", "SELECT g.namnd, g.ar, g.mnkr, h.mnkr AS forra FROM grants g JOIN grants h ON g.namnd || '-' || g.ar = h.namnd || '-' || (h.ar + 1)")
def series_lookup(c: Civic) -> DataFrame:
    before = c.grants().select("namnd", (F.col("ar") + 1).alias("ar"), F.col("mnkr").alias("forra"))
    return c.grants().join(before, ["namnd", "ar"]).select("namnd", "ar", "mnkr", "forra")


@query("jon_21_roster_diff", "SELECT id FROM people WHERE id NOT IN (SELECT from_id FROM acts)")
def roster_diff(c: Civic) -> DataFrame:
    return c.people().select("id").join(c.acts().select(F.col("from_id").alias("id")), "id", "left_anti")


@query("jon_22_positional", """
SELECT s.key, list_extract(l.xs, (split_part(s.key, '-', 2)::INT + 1)::INT) AS langd FROM speeches s
JOIN (SELECT conv_id::VARCHAR AS arende, list(coalesce(length(text), 0)::INT ORDER BY turn) AS xs FROM conversations GROUP BY 1) l ON s.arende = l.arende
""")
def positional(c: Civic) -> DataFrame:
    """The index in a key against the elements of an array."""
    lists = c.table("conversations").groupBy(F.col("conv_id").cast("string").alias("arende")).agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce(F.length("text"), F.lit(0)).alias("langd")))).alias("xs"))
    places = lists.select("arende", F.posexplode("xs").alias("plats", "x"))
    keys = c.speeches().select("key", "arende", F.split_part("key", F.lit("-"), F.lit(2)).cast("int").alias("plats"))
    return keys.join(places, ["arende", "plats"], "left").select("key", F.col("x.langd").alias("langd"))


@query("jon_23_case_insensitive", "SELECT p.id, s.s_suppkey FROM people p JOIN supplier s ON lower(p.namn) = lower(upper(s.s_name))")
def case_insensitive(c: Civic) -> DataFrame:
    names = c.table("supplier").select(F.lower(F.upper("s_name")).alias("nyckel"), "s_suppkey")
    return c.people().withColumn("nyckel", F.lower("namn")).join(names, "nyckel").select("id", "s_suppkey")


@query("jon_25_annex_merge", """
, annex AS (SELECT n_nationkey AS nr, 'ärende ' || (n_nationkey * 37) || CASE WHEN n_nationkey % 5 = 0 THEN ' saknas helt' ELSE ' (' END AS text FROM nation),
hit AS (SELECT a.nr, min(p.id) AS id FROM annex a JOIN paragraphs p ON contains(lower(p.label), left(a.text, 20)) GROUP BY 1)
SELECT a.nr, coalesce(h.id, 'votering-' || a.nr) AS id, h.id IS NULL AS ny FROM annex a LEFT JOIN hit h ON a.nr = h.nr
""")  # fmt: skip
def annex_merge(c: Civic) -> DataFrame:
    """Annexes go to the first paragraph whose label contains their first 20 characters, else they become nodes of their own.

    Labels are short, so annexes meet their pieces of 20 characters in an equi-join.
    """
    key = F.col("n_nationkey")
    text = F.concat(F.lit("ärende "), (key * 37).cast("string"), F.when(key % 5 == 0, " saknas helt").otherwise(" ("))
    annex = c.table("nation").select(key.alias("nr"), F.left(text, F.lit(20)).alias("text"))
    labels = c.paragraphs().select("id", F.lower("label").alias("label"))
    hits = R.containing(labels, "label", annex, "text", 20).groupBy("nr").agg(F.min("id").alias("hit"))
    return annex.join(hits, "nr", "left").select("nr", F.coalesce("hit", F.concat(F.lit("votering-"), F.col("nr").cast("string"))).alias("id"), F.col("hit").isNull().alias("ny"))


# ---- set operations -------------------------------------------------------------------------------------------------------


@query("set_01_search_union", """
SELECT * FROM (SELECT 'person' AS slag, id, namn AS text FROM people WHERE namn ILIKE '%1%' ORDER BY id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'dokument', doc_id::VARCHAR, source FROM documents WHERE text ILIKE '%nation%' ORDER BY doc_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'nod', id, label FROM nodes WHERE label ILIKE '%1%' ORDER BY id LIMIT 20)
""")
def search_union(c: Civic) -> DataFrame:
    """Hits of three kinds, each branch with its own limit: the report's page size."""
    people = c.people().filter(S.contains_ci(F.col("namn"), "1")).orderBy("id").limit(10).select(F.lit("person").alias("slag"), "id", F.col("namn").alias("text"))
    docs = c.table("documents").filter(S.contains_ci(F.col("text"), "nation")).orderBy("doc_id").limit(10).select(F.lit("dokument").alias("slag"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("text"))
    nodes = c.nodes().filter(S.contains_ci(F.col("label"), "1")).orderBy("id").limit(20).select(F.lit("nod").alias("slag"), "id", F.col("label").alias("text"))
    return people.unionByName(docs).unionByName(nodes)


@query("set_03_union_distinct", "SELECT from_id AS id FROM edges WHERE typ = 'yrkat' UNION SELECT to_id FROM edges WHERE typ = 'yrkat'")
def union_distinct(c: Civic) -> DataFrame:
    asks = c.edges().filter("typ = 'yrkat'")
    return asks.select(F.col("from_id").alias("id")).union(asks.select("to_id")).distinct()


@query("set_04_except", "SELECT from_id AS id FROM acts EXCEPT SELECT id FROM people")
def set_except(c: Civic) -> DataFrame:
    return c.acts().select(F.col("from_id").alias("id")).subtract(c.people().select("id"))


@query("set_05_two_passes", "SELECT key FROM speeches WHERE langd < 100 UNION SELECT key FROM speeches WHERE talare = 'system'")
def two_passes(c: Civic) -> DataFrame:
    return c.speeches().filter("langd < 100").select("key").union(c.speeches().filter("talare = 'system'").select("key")).distinct()


@query("set_06_both_ends", """
, ids AS (SELECT id FROM people WHERE saldo > 0 UNION SELECT id FROM nodes WHERE label LIKE '%2%')
SELECT from_id, to_id FROM edges WHERE typ = 'ledamot_i' AND from_id IN (SELECT id FROM ids) AND to_id IN (SELECT id FROM ids)
""")
def both_ends(c: Civic) -> DataFrame:
    """Seats with both ends in one set: people with a balance and all nodes with a 2 in their label, people among them."""
    from plenum.operators.graph import within

    ids = c.people().filter("saldo > 0").select("id").union(c.nodes().filter(F.col("label").like("%2%")).select("id"))
    return within(c.edges().filter("typ = 'ledamot_i'"), ids).select("from_id", "to_id")


# ---- sorting, limits, paging ----------------------------------------------------------------------------------------------


@query("srt_01_multi_key", "SELECT id, row_number() OVER (ORDER BY datum DESC NULLS FIRST, nr ASC NULLS LAST, id) AS plats FROM paragraphs ORDER BY plats LIMIT 50")
def multi_key(c: Civic) -> DataFrame:
    first = c.paragraphs().orderBy(S.descending("datum"), S.ascending("nr"), "id").limit(50)
    return first.select("id", F.row_number().over(Window.orderBy(S.descending("datum"), S.ascending("nr"), "id")).cast("long").alias("plats"))


@query("srt_02_nulls_last", "SELECT id, nr FROM paragraphs ORDER BY nr DESC NULLS LAST, id LIMIT 40")
def nulls_last(c: Civic) -> DataFrame:
    return c.paragraphs().orderBy(S.descending("nr", nulls_last=True), "id").limit(40).select("id", "nr")


@query("srt_03_dynamic_key", "SELECT id FROM people ORDER BY lpad(floor(abs(saldo))::BIGINT::VARCHAR, 10, '0') DESC, id LIMIT 20")
def dynamic_key(c: Civic, by: str = "saldo") -> DataFrame:
    key = {"saldo": F.lpad(F.floor(F.abs("saldo")).cast("string"), 10, "0").desc(), "namn": F.col("namn").asc()}[by]
    return c.people().orderBy(key, "id").limit(20).select("id")


@query("srt_04_locale", "SELECT id FROM (SELECT id, namn, parti FROM people) ORDER BY CASE parti WHEN 'P3' THEN 1 WHEN 'P1' THEN 2 ELSE 99 END, namn, id LIMIT 30")
def locale(c: Civic) -> DataFrame:
    rank = F.when(F.col("parti") == "P3", 1).when(F.col("parti") == "P1", 2).otherwise(99)
    return c.people().orderBy(rank, F.expr("namn COLLATE sv"), "id").limit(30).select("id")


@query("srt_05_limit_total", "SELECT id, (SELECT count(*) FROM people) AS totalt FROM people ORDER BY id LIMIT 12")
def limit_total(c: Civic) -> DataFrame:
    total = c.people().agg(F.count("*").alias("totalt"))
    return c.people().orderBy("id").limit(S.page_limit("12abc", 100)).select("id").crossJoin(F.broadcast(total))


@query("srt_07_paging", "SELECT id FROM people ORDER BY id LIMIT 15 OFFSET 30")
def paging(c: Civic) -> DataFrame:
    return R.page(c.people().select("id"), [F.col("id")], 3, 15)


@query("srt_08_typed_sort", "SELECT id FROM people ORDER BY coalesce(TRY_CAST(regexp_extract(namn, '(\\d+)', 1) AS DOUBLE), 0) DESC, id LIMIT 25")
def typed_sort(c: Civic) -> DataFrame:
    value = F.coalesce(F.regexp_extract("namn", r"(\d+)", 1).try_cast("double"), F.lit(0.0))
    return c.people().orderBy(value.desc(), "id").limit(25).select("id")


@query("srt_09_top_and_rest", """
SELECT CASE WHEN n <= 10 THEN konto ELSE 'Övrigt' END AS konto, floor(sum(s) + 0.5) AS summa FROM (
  SELECT leverantor AS konto, sum(belopp) AS s, row_number() OVER (ORDER BY sum(belopp) DESC, leverantor) AS n FROM invoices GROUP BY 1) GROUP BY 1
""")
def top_and_rest(c: Civic) -> DataFrame:
    sums = c.invoices().groupBy(F.col("leverantor").alias("konto")).agg(F.sum("belopp").alias("summa"))
    return R.top_and_rest(sums, "konto", "summa", 10).select("konto", (S.half_up(F.col("summa")) * 1.0).alias("summa"))


@query("srt_10_absolute", "SELECT id, saldo FROM people ORDER BY abs(saldo - 4000) DESC NULLS LAST, id LIMIT 20")
def absolute(c: Civic) -> DataFrame:
    return c.people().orderBy(F.abs(F.col("saldo") - 4000).desc_nulls_last(), "id").limit(20).select("id", "saldo")
