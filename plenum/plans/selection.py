"""Projections, filters, scalar functions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions import semantics as S
from plenum.functions import text as X
from plenum.plans.registry import query
from plenum.sources.projection import Civic

# ---- projections ----------------------------------------------------------------------------------------------------------


@query("prj_01_full_name", "SELECT id, split_part(namn, '#', 1) || ' ' || split_part(namn, '#', 2) AS namn, parti FROM people")
def full_name(c: Civic) -> DataFrame:
    return c.people().select("id", F.concat(F.split_part("namn", F.lit("#"), F.lit(1)), F.lit(" "), F.split_part("namn", F.lit("#"), F.lit(2))).alias("namn"), "parti")


@query("prj_02_spread", "SELECT id, 'kf' AS typ, datum AS label, beslut, orsak, belopp FROM paragraphs")
def spread(c: Civic) -> DataFrame:
    """Attributes spread over a record: later keys override earlier ones (typ and label)."""
    return c.paragraphs().withColumns({"typ": F.lit("paragraf")}).withColumns({"typ": F.lit("kf"), "label": F.col("datum")}).select("id", "typ", "label", "beslut", "orsak", "belopp")


@query("prj_03_organ", "SELECT id, CASE WHEN id LIKE 'ks-%' THEN 'KS' ELSE 'KF' END AS organ FROM paragraphs")
def organ(c: Civic) -> DataFrame:
    return c.paragraphs().select("id", F.when(F.col("id").startswith("ks-"), "KS").otherwise("KF").alias("organ"))


@query("prj_04_paragraph_label", "SELECT id, CASE WHEN nr IS NOT NULL THEN '§ ' || nr END AS paragraf FROM paragraphs")
def paragraph_label(c: Civic) -> DataFrame:
    return c.paragraphs().select("id", F.when(F.col("nr").isNotNull(), F.concat(F.lit("§ "), F.col("nr").cast("string"))).alias("paragraf"))


@query("prj_05_has_roll_call", "SELECT id, EXISTS (SELECT 1 FROM votes v WHERE v.to_id = p.id) AS har_rost FROM paragraphs p")
def has_roll_call(c: Civic) -> DataFrame:
    voted = c.votes().select(F.col("to_id").alias("id")).distinct().withColumn("_v", F.lit(True))
    return c.paragraphs().select("id").join(voted, "id", "left").select("id", F.col("_v").isNotNull().alias("har_rost"))


def result_status(result, large: float):
    return F.when(result < large, "stort underskott").when(result < 0, "underskott").otherwise("i balans")


@query("prj_06_status", """
SELECT id, CASE WHEN saldo < -50 THEN 'stort underskott' WHEN saldo < 0 THEN 'underskott' ELSE 'i balans' END AS status,
       CASE WHEN saldo < -10 THEN 'stort underskott' WHEN saldo < 0 THEN 'underskott' ELSE 'i balans' END AS status_10 FROM people
""")
def status(c: Civic) -> DataFrame:
    return c.people().select("id", result_status(F.col("saldo"), -50).alias("status"), result_status(F.col("saldo"), -10).alias("status_10"))


BUCKETS = [("liten", "small|tiny|mini"), ("färgad", "red|blue|green"), ("mekanik", "gear|bolt|widget|ring")]


@query("prj_07_buckets", """
SELECT unnest(b) AS grupp, count(*) AS antal FROM (
  SELECT CASE WHEN len(x) = 0 THEN ['övrigt'] ELSE x END AS b FROM (
    SELECT list_filter([CASE WHEN regexp_matches(p_name, 'small|tiny|mini') THEN 'liten' END, CASE WHEN regexp_matches(p_name, 'red|blue|green') THEN 'färgad' END,
      CASE WHEN regexp_matches(p_name, 'gear|bolt|widget|ring') THEN 'mekanik' END], lambda e: e IS NOT NULL) AS x FROM part)) GROUP BY 1
""", plain=True)  # fmt: skip
def buckets(c: Civic) -> DataFrame:
    found = X.all_matches(F.col("p_name"), BUCKETS)
    found = F.when(F.size(found) == 0, F.array(F.lit("övrigt"))).otherwise(found)
    return c.table("part").select(F.explode(found).alias("grupp")).groupBy("grupp").agg(F.count("*").alias("antal"))


@query("prj_08_decision_label", """
SELECT id, CASE beslut WHEN 'bifall' THEN 'Bifallen' WHEN 'avslag' THEN 'Avslagen' WHEN 'bordläggning' THEN 'Bordlagd' ELSE 'Okänd' END AS status FROM paragraphs
""")
def decision_label(c: Civic) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in (("bifall", "Bifallen"), ("avslag", "Avslagen"), ("bordläggning", "Bordlagd")) for x in pair])
    return c.paragraphs().select("id", F.coalesce(F.try_element_at(names, F.col("beslut")), F.lit("Okänd")).alias("status"))


@query("prj_09_role_categories", """
SELECT from_id AS id, string_agg(DISTINCT k, ',' ORDER BY k) AS roller FROM (
  SELECT from_id, CASE WHEN to_id LIKE 'kf-%' THEN 'KF' WHEN to_id LIKE 'ks-%' THEN 'KS' WHEN to_id LIKE 'nämnd-%' THEN substr(to_id, 7) END AS k
  FROM edges WHERE to_id NOT LIKE 'möte-%') GROUP BY 1
""")
def role_categories(c: Civic) -> DataFrame:
    to = F.col("to_id")
    kind = F.when(to.startswith("kf-"), "KF").when(to.startswith("ks-"), "KS").when(to.startswith("nämnd-"), F.substr(to, F.lit(7)))
    kinds = c.edges().filter(~to.startswith("möte-")).select(F.col("from_id").alias("id"), kind.alias("k")).distinct()
    return kinds.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("roller"))


@query("prj_10_active_since", """
SELECT o_custkey AS kund, coalesce(CASE WHEN min(year(o_orderdate)) FILTER (WHERE o_orderstatus = 'F') IS NOT NULL THEN min(year(o_orderdate)) FILTER (WHERE o_orderstatus = 'F') END,
       min(year(o_orderdate)))::INT AS sedan FROM orders GROUP BY 1
""", plain=True)  # fmt: skip
def active_since(c: Civic) -> DataFrame:
    """The first mandate period's start, else the least year over roles."""
    year = F.year("o_orderdate")
    return c.table("orders").groupBy(F.col("o_custkey").alias("kund")).agg(F.coalesce(F.min(F.when(F.col("o_orderstatus") == "F", year)), F.min(year)).alias("sedan"))


@query("prj_11_utilisation", """
SELECT namnd, ar, CASE WHEN mnkr > 20 THEN floor(abs(-mnkr * 0.97) / (mnkr - 20) * 100 * 10 + 0.5) / 10 ELSE 0 END AS andel FROM grants
""")
def utilisation(c: Civic) -> DataFrame:
    whole = F.col("mnkr") - 20
    return c.grants().select("namnd", "ar", F.when(whole > 0, S.half_up(F.abs(-F.col("mnkr") * 0.97) / whole * 100, 1)).otherwise(F.lit(0.0)).alias("andel"))


@query("prj_13_publication", """
SELECT d.doc_id, CASE WHEN regexp_matches(d.text, '@example\\.') THEN NULL ELSE d.source END AS kalla
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON d.doc_id = t.doc_id WHERE t.doc_id IS NULL
""", plain=True)  # fmt: skip
def publication(c: Civic) -> DataFrame:
    """The publication boundary: withheld rows go, a private value is masked, before any public view."""
    withheld = c.table("labels").filter("toxic = 1").select("doc_id").distinct()
    return c.table("documents").join(withheld, "doc_id", "left_anti").select("doc_id", F.when(F.col("text").rlike(r"@example\."), None).otherwise(F.col("source")).alias("kalla"))


@query("prj_14_timeline", """
SELECT kund, string_agg(datum || ' ' || id, '; ' ORDER BY datum, id) AS tidslinje FROM (
  SELECT kund, datum, id, row_number() OVER (PARTITION BY kund ORDER BY datum, id) AS n FROM paragraphs WHERE beslut <> 'avslag') WHERE n <= 5 GROUP BY 1
""")
def timeline(c: Civic) -> DataFrame:
    """The first five events per case, as text. Keeping five per group before they are listed bounds the list."""
    from plenum.operators.relational import first_per

    first = first_per(c.paragraphs().filter("beslut != 'avslag'"), ["kund"], F.col("datum"), F.col("id"), take=5)
    listed = F.array_sort(F.collect_list(F.concat_ws(" ", "datum", "id")))
    return first.groupBy("kund").agg(F.array_join(listed, "; ").alias("tidslinje"))


# ---- filters --------------------------------------------------------------------------------------------------------------


@query("flt_01_equal", "SELECT id, namn FROM people WHERE parti = upper('p1')")
def equal(c: Civic) -> DataFrame:
    return c.people().filter(F.col("parti") == F.upper(F.lit("p1"))).select("id", "namn")


@query("flt_02_json_equal", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'", plain=True)
def json_equal(c: Civic) -> DataFrame:
    return c.table("events").filter(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("flt_03_year_prefix", "SELECT id, datum FROM paragraphs WHERE datum LIKE '1998-%'")
def year_prefix(c: Civic) -> DataFrame:
    return c.paragraphs().filter(F.col("datum").startswith("1998-")).select("id", "datum")


@query("flt_04_ilike", "SELECT id, label FROM paragraphs WHERE label ILIKE '%ÄRENDE 12%'")
def ilike(c: Civic) -> DataFrame:
    return c.paragraphs().filter(S.contains_ci(F.col("label"), "ÄRENDE 12")).select("id", "label")


def decisions_for(rows: DataFrame, body: str = "alla", date: str | None = None, year: str | None = None, text: str | None = None) -> DataFrame:
    """Optional predicates: the body, and of date, year and text the first that is given."""
    if body in ("ks", "kf"):
        rows = rows.filter(F.col("id").startswith("ks-") if body == "ks" else ~F.col("id").startswith("ks-"))
    if date:
        return rows.filter(F.col("datum") == date)
    if year:
        return rows.filter(F.col("datum").startswith(f"{year}-"))
    return rows.filter(S.contains_ci(F.col("label"), text)) if text else rows


@query("flt_05_optional", "SELECT id, datum, label FROM paragraphs WHERE id LIKE 'ks-%' AND datum LIKE '1997-%'")
def optional(c: Civic) -> DataFrame:
    return decisions_for(c.paragraphs(), "ks", year="1997", text="does not count").select("id", "datum", "label")


@query("flt_06_id_prefix", "SELECT id, typ FROM nodes WHERE id LIKE 'nämnd-nation_1%'")
def id_prefix(c: Civic) -> DataFrame:
    return c.nodes().filter(F.col("id").startswith("nämnd-nation_1")).select("id", "typ")


@query("flt_07_key_exists", "SELECT count(*) AS antal, count(*) FILTER (WHERE json_exists(props, '$.k')) AS med_nyckel FROM events", plain=True)
def key_exists(c: Civic) -> DataFrame:
    has = F.expr("try_variant_get(parse_json(props), '$.k', 'variant')").isNotNull()
    return c.table("events").agg(F.count("*").alias("antal"), F.count_if(has).alias("med_nyckel"))


@query("flt_08_any_of", "SELECT from_id, to_id, typ FROM edges WHERE from_id IN (SELECT id FROM people WHERE parti = 'P2') AND typ = 'ledamot_i'")
def any_of(c: Civic) -> DataFrame:
    ids = c.people().filter("parti = 'P2'").select(F.col("id").alias("from_id"))
    return c.edges().filter("typ = 'ledamot_i'").join(ids, "from_id", "left_semi").select("from_id", "to_id", "typ")


@query("flt_09_null_safe_flag", "SELECT id FROM paragraphs WHERE coalesce(nr % 2 = 0, false) <> true")
def null_safe_flag(c: Civic) -> DataFrame:
    return c.paragraphs().filter(F.coalesce(F.col("nr") % 2 == 0, F.lit(False)) != F.lit(True)).select("id")


@query("flt_10_in_not_like", "SELECT from_id, to_id, typ FROM edges WHERE typ IN ('ledamot_i', 'yrkat') AND label NOT LIKE 'Ersättare%'")
def in_not_like(c: Civic) -> DataFrame:
    return c.edges().filter(F.col("typ").isin("ledamot_i", "yrkat") & ~F.col("label").like("Ersättare%")).select("from_id", "to_id", "typ")


@query("flt_11_exists_in_array", "SELECT o_custkey AS kund, count(*) AS antal FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 400000) > 0", plain=True)
def exists_in_array(c: Civic) -> DataFrame:
    """EXISTS over a nested array, by a higher-order function."""
    cases = c.table("orders").groupBy(F.col("o_custkey").alias("kund")).agg(F.collect_list(F.struct("o_orderstatus", "o_totalprice")).alias("arenden"))
    hit = F.exists("arenden", lambda a: (a["o_orderstatus"] == "O") & (a["o_totalprice"] > 400000))
    return cases.filter(hit).select("kund", F.size("arenden").cast("long").alias("antal"))


@query("flt_12_speech_filters", "SELECT key, talare FROM speeches WHERE lower(talare) LIKE '%user%' AND arende = '7' AND langd > 50")
def speech_filters(c: Civic) -> DataFrame:
    return c.speeches().filter(F.contains(F.lower("talare"), F.lit("user")) & (F.col("arende") == "7") & (F.col("langd") > 50)).select("key", "talare")


@query("flt_13_guards", "SELECT id FROM paragraphs WHERE length(label) > 3 AND nr BETWEEN 1 AND 200 AND belopp >= 1000")
def guards(c: Civic) -> DataFrame:
    return c.paragraphs().filter((F.length("label") > 3) & F.col("nr").between(1, 200) & (F.col("belopp") >= 1000)).select("id")


@query("flt_15_column_filters", "SELECT id, namn, parti FROM people WHERE contains(lower(namn), '00') AND contains(lower(parti), 'p3')")
def column_filters(c: Civic) -> DataFrame:
    from plenum.operators.relational import matching

    return matching(c.people(), {"namn": "00", "parti": "P3", "namnd": ""}).select("id", "namn", "parti")


@query("flt_16_facets", "SELECT id, namn FROM people WHERE parti = 'P1' AND namnd IN ('nämnd-nation_1', 'nämnd-nation_6') AND contains(lower(namn), 'supplier')")
def facets(c: Civic) -> DataFrame:
    wanted = F.array(F.lit("nämnd-nation_1"), F.lit("nämnd-nation_6"))
    return c.people().filter((F.col("parti") == "P1") & F.array_contains(wanted, F.col("namnd")) & F.contains(F.lower("namn"), F.lit("supplier"))).select("id", "namn")


# ---- scalar functions -----------------------------------------------------------------------------------------------------


@query("scl_01_json_text", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.saknas') AS saknas FROM events", plain=True)
def json_text(c: Civic) -> DataFrame:
    return c.table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.saknas").alias("saknas"))


@query("scl_02_json_casts", "SELECT event_id, json_extract(props, '$.k')::INT AS k, json_extract(props, '$.k')::DOUBLE / 4 AS kvart FROM events", plain=True)
def json_casts(c: Civic) -> DataFrame:
    v = F.parse_json("props")
    return c.table("events").select("event_id", F.variant_get(v, "$.k", "int").alias("k"), (F.variant_get(v, "$.k", "double") / 4).alias("kvart"))


@query("scl_03_unnest", "SELECT w AS ord, count(*) AS antal FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1", plain=True)
def unnest(c: Civic) -> DataFrame:
    return c.table("part").select(F.explode(F.split("p_name", " ")).alias("ord")).groupBy("ord").agg(F.count("*").alias("antal"))


@query("scl_04_coalesce", "SELECT id, coalesce(nr::VARCHAR, orsak, '') AS nyckel FROM paragraphs")
def coalesced(c: Civic) -> DataFrame:
    return c.paragraphs().select("id", F.coalesce(F.col("nr").cast("string"), "orsak", F.lit("")).alias("nyckel"))


@query("scl_05_case", "SELECT id, CASE WHEN beslut = 'bifall' THEN 1 WHEN beslut = 'avslag' THEN 2 ELSE 9 END AS rang FROM paragraphs")
def case(c: Civic) -> DataFrame:
    return c.paragraphs().select("id", F.when(F.col("beslut") == "bifall", 1).when(F.col("beslut") == "avslag", 2).otherwise(9).alias("rang"))


@query("scl_06_substring", "SELECT substr(datum, 1, 4) AS ar, count(*) AS antal FROM paragraphs GROUP BY 1")
def substring(c: Civic) -> DataFrame:
    return c.paragraphs().groupBy(F.substring("datum", 1, 4).alias("ar")).agg(F.count("*").alias("antal"))


@query("scl_07_length", "SELECT doc_id, length(text)::INT AS langd FROM documents", plain=True)
def length(c: Civic) -> DataFrame:
    return c.table("documents").select("doc_id", F.length("text").alias("langd"))


@query("scl_08_strings", "SELECT id, replace(namn, '#', '-') AS a, lpad(substr(namn, -3), 6, '0') AS b, upper(parti) || '/' || namnd AS c FROM people")
def strings(c: Civic) -> DataFrame:
    return c.people().select(
        "id", F.replace("namn", F.lit("#"), F.lit("-")).alias("a"), F.lpad(F.right("namn", F.lit(3)), 6, "0").alias("b"), F.concat(F.upper("parti"), F.lit("/"), F.col("namnd")).alias("c")
    )


@query("scl_09_without_bracket", "SELECT id, regexp_replace(label, '\\s*\\([^)]+\\)$', '') AS rubrik FROM paragraphs")
def without_bracket(c: Civic) -> DataFrame:
    return c.paragraphs().select("id", X.without_bracket(F.col("label")).alias("rubrik"))


@query("scl_10_speaker", "SELECT id, CASE WHEN regexp_matches(label, '^(.+?)\\s*\\(') THEN regexp_extract(label, '^(.+?)\\s*\\(', 1) ELSE label END AS talare FROM nodes")
def speaker(c: Civic) -> DataFrame:
    return c.nodes().select("id", X.speaker(F.col("label")).alias("talare"))


@query("scl_11_slugs", """
SELECT id, regexp_replace(regexp_replace(lower(label), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS unicode,
       regexp_replace(regexp_replace(translate(lower(label), 'åäöéü', 'aaoeu'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS ascii,
       regexp_replace(regexp_replace(lower(label), '[^a-zåäö0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS svensk,
       regexp_replace(regexp_replace(regexp_replace(lower(label), '[^a-zåäö0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g') AS tat
FROM nodes
""")
def slugs(c: Civic) -> DataFrame:
    label = F.col("label")
    return c.nodes().select("id", X.slug(label).alias("unicode"), X.slug_ascii(label).alias("ascii"), X.slug(label, "a-zåäö0-9").alias("svensk"), X.slug_compact(label).alias("tat"))


@query("scl_12_company", """
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(' ' || lower(namn || ' AB') || ' ', '[.,/&()''"-]', ' ', 'g'), ' (ab|hb|kb) ', ' ', 'g'), '\\s+', ' ', 'g')) AS bolag FROM people
""")
def company(c: Civic) -> DataFrame:
    return c.people().select("id", X.company(F.concat("namn", F.lit(" AB"))).alias("bolag"))


@query("scl_13_organisation", "SELECT id, regexp_replace(lower(regexp_replace(label, '^Stadens ', '')) || ' nämnden', '^nämnd för ', 'nämnden för ') AS organisation FROM nodes WHERE typ = 'organisation'")
def organisation(c: Civic) -> DataFrame:
    rows = c.nodes().filter("typ = 'organisation'")
    return rows.select("id", X.organisation(F.concat(F.lit("Stadens "), "label", F.lit(" \n Nämnd")), "Stadens").alias("organisation"))


@query("scl_14_plain", "SELECT id, trim(regexp_replace(lower(label), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm FROM nodes")
def plain(c: Civic) -> DataFrame:
    return c.nodes().select("id", X.plain(F.col("label")).alias("norm"))


@query("scl_16_number", """
SELECT id, coalesce(TRY_CAST(replace(regexp_replace(t, '\\s', '', 'g'), ',', '.') AS DOUBLE), 0) AS tal FROM (
  SELECT id, CASE WHEN belopp > 400000 THEN 'okänt' ELSE (floor(belopp / 1000)::BIGINT)::VARCHAR || ' ' || lpad((floor(belopp)::BIGINT % 1000)::VARCHAR, 3, '0') || ',5' END AS t FROM paragraphs)
""")
def number(c: Civic) -> DataFrame:
    whole = F.floor("belopp")
    written = F.concat(F.floor(F.col("belopp") / 1000).cast("string"), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(",5"))
    return c.paragraphs().select("id", X.number(F.when(F.col("belopp") > 400000, "okänt").otherwise(written)).alias("tal"))


MONTH_LIST = "['januari','februari','mars','april','maj','juni','juli','augusti','september','oktober','november','december']"


@query("scl_17_months", f"""
SELECT id, ar || '-' || lpad(list_position({MONTH_LIST}, namn)::VARCHAR, 2, '0') || '-' || lpad(dag, 2, '0') AS datum FROM (
  SELECT id, substr(datum, 1, 4) AS ar, {MONTH_LIST}[substr(datum, 6, 2)::INT] AS namn, (substr(datum, 9, 2)::INT)::VARCHAR AS dag FROM paragraphs)
""")
def months(c: Civic) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, X.MONTHS)), F.substring("datum", 6, 2).cast("int"))
    return c.paragraphs().select("id", X.dated(F.substring("datum", 9, 2).cast("int"), F.initcap(name), F.substring("datum", 1, 4)).alias("datum"))


@query("scl_18_stable_id", """
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3)
       || '-' || substr(h, 21, 12) AS uuid FROM (SELECT id, sha1(namn || parti) AS h FROM people)
""")
def stable_id(c: Civic) -> DataFrame:
    return c.people().select("id", X.stable_id(F.concat("namn", "parti")).alias("uuid"))


@query("scl_19_rounding", """
SELECT id, floor(saldo + 0.5) AS r0, floor(saldo * 10 + 0.5) / 10 AS r1, floor(saldo / 7 * 100 + 0.5) / 100 AS r2 FROM people
""")
def rounding(c: Civic) -> DataFrame:
    x = F.col("saldo")
    return c.people().select("id", (S.half_up(x, 0) * 1.0).alias("r0"), S.half_up(x, 1).alias("r1"), S.half_up(x / 7, 2).alias("r2"))


@query("scl_20_units", "SELECT id, floor(belopp / 1000 + 0.5) AS tkr, floor(belopp / 1e6 * 10 + 0.5) / 10 AS mnkr FROM paragraphs")
def units(c: Civic) -> DataFrame:
    return c.paragraphs().select("id", (S.half_up(F.col("belopp") / 1000) * 1.0).alias("tkr"), S.half_up(F.col("belopp") / 1e6, 1).alias("mnkr"))


@query("scl_21_deviation", "SELECT id, CASE WHEN saldo <> 0 THEN floor((1000 - saldo) / abs(saldo) * 100 * 10 + 0.5) / 10 ELSE 0 END AS avvikelse FROM people")
def deviation(c: Civic) -> DataFrame:
    b = F.col("saldo")
    return c.people().select("id", F.when(b != 0, S.half_up((1000 - b) / F.abs(b) * 100, 1)).otherwise(F.lit(0.0)).alias("avvikelse"))


@query("scl_22_excerpt", """
SELECT doc_id, CASE WHEN s > 1 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, s::INT, (e - s)::INT), '\\s+', ' ', 'g')) || CASE WHEN e <= length(text) THEN '…' ELSE '' END AS utdrag FROM (
  SELECT doc_id, text, greatest(a - 60, 1) AS s, least(a + 4 + 100, length(text) + 1) AS e FROM (SELECT doc_id, text, strpos(text, ' the') AS a FROM documents) WHERE a > 0)
""", plain=True)  # fmt: skip
def excerpts(c: Civic) -> DataFrame:
    rows = c.table("documents").withColumn("at", F.instr("text", " the")).filter("at > 0")
    return rows.select("doc_id", X.excerpt(F.col("text"), F.col("at"), F.lit(4)).alias("utdrag"))


KINDS = [("avslag", "MACHINERY|HOUSEHOLD"), ("bygg", "BUILDING"), ("fordon", "AUTO")]


@query("scl_23_classifier", "SELECT c_custkey, CASE WHEN c_mktsegment LIKE '%MACHINERY%' OR c_mktsegment LIKE '%HOUSEHOLD%' THEN 'avslag' WHEN c_mktsegment LIKE '%BUILDING%' THEN 'bygg' WHEN c_mktsegment LIKE '%AUTO%' THEN 'fordon' ELSE 'övrigt' END AS typ FROM customer", plain=True)
def classifier(c: Civic) -> DataFrame:
    return c.table("customer").select("c_custkey", X.first_match(F.col("c_mktsegment"), KINDS, "övrigt").alias("typ"))


@query("scl_24_tagger", """
SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(p_name, 'small|tiny|mini') THEN 'liten' END, CASE WHEN regexp_matches(p_name, 'red|blue|green') THEN 'färgad' END,
       CASE WHEN regexp_matches(p_name, 'gear|bolt|widget|ring') THEN 'mekanik' END) AS taggar FROM part
""", plain=True)  # fmt: skip
def tagger(c: Civic) -> DataFrame:
    return c.table("part").select("p_partkey", F.array_join(X.all_matches(F.col("p_name"), BUCKETS), ",").alias("taggar"))


@query("scl_25_party_code", "SELECT id, CASE parti WHEN 'P0' THEN 'S' WHEN 'P1' THEN 'M' ELSE coalesce(nullif(parti, ''), '-') END AS kod FROM people")
def party_code(c: Civic) -> DataFrame:
    codes = F.create_map(F.lit("P0"), F.lit("S"), F.lit("P1"), F.lit("M"))
    return c.people().select("id", F.coalesce(F.try_element_at(codes, F.col("parti")), F.nullif("parti", F.lit("")), F.lit("-")).alias("kod"))


@query("scl_26_percent_label", "SELECT id, CASE WHEN saldo > 0 THEN '+' ELSE '' END || (floor(saldo / 100 + 0.5)::BIGINT)::VARCHAR || ' %' AS etikett FROM people")
def percent_label(c: Civic) -> DataFrame:
    return c.people().select("id", F.concat(F.when(F.col("saldo") > 0, "+").otherwise(""), F.floor(F.col("saldo") / 100 + 0.5).cast("string"), F.lit(" %")).alias("etikett"))


@query("scl_27_url", "SELECT id, replace(url_encode('§ ' || id), '%20', '+') AS kodad, url_decode(url_encode(label)) AS avkodad FROM nodes")
def url(c: Civic) -> DataFrame:
    return c.nodes().select("id", F.url_encode(F.concat(F.lit("§ "), "id")).alias("kodad"), F.url_decode(F.url_encode("label")).alias("avkodad"))


@query("scl_29_clamp", "SELECT id, greatest(0.0, least(100.0, saldo / 50)) AS andel FROM people")
def clamp(c: Civic) -> DataFrame:
    return c.people().select("id", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("saldo") / 50)).alias("andel"))


@query("scl_30_nice_axis", "SELECT id, ceil(belopp / pow(10, floor(log10(belopp)))) * pow(10, floor(log10(belopp))) AS axel FROM paragraphs WHERE belopp > 0")
def nice_axis(c: Civic) -> DataFrame:
    step = F.pow(F.lit(10.0), F.floor(F.log10("belopp")))
    return c.paragraphs().filter("belopp > 0").select("id", (F.ceil(F.col("belopp") / step) * step).alias("axel"))


@query("scl_31_min_max", "SELECT id, floor((saldo - min(saldo) OVER ()) / (max(saldo) OVER () - min(saldo) OVER ()) * 1e4 + 0.5) / 1e4 AS skala FROM people")
def min_max(c: Civic) -> DataFrame:
    """The extremes are one row, joined; a window over everything would be one task."""
    ends = c.people().agg(F.min("saldo").alias("a"), F.max("saldo").alias("b"))
    return c.people().crossJoin(F.broadcast(ends)).select("id", S.half_up((F.col("saldo") - F.col("a")) / (F.col("b") - F.col("a")), 4).alias("skala"))


@query("scl_32_divergence", """
SELECT id, d, CASE WHEN d > 10 THEN 'hög' WHEN d > 5 THEN 'förhöjd' WHEN d < -5 THEN 'låg' ELSE 'normal' END AS klass FROM (SELECT id, floor((saldo / 500 - 8) * 10 + 0.5) / 10 AS d FROM people)
""")
def divergence(c: Civic) -> DataFrame:
    d = F.col("d")
    rows = c.people().select("id", S.half_up(F.col("saldo") / 500 - 8, 1).alias("d"))
    return rows.withColumn("klass", F.when(d > 10, "hög").when(d > 5, "förhöjd").when(d < -5, "låg").otherwise("normal"))


@query("scl_33_array_maintenance", """
SELECT kund, string_agg(DISTINCT p, ',' ORDER BY p) AS perioder FROM (
  SELECT o_custkey AS kund, year(o_orderdate)::VARCHAR AS p FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT o_custkey, '2026' FROM orders WHERE o_orderstatus = 'F') GROUP BY 1
""", plain=True)  # fmt: skip
def array_maintenance(c: Civic) -> DataFrame:
    """A missing current period is appended only where there is a history; periods stay sorted."""
    history = c.table("orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("kund")).agg(F.collect_set(F.year("o_orderdate").cast("string")).alias("p"))
    with_now = F.when((F.size("p") > 0) & ~F.array_contains("p", F.lit("2026")), F.array_append("p", F.lit("2026"))).otherwise(F.col("p"))
    return history.select("kund", F.array_join(F.array_sort(with_now), ",").alias("perioder"))
