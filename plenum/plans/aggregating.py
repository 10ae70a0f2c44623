"""Aggregations and ordered (window) computations."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import semantics as S
from plenum.functions import text as X
from plenum.operators import relational as R
from plenum.plans.registry import query
from plenum.sources.projection import Civic


@query("agg_01_counts", "SELECT count(*) AS antal, count(*) FILTER (WHERE beslut = 'bifall') AS bifall, count(*) FILTER (WHERE id LIKE 'ks-%') AS ks FROM paragraphs")
def counts(c: Civic) -> DataFrame:
    return c.paragraphs().agg(F.count("*").alias("antal"), F.count_if(F.col("beslut") == "bifall").alias("bifall"), F.count_if(F.col("id").startswith("ks-")).alias("ks"))


@query("agg_02_distinct", "SELECT count(DISTINCT to_id) AS arenden, count(DISTINCT from_id) AS personer FROM votes")
def distinct(c: Civic) -> DataFrame:
    return c.votes().agg(F.count_distinct("to_id").alias("arenden"), F.count_distinct("from_id").alias("personer"))


@query("agg_03_by_type", "SELECT typ, count(*) AS antal FROM nodes GROUP BY 1")
def by_type(c: Civic) -> DataFrame:
    return c.nodes().groupBy("typ").agg(F.count("*").alias("antal"))


@query("agg_04_by_attribute", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS antal FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1", plain=True)
def by_attribute(c: Civic) -> DataFrame:
    return c.table("events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("antal")).filter("k is not null")


@query("agg_05_pivot", """
SELECT parti, count(*) FILTER (WHERE rost = 'ja') AS ja, count(*) FILTER (WHERE rost = 'nej') AS nej, count(*) FILTER (WHERE rost = 'avstår') AS avstar, count(*) AS totalt,
       floor(100.0 * count(*) FILTER (WHERE rost = 'ja') / count(*) + 0.5) AS procent FROM party_votes GROUP BY 1
""")
def pivot(c: Civic) -> DataFrame:
    n = {k: F.count_if(F.col("rost") == v) for k, v in (("ja", "ja"), ("nej", "nej"), ("avstar", "avstår"))}
    return c.party_votes().groupBy("parti").agg(*[v.alias(k) for k, v in n.items()], F.count("*").alias("totalt"), (S.half_up(100.0 * n["ja"] / F.count("*")) * 1.0).alias("procent"))


@query("agg_06_having", "SELECT to_id, count(*) FILTER (WHERE rost = 'ja') AS ja, count(*) FILTER (WHERE rost = 'nej') AS nej FROM votes GROUP BY 1 HAVING count(*) FILTER (WHERE rost IN ('ja', 'nej')) >= 5")
def having(c: Civic) -> DataFrame:
    sums = c.votes().groupBy("to_id").agg(F.count_if(F.col("rost") == "ja").alias("ja"), F.count_if(F.col("rost") == "nej").alias("nej"))
    return sums.filter(F.col("ja") + F.col("nej") >= 5)


@query("agg_07_mixed", """
SELECT from_id, count(DISTINCT CASE WHEN typ = 'närvarade' THEN to_id END) AS moten, count(*) FILTER (WHERE typ = 'talade_i') AS inlagg,
       count(*) FILTER (WHERE typ IN ('yrkat', 'inlämnade_motion')) AS initiativ FROM acts GROUP BY 1
""")
def mixed(c: Civic) -> DataFrame:
    typ = F.col("typ")
    return c.acts().groupBy("from_id").agg(
        F.count_distinct(F.when(typ == "närvarade", F.col("to_id"))).alias("moten"), F.count_if(typ == "talade_i").alias("inlagg"), F.count_if(typ.isin("yrkat", "inlämnade_motion")).alias("initiativ")
    )


@query("agg_08_by_year", "SELECT substr(datum, 1, 4) AS ar, count(*) AS antal, count(DISTINCT datum) AS dagar FROM paragraphs GROUP BY 1")
def by_year(c: Civic) -> DataFrame:
    return c.paragraphs().groupBy(F.substring("datum", 1, 4).alias("ar")).agg(F.count("*").alias("antal"), F.count_distinct("datum").alias("dagar"))


@query("agg_10_agreement_ratio", """
SELECT v.from_id, count(*) AS antal, floor(avg(CASE WHEN (v.rost = 'ja') = (p.beslut = 'bifall') THEN 1.0 ELSE 0 END) * 100 + 0.5) AS procent
FROM votes v JOIN paragraphs p ON v.to_id = p.id WHERE v.rost IN ('ja', 'nej') GROUP BY 1 HAVING count(*) >= 5
""")
def agreement_ratio(c: Civic) -> DataFrame:
    rows = c.votes().filter(F.col("rost").isin("ja", "nej")).join(c.paragraphs().select(F.col("id").alias("to_id"), "beslut"), "to_id")
    same = F.when((F.col("rost") == "ja") == (F.col("beslut") == "bifall"), 1.0).otherwise(0.0)
    return rows.groupBy("from_id").agg(F.count("*").alias("antal"), (S.half_up(F.avg(same) * 100) * 1.0).alias("procent")).filter("antal >= 5")


@query("agg_11_upper_median", "SELECT talare, arende, (list(langd ORDER BY langd))[(count(*) // 2 + 1)::INT] AS median FROM speeches GROUP BY 1, 2")
def upper_median(c: Civic) -> DataFrame:
    return c.speeches().groupBy("talare", "arende").agg(S.upper_median(F.col("langd")).alias("median"))


@query("agg_12_gini", """
SELECT typ, CASE WHEN count(*) <= 1 OR sum(n) = 0 THEN 0 ELSE floor((2 * sum(r * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)) * 100 + 0.5) / 100 END AS gini
FROM (SELECT typ, n, row_number() OVER (PARTITION BY typ ORDER BY n, from_id) AS r FROM (SELECT typ, from_id, count(*) AS n FROM acts GROUP BY 1, 2)) GROUP BY 1
""")
def gini(c: Civic) -> DataFrame:
    per = c.acts().groupBy("typ", "from_id").agg(F.count("*").alias("value"))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("typ").orderBy("value", "from_id")))
    return ranked.groupBy("typ").agg(S.gini().alias("gini"))


@query("agg_13_grains", """
SELECT CASE WHEN GROUPING(konto) = 0 THEN 'namnd-ar-konto' WHEN GROUPING(manad) = 0 THEN 'namnd-ar-manad' ELSE 'namnd-ar' END AS niva, namnd, ar, konto, manad, count(*) AS antal, floor(sum(belopp) + 0.5) AS summa
FROM invoices GROUP BY GROUPING SETS ((namnd, ar), (namnd, ar, konto), (namnd, ar, manad))
""")
def grains(c: Civic) -> DataFrame:
    """Three grains in one pass."""
    keys = [F.col(k) for k in ("namnd", "ar", "konto", "manad")]
    sets = [[keys[0], keys[1]], [keys[0], keys[1], keys[2]], [keys[0], keys[1], keys[3]]]
    grain = F.when(F.grouping("konto") == 0, "namnd-ar-konto").when(F.grouping("manad") == 0, "namnd-ar-manad").otherwise("namnd-ar")
    out = c.invoices().groupingSets(sets, *keys).agg(grain.alias("niva"), F.count("*").alias("antal"), (S.half_up(F.sum("belopp")) * 1.0).alias("summa"))
    return out.select("niva", "namnd", "ar", "konto", "manad", "antal", "summa")


@query("agg_14_largest_per_name", "SELECT lower(p_type) AS namn, max(p_retailprice) AS belopp, arg_max(p_name, (p_retailprice, -p_partkey)) AS post FROM part GROUP BY 1", plain=True)
def largest_per_name(c: Civic) -> DataFrame:
    key = F.struct("p_retailprice", -F.col("p_partkey"))
    return c.table("part").groupBy(F.lower("p_type").alias("namn")).agg(F.max("p_retailprice").alias("belopp"), F.max_by("p_name", key).alias("post"))


@query("agg_15_first_and_last", """
SELECT a.user_id, a.event_id AS forsta, b.event_id AS sista FROM (SELECT user_id, min((ts, event_id)) AS k, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1) a
JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1) b ON a.user_id = b.user_id
""", plain=True)
def first_and_last(c: Civic) -> DataFrame:
    """First-writer-wins and last-writer-wins in one aggregation."""
    order = F.struct("ts", "event_id")
    return c.table("events").groupBy("user_id").agg(F.min_by("event_id", order).alias("forsta"), F.max_by("event_id", order).alias("sista"))


@query("agg_16_interval_labels", """
SELECT from_id, to_id, string_agg(DISTINCT arende::VARCHAR, ', ' ORDER BY arende::VARCHAR) AS tider FROM acts WHERE typ = 'närvarade' GROUP BY 1, 2
""")
def interval_labels(c: Civic) -> DataFrame:
    """Distinct labels per meeting and person; a day's labels are few."""
    rows = c.acts().filter("typ = 'närvarade'").groupBy("from_id", "to_id")
    return rows.agg(F.array_join(F.array_sort(F.collect_set(F.col("arende").cast("string"))), ", ").alias("tider"))


@query("agg_17_share", "SELECT namnd, ar, floor(mnkr / sum(mnkr) OVER (PARTITION BY ar) * 100 * 10 + 0.5) / 10 AS andel FROM grants")
def share(c: Civic) -> DataFrame:
    """Totals per year are joined back: few rows, where a window would hold a year in one task."""
    grants = c.grants()
    totals = grants.groupBy("ar").agg(F.sum("mnkr").alias("totalt"))
    return grants.join(totals, "ar").select("namnd", "ar", S.half_up(F.col("mnkr") / F.col("totalt") * 100, 1).alias("andel"))


@query("agg_18_surplus_lists", """
SELECT parti, count(*) FILTER (WHERE saldo < 0) AS underskott, count(*) FILTER (WHERE saldo >= 0) AS overskott, floor(sum(saldo) + 0.5) AS summa,
       string_agg(CASE WHEN saldo < 0 THEN id END, ',' ORDER BY id) AS lista FROM people GROUP BY 1
""")
def surplus_lists(c: Civic) -> DataFrame:
    low = F.when(F.col("saldo") < 0, F.col("id"))
    listed = F.array_sort(F.collect_list(low))
    return c.people().groupBy("parti").agg(
        F.count_if(F.col("saldo") < 0).alias("underskott"), F.count_if(F.col("saldo") >= 0).alias("overskott"), (S.half_up(F.sum("saldo")) * 1.0).alias("summa"),
        F.when(F.count(low) > 0, F.array_join(listed, ",")).alias("lista"),
    )


@query("agg_19_by_party_size", "SELECT id, parti, dense_rank() OVER (ORDER BY n DESC, parti) AS plats FROM (SELECT id, parti, count(*) OVER (PARTITION BY parti) AS n FROM people)")
def by_party_size(c: Civic) -> DataFrame:
    """Members ordered by their party's size: the few parties are ranked, and joined back."""
    sizes = c.people().groupBy("parti").agg(F.count("*").alias("n"))
    ranked = sizes.select("parti", F.row_number().over(Window.orderBy(F.col("n").desc(), "parti")).cast("long").alias("plats"))
    return c.people().join(ranked, "parti").select("id", "parti", "plats")


@query("agg_20_children", "SELECT namnd, count(*) AS antal, string_agg(namn, '|' ORDER BY namn) AS medlemmar FROM people GROUP BY 1")
def children(c: Civic) -> DataFrame:
    return c.people().groupBy("namnd").agg(F.count("*").alias("antal"), F.array_join(F.array_sort(F.collect_list("namn")), "|").alias("medlemmar"))


@query("agg_21_aliases", "SELECT namnd AS id, string_agg(id, ',' ORDER BY id) AS alias FROM people WHERE saldo < 3000 GROUP BY 1")
def aliases(c: Civic) -> DataFrame:
    return c.people().filter("saldo < 3000").groupBy(F.col("namnd").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("alias"))


@query("agg_22_date_ends", "SELECT orsak, min(datum) AS forsta, max(datum) AS sista, count(DISTINCT datum) AS dagar FROM paragraphs GROUP BY 1")
def date_ends(c: Civic) -> DataFrame:
    return c.paragraphs().groupBy("orsak").agg(F.min("datum").alias("forsta"), F.max("datum").alias("sista"), F.count_distinct("datum").alias("dagar"))


@query("agg_23_distinct_values", "SELECT DISTINCT orsak, beslut FROM paragraphs")
def distinct_values(c: Civic) -> DataFrame:
    return c.paragraphs().select("orsak", "beslut").distinct()


@query("agg_24_diagnostics", """
SELECT CASE WHEN n <= 25 THEN datum ELSE 'övriga' END AS nyckel, sum(k)::BIGINT AS antal, min(ex) AS exempel FROM (
  SELECT datum, count(*) AS k, min(id) AS ex, row_number() OVER (ORDER BY count(*) DESC, datum) AS n FROM paragraphs GROUP BY 1) GROUP BY 1
""")
def diagnostics(c: Civic) -> DataFrame:
    """The 25 most frequent keys with an example, and the remainder as one row: a report."""
    groups = c.paragraphs().groupBy("datum").agg(F.count("*").alias("k"), F.min("id").alias("ex"))
    top = groups.orderBy(F.col("k").desc(), "datum").limit(25).select("datum").withColumn("topp", F.lit(True))
    key = F.when(F.col("topp"), F.col("datum")).otherwise(F.lit("övriga"))
    return groups.join(top, "datum", "left").groupBy(key.alias("nyckel")).agg(F.sum("k").alias("antal"), F.min("ex").alias("exempel"))


@query("agg_25_stacked", "SELECT namnd, ar, floor(sum(mnkr) OVER (PARTITION BY ar ORDER BY namnd) * 100 + 0.5) / 100 AS staplat FROM grants")
def stacked(c: Civic) -> DataFrame:
    order = Window.partitionBy("ar").orderBy("namnd").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.grants().select("namnd", "ar", S.half_up(F.sum("mnkr").over(order), 2).alias("staplat"))


@query("agg_26_proportions", "SELECT beslut, count(*) AS antal, floor(100.0 * count(*) / greatest(sum(count(*)) OVER (), 1) * 10 + 0.5) / 10 AS andel FROM paragraphs GROUP BY 1")
def proportions(c: Civic) -> DataFrame:
    groups = c.paragraphs().groupBy("beslut").agg(F.count("*").alias("antal"))
    return groups.select("beslut", "antal", S.share_of_total(F.col("antal"), Window.partitionBy()).alias("andel"))


@query("agg_27_accumulated_roles", """
SELECT user_id, arg_min(event_type, (ts, event_id)) AS forsta, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE event_type <> 'error') AS roller FROM events GROUP BY 1
""", plain=True)
def accumulated_roles(c: Civic) -> DataFrame:
    roles = F.array_sort(F.collect_set(F.when(F.col("event_type") != "error", F.col("event_type"))))
    return c.table("events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("forsta"), F.array_join(roles, ",").alias("roller"))


@query("agg_09_mean_of_ratios", """
SELECT parti, floor(avg(abs(ja - nej) / (ja + nej)) * 100 + 0.5) / 100 AS snitt FROM (
  SELECT parti, to_id, count(*) FILTER (WHERE rost = 'ja')::DOUBLE AS ja, count(*) FILTER (WHERE rost = 'nej') AS nej FROM party_votes GROUP BY 1, 2) WHERE ja + nej > 0 GROUP BY 1
""")
def mean_of_ratios(c: Civic) -> DataFrame:
    per = c.party_votes().groupBy("parti", "to_id").agg(F.count_if(F.col("rost") == "ja").alias("ja"), F.count_if(F.col("rost") == "nej").alias("nej")).filter("ja + nej > 0")
    return per.groupBy("parti").agg(S.half_up(F.avg(F.abs(F.col("ja") - F.col("nej")) / (F.col("ja") + F.col("nej"))), 2).alias("snitt"))


# ---- windows --------------------------------------------------------------------------------------------------------------


@query("win_01_distinct_on", "SELECT DISTINCT ON (namnd) namnd, id, saldo FROM people ORDER BY namnd, saldo DESC, id LIMIT 80")
def distinct_on(c: Civic) -> DataFrame:
    return R.first_per(c.people(), ["namnd"], F.col("saldo").desc(), F.col("id")).orderBy("namnd").limit(80).select("namnd", "id", "saldo")


@query("win_02_mid_rank", """
SELECT from_id, n, floor((below + equal / 2.0) / total * 100 + 0.5) AS percentil FROM (SELECT from_id, n, count(*) OVER (PARTITION BY n) AS equal, count(*) OVER () AS total,
  rank() OVER (ORDER BY n) - 1 AS below FROM (SELECT from_id, count(*) AS n FROM acts WHERE typ = 'talade_i' GROUP BY 1))
""")
def mid_rank(c: Civic) -> DataFrame:
    per = c.acts().filter("typ = 'talade_i'").groupBy("from_id").agg(F.count("*").alias("n"))
    return per.withColumn("m", S.mid_rank("n")).select("from_id", "n", (S.half_up(F.col("m") * 100) * 1.0).alias("percentil"))


@query("win_03_top_k", """
SELECT namnd, ar, leverantor, floor(s + 0.5) AS summa FROM (SELECT namnd, ar, leverantor, sum(belopp) AS s, row_number() OVER (PARTITION BY namnd, ar ORDER BY sum(belopp) DESC, leverantor) AS n
  FROM invoices GROUP BY 1, 2, 3) WHERE n <= 3
""")
def top_k(c: Civic) -> DataFrame:
    sums = c.invoices().groupBy("namnd", "ar", "leverantor").agg(F.sum("belopp").alias("s"))
    return R.first_per(sums, ["namnd", "ar"], F.col("s").desc(), F.col("leverantor"), take=3).select("namnd", "ar", "leverantor", (S.half_up(F.col("s")) * 1.0).alias("summa"))


@query("win_04_first_last_change", """
SELECT namnd, CASE WHEN count(mnkr) >= 2 AND arg_min(mnkr, ar) <> 0 THEN floor((arg_max(mnkr, ar) - arg_min(mnkr, ar)) / abs(arg_min(mnkr, ar)) * 100 * 10 + 0.5) / 10 END AS andring FROM grants GROUP BY 1
""")
def first_last_change(c: Civic) -> DataFrame:
    rows = c.grants().filter("mnkr is not null").groupBy("namnd").agg(F.count("*").alias("n"), F.min_by("mnkr", "ar").alias("a"), F.max_by("mnkr", "ar").alias("b"))
    return rows.select("namnd", F.when((F.col("n") >= 2) & (F.col("a") != 0), S.half_up((F.col("b") - F.col("a")) / F.abs("a") * 100, 1)).alias("andring"))


@query("win_05_year_over_year", "SELECT namnd, ar, floor((mnkr - lag(mnkr) OVER w) / lag(mnkr) OVER w * 100 * 10 + 0.5) / 10 AS andring FROM grants WHERE ar < 2000 WINDOW w AS (PARTITION BY namnd ORDER BY ar)")
def year_over_year(c: Civic) -> DataFrame:
    before = F.lag("mnkr").over(Window.partitionBy("namnd").orderBy("ar"))
    return c.grants().filter("ar < 2000").select("namnd", "ar", S.half_up((F.col("mnkr") - before) / before * 100, 1).alias("andring"))


@query("win_06_deflated", """
SELECT g.namnd, floor((g.b / (i.b / i.a) / g.a - 1) * 100 * 10 + 0.5) / 10 AS real FROM (SELECT namnd, arg_min(mnkr, ar) AS a, arg_max(mnkr, ar) AS b, min(ar) AS fa, max(ar) AS fb FROM grants GROUP BY 1) g,
LATERAL (SELECT 100 + 2.0 * (g.fa - 1990) AS a, 100 + 2.0 * (g.fb - 1990) AS b) i
""")
def deflated(c: Civic) -> DataFrame:
    """Change in fixed prices, by an index of the first and last year."""
    index = lambda y: 100 + 2.0 * (y - 1990)
    rows = c.grants().groupBy("namnd").agg(F.min_by("mnkr", "ar").alias("a"), F.max_by("mnkr", "ar").alias("b"), F.min("ar").alias("fa"), F.max("ar").alias("fb"))
    prices = index(F.col("fb")) / index(F.col("fa"))
    return rows.select("namnd", S.half_up((F.col("b") / prices / F.col("a") - 1) * 100, 1).alias("real"))


@query("win_07_running_state", """
SELECT user_id, event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w::BIGINT AS avsnitt, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS rubrik
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""", plain=True)
def running_state(c: Civic) -> DataFrame:
    """The last heading seen, and the number of headings so far, for each line of a transcript."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return c.table("events").select("user_id", "event_id", F.count(heading).over(order).alias("avsnitt"), F.last(heading, ignorenulls=True).over(order).alias("rubrik"))


@query("win_09_ordinal", "SELECT id, row_number() OVER (PARTITION BY mote ORDER BY id) AS ordning FROM paragraphs")
def ordinal(c: Civic) -> DataFrame:
    return c.paragraphs().select("id", F.row_number().over(Window.partitionBy("mote").orderBy("id")).cast("long").alias("ordning"))


@query("win_10_seat_rank", "SELECT id, coalesce(CASE parti WHEN 'P3' THEN 1 WHEN 'P1' THEN 2 END, 99) AS rang FROM people")
def seat_rank(c: Civic) -> DataFrame:
    seats = c.spark.createDataFrame([("P3", 1), ("P1", 2)], "parti string, rang int")
    return c.people().join(seats, "parti", "left").select("id", F.coalesce("rang", F.lit(99)).alias("rang"))


@query("win_11_suffix", "SELECT id, CASE WHEN n > 1 THEN b || '-' || n ELSE b END AS slug FROM (SELECT id, lower(orsak) || '-' || datum AS b, row_number() OVER (PARTITION BY orsak, datum ORDER BY id) AS n FROM paragraphs)")
def suffix(c: Civic) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("orsak", "datum").orderBy("id"))
    rows = c.paragraphs().select("id", F.concat_ws("-", F.lower("orsak"), "datum").alias("b"), n.alias("n"))
    return rows.select("id", F.when(F.col("n") > 1, F.concat_ws("-", "b", F.col("n").cast("string"))).otherwise(F.col("b")).alias("slug"))


@query("win_12_group_breaks", "SELECT user_id, event_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ny_grupp FROM events", plain=True)
def group_breaks(c: Civic) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return c.table("events").select("user_id", "event_id", (~F.col("event_type").eqNullSafe(before)).alias("ny_grupp"))


@query("win_13_months_in_year", """
SELECT namnd, ar, string_agg(manad || ':' || s, ' ' ORDER BY manad) AS manader FROM (SELECT namnd, ar, lpad(manad::VARCHAR, 2, '0') AS manad, (floor(sum(belopp) / 1000 + 0.5)::BIGINT)::VARCHAR AS s FROM invoices GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def months_in_year(c: Civic) -> DataFrame:
    """Twelve rows at most per year and committee, as a sorted list."""
    month = F.lpad(F.col("manad").cast("string"), 2, "0")
    per = c.invoices().groupBy("namnd", "ar", month.alias("m")).agg(F.floor(F.sum("belopp") / 1000 + 0.5).cast("string").alias("s"))
    return per.groupBy("namnd", "ar").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "m", "s"))), " ").alias("manader"))


@query("src_10_best_candidate", """
SELECT datum, id FROM (SELECT datum, id, row_number() OVER (PARTITION BY datum ORDER BY nr DESC NULLS LAST, id DESC) AS n FROM paragraphs WHERE belopp > 50000) WHERE n = 1
""")
def best_candidate(c: Civic) -> DataFrame:
    """The latest published file of a period: changed last (unknown last), then the highest id, invalid ones passed over."""
    return R.first_per(c.paragraphs().filter("belopp > 50000"), ["datum"], F.col("nr").desc_nulls_last(), F.col("id").desc()).select("datum", "id")


@query("src_11_title_month", "SELECT id, substr(datum, 1, 7) AS manad FROM paragraphs")
def title_month(c: Civic) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, X.MONTHS)), F.substring("datum", 6, 2).cast("int"))
    by_name = F.concat(F.lit("Leverantörsfakturor "), name, F.lit(" "), F.substring("datum", 1, 4))
    digits = F.concat(F.lit("fakturor_"), F.substring("datum", 1, 4), F.substring("datum", 6, 2), F.lit(".csv"))
    title = F.when(F.col("nr").isNull(), digits).otherwise(by_name)
    return c.paragraphs().select("id", X.month_of_title(title).alias("manad"))
