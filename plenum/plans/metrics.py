"""The composite figures that users of the platform see."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import semantics as S
from plenum.operators import relational as R
from plenum.plans.registry import query
from plenum.sources.projection import Civic

RICE_SQL = """
SELECT parti, floor(avg(abs(ja - nej) / (ja + nej)) * 100 + 0.5) / 100 AS rice, count(*) AS arenden FROM (
  SELECT parti, to_id, count(*) FILTER (WHERE rost = 'ja')::DOUBLE AS ja, count(*) FILTER (WHERE rost = 'nej') AS nej FROM party_votes GROUP BY 1, 2) WHERE ja + nej >= 2 GROUP BY 1
"""


def party_tallies(c: Civic) -> DataFrame:
    """parti, to_id, ja, nej for each vote in which a party took a side."""
    ja, nej = F.count_if(F.col("rost") == "ja"), F.count_if(F.col("rost") == "nej")
    return c.party_votes().groupBy("parti", "to_id").agg(ja.alias("ja"), nej.alias("nej")).filter("ja + nej > 0")


@query("met_04_rice", RICE_SQL)
def rice(c: Civic) -> DataFrame:
    """Rice cohesion: the mean of |yes - no| / (yes + no) over votes with two voters of the party or more."""
    rows = party_tallies(c).filter("ja + nej >= 2")
    return rows.groupBy("parti").agg(S.half_up(F.avg(F.abs(F.col("ja") - F.col("nej")) / (F.col("ja") + F.col("nej"))), 2).alias("rice"), F.count("*").alias("arenden"))


@query("met_01_decision_power", """
SELECT beslut, count(*) AS antal, floor(100.0 * count(*) / (SELECT count(*) FROM paragraphs WHERE beslut IS NOT NULL) + 0.5) AS procent FROM paragraphs WHERE beslut IS NOT NULL GROUP BY 1
""")
def decision_power(c: Civic) -> DataFrame:
    groups = c.paragraphs().filter("beslut is not null").groupBy("beslut").agg(F.count("*").alias("antal"))
    total = groups.agg(F.sum("antal").alias("alla"))
    return groups.crossJoin(F.broadcast(total)).select("beslut", "antal", (S.half_up(100.0 * F.col("antal") / F.col("alla")) * 1.0).alias("procent"))


@query("met_01_reasons", "SELECT orsak, count(*) AS antal FROM paragraphs WHERE beslut = 'bordläggning' GROUP BY 1")
def reasons(c: Civic) -> DataFrame:
    return c.paragraphs().filter("beslut = 'bordläggning'").groupBy("orsak").agg(F.count("*").alias("antal"))


@query("met_02_consensus", """
SELECT count(*) AS arenden, count(v.to_id) AS med_votering, floor(100.0 * (count(*) - count(v.to_id)) / count(*) + 0.5) AS konsensus FROM paragraphs p LEFT JOIN (SELECT DISTINCT to_id FROM votes) v ON p.id = v.to_id
""")
def consensus(c: Civic) -> DataFrame:
    voted = c.votes().select(F.col("to_id").alias("id")).distinct().withColumn("v", F.lit(1))
    rows = c.paragraphs().select("id").join(voted, "id", "left")
    return rows.agg(F.count("*").alias("arenden"), F.count("v").alias("med_votering"), (S.half_up(100.0 * (F.count("*") - F.count("v")) / F.count("*")) * 1.0).alias("konsensus"))


@query("met_03_party_split", """
SELECT parti, count(*) FILTER (WHERE rost = 'ja') AS ja, count(*) FILTER (WHERE rost = 'nej') AS nej, count(*) FILTER (WHERE rost = 'avstår') AS avstar,
       floor(100.0 * count(*) FILTER (WHERE rost = 'ja') / count(*) + 0.5) AS ja_procent FROM party_votes GROUP BY 1
""")
def party_split(c: Civic) -> DataFrame:
    n = lambda v: F.count_if(F.col("rost") == v)
    return c.party_votes().groupBy("parti").agg(n("ja").alias("ja"), n("nej").alias("nej"), n("avstår").alias("avstar"), (S.half_up(100.0 * n("ja") / F.count("*")) * 1.0).alias("ja_procent"))


@query("met_05_agreement", """
, pos AS (SELECT parti, to_id, sign(count(*) FILTER (WHERE rost = 'ja') - count(*) FILTER (WHERE rost = 'nej')) AS s FROM party_votes GROUP BY 1, 2 HAVING s <> 0),
par AS (SELECT DISTINCT parti FROM party_votes)
SELECT a.parti AS a, b.parti AS b, CASE WHEN a.parti = b.parti THEN 1.0 WHEN count(x.to_id) > 0 THEN floor(avg(CASE WHEN x.s = y.s THEN 1.0 ELSE 0 END) * 100 + 0.5) / 100 END AS enighet
FROM par a JOIN par b ON a.parti <= b.parti LEFT JOIN pos x ON x.parti = a.parti AND a.parti <> b.parti AND EXISTS (SELECT 1 FROM pos z WHERE z.to_id = x.to_id AND z.parti = b.parti) LEFT JOIN pos y ON y.to_id = x.to_id AND y.parti = b.parti GROUP BY 1, 2
""")
def agreement(c: Civic) -> DataFrame:
    """How often two parties' majorities agree; ties take no position, the diagonal is 1, no common vote is null."""
    position = F.signum(F.col("ja") - F.col("nej"))
    positions = party_tallies(c).select("to_id", "parti", position.alias("s")).filter("s != 0")
    a = positions.select("to_id", F.col("parti").alias("a"), F.col("s").alias("sa"))
    b = positions.select("to_id", F.col("parti").alias("b"), F.col("s").alias("sb"))
    same = a.join(b, "to_id").filter("a < b").groupBy("a", "b").agg(S.half_up(F.avg(F.when(F.col("sa") == F.col("sb"), 1.0).otherwise(0.0)), 2).alias("enighet"))
    parties = c.people().select("parti").distinct()
    cells = parties.withColumnRenamed("parti", "a").join(parties.withColumnRenamed("parti", "b"), F.col("a") <= F.col("b"))
    return cells.join(same, ["a", "b"], "left").withColumn("enighet", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("enighet")))


@query("met_06_attendance", """
SELECT count(*) AS registreringar, count(DISTINCT to_id) AS moten, floor(count(*) / count(DISTINCT to_id) + 0.5) AS snitt FROM acts WHERE typ = 'närvarade'
""")
def attendance(c: Civic) -> DataFrame:
    n, days = F.count("*"), F.count_distinct("to_id")
    return c.acts().filter("typ = 'närvarade'").agg(n.alias("registreringar"), days.alias("moten"), (S.half_up(n / days) * 1.0).alias("snitt"))


@query("met_07_debate_gini", """
SELECT floor((2 * sum(r * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)) * 100 + 0.5) / 100 AS gini, count(*) AS talare FROM (
  SELECT n, row_number() OVER (ORDER BY n) AS r FROM (SELECT from_id, count(*) AS n FROM acts WHERE typ = 'talade_i' AND langd >= 10 GROUP BY 1))
""")
def debate_gini(c: Civic) -> DataFrame:
    """Concentration of speaking among speakers, procedural remarks left out."""
    per = c.acts().filter("typ = 'talade_i' and langd >= 10").groupBy("from_id").agg(F.count("*").alias("value"))
    # Speakers with as many turns share a row: what is put in order is the numbers of turns that occur.
    same = per.groupBy("value").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.col("k") * F.col("fore") + F.col("k") * (F.col("k") + 1) / 2
    people, turns = F.sum("k"), F.sum(F.col("k") * F.col("value"))
    gini = F.when(people > 1, (2 * F.sum(ranks * F.col("value")) - (people + 1) * turns) / (people * turns)).otherwise(F.lit(0.0))
    return same.withColumn("fore", before).agg(S.half_up(gini, 2).alias("gini"), people.alias("talare"))


@query("met_08_debate_depth", """
SELECT substr(datum, 1, 7) AS period, count(*) AS inlagg, count(DISTINCT arende) AS arenden, floor(count(*) / count(DISTINCT arende) * 10 + 0.5) / 10 AS djup FROM acts WHERE typ = 'talade_i' GROUP BY 1
""")
def debate_depth(c: Civic) -> DataFrame:
    n, items = F.count("*"), F.count_distinct("arende")
    return c.acts().filter("typ = 'talade_i'").groupBy(F.substring("datum", 1, 7).alias("period")).agg(n.alias("inlagg"), items.alias("arenden"), S.half_up(n / items, 1).alias("djup"))


@query("met_09_activity", "SELECT count(*) FILTER (WHERE typ = 'jävsanmälan') AS jav, count(*) FILTER (WHERE typ = 'yrkat') AS yrkanden, count(*) FILTER (WHERE typ = 'inlämnade_motion') AS motioner FROM acts")
def activity(c: Civic) -> DataFrame:
    n = lambda t: F.count_if(F.col("typ") == t)
    return c.acts().agg(n("jävsanmälan").alias("jav"), n("yrkat").alias("yrkanden"), n("inlämnade_motion").alias("motioner"))


@query("met_10_overview", """
SELECT (SELECT count(*) FROM people) AS personer, (SELECT count(DISTINCT parti) FROM people) AS partier, (SELECT count(*) FROM paragraphs) AS beslut, (SELECT count(DISTINCT to_id) FROM acts) AS moten
""")
def overview(c: Civic) -> DataFrame:
    """Four one-row aggregates side by side."""
    people = c.people().agg(F.count("*").alias("personer"), F.count_distinct("parti").alias("partier"))
    decisions = c.paragraphs().agg(F.count("*").alias("beslut"))
    return people.crossJoin(decisions).crossJoin(c.acts().agg(F.count_distinct("to_id").alias("moten")))


PROFILE_SQL = """
, pop AS (SELECT DISTINCT p.id, p.parti FROM people p JOIN acts a ON a.from_id = p.id), m AS (SELECT count(DISTINCT to_id) AS alla FROM acts),
act AS (SELECT from_id, count(DISTINCT CASE WHEN typ = 'närvarade' THEN to_id END) AS nar, count(*) FILTER (WHERE typ = 'talade_i') AS tal, count(*) FILTER (WHERE typ IN ('yrkat', 'inlämnade_motion')) AS ini FROM acts GROUP BY 1),
maj AS (SELECT parti, to_id, count(*) FILTER (WHERE rost = 'ja') AS ja, count(*) FILTER (WHERE rost = 'nej') AS nej FROM party_votes GROUP BY 1, 2),
loj AS (SELECT v.from_id, count(*) AS n, avg(CASE WHEN (v.rost = 'ja') = (j.ja > j.nej) THEN 1.0 ELSE 0 END) * 100 AS l FROM party_votes v JOIN maj j ON v.parti = j.parti AND v.to_id = j.to_id AND j.ja <> j.nej WHERE v.rost IN ('ja', 'nej') GROUP BY 1),
ax AS (SELECT p.id, CASE WHEN m.alla > 0 THEN a.nar / m.alla END AS narvaro, CASE WHEN a.nar >= 3 AND a.tal / a.nar <= 20 THEN a.tal / a.nar END AS debatt, CASE WHEN a.nar > 0 THEN a.ini END AS initiativ, CASE WHEN l.n >= 5 THEN l.l END AS lojalitet
  FROM pop p CROSS JOIN m JOIN act a ON a.from_id = p.id LEFT JOIN loj l ON l.from_id = p.id),
long AS (SELECT id, 'narvaro' AS axel, narvaro::DOUBLE AS v FROM ax UNION ALL SELECT id, 'debatt', debatt FROM ax UNION ALL SELECT id, 'initiativ', initiativ FROM ax UNION ALL SELECT id, 'lojalitet', lojalitet FROM ax)
SELECT id, axel, floor(v * 100 + 0.5) / 100 AS varde, CASE WHEN v IS NOT NULL THEN floor((rank() OVER (PARTITION BY axel ORDER BY v NULLS LAST) - 1 + count(*) OVER (PARTITION BY axel, v) / 2.0) / count(v) OVER (PARTITION BY axel) * 100 + 0.5) END AS percentil FROM long
"""


def profile_axes(c: Civic) -> DataFrame:
    """id, axel, v: attendance, debate, initiative and loyalty of everyone with an outgoing edge."""
    typ = F.col("typ")
    acts = c.acts().groupBy("from_id").agg(
        F.count_distinct(F.when(typ == "närvarade", F.col("to_id"))).alias("nar"), F.count_if(typ == "talade_i").alias("tal"), F.count_if(typ.isin("yrkat", "inlämnade_motion")).alias("ini")
    )
    meetings = c.acts().agg(F.count_distinct("to_id").alias("alla"))
    same = Window.partitionBy("parti", "to_id")
    tallies = [F.count_if(F.col("rost") == k).over(same).alias(k) for k in ("ja", "nej")]
    votes = c.party_votes().filter(F.col("rost").isin("ja", "nej")).select("from_id", "rost", *tallies)
    own = votes.filter("ja != nej").select("from_id", "rost", (F.col("ja") > F.col("nej")).alias("for"))
    loyalty = own.groupBy("from_id").agg(F.count("*").alias("n"), (F.avg(F.when((F.col("rost") == "ja") == F.col("for"), 1.0).otherwise(0.0)) * 100).alias("l"))
    rows = c.people().select(F.col("id").alias("from_id")).join(acts, "from_id").join(loyalty, "from_id", "left").crossJoin(F.broadcast(meetings))
    per = F.col("tal") / F.col("nar")
    axes = {
        "narvaro": F.when(F.col("alla") > 0, F.col("nar") / F.col("alla")), "debatt": F.when((F.col("nar") >= 3) & (per <= 20), per),
        "initiativ": F.when(F.col("nar") > 0, F.col("ini").cast("double")), "lojalitet": F.when(F.col("n") >= 5, F.col("l")),
    }
    wide = rows.select(F.col("from_id").alias("id"), *[v.alias(k) for k, v in axes.items()])
    return wide.unpivot("id", list(axes), "axel", "v")


@query("met_11_profile", PROFILE_SQL)
def profile(c: Civic) -> DataFrame:
    """Raw value and mid-rank percentile on each axis; a missing value has no percentile."""
    rows = profile_axes(c).withColumn("m", S.mid_rank("v", ["axel"]))
    return rows.select("id", "axel", S.half_up(F.col("v"), 2).alias("varde"), (S.half_up(F.col("m") * 100) * 1.0).alias("percentil"))


@query("met_12_remuneration", """
SELECT p.id, coalesce(nullif(a.n, 0) * 1500, nullif(p.saldo, 0), 68000) AS arvode FROM people p LEFT JOIN (SELECT from_id, count(*) AS n FROM acts WHERE typ = 'närvarade' AND langd > 200 GROUP BY 1) a ON a.from_id = p.id
""")
def remuneration(c: Civic) -> DataFrame:
    """A fee table with defaults, zero and null alike counting as missing."""
    days = c.acts().filter("typ = 'närvarade' and langd > 200").groupBy(F.col("from_id").alias("id")).agg((F.count("*") * 1500.0).alias("n"))
    return c.people().join(days, "id", "left").select("id", S.or_else(F.col("n"), F.col("saldo"), F.lit(68000.0)).alias("arvode"))


PROCEDURAL_SQL = """
, s AS (SELECT datum, arende, talare, count(*) AS n, (list(langd ORDER BY langd))[(count(*) // 2 + 1)::INT] AS m FROM speeches GROUP BY 1, 2, 3),
i AS (SELECT datum, arende, count(*) AS talare_n, sum(n) AS alla, coalesce(max(n) FILTER (WHERE m >= 300), 0) AS busiest FROM s GROUP BY 1, 2),
l AS (SELECT s.datum, s.arende, s.talare FROM s JOIN i ON s.datum = i.datum AND s.arende = i.arende WHERE i.talare_n >= 3 AND s.n >= 3 AND s.m < 300 AND (s.n / i.alla >= 0.35 OR (i.busiest > 0 AND s.n >= 2 * i.busiest))),
solo AS (SELECT datum, arende, min(talare) AS talare FROM speeches GROUP BY 1, 2 HAVING count(DISTINCT talare) = 1 AND max(langd) < 600)
SELECT key FROM speeches x WHERE EXISTS (SELECT 1 FROM l WHERE l.datum = x.datum AND l.arende = x.arende AND l.talare = x.talare)
UNION SELECT key FROM speeches x WHERE EXISTS (SELECT 1 FROM solo o WHERE o.datum = x.datum AND o.arende = x.arende) AND EXISTS (SELECT 1 FROM l WHERE l.datum = x.datum AND l.talare = x.talare)
"""


def procedural(speeches: DataFrame) -> DataFrame:
    """Keys of procedural entries among (key, datum, arende, talare, langd).

    In an item with three speakers or more, a speaker leads who has three entries or more, an upper median length below 300,
    and either 35 % of the entries or twice as many as the busiest real speaker (median of 300 or more).  All of a leader's
    entries in the item count; so do those of items on the same date whose only speaker is a leader of that date and whose
    entries all are shorter than 600.
    """
    per = speeches.groupBy("datum", "arende", "talare").agg(F.count("*").alias("n"), S.upper_median(F.col("langd")).alias("m"))
    items = per.groupBy("datum", "arende").agg(F.count("*").alias("talare_n"), F.sum("n").alias("alla"), F.coalesce(F.max(F.when(F.col("m") >= 300, F.col("n"))), F.lit(0)).alias("busiest"))
    n, busiest = F.col("n"), F.col("busiest")
    leads = (F.col("talare_n") >= 3) & (n >= 3) & (F.col("m") < 300) & ((n / F.col("alla") >= 0.35) | ((busiest > 0) & (n >= 2 * busiest)))
    leaders = per.join(items, ["datum", "arende"]).filter(leads).select("datum", "arende", "talare")
    solo = speeches.groupBy("datum", "arende").agg(F.count_distinct("talare").alias("k"), F.max("langd").alias("longest")).filter("k = 1 and longest < 600").select("datum", "arende")
    first = speeches.join(leaders, ["datum", "arende", "talare"], "left_semi").select("key")
    second = speeches.join(solo, ["datum", "arende"], "left_semi").join(leaders.select("datum", "talare"), ["datum", "talare"], "left_semi").select("key")
    return first.union(second).distinct()


@query("met_13_procedural", PROCEDURAL_SQL)
def procedural_speeches(c: Civic) -> DataFrame:
    return procedural(c.speeches())


@query("met_14_supplier_outturn", """
SELECT i.namnd, i.ar, floor(i.s / 1000 + 0.5) AS tkr, i.n AS fakturor, CASE WHEN g.mnkr > 0 THEN floor(i.s / 1e6 / g.mnkr * 100 * 10 + 0.5) / 10 END AS andel
FROM (SELECT namnd, ar, sum(belopp) AS s, count(*) AS n FROM invoices GROUP BY 1, 2) i LEFT JOIN grants g ON i.namnd = g.namnd AND i.ar = g.ar
""")
def supplier_outturn(c: Civic) -> DataFrame:
    """Invoices per committee and year in thousands, and as a share of the grant (null without one)."""
    bills = c.invoices().groupBy("namnd", "ar").agg(F.sum("belopp").alias("s"), F.count("*").alias("fakturor"))
    share = F.when(F.col("mnkr") > 0, S.half_up(F.col("s") / 1e6 / F.col("mnkr") * 100, 1))
    return bills.join(c.grants(), ["namnd", "ar"], "left").select("namnd", "ar", (S.half_up(F.col("s") / 1000) * 1.0).alias("tkr"), "fakturor", share.alias("andel"))


@query("met_14_monthly", "SELECT namnd, ar, manad, floor(sum(belopp) / 1000 + 0.5) AS tkr, count(*) AS fakturor FROM invoices GROUP BY 1, 2, 3")
def monthly_outturn(c: Civic) -> DataFrame:
    return c.invoices().groupBy("namnd", "ar", "manad").agg((S.half_up(F.sum("belopp") / 1000) * 1.0).alias("tkr"), F.count("*").alias("fakturor"))


@query("met_15_conflicts", """
SELECT p.id, i.orgnr, i.namnd, count(*) AS fakturor, floor(sum(i.belopp) + 0.5) AS summa FROM invoices i JOIN people p ON p.namn = i.leverantor AND p.saldo > 2000
WHERE i.leverantor NOT IN (SELECT s_name FROM supplier WHERE s_suppkey % 10 = 0) AND p.namnd <> 'nämnd-nation_3' GROUP BY 1, 2, 3
""")
def conflicts(c: Civic) -> DataFrame:
    """Invoices from companies in which people have roles, without those officially disclosed."""
    watched = c.people().filter("saldo > 2000 and namnd != 'nämnd-nation_3'").select("id", F.col("namn").alias("leverantor"))
    known = c.table("supplier").filter("s_suppkey % 10 = 0").select(F.col("s_name").alias("leverantor"))
    rows = c.invoices().join(watched, "leverantor").join(known, "leverantor", "left_anti")
    return rows.groupBy("id", "orgnr", "namnd").agg(F.count("*").alias("fakturor"), (S.half_up(F.sum("belopp")) * 1.0).alias("summa"))


@query("met_16_trends", """
, b AS (SELECT namnd, arg_min(mnkr, ar) AS a, arg_max(mnkr, ar) AS z, count(*) AS n FROM grants GROUP BY 1),
u AS (SELECT namnd, arg_min(s, ar) AS a, arg_max(s, ar) AS z, count(*) AS n FROM (SELECT namnd, ar, floor(sum(belopp) / 1e4 + 0.5) / 100 AS s FROM invoices GROUP BY 1, 2) GROUP BY 1)
SELECT b.namnd, floor((b.z - b.a) / abs(b.a) * 100 * 10 + 0.5) / 10 AS budget, floor((u.z - u.a) / abs(u.a) * 100 * 10 + 0.5) / 10 AS utfall,
       floor((floor((b.z - b.a) / abs(b.a) * 100 * 10 + 0.5) / 10 - floor((u.z - u.a) / abs(u.a) * 100 * 10 + 0.5) / 10) * 10 + 0.5) / 10 AS skillnad FROM b JOIN u ON b.namnd = u.namnd
""")
def trends(c: Civic) -> DataFrame:
    """First to last change of budget and outcome, and how far they diverge."""
    def change(rows: DataFrame, value: str, name: str) -> DataFrame:
        ends = rows.groupBy("namnd").agg(F.min_by(value, "ar").alias("a"), F.max_by(value, "ar").alias("z"))
        return ends.select("namnd", S.half_up((F.col("z") - F.col("a")) / F.abs("a") * 100, 1).alias(name))

    spent = c.invoices().groupBy("namnd", "ar").agg(S.half_up(F.sum("belopp") / 1e6, 2).alias("s"))
    both = change(c.grants(), "mnkr", "budget").join(change(spent, "s", "utfall"), "namnd")
    return both.withColumn("skillnad", S.half_up(F.col("budget") - F.col("utfall"), 1))


@query("met_17_budget_year", """
SELECT n.label AS namnd, g.mnkr, floor(g.mnkr / sum(g.mnkr) OVER () * 100 * 10 + 0.5) / 10 AS andel FROM grants g JOIN nodes n ON g.namnd = n.id WHERE g.ar = (SELECT max(ar) FROM grants)
""")
def budget_year(c: Civic) -> DataFrame:
    """The latest year's budget by committee."""
    last = c.grants().agg(F.max("ar").alias("ar"))
    rows = c.grants().join(last, "ar")
    total = rows.agg(F.sum("mnkr").alias("allt"))
    named = rows.join(c.nodes().filter("typ = 'organisation'").select(F.col("id").alias("namnd"), "label"), "namnd").crossJoin(F.broadcast(total))
    return named.select(F.col("label").alias("namnd"), "mnkr", S.half_up(F.col("mnkr") / F.col("allt") * 100, 1).alias("andel"))


@query("met_17_summary", "SELECT ar, count(*) AS namnder, floor(sum(mnkr) * 100 + 0.5) / 100 AS totalt FROM grants GROUP BY 1")
def budget_summary(c: Civic) -> DataFrame:
    return c.grants().groupBy("ar").agg(F.count("*").alias("namnder"), S.half_up(F.sum("mnkr"), 2).alias("totalt"))


@query("met_18_seats", "SELECT n.label AS namnd, count(*) AS uppdrag FROM edges e JOIN nodes n ON e.to_id = n.id WHERE e.typ = 'ledamot_i' GROUP BY 1")
def seats(c: Civic) -> DataFrame:
    offices = c.nodes().filter("typ = 'organisation'").select(F.col("id").alias("to_id"), F.col("label").alias("namnd"))
    return c.edges().filter("typ = 'ledamot_i'").join(offices, "to_id").groupBy("namnd").agg(F.count("*").alias("uppdrag"))


@query("met_19_members", """
SELECT p.namnd, p.id, row_number() OVER (PARTITION BY p.namnd ORDER BY k.n DESC, p.parti, p.namn) AS plats FROM people p JOIN (SELECT parti, count(*) AS n FROM people GROUP BY 1) k ON p.parti = k.parti WHERE p.saldo >= 0
""")
def members(c: Civic) -> DataFrame:
    """Regular members per committee in order of their party's size."""
    sizes = c.people().groupBy("parti").agg(F.count("*").alias("n"))
    order = Window.partitionBy("namnd").orderBy(F.col("n").desc(), "parti", "namn")
    rows = c.people().filter("saldo >= 0").join(sizes, "parti")
    return rows.select("namnd", "id", F.row_number().over(order).cast("long").alias("plats"))


@query("met_20_meetings", """
SELECT m.id, m.datum, coalesce(a.n, 0) AS narvarande, coalesce(a.t, 0) AS inlagg, coalesce(p.n, 0) AS beslut FROM nodes m
LEFT JOIN (SELECT to_id, count(DISTINCT from_id) FILTER (WHERE typ = 'närvarade') AS n, count(*) FILTER (WHERE typ = 'talade_i') AS t FROM acts GROUP BY 1) a ON m.id = a.to_id
LEFT JOIN (SELECT datum, count(*) AS n FROM paragraphs GROUP BY 1) p ON m.datum = p.datum WHERE m.typ = 'möte'
""")
def meetings(c: Civic) -> DataFrame:
    """Meetings with what happened at them; counts go by date, so two bodies on one day share them."""
    typ = F.col("typ")
    acts = c.acts().groupBy(F.col("to_id").alias("id")).agg(F.count_distinct(F.when(typ == "närvarade", F.col("from_id"))).alias("narvarande"), F.count_if(typ == "talade_i").alias("inlagg"))
    decisions = c.paragraphs().groupBy("datum").agg(F.count("*").alias("beslut"))
    rows = c.nodes().filter("typ = 'möte'").select("id", "datum").join(acts, "id", "left").join(decisions, "datum", "left")
    return rows.select("id", "datum", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("narvarande", "inlagg", "beslut")])


@query("met_21_decisions", """
SELECT p.id, p.datum, CASE WHEN p.id LIKE 'ks-%' THEN 'KS' ELSE 'KF' END AS organ, p.beslut, v.to_id IS NOT NULL AS har_rost, coalesce(v.ja, 0) AS ja, coalesce(v.nej, 0) AS nej
FROM paragraphs p LEFT JOIN (SELECT to_id, count(*) FILTER (WHERE rost = 'ja') AS ja, count(*) FILTER (WHERE rost = 'nej') AS nej FROM votes GROUP BY 1) v ON p.id = v.to_id
""")
def decisions(c: Civic) -> DataFrame:
    tallies = c.votes().groupBy(F.col("to_id").alias("id")).agg(F.count_if(F.col("rost") == "ja").alias("ja"), F.count_if(F.col("rost") == "nej").alias("nej"), F.lit(True).alias("v"))
    rows = c.paragraphs().join(tallies, "id", "left")
    return rows.select("id", "datum", F.when(F.col("id").startswith("ks-"), "KS").otherwise("KF").alias("organ"), "beslut", F.col("v").isNotNull().alias("har_rost"), F.coalesce("ja", F.lit(0)).alias("ja"), F.coalesce("nej", F.lit(0)).alias("nej"))


@query("met_22_politicians", "SELECT p.id, p.namn, p.parti, count(a.from_id) AS handelser, min(a.datum) AS forsta FROM people p LEFT JOIN acts a ON p.id = a.from_id GROUP BY 1, 2, 3")
def politicians(c: Civic) -> DataFrame:
    acts = c.acts().groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("handelser"), F.min("datum").alias("forsta"))
    return c.people().join(acts, "id", "left").select("id", "namn", "parti", F.coalesce("handelser", F.lit(0)).alias("handelser"), "forsta")


@query("met_23_directors", """
SELECT id, namnd, saldo, row_number() OVER (ORDER BY lpad(floor(saldo)::BIGINT::VARCHAR, 10, '0') DESC, id) AS plats FROM (SELECT *, row_number() OVER (PARTITION BY namnd ORDER BY saldo DESC, id) AS n FROM people WHERE saldo > 0) WHERE n = 1
""")
def directors(c: Civic) -> DataFrame:
    """The best paid of each committee, in order of pay as text."""
    best = R.first_per(c.people().filter("saldo > 0"), ["namnd"], F.col("saldo").desc(), F.col("id"))
    key = F.lpad(F.floor("saldo").cast("string"), 10, "0")
    return best.select("id", "namnd", "saldo", F.row_number().over(Window.orderBy(key.desc(), "id")).cast("long").alias("plats"))


@query("met_24_departments", "SELECT n.label, count(p.id) AS medlemmar, g.mnkr FROM nodes n LEFT JOIN people p ON p.namnd = n.id LEFT JOIN (SELECT namnd, arg_max(mnkr, ar) AS mnkr FROM grants GROUP BY 1) g ON g.namnd = n.id WHERE n.typ = 'organisation' GROUP BY 1, 3")
def departments(c: Civic) -> DataFrame:
    offices = c.nodes().filter("typ = 'organisation'").select(F.col("id").alias("namnd"), "label")
    heads = c.people().groupBy("namnd").agg(F.count("*").alias("medlemmar"))
    latest = c.grants().groupBy("namnd").agg(F.max_by("mnkr", "ar").alias("mnkr"))
    return offices.join(heads, "namnd", "left").join(latest, "namnd", "left").select("label", F.coalesce("medlemmar", F.lit(0)).alias("medlemmar"), "mnkr")


@query("met_25_vote_history", """
SELECT p.id, coalesce(v.ja, 0) AS ja, coalesce(v.nej, 0) AS nej, coalesce(v.avstar, 0) AS avstar, (SELECT count(DISTINCT to_id) FROM acts) - coalesce(a.n, 0) AS franvaro FROM people p
LEFT JOIN (SELECT from_id, count(*) FILTER (WHERE rost = 'ja') AS ja, count(*) FILTER (WHERE rost = 'nej') AS nej, count(*) FILTER (WHERE rost = 'avstår') AS avstar FROM votes GROUP BY 1) v ON v.from_id = p.id
LEFT JOIN (SELECT from_id, count(DISTINCT to_id) AS n FROM acts WHERE typ = 'närvarade' GROUP BY 1) a ON a.from_id = p.id
""")
def vote_history(c: Civic) -> DataFrame:
    votes = c.votes().groupBy(F.col("from_id").alias("id")).agg(*[F.count_if(F.col("rost") == v).alias(k) for k, v in (("ja", "ja"), ("nej", "nej"), ("avstar", "avstår"))])
    there = c.acts().filter("typ = 'närvarade'").groupBy(F.col("from_id").alias("id")).agg(F.count_distinct("to_id").alias("n"))
    all_days = c.acts().agg(F.count_distinct("to_id").alias("alla"))
    rows = c.people().select("id").join(votes, "id", "left").join(there, "id", "left").crossJoin(F.broadcast(all_days))
    return rows.select("id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("ja", "nej", "avstar")], (F.col("alla") - F.coalesce("n", F.lit(0))).alias("franvaro"))


@query("met_26_department_status", """
SELECT namnd, arg_max(s, ar) AS senaste, max(ar)::INT AS ar, CASE WHEN arg_max(s, ar) > 20000000 THEN 'hög' ELSE 'normal' END AS status FROM (SELECT namnd, ar, floor(sum(belopp) + 0.5) AS s FROM invoices GROUP BY 1, 2) GROUP BY 1
""")
def department_status(c: Civic) -> DataFrame:
    """The latest year's row per department."""
    sums = c.invoices().groupBy("namnd", "ar").agg((S.half_up(F.sum("belopp")) * 1.0).alias("s"))
    rows = sums.groupBy("namnd").agg(F.max_by("s", "ar").alias("senaste"), F.max("ar").alias("ar"))
    return rows.withColumn("status", F.when(F.col("senaste") > 20000000, "hög").otherwise("normal"))


@query("ui_02_apportionment", """
SELECT parti, count(*) AS mandat FROM (SELECT parti, row_number() OVER (ORDER BY n / (2 * k + 1) DESC, parti, k) AS plats FROM (SELECT parti, count(*)::DOUBLE AS n FROM party_votes WHERE rost = 'ja' GROUP BY 1), range(0, 81) t(k)) WHERE plats <= 81 GROUP BY 1
""")
def apportionment(c: Civic, seats_: int = 81) -> DataFrame:
    """Seats by odd-number quotients; parties times seats rows are ranked."""
    votes = c.party_votes().filter("rost = 'ja'").groupBy("parti").agg(F.count("*").cast("double").alias("n"))
    quotients = votes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(seats_ - 1)))).withColumn("q", F.col("n") / (2 * F.col("k") + 1))
    return quotients.orderBy(F.col("q").desc(), "parti", "k").limit(seats_).groupBy("parti").agg(F.count("*").alias("mandat"))


@query("ui_04_tally", "SELECT to_id, count(*) FILTER (WHERE rost = 'ja') AS ja, count(*) FILTER (WHERE rost = 'nej') AS nej, count(*) FILTER (WHERE rost = 'avstår') AS avstar FROM votes GROUP BY 1")
def tally(c: Civic) -> DataFrame:
    return c.votes().groupBy("to_id").agg(*[F.count_if(F.col("rost") == v).alias(k) for k, v in (("ja", "ja"), ("nej", "nej"), ("avstar", "avstår"))])


@query("ui_05_highlight", "SELECT e.from_id, e.to_id FROM edges e WHERE e.typ = 'ledamot_i' AND e.to_id IN (SELECT id FROM nodes WHERE label ILIKE '%nation_1%')")
def highlight(c: Civic) -> DataFrame:
    from plenum.operators.graph import incident_to_set

    found = c.nodes().filter(S.contains_ci(F.col("label"), "nation_1")).select("id")
    return incident_to_set(c.edges().filter("typ = 'ledamot_i'"), found).select("from_id", "to_id")
