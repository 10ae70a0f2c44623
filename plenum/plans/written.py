"""Documents, tables and files written from the tables in the forms of minutes, annexes and reports, and read back as rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import text as X
from plenum.operators import executive as K
from plenum.operators import extraction as E
from plenum.operators import reports
from plenum.plans.registry import query
from plenum.sources import files, sinks
from plenum.sources.projection import Civic
from plenum.sources.shared import shared_folder

PARTIES = ["S", "M", "V", "SD", "L", "MP", "D", "KD", "C"]
#: Invoices of all months together that have one file a month.
FILED_LINES = 20_000_000


def _letters(number: Column, width: int = 3) -> Column:
    """A number in letters, for names."""
    digits = number.cast("string")
    return F.translate(F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")), "0123456789", "abcdefghij")


LETTERS = "translate(lpad({0}::VARCHAR, greatest(3, length({0}::VARCHAR))::INT, '0'), '0123456789', 'abcdefghij')"


def _number(column: str) -> Column:
    return F.regexp_extract(column, "[0-9]+", 0).cast("long")


def _of(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _joined(rows: DataFrame, doc: Column, order: Column, line: Column, head: str = "", tail: str = "", between: str = "\n") -> DataFrame:
    """doc, text: the lines of a document in order, between a head and a tail."""
    lines = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    text = F.array_join(F.transform(lines, lambda x: x["l"]), between)
    return rows.groupBy(doc.alias("doc")).agg(F.concat(F.lit(head), text, F.lit(tail)).alias("text"))


# ---- attendance -----------------------------------------------------------------------------------------------------------


def _attendance(c: Civic) -> DataFrame:
    k = _number("id")
    people = c.people().filter(k % 3 > 0)
    line = F.concat(F.lit("Ek, N"), _letters(k), F.lit("    "), _of([*PARTIES, "FP"], k), F.lit("   "), (k % 10 + 8).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("   21:05"))
    return _joined(people, F.col("namnd"), k, line, "Början\nNo, Name   S   9:00   10:00\nBILAGA 1\nPlats  Ledamot\n", "\n")


PRESENT = f"(SELECT *, 'N' || {LETTERS.format('k')} AS fornamn, ['S','M','V','SD','L','MP','D','KD','C','FP'][(k % 10 + 1)::INT] AS p, (k % 10 + 8) || ':' || lpad((k % 60)::VARCHAR, 2, '0') AS kom FROM (SELECT *, regexp_extract(id, '[0-9]+')::BIGINT AS k FROM people) WHERE k % 3 > 0)"


@query("txt_10_attendance", f"SELECT namnd AS doc, 'Ek, ' || fornamn AS namn, p AS parti, kom AS ankom, '21:05' AS utgick FROM {PRESENT}")
def attendance(c: Civic) -> DataFrame:
    return E.wide_attendance(_attendance(c)).drop("nr")


@query("txt_10_attendance_edges", f"SELECT namnd AS doc, id AS person, kom || '–21:05' AS label FROM {PRESENT} WHERE k % 2 = 0")
def attendance_edges(c: Civic) -> DataFrame:
    """Names of the annex as people: those with even numbers are in the roster, a third of them with another surname, a third with more names."""
    k = _number("id")
    first = F.when(k % 3 == 2, F.concat(F.lit("N"), _letters(k), F.lit(" Mellan"))).otherwise(F.concat(F.lit("N"), _letters(k)))
    roster = c.people().filter(k % 2 == 0).select(F.col("id").alias("person"), first.alias("fornamn"), F.when(k % 3 == 1, F.lit("Ek Alm")).otherwise(F.lit("Ek")).alias("efternamn"), k.alias("plats"))
    rows = E.resolved(E.wide_attendance(_attendance(c)), roster)
    return rows.select("doc", "person", F.concat("ankom", F.lit("–"), "utgick").alias("label"))


@query("txt_10_presence", f"SELECT namnd AS doc, fornamn || ' Ek' AS namn, ['S','M','V','SD','L','MP','D','KD','C'][(k % 9 + 1)::INT] AS parti, '14:' || lpad((k % 60)::VARCHAR, 2, '0') AS ankom FROM {PRESENT}")
def presence(c: Civic) -> DataFrame:
    """The numbered table of the same annex in its other form."""
    k = _number("id")
    line = F.concat(F.lit(" "), k.cast("string"), F.lit("  Ek, N"), _letters(k), F.lit("     "), _of(PARTIES, k), F.lit("     14:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("   21:00"))
    docs = _joined(c.people().filter(k % 3 > 0), F.col("namnd"), k, line, "Bilaga 1\nPlats  Ledamot\n", "\nBilaga 2\n")
    return E.presence_lists(docs).select("doc", "namn", "parti", "ankom")


# ---- the executive --------------------------------------------------------------------------------------------------------


@query("txt_14_roll_calls", """
, v AS (SELECT * FROM votes WHERE to_id LIKE 'ks-%'), n AS (SELECT to_id, count(*) FILTER (rost = 'ja') AS ja, count(*) FILTER (rost = 'nej') AS nej, count(*) FILTER (rost = 'avstår') AS avstar FROM v GROUP BY 1)
SELECT v.to_id AS doc, v.rost, v.from_id AS namn, 'P' || right(v.from_id, 1) AS parti, ja::INT AS ja, nej::INT AS nej, avstar::INT AS avstar, regexp_extract(v.to_id, '[0-9]+')::BIGINT % 4 > 0 AS verifierad FROM v JOIN n ON v.to_id = n.to_id
""")
def roll_calls(c: Civic) -> DataFrame:
    """The executive's votes in prose; in a fourth of the paragraphs the proposition says nothing of yes and no."""
    votes = c.votes().filter(F.col("to_id").startswith("ks-")).groupBy("to_id").agg(F.array_sort(F.collect_list(F.struct("rost", "from_id"))).alias("x"))
    verbs = {"ja": "röstar Ja", "nej": "röstar Nej", "avstår": "avstår från att rösta"}

    def side(rost: str) -> Column:
        of = F.filter("x", lambda v: v["rost"] == rost)
        names = F.transform(of, lambda v: F.concat(v["from_id"], F.lit(" (P"), F.right(v["from_id"], F.lit(1)), F.lit(")")))
        n = F.size(names)
        # The last name follows "och" or "samt", the second one a new line.
        listed = F.when(n == 1, names[0]).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ",\n"), F.when(n % 2 == 0, " och ").otherwise(" samt "), F.element_at(names, -1)))
        return F.when(n > 0, F.concat(listed, F.lit(f" {verbs[rost]} ("), n.cast("string"), F.lit(").\n"))).otherwise(F.lit(""))

    said = F.when(_number("to_id") % 4 > 0, "Ja för avslag och Nej för bifall till yrkandet.").otherwise("Ja för något annat.")
    text = F.concat(F.lit('Omröstning\nGodkänd voteringsproposition: "'), said, F.lit('"\n'), side("ja"), side("nej"), side("avstår"), F.lit("Reservation\nIngen röstar Ja (9)."))
    calls = K.roll_calls(votes.select(F.col("to_id").alias("doc"), F.lit(1).alias("nr"), text.alias("text")))
    return calls.select("doc", F.inline("roster"), "ja", "nej", "avstar", "verifierad")


@query("txt_15_executive", """
SELECT mote AS doc, n AS nr, 'SLK-2024-' || k AS arende, 'Titel ' || k || ' i två rader' AS rubrik, CASE WHEN n % 6 = 0 THEN 'tillstyrkan_kf' ELSE beslut END AS beslut
FROM (SELECT *, regexp_extract(id, '[0-9]+')::BIGINT AS k, row_number() OVER (PARTITION BY mote ORDER BY id)::INT AS n FROM paragraphs WHERE id LIKE 'ks-%')
""")
def executive(c: Civic) -> DataFrame:
    k, n = _number("id").cast("string"), F.row_number().over(Window.partitionBy("mote").orderBy("id"))
    rows = c.paragraphs().filter(F.col("id").startswith("ks-")).withColumn("n", n)
    phrase = F.when(F.col("n") % 6 == 0, "Styrelsen tillstyrker förslaget och föreslår att\nkommunfullmäktige beslutar.").when(F.col("beslut") == "bifall", "Förslaget vinner bifall.")
    phrase = phrase.when(F.col("beslut") == "avslag", "Yrkandet avslås.").otherwise("Ärendet bordläggs.")
    line = F.concat(F.lit("§ "), F.col("n").cast("string"), F.lit(" Ärendenummer SLK-2024-"), k, F.lit("\nTitel "), k, F.lit(" i\n12 (40)\ntvå rader\nBeslut\n"), phrase)
    return K.paragraphs(_joined(rows, F.col("mote"), F.col("n"), line, "Protokoll\n", "\n")).select("doc", "nr", "arende", "rubrik", "beslut")


@query("txt_15_present", f"SELECT namnd AS doc, CASE WHEN saldo < 0 THEN 'Tjänstgörande ersättare' ELSE 'Ledamot' END AS roll, 'Namn ' || {LETTERS.format('k')} AS namn, parti FROM (SELECT *, regexp_extract(id, '[0-9]+')::BIGINT AS k FROM people)")
def present(c: Civic) -> DataFrame:
    k = _number("id")
    stands_in = F.col("saldo") < 0
    rows = c.people().select("namnd", stands_in.cast("int").alias("ersättare"), k.alias("k"), F.concat(F.lit("Namn "), _letters(k), F.lit(" ("), "parti", F.lit(")")).alias("rad"))
    first = F.row_number().over(Window.partitionBy("namnd", "ersättare").orderBy("k")) == 1
    rows = rows.withColumn("rad", F.when(first & (F.col("ersättare") == 1), F.concat(F.lit("Tjänstgörande ersättare\n"), "rad")).otherwise(F.col("rad")))
    docs = _joined(rows, F.col("namnd"), F.struct("ersättare", "k"), F.col("rad"), "Närvarande\nLedamöter\n", "\nÖvriga närvarande\nJusteringsdag: 3\n")
    return K.present(docs)


# ---- budgets and reports --------------------------------------------------------------------------------------------------


def _money(value: Column, digits: int) -> Column:
    return F.replace(value.cast(f"decimal(18,{digits})").cast("string"), F.lit("."), F.lit(","))


@query("txt_17_budget_rows", f"SELECT ar::VARCHAR AS doc, 'Nämnden för ' || {LETTERS.format('k')} AS namn, mnkr FROM (SELECT *, split_part(namnd, '_', 2)::BIGINT AS k FROM grants)")
def budget_rows(c: Civic) -> DataFrame:
    k = _number("namnd")
    line = F.concat(F.lit("  Nämnden för "), _letters(k), F.lit("    "), _money(F.col("mnkr"), 2))
    return E.budget_rows(_joined(c.grants(), F.col("ar").cast("string"), k, line, "Kommunbidrag\n", "\nSumma   9 999,0\nSida 3\n"))


@query("txt_18_assignments", f"SELECT id AS doc, 'Nämnden ' || {LETTERS.format('k')} AS mottagare, 'svara på fråga ' || k AS uppdrag FROM (SELECT *, regexp_extract(id, '[0-9]+')::BIGINT AS k FROM paragraphs)")
def assignments(c: Civic) -> DataFrame:
    k = _number("id")
    text = F.concat(F.lit("Beslut.\nNämnden "), _letters(k), F.lit(" får i uppdrag att svara på fråga "), k.cast("string"), F.lit(". Mer text."))
    return E.assignments(c.paragraphs().select(F.col("id").alias("doc"), text.alias("text")))


@query("txt_19_results", f"""
, g AS (SELECT ar, split_part(namnd, '_', 2)::BIGINT AS k, floor(mnkr) + 1000 AS b FROM grants), r AS (SELECT *, b + k % 7 - 3 AS u FROM g WHERE ar % 2 = 0 OR k < 4)
SELECT ar::VARCHAR AS doc, 'Nämnden för ' || {LETTERS.format('k')} AS namn, 'n' || k AS nyckel, b AS budget, u AS utfall, u - b AS avvikelse, floor((u - b) / abs(b) * 1000 + 0.5) / 10 AS procent FROM r
""")
def results(c: Civic) -> DataFrame:
    """Annual reports of even years with a table, of others as a follow-up with fewer lines, in running text."""
    k = _number("namnd")
    known = c.table("nation").select(F.concat(F.lit("Nämnden för "), _letters(F.col("n_nationkey"))).alias("namn"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("nyckel"), F.col("n_nationkey").alias("ordning"))
    b = F.floor("mnkr") + 1000
    u = b + k % 7 - 3
    name = F.concat(F.lit("Nämnden för "), _letters(k))
    even = F.col("ar") % 2 == 0
    row = F.when(even, F.concat_ws("    ", name, b.cast("string"), u.cast("string"), F.lit("0"))).otherwise(F.concat(name, F.lit(" hade "), b.cast("string"), F.lit(" mot "), u.cast("string"), F.lit(" i år")))
    docs = _joined(c.grants().filter(even | (k < 4)), F.col("ar").cast("string"), k, row, "", "\nSumma nämnder    1    2    3\n")
    docs = docs.withColumn("text", F.concat(F.when(F.col("doc").cast("int") % 2 == 0, "Driften\nNämnd    Budget    Resultat    Avvikelse\n------\n").otherwise("Uppföljning\n"), "text"))
    return reports.committee_results(docs, known).drop("nr")


def _tables(c: Civic) -> DataFrame:
    """Interim tables by year: another one, then posts, then services under headings."""
    k, m = _number("namnd"), F.col("mnkr")
    grants = c.grants().select(F.col("ar").cast("string").alias("doc"), k.cast("int").alias("k"), m.alias("mnkr"))
    years = grants.select("doc").distinct()
    text = lambda x: _money(x, 2)
    head = lambda table, nr, *cells: years.select("doc", F.lit(table).alias("tabell"), F.lit(nr).alias("nr"), F.array(*map(F.lit, cells)).alias("celler"))
    posts = grants.select("doc", F.lit(1).alias("tabell"), (F.col("k") + 4).alias("nr"), F.array(F.concat(F.lit(" Post "), F.col("k").cast("string")), text(F.col("mnkr")), F.lit("1 000"), F.lit("-")).alias("celler"))
    child = F.when(F.col("k") % 3 == 0, F.array(F.concat(F.lit("Grupp "), F.col("k").cast("string")), F.lit(""), F.lit(" ")))
    child = child.otherwise(F.array(F.concat(F.lit("- Tjänst "), F.col("k").cast("string")), F.lit("1"), F.lit("2"), text(F.col("mnkr"))))
    services = grants.select("doc", F.lit(2).alias("tabell"), (F.col("k") + 1).alias("nr"), child.alias("celler"))
    heads = [head(0, 0, "Annat"), head(0, 1, "Resultat", "1"), head(1, 0, "", "P", "B"), head(1, 1, "Intäkter", "1"), head(1, 2, "Kommunbidrag", "2"), head(1, 3, "Resultat", "3"), head(2, 0, "Tjänster", "Resultat period"), head(2, 999, "Total", "7")]
    out = posts.unionByName(services)
    for h in heads:
        out = out.unionByName(h)
    return out


@query("txt_20_posts", """
, g AS (SELECT ar, split_part(namnd, '_', 2)::INT AS k, mnkr FROM grants), y AS (SELECT DISTINCT ar FROM g)
SELECT ar::VARCHAR AS doc, (k + 4)::INT AS nr, 'Post ' || k AS namn, mnkr AS "utfallPeriod", 1000.0::DOUBLE AS "budgetPeriod" FROM g
UNION ALL SELECT ar::VARCHAR, nr, namn, nr::DOUBLE, 0.0 FROM y, (VALUES (1, 'Intäkter'), (2, 'Kommunbidrag'), (3, 'Resultat')) v(nr, namn)
""")
def interim_posts(c: Civic) -> DataFrame:
    return reports.result_posts(_tables(c)).select("doc", "nr", "namn", "utfallPeriod", "budgetPeriod")


@query("txt_20_services", """
, g AS (SELECT ar, split_part(namnd, '_', 2)::INT AS k, mnkr FROM grants)
SELECT ar::VARCHAR AS doc, 'Tjänst ' || k AS namn, 'Grupp ' || h AS kategori, false AS summa, mnkr AS resultat
FROM (SELECT *, max(CASE WHEN k % 3 = 0 THEN k END) OVER (PARTITION BY ar ORDER BY k) AS h FROM g) WHERE k % 3 > 0
UNION ALL SELECT DISTINCT ar::VARCHAR, 'Total', NULL, true, 0.0 FROM g
""")
def interim_services(c: Civic) -> DataFrame:
    """Services carry the last heading above them down."""
    return reports.services(_tables(c)).select("doc", F.col("tjänst").alias("namn"), "kategori", F.col("är_summa").alias("summa"), F.col("resultatPeriod").alias("resultat"))


@query("txt_21_audits", f"""
SELECT id AS doc, 'Ärende ' || l AS titel, false AS reserv, 'Stadsrevisionen har granskat ärende ' || l || ' hos nämnden. Det finns brister.' AS sammanfattning, 'nämnden ' || l AS mottagare, (1 + (k % 2 = 0)::INT)::INT AS antal
FROM (SELECT *, {LETTERS.format('k')} AS l FROM (SELECT *, regexp_extract(id, '[0-9]+')::BIGINT AS k FROM paragraphs))
""")
def audits(c: Civic) -> DataFrame:
    k = _number("id")
    more = F.when(k % 2 == 0, F.lit(" Bolaget AB rekommenderas att se över avtal.")).otherwise(F.concat(F.lit(" Nämnden "), _letters(k), F.lit(" rekommenderas att ta fram rutiner.")))
    text = F.concat(F.lit("Rapportsammandrag\nStadsrevisionen\nMissiv till ansvariga nämnder och till alla bolagsstyrelser i den berörda koncernen\nStadsrevisionen har granskat ären-\nde "), _letters(k), F.lit(" hos\nnämnden. Det finns brister.\nStadsrevisionen, Fordon   1 (2)\nRevisionskontoret rekommenderar nämnden "), _letters(k), F.lit(" att ta fram ru-tiner."), more)
    rows = reports.audits(c.paragraphs().select(F.col("id").alias("doc"), text.alias("text")))
    return rows.select("doc", "titel", "reserv", "sammanfattning", F.get("rekommendationer", 0)["mottagare"].alias("mottagare"), F.size("rekommendationer").alias("antal"))


@query("txt_25_older_annex", """
SELECT to_id AS doc, (k % 90 + 1)::VARCHAR AS arende, 'Motion om ' || k AS mening, count(*) FILTER (rost = 'ja') OVER (PARTITION BY to_id)::INT AS ja, 'Politiker med nummer ' || regexp_extract(from_id, '[0-9]+') AS namn,
       ['S','M','V','SD','L','MP','D','KD','C'][(regexp_extract(from_id, '[0-9]+')::BIGINT % 9 + 1)::INT] AS parti, rost FROM (SELECT *, regexp_extract(to_id, '[0-9]+')::BIGINT AS k FROM votes)
""")
def older_annex(c: Civic) -> DataFrame:
    """Votes in the older annex's wide columns; a name in three begins on a line of its own."""
    k = _number("to_id")
    docs = c.votes().groupBy("to_id").agg(F.sort_array(F.collect_list(F.struct("from_id", "rost"))).alias("x"))
    docs = docs.withColumn("ja", F.size(F.filter("x", lambda v: v["rost"] == "ja")))
    votes = F.transform("x", lambda v: F.struct(F.regexp_extract(v["from_id"], "[0-9]+", 0).cast("long").alias("who"), v["rost"].alias("rost")))

    def line(v: Column) -> Column:
        who, broken = v["who"].cast("string"), v["who"] % 3 == 0
        name = F.concat(F.when(broken, "med nummer ").otherwise("Politiker med nummer "), who)
        return F.concat(F.when(broken, "Politiker\n").otherwise(""), F.rpad(name, 30, " "), F.rpad(_of(PARTIES, v["who"]), 10, " "), F.rpad(who, 10, " "), F.rpad(F.lit("Ledamot"), 15, " "), F.when(v["rost"] == "ja", "Ja").when(v["rost"] == "nej", "Nej").otherwise(F.initcap(v["rost"])))

    head = F.concat(F.lit("Bilaga 2 \nÄrende: "), (k % 90 + 1).cast("string"), F.lit("\nÄrendemening: Motion\nom "), k.cast("string"), F.lit("\nAntal Ja: "), F.col("ja").cast("string"), F.lit("\nResultat\nNamn  Parti\n"))
    docs = docs.select(F.col("to_id").alias("doc"), F.concat(head, F.array_join(F.transform(votes, line), "\n\n"), F.lit("\n")).alias("text"))
    return E.older_annex_votes(docs).select("doc", "arende", "mening", "ja", "namn", "parti", "rost")


# ---- references -----------------------------------------------------------------------------------------------------------


@query("grf_12_recipients", f"""
SELECT DISTINCT id, 'mål-' || m AS mal FROM (SELECT id, unnest(CASE k % 4 WHEN 0 THEN [k % 25, (k + 1) % 25] WHEN 1 THEN [k % 25, (k + 1) % 25, (k + 2) % 25] WHEN 2 THEN [k % 25] ELSE [] END) AS m FROM (SELECT id, regexp_extract(id, '[0-9]+')::BIGINT AS k FROM paragraphs))
""")
def recipients(c: Civic) -> DataFrame:
    """Bodies between commas and och, some with an och of their own, some unknown."""
    k = _number("id")
    name = lambda n: F.concat(F.lit("Kretslopp "), _letters(n % 25), F.lit(" och vattennämnden"))
    to = F.when(k % 4 == 0, F.concat(name(k), F.lit(" och "), name(k + 1))).when(k % 4 == 1, F.concat(name(k), F.lit(", "), F.lower(name(k + 1)), F.lit(" och "), F.regexp_replace(name(k + 2), "nämnden", "nämnd")))
    to = to.when(k % 4 == 2, F.concat(name(k), F.lit(" och okänd"))).otherwise(F.lit("okänd och helt annan, ingen"))
    key = F.col("n_nationkey")
    known = c.table("nation").select(name(key).alias("namn"), F.concat(F.lit("mål-"), key.cast("string")).alias("mal"))
    return E.recipients(c.paragraphs().select("id", to.alias("mottagare")), known)


@query("grf_16_references", """
, k AS (SELECT *, regexp_extract(id, '[0-9]+')::BIGINT AS k FROM paragraphs)
SELECT id AS doc, 'regleras_av' AS typ, 'lag-19' || (k % 90 + 10) || ':' || (k % 900 + 100) AS till FROM k UNION ALL SELECT id, 'bordlagd_från', 'kf-' || datum || '-§' || (k % 50 + 1) FROM k WHERE k % 2 = 0
UNION ALL SELECT id, 'uppdrag_till', CASE WHEN k % 6 = 1 THEN 'org-kommunstyrelsen' ELSE 'org-byggnämnden' END FROM k WHERE k % 3 = 1
""")
def references(c: Civic) -> DataFrame:
    k = _number("id")
    law = F.concat(F.lit("Enligt lag (19"), (k % 90 + 10).cast("string"), F.lit(":"), (k % 900 + 100).cast("string"), F.lit("). "))
    earlier = F.when(k % 2 == 0, F.concat(F.lit("Bordlagt den "), "datum", F.lit(", § "), (k % 50 + 1).cast("string"), F.lit(". "))).otherwise("")
    task = F.when(k % 6 == 1, "Kommunstyrelsen får i uppdrag att svara.").when(k % 3 == 1, "Byggnämnden får i uppdrag att svara.").otherwise("")
    return E.references(c.paragraphs().select(F.col("id").alias("doc"), F.lit(1).alias("nr"), F.concat(law, earlier, task).alias("text"))).drop("nr")


@query("jon_24_handlings", "SELECT id AS doc, '2024 nr ' || (kund % 60) AS handling, 'Text ' || (kund % 60) AS innehall FROM paragraphs WHERE kund % 60 < 50")
def handlings(c: Civic) -> DataFrame:
    """Paragraphs to the texts of the papers that they cite, by address; ten papers have no address."""
    number = (F.col("kund") % 60).cast("string")
    rows = c.paragraphs().select(F.col("id").alias("doc"), F.lit(1).alias("nr"), F.concat(F.lit("Se handling 2024  nr "), number, F.lit(" och Handling 2024 nr "), number, F.lit(".")).alias("text"))
    cited = c.paragraphs().select((F.col("kund") % 60).alias("n")).distinct().filter("n < 50")
    url = F.concat(F.lit("https://x.example/"), F.col("n").cast("string"))
    urls = cited.select(F.concat(F.lit("2024 nr "), F.col("n").cast("string")).alias("handling"), url.alias("url"))
    texts = cited.select(url.alias("url"), F.concat(F.lit("Text "), F.col("n").cast("string")).alias("innehall"))
    return E.handling_texts(rows, urls, texts).select("doc", "handling", "innehall")


# ---- values ---------------------------------------------------------------------------------------------------------------


@query("scl_15_composed", r"SELECT s_suppkey, lower(regexp_replace(nfc_normalize('  A' || chr(778) || 'ke  ' || s_name || ' O' || chr(776) || 'st'), '\s+', ' ', 'g')).trim() AS namn FROM supplier", plain=True)
def composed(c: Civic) -> DataFrame:
    name = F.concat(F.lit("  A\u030ake  "), "s_name", F.lit(" O\u0308st"))
    return c.table("supplier").select("s_suppkey", X.composed(name).alias("namn"))


@query("scl_28_reflowed", r"""
SELECT doc_id, trim(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(\p{Ll})-\n(\p{Ll})', '\1\2', 'g'), '[ \t]*\n[ \t]*\n\s*', chr(1), 'g'), '[ \t]*\n[ \t]*', ' ', 'g'), chr(1), chr(10) || chr(10))) AS text
FROM documents WHERE NOT regexp_matches(text, '^\s|\s$')
""", plain=True)
def reflowed(c: Civic) -> DataFrame:
    """Whole texts with their wrapped lines joined to paragraphs."""
    return c.table("documents").filter(~F.col("text").rlike(r"^\s|\s\z")).select("doc_id", X.reflowed(F.col("text")).alias("text"))


# ---- files ----------------------------------------------------------------------------------------------------------------


def _graph_files(c: Civic) -> str:
    """A graph file per committee: its members as nodes with open data, their seats as edges."""
    path = shared_folder(c.spark)
    node = F.struct("id", F.lit("politiker").alias("typ"), F.col("namn").alias("label"), F.struct("parti").alias("data"))
    edge = F.struct(F.col("id").alias("from"), F.col("namnd").alias("to"), F.lit("ledamot_i").alias("typ"), F.col("parti").alias("label"))
    files_ = c.people().groupBy("namnd").agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))
    files_.withColumn("fil", F.col("namnd")).drop("namnd").repartition("fil").write.partitionBy("fil").json(path)
    return path


@query("src_01_graph_nodes", "SELECT id, 'politiker' AS typ, namn AS label, parti FROM people")
def graph_nodes(c: Civic) -> DataFrame:
    """Nodes of all graph files below a folder; open data is a variant."""
    nodes, _ = files.graph(c.spark, _graph_files(c))
    return nodes.select("id", "typ", "label", F.variant_get("data", "$.parti", "string").alias("parti"))


@query("set_02_graph_edges", "SELECT id AS from_id, namnd AS to_id, 'ledamot_i' AS typ, parti AS label FROM people")
def graph_edges(c: Civic) -> DataFrame:
    _, edges = files.graph(c.spark, _graph_files(c))
    return edges.drop("data")


@query("src_02_optional", "SELECT id FROM people UNION ALL SELECT 'saknas' WHERE false")
def optional(c: Civic) -> DataFrame:
    """A file that is there, and one that is not and adds no row."""
    path = shared_folder(c.spark)
    c.people().select("id").write.json(path)
    lines = c.spark.read.schema("id string").json(path)
    return lines.unionByName(files.optional(c.spark, f"{path}-saknas", "id string"))


@query("src_06_invoices", "SELECT leverantor AS leverantör, count(*) AS antal, sum(floor(belopp * 100))::BIGINT AS öre FROM invoices GROUP BY 1")
def invoices(c: Civic) -> DataFrame:
    """Invoices as semicolon files by month, with a byte-order mark, two line ends and amounts as Swedes write them."""
    path = shared_folder(c.spark)
    amount = F.floor(F.col("belopp") * 100)
    whole = F.floor(amount / 100)
    written = F.concat(F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string")), F.lit(","), F.lpad((amount % 100).cast("string"), 2, "0"))
    line = F.concat_ws(";", "namnd", F.concat(F.lit(" "), "leverantor", F.lit(" ")), "orgnr", written, "konto")
    # A month's lines are dealt over files of some megabytes, each with a first line of its own, and written line by line.
    dealt = F.pmod(F.xxhash64("orgnr", "konto", "belopp"), F.lit(c.table("lineitem").count() // FILED_LINES + 1)).alias("del")
    crlf = F.when(amount % 2 == 0, "\r").otherwise("")
    rows = c.invoices().select(F.concat_ws("-", "ar", "manad").alias("fil"), dealt, F.lit(1).alias("plats"), F.concat(line, crlf).alias("value"))
    head = "\ufeffFörvaltning; Leverantör ;Organisationsnummer;Belopp SEK;Kontotext\r"
    ends = rows.select("fil", "del").distinct().select("fil", "del", F.inline(F.array(F.struct(F.lit(0).alias("plats"), F.lit(head).alias("value")), F.struct(F.lit(2).alias("plats"), F.lit("").alias("value")))))
    lines = rows.unionByName(ends).repartition("fil", "del").sortWithinPartitions("fil", "del", "plats")
    lines.select("fil", "del", "value").write.option("lineSep", "\n").partitionBy("fil", "del").text(path)
    read = files.invoices(c.spark, path)
    return read.groupBy("leverantör").agg(F.count("*").alias("antal"), F.sum(F.round(F.col("belopp") * 100).cast("long")).alias("öre"))


@query("src_21_kpis", "SELECT 'N' || split_part(namnd, '_', 2) AS kpi, ar::INT AS år, mnkr AS värde FROM grants")
def kpis(c: Civic) -> DataFrame:
    """A statistics service's replies, with values by gender."""
    path = shared_folder(c.spark)
    by = lambda g, v: F.struct(F.lit(g).alias("gender"), v.alias("value"))
    value = F.struct(F.concat(F.lit("N"), _number("namnd").cast("string")).alias("kpi"), F.col("ar").alias("period"), F.array(by("K", F.lit(-1.0)), by("T", F.col("mnkr")), by("M", F.lit(-2.0))).alias("values"))
    c.grants().groupBy("ar").agg(F.collect_list(value).alias("values")).withColumn("fil", F.col("ar")).drop("ar").repartition("fil").write.partitionBy("fil").json(path)
    return files.kpis(c.spark, path).select("kpi", "år", "värde")


@query("src_22_json_stat", "SELECT ar::VARCHAR AS år, floor(sum(mnkr) + 0.001) AS värde FROM grants GROUP BY ar")
def json_stat(c: Civic) -> DataFrame:
    path = shared_folder(c.spark)
    years = c.grants().groupBy(F.col("ar").cast("string").alias("ar")).agg(F.floor(F.sum("mnkr") + 0.001).cast("double").alias("v"))
    one = years.agg(F.array_sort(F.collect_list(F.struct("ar", "v"))).alias("x"))
    index = F.map_from_entries(F.transform("x", lambda e, i: F.struct(e["ar"], i)))
    one.select(F.struct(F.struct(F.struct(index.alias("index")).alias("category")).alias("Tid")).alias("dimension"), F.transform("x", lambda e: e["v"]).alias("value")).coalesce(1).write.json(path)
    return files.json_stat(c.spark, path)


@query("src_27_first_handling", "SELECT datum, min(id) AS titel, 'https://x.example/' || min(id) AS url FROM (SELECT datum, 'Underlag ' || id AS id FROM paragraphs WHERE beslut = 'bifall') GROUP BY datum")
def first_handling(c: Civic) -> DataFrame:
    """Meetings nested in yearly indexes: the first paper of a date whose title says so."""
    path = shared_folder(c.spark)
    title = F.when(F.col("beslut") == "bifall", F.concat(F.lit("Underlag "), "id")).otherwise(F.concat(F.lit("Annat "), "id"))
    rows = c.paragraphs().select("datum", title.alias("titel")).withColumn("url", F.concat(F.lit("https://x.example/"), "titel"))
    meetings = rows.groupBy("datum").agg(F.array_sort(F.collect_list(F.struct("titel", "url", F.lit("pdf").alias("typ")))).alias("handlingar"))
    years = meetings.groupBy(F.left("datum", F.lit(4)).cast("int").alias("år")).agg(F.collect_list(F.struct("datum", "handlingar")).alias("sammanträden"))
    years.withColumn("fil", F.col("år")).repartition("fil").write.partitionBy("fil").json(path)
    return files.first_handling(c.spark, path, "UNDERLAG")


@query("snk_07_guarded", "SELECT from_id, to_id, typ FROM edges WHERE typ = 'ledamot_i' AND regexp_extract(from_id, '[0-9]+')::BIGINT % 20 > 0")
def guarded(c: Civic) -> DataFrame:
    """A table replaced by one that lacks a twentieth; a replacement that would lose half is refused."""
    path, seats = shared_folder(c.spark), c.edges().filter("typ = 'ledamot_i'").select("from_id", "to_id", "typ")
    seats.write.parquet(path)
    sinks.replace_guarded(seats.filter(_number("from_id") % 20 > 0), path)
    try:
        sinks.replace_guarded(seats.filter(_number("from_id") % 2 > 0), path)
    except ValueError:
        return c.spark.read.parquet(path)
    raise AssertionError("half of the rows went without a word")
