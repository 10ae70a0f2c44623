"""Text extraction over documents made from the tables, full-text search, HTML, request windows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators import archive as A
from plenum.operators import extraction as E
from plenum.operators import html as H
from plenum.operators import index as I
from plenum.operators import search as Q
from plenum.plans.registry import query
from plenum.sources.shared import shared_folder
from plenum.sources.projection import Civic


RECUSED = [("Karin Ek", "V"), ("Bo Alm", "M"), ("Cia Dahl-Berg", "KD")]
PHRASES = [
    "Ärendet bordläggs. Återstående ärenden ska bordläggas.", "Tidigare behandling: Bordlagt i mars.\nÄrendet bordläggs.", "Interpellationen bordläggs.", "Ärendet bordläggs.", "Ärendet får återremiss.",
]


def _one_of(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def protocols(c: Civic) -> DataFrame:
    """doc, text: a protocol per meeting day from its paragraphs; every fourth paragraph is continued on a later page."""
    nr = F.row_number().over(Window.partitionBy("mote").orderBy("id"))
    n = F.col("nr").cast("string")
    head = F.concat(F.lit("§ "), n, F.lit(" "), (F.col("nr") % 9 + 1000).cast("string"), F.lit("/2"), (F.col("nr") % 4).cast("string"))
    phrase = F.when(F.col("beslut") == "bifall", "Förslaget har bifallits.").when(F.col("beslut") == "avslag", "Beslutet blev avslag.").otherwise(_one_of(PHRASES, F.col("nr")))
    body = F.concat(
        head, F.lit("\n"), F.split_part("label", F.lit(" ("), F.lit(1)), F.lit("\nBeslut\n"), phrase, F.lit("\n"),
        n, F.lit(" Ja mot "), (F.col("nr") % 7).cast("string"), F.lit(" Nej\n"), _one_of([f"{name} ({party})" for name, party in RECUSED], F.col("nr")), F.lit(" deltar inte i beslutet.\n"),
        F.when(F.col("nr") % 4 == 0, F.concat(head, F.lit(" forts.\nmera text\n"))).otherwise(F.lit("")),
    )
    rows = c.paragraphs().withColumn("nr", nr).select(F.col("mote").alias("doc"), "nr", body.alias("del"))
    texts = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("nr", "del"))).alias("x"))
    return texts.select("doc", F.concat(F.lit("Kommunfullmäktige\n"), F.array_join(F.transform("x", lambda d: d["del"]), "")).alias("text"))


NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY mote ORDER BY id)::INT AS n FROM paragraphs)"
DECIDED = f"""(SELECT mote AS doc, n AS nr, n AS ja, n % 7 AS nej, label, (1000 + n % 9) || '/2' || (n % 4) AS arende,
  CASE WHEN beslut IN ('bifall', 'avslag') THEN beslut WHEN n % 5 = 4 THEN 'återremiss' ELSE 'bordläggning' END AS beslut,
  CASE WHEN beslut IN ('bifall', 'avslag') OR n % 5 = 4 THEN NULL ELSE ['tid', 'tidigare_bordlagd', 'interpellation_väntar', 'övrigt'][n % 5 + 1] END AS orsak,
  ['Karin Ek', 'Bo Alm', 'Cia Dahl-Berg'][n % 3 + 1] AS namn, ['V', 'M', 'KD'][n % 3 + 1] AS parti FROM {NUMBERED})"""


@query("txt_04_sections", f"SELECT doc, nr, arende FROM {DECIDED}")
def sections(c: Civic) -> DataFrame:
    return E.sections(protocols(c)).select("doc", "nr", "arende")


@query("txt_05_titles", f"SELECT doc, nr, split_part(label, ' (', 1) AS rubrik FROM {DECIDED}")
def titles(c: Civic) -> DataFrame:
    return E.decided(E.sections(protocols(c))).select("doc", "nr", "rubrik")


@query("txt_06_decisions", f"SELECT doc, nr, beslut, orsak FROM {DECIDED}")
def decisions(c: Civic) -> DataFrame:
    return E.decided(E.sections(protocols(c))).select("doc", "nr", "beslut", "orsak")


@query("txt_07_tallies", f"SELECT doc, nr, ja, nej, namn, parti FROM {DECIDED}")
def tallies(c: Civic) -> DataFrame:
    rows = E.decided(E.sections(protocols(c)))
    return rows.select("doc", "nr", "ja", "nej").join(E.recusals(rows), ["doc", "nr"])


@query("txt_08_merged_headers", f"SELECT doc, nr, beslut, ja FROM {DECIDED}")
def merged_headers(c: Civic) -> DataFrame:
    """Protocols printed twice, the second time without decisions: headers repeat and are merged."""
    once = protocols(c)
    again = F.regexp_replace(F.regexp_replace("text", r"(?m)^(Förslaget|Beslutet|Ärendet|Tidigare|Interpellationen).*$", ""), r"\d+ Ja mot \d Nej", "")
    return E.merged_headers(E.decided(E.sections(once.withColumn("text", F.concat("text", again))))).select("doc", "nr", "beslut", "ja")


@query("txt_09_postponed", f"SELECT mote AS doc, n AS nr FROM {NUMBERED} WHERE n BETWEEN 2 AND 3")
def postponed(c: Civic) -> DataFrame:
    docs = protocols(c)
    ranges = E.postponed_ranges(docs.select("doc", F.lit("Beslut: §§ 2–3 bordläggs.").alias("text")))
    return E.sections(docs).select("doc", "nr").join(ranges, ["doc", "nr"], "left_semi")


def annexes(c: Civic) -> DataFrame:
    """doc, text: a vote annex per paragraph; a name in three is broken over two lines, and a fourth of the annexes says one too few."""
    votes = c.votes().groupBy(F.col("to_id").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("from_id", "rost"))).alias("x"))
    name = lambda v: F.when(F.length(v["from_id"]) % 3 == 0, F.concat(F.lit("Nils\n"), v["from_id"])).otherwise(v["from_id"])
    rows = F.array_join(F.transform("x", lambda v: F.concat(name(v), F.lit("   (P"), F.right(v["from_id"], F.lit(1)), F.lit(")   "), F.when(v["rost"] == "ja", "Ja").when(v["rost"] == "nej", "Nej").otherwise(F.initcap(v["rost"])))), "\n")
    key = F.regexp_extract("doc", "[0-9]+", 0).cast("long")
    yes = F.size(F.filter("x", lambda v: v["rost"] == "ja"))
    no = F.size("x") - yes - F.when(key % 4 == 0, 1).otherwise(0)
    item = F.concat((key % 90 + 1).cast("string"), F.lit(":"), (key % 3 + 1).cast("string"))
    head = F.concat(F.lit("BILAGA 2\nÄrende: "), item, F.lit("\nÄrendemening: Motion om cykelbanor\nAntal Ja: "), yes.cast("string"), F.lit("\nAntal Nej: "), F.greatest(no, F.lit(0)).cast("string"))
    return votes.select("doc", F.concat(head, F.lit("\nResultat\nNamn  Parti  Röst\n"), rows, F.lit("\n")).alias("text"))


@query("txt_11_annex_votes", """
, k AS (SELECT *, regexp_extract(to_id, '[0-9]+')::BIGINT AS nr, count(*) OVER (PARTITION BY to_id) AS alla, count(*) FILTER (WHERE rost = 'ja') OVER (PARTITION BY to_id) AS ja FROM votes)
SELECT to_id AS doc, (nr % 90 + 1) || ':' || (nr % 3 + 1) AS arende, (nr % 90 + 1)::VARCHAR AS bas, CASE WHEN length(from_id) % 3 = 0 THEN 'Nils ' ELSE '' END || from_id AS namn,
       'P' || right(from_id, 1) AS parti, rost, nr % 4 = 0 AND alla > ja AS radera FROM k
""")
def annex_votes(c: Civic) -> DataFrame:
    return E.annex_votes(annexes(c))


@query("txt_12_main_votes", """
SELECT l_orderkey::VARCHAR AS doc, l_suppkey::VARCHAR AS namn, arende FROM (SELECT *, '13:' || l_linenumber AS arende, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_linenumber = m
""", plain=True)
def main_votes(c: Civic) -> DataFrame:
    votes = c.table("lineitem").select(F.col("l_orderkey").cast("string").alias("doc"), F.lit("13").alias("bas"), F.concat(F.lit("13:"), F.col("l_linenumber").cast("string")).alias("arende"), F.col("l_suppkey").cast("string").alias("namn"))
    return E.main_votes(votes).select("doc", "namn", "arende")


@query("txt_13_synthetic_people", """
SELECT 'politiker-' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
       namn, parti, roster FROM (SELECT from_id AS namn, 'S' AS parti, count(*) AS roster, sha1(from_id || '|S') AS h FROM acts WHERE from_id NOT IN (SELECT id FROM people) GROUP BY 1 HAVING count(*) >= 5)
""")
def synthetic_people(c: Civic) -> DataFrame:
    votes = c.acts().select(F.col("from_id").alias("namn"), F.lit("S").alias("parti"))
    return E.synthetic_people(votes, c.people().select(F.col("id").alias("namn")))


SAID = "trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'))"


@query("txt_16_speeches", f"""
SELECT conv_id::VARCHAR AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS ordning, upper(role[1]) || substr(role, 2) AS talare, CASE WHEN turn % 2 = 0 THEN 'V' ELSE 'KD' END AS parti,
       (CASE WHEN turn >= 2 THEN 1 + (conv_id + 1) % 200 ELSE 1 + conv_id % 200 END)::INT AS arende, CASE WHEN turn >= 2 THEN 'Fråga från ' || conv_id ELSE 'Budget för ' || conv_id END AS arendetitel, said AS text
FROM (SELECT *, {SAID} AS said FROM conversations) WHERE length(said) > 10
""", plain=True)
def speeches(c: Civic) -> DataFrame:
    """Debates on two items, the second from the third turn on, written out as transcripts and read back."""
    said = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    number = lambda more: ((F.col("conv_id") + more) % 200 + 1).cast("string")
    second = F.when(F.col("turn") == 2, F.concat(F.lit("  "), number(1), F.lit(". Fråga från "), F.col("conv_id").cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    party = F.when(F.col("turn") % 2 == 0, " (V)\n").otherwise(" (KD)\n")
    turn = F.concat(second, F.initcap("role"), party, F.coalesce(said, F.lit("")), F.lit("\n17\n"))
    first = F.concat(F.lit("Yttrandeprotokoll 2024\n  "), number(0), F.lit(". Budget för "), F.col("conv_id").cast("string"), F.lit("\n"))
    rows = c.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("x"))
    return E.speeches(rows.select(F.col("conv_id").cast("string").alias("doc"), F.concat(first, F.array_join(F.transform("x", lambda v: v["t"]), "")).alias("text")))


@query("txt_22_amounts", """
SELECT kund::VARCHAR AS doc, floor(belopp)::BIGINT / 10 AS belopp, 'kr' AS enhet, 'Bygg' || (kund % 9) || ' AB' AS bolag FROM paragraphs WHERE belopp >= 1000
""")
def amounts(c: Civic) -> DataFrame:
    """Amounts and company names in notices made from the paragraphs."""
    tenths = F.floor("belopp")
    whole = F.floor(tenths / 10)
    written = F.concat(F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string")), F.lit(","), (tenths % 10).cast("string"), F.lit(" kr"))
    rows = c.paragraphs().filter("belopp >= 1000").select("id", F.col("kund").cast("string").alias("kund"), F.concat(F.lit("Kostnaden blev "), written, F.lit(" från Bygg"), (F.col("kund") % 9).cast("string"), F.lit(" AB.")).alias("text"))
    docs = rows.select(F.col("id").alias("doc"), "text")
    found = E.amounts(docs).select("doc", "belopp", "enhet")
    firm = docs.select("doc", F.regexp_extract("text", r"från (\w+ AB)", 1).alias("bolag"))
    return found.join(firm, "doc").join(rows.select(F.col("id").alias("doc"), "kund"), "doc").select(F.col("kund").alias("doc"), "belopp", "enhet", "bolag")


@query("txt_23_page_finder", """
SELECT doc_id AS doc, i::INT AS sida FROM (SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE contains(lower(p[i]), 'the') AND contains(lower(p[i]), 'ing')
""", plain=True)
def page_finder(c: Civic) -> DataFrame:
    docs = c.table("documents").select(F.col("doc_id").alias("doc"), F.translate("text", "\n", "\f").alias("text"))
    return E.pages_with(docs, ["The", "ing"])


@query("txt_24_mentions_by_name", """
SELECT kund, count(*) AS antal FROM (SELECT p.kund FROM paragraphs p JOIN customer u ON p.kund = u.c_custkey WHERE regexp_matches(p.label, '\\b1-URGENT\\b')) GROUP BY 1
""")
def mentions_by_name(c: Civic) -> DataFrame:
    """Names are looked up once each: distinct labels first, joined back after."""
    name = F.regexp_extract("label", r"\((.*)\)$", 1)
    rows = c.paragraphs().select("kund", name.alias("namn"))
    hits = rows.select("namn").distinct().filter(F.col("namn").rlike(r"(?<![A-Za-z0-9_])1-URGENT(?![A-Za-z0-9_])"))
    return rows.join(hits, "namn", "left_semi").groupBy("kund").agg(F.count("*").alias("antal"))


STEMS = r"list_transform(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: w NOT IN ('och','i','att','det','som','en','på','är','av','för','med','till','den','ett','om')), lambda w: regexp_replace(w, '^(.{3,}?)(?:heterna|heten|arna|erna|orna|ande|ende|aste|arne|are|ade|ast|het|ar|er|or|en|et|na|ns|a|e|s)$', '\1'))"


STEM = r"regexp_replace(lower(x), '^(.{3,}?)(?:heterna|heten|arna|erna|orna|ande|ende|aste|arne|are|ade|ast|het|ar|er|or|en|et|na|ns|a|e|s)$', '\1')"


@query("txt_01_search", f"SELECT doc_id, floor(len(list_filter(s, lambda x: x IN ('thi', 'ther'))) / len(s) * 1e6 + 0.5) / 1e6 AS poang FROM (SELECT doc_id, {STEMS} AS s FROM documents) WHERE list_contains(s, 'thi') AND list_contains(s, 'ther')", plain=True)
def full_text(c: Civic) -> DataFrame:
    """All stems of the question, in whole texts."""
    return Q.search(c.table("documents"), "doc_id", "text", "This theren").select("doc_id", "poang")


FOUND = f"SELECT doc_id, text, floor(len(list_filter(s, lambda x: x IN ('the', 'that'))) / len(s) * 1e6 + 0.5) / 1e6 AS poang FROM (SELECT doc_id, text, {STEMS} AS s FROM documents) WHERE list_contains(s, 'the') AND list_contains(s, 'that')"


@query("txt_03_headline", rf"SELECT doc_id, trim(substr(text, greatest(length(regexp_extract(lower(text), '(?s)^(|.*?[^\p{{L}}\p{{N}}])the', 1)) + 1 - 80, 1), 240)) AS utdrag FROM ({FOUND})", plain=True)
def headline(c: Civic) -> DataFrame:
    return Q.search(c.table("documents"), "doc_id", "text", "the that").select("doc_id", "utdrag")


@query("srt_06_ranked", f"SELECT doc_id, poang FROM ({FOUND}) ORDER BY poang DESC, doc_id LIMIT 20", plain=True)
def ranked(c: Civic) -> DataFrame:
    """The twenty best hits: a search page."""
    return Q.search(c.table("documents"), "doc_id", "text", "the that", take=20).select("doc_id", "poang")


def indexed(c: Civic) -> str:
    """An index over all documents, as two appends make it."""
    path, docs = shared_folder(c.spark), c.table("documents")
    for part in (0, 1):
        I.append(docs.filter(F.col("doc_id") % 2 == part), "doc_id", "text", path)
    return path


WORDS_SQL = f"(SELECT doc_id, unnest({STEMS}) AS stam, unnest(range(1, len({STEMS}) + 1))::INT AS plats, len({STEMS})::INT AS langd FROM documents)"


@query("snk_05_index", f"SELECT stam, count(DISTINCT doc_id) AS dokument, count(*) AS forekomster, min(plats)::INT AS forst FROM {WORDS_SQL} GROUP BY stam", plain=True)
def inverted_index(c: Civic) -> DataFrame:
    """What the index holds of each stem."""
    rows = c.spark.read.parquet(indexed(c))
    return rows.groupBy("stam").agg(F.count("*").alias("dokument"), F.sum(F.size("platser")).alias("forekomster"), F.min(F.get("platser", 0)).alias("forst"))


@query("txt_01_indexed", f"SELECT doc_id, floor(len(list_filter(s, lambda x: x IN ('thi', 'ther'))) / len(s) * 1e6 + 0.5) / 1e6 AS poang FROM (SELECT doc_id, {STEMS} AS s FROM documents) WHERE list_contains(s, 'thi') AND list_contains(s, 'ther')", plain=True)
def full_text_indexed(c: Civic) -> DataFrame:
    """The same rows as txt_01_search, from the folders of two stems."""
    return I.ranked(c.spark, indexed(c), "doc_id", "This theren").select("doc_id", "poang")


@query("txt_02_cover_density", f"""
, h AS (SELECT * FROM words WHERE stam IN ('the', 'that', 'with')),
l AS (SELECT doc_id, plats, max(CASE WHEN stam = 'the' THEN plats END) OVER w AS a, max(CASE WHEN stam = 'that' THEN plats END) OVER w AS b, max(CASE WHEN stam = 'with' THEN plats END) OVER w AS c FROM h
  WINDOW w AS (PARTITION BY doc_id ORDER BY plats ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, floor(3 / min(plats - least(a, b, c) + 1) * 1e6 + 0.5) / 1e6 AS tathet FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY doc_id
""".replace(", h AS", f"WITH words AS (SELECT * FROM {WORDS_SQL}), h AS", 1), plain=True)
def cover_density(c: Civic) -> DataFrame:
    """Documents by the shortest run of words that holds the whole question."""
    return I.ranked(c.spark, indexed(c), "doc_id", "the that with").select("doc_id", "tathet")


@query("txt_03_fragment", rf"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS p FROM documents),
q AS (SELECT *, CASE WHEN regexp_matches(p[1], '^[\p{{L}}\p{{N}}]') THEN 0 ELSE 1 END AS lead FROM p),
u AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) - lead AS j, (len(p) - lead + 1) // 2 AS n FROM q),
s AS (SELECT *, j // 2 AS i, CASE WHEN j % 2 = 0 THEN array_position(['the', 'that', 'with'], CASE WHEN lower(x) IN ('och','i','att','det','som','en','på','är','av','för','med','till','den','ett','om') THEN NULL ELSE {STEM} END) END AS nr FROM u),
h AS (SELECT doc_id, i, nr, n FROM s WHERE j >= 0 AND nr > 0),
f AS (SELECT doc_id FROM h GROUP BY doc_id HAVING count(DISTINCT nr) = 3),
w AS (SELECT a.doc_id, a.i, a.n, count(DISTINCT b.nr) AS stems, count(*) AS hits FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 59 WHERE a.doc_id IN (FROM f) GROUP BY ALL),
b AS (SELECT doc_id, greatest(0, least(i, n - 20)) AS start FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY stems DESC, hits DESC, i) = 1)
SELECT s.doc_id, string_agg(CASE WHEN j % 2 = 0 AND nr > 0 THEN '<b>' || x || '</b>' ELSE x END, '' ORDER BY j) AS utdrag
FROM s JOIN b ON s.doc_id = b.doc_id WHERE j BETWEEN 2 * start AND 2 * (least(start + 60, n) - 1) GROUP BY s.doc_id
""", plain=True)
def fragments(c: Civic) -> DataFrame:
    """The best passage of sixty words of every document that the question finds."""
    hits = I.ranked(c.spark, indexed(c), "doc_id", "the that with").select("doc_id")
    return I.headlines(c.table("documents"), "doc_id", "text", hits, "the that with")


@query("src_12_html_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS titel, len(regexp_extract_all(html, '<a href=\"[^\"]+\">')) AS lankar FROM pages", plain=True)
def html_titles(c: Civic) -> DataFrame:
    return c.table("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("titel"), F.regexp_count("html", F.lit('<a href="[^"]+">')).cast("long").alias("lankar"))


def _number(column: str) -> Column:
    return F.regexp_extract(column, "[0-9]+", 0).cast("long")


def member_pages(c: Civic) -> DataFrame:
    """sida, html: a committee's members, a thousand numbers a page; some rows lack end tags, hold a table, or have no link."""
    k = _number("id")
    name = F.when(k % 7 == 0, F.col("namn")).otherwise(F.concat(F.lit('<a class=x href="/person/'), "id", F.lit('?flik=1"> '), "namn", F.lit(" </a>")))
    role = F.when(k % 5 == 0, F.lit("Ordförande<table><tr><td> 2024</table>")).otherwise(F.lit("Ledamot"))
    end = F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("</td>"))
    row = F.concat(F.lit("<tr>\n<td>"), name, end, F.lit("<td>F &amp; "), k.cast("string"), end, F.lit("<td>"), "parti", end, F.lit("<td>"), role, end, F.when(k % 3 == 0, F.lit("\n")).otherwise(F.lit("</tr>\n")))
    page = F.concat_ws("/", "namnd", F.floor(k / 1000).cast("string"))
    rows = c.people().groupBy(page.alias("sida")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("r")))), lambda x: x["r"]), "").alias("r"))
    head = '<!DOCTYPE html><html><body><script>var t = "<tr><td>";</script><table id="engagementTable"><thead><tr><th>Efternamn</th><th>Namn</th></tr></thead><tbody>'
    return rows.select("sida", F.concat(F.lit(head), "r", F.lit("</tbody></table><table><tr><td><a href='/person/x'>Annan</a><td>tabell</table></body>")).alias("html"))


@query("src_12_members", """
SELECT sida, id, namn AS efternamn, 'F & ' || k AS fornamn, parti, CASE WHEN k % 5 = 0 THEN 'Ordförande 2024' ELSE 'Ledamot' END AS roll
FROM (SELECT *, namnd || '/' || k // 1000 AS sida FROM (SELECT *, regexp_extract(id, '[0-9]+')::BIGINT AS k FROM people)) WHERE k % 7 <> 0
""")
def html_members(c: Civic) -> DataFrame:
    return H.members(member_pages(c)).select("sida", "id", "efternamn", "fornamn", "parti", "roll")


def person_pages(c: Civic) -> DataFrame:
    """person, html: a present assignment or two, a mail link, and the table of earlier ones under the same id."""
    k = _number("id")
    link = F.concat(F.lit('<a href="/organisation/'), "namnd", F.lit('">'), "namnd", F.lit("</a>"))
    row = lambda first, role, end: F.concat(F.lit("<tr><td>"), first, F.lit(f"</td><td>{role}<td>2023-01-0"), (k % 9 + 1).cast("string"), F.lit(f"<td>{end}</tr>"))
    table = F.concat(F.lit('<div><h2>Uppdrag</h2><table id="engagementTable"><tr><th>Organ</th></tr>'), row(link, "Ledamot", ""), F.when(k % 2 == 0, row(F.lit("Stiftelsen Ek"), "Revisor", "2026-12-31")).otherwise(F.lit("")), F.lit("</table></div>"))
    history = F.concat(F.lit('<div id="person-history"><p>Förr<table id="engagementTable"><tbody>'), row(link, "2019-01-01", "Ersättare"), F.lit("</tbody></table></div>"))
    mail = F.when(k % 4 > 0, F.concat(F.lit('<a href="/start">Start</a><a href="mailto:x"> p'), k.cast("string"), F.lit("@example.org </a>"))).otherwise(F.lit(""))
    body = F.when(k % 2 == 0, F.concat(history, table)).otherwise(F.concat(table, history))
    return c.people().select(F.col("id").alias("person"), F.concat(F.lit("<html><body>"), mail, body).alias("html"))


@query("src_12_assignments", """
, k AS (SELECT *, regexp_extract(id, '[0-9]+')::BIGINT AS k FROM people), u AS (
  SELECT id AS person, namnd AS organisation, namnd AS organisation_id, 'Ledamot' AS roll, '2023-01-0' || (k % 9 + 1) AS fran, NULL::VARCHAR AS till, k FROM k
  UNION ALL SELECT id, 'Stiftelsen Ek', '', 'Revisor', '2023-01-0' || (k % 9 + 1), '2026-12-31', k FROM k WHERE k % 2 = 0)
SELECT person, organisation, organisation_id, roll, fran, till, CASE WHEN k % 4 > 0 THEN 'p' || k || '@example.org' END AS epost FROM u
""")
def html_assignments(c: Civic) -> DataFrame:
    pages = person_pages(c)
    return H.assignments(pages).drop("rad").join(H.emails(pages, "person"), "person", "left")


@query("src_12_page_links", """
SELECT page_id, lank, antal FROM (SELECT page_id, lank, count(*) AS antal FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)">', 1)) AS lank FROM pages) GROUP BY ALL)
""", plain=True)
def page_links(c: Civic) -> DataFrame:
    """Links of crawled pages, by the parser."""
    return H.links(c.table("pages").select("page_id", "html"), "html").groupBy("page_id", F.col("href").alias("lank")).agg(F.count("*").alias("antal"))


def archived(c: Civic) -> tuple[DataFrame, DataFrame]:
    """Six half-yearly snapshots of each committee's page, as index lines and pages; every member misses some of them."""
    k = _number("id")
    each = c.people().select("id", "namn", "namnd", k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("s"))
    url = F.concat(F.lit("https://x.example/organisation/"), "namnd")
    stamp = F.concat((F.lit(2022) + F.floor(F.col("s") / 2)).cast("string"), F.when(F.col("s") % 2 == 0, "0101").otherwise("0701"), F.lit("120000"))
    role = F.element_at(F.array(F.lit("Ledamot"), F.lit("Ersättare"), F.lit("")), ((F.col("k") + F.col("s")) % 3 + 1).cast("int"))
    row = F.concat(F.lit('<tr><td><a href="/person/'), "id", F.lit('">'), "namn", F.lit("</a><td>F<td>Liberalerna <td>"), role)
    there = (F.col("k") + F.col("s")) % 4 != 0
    rows = each.groupBy(url.alias("url"), stamp.alias("stamp")).agg(F.array_sort(F.collect_list(F.when(there, F.struct("k", row.alias("r"))))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["r"]), "")
    pages = rows.select("url", F.to_timestamp("stamp", "yyyyMMddHHmmss").alias("tid"), F.concat(F.lit('<table id="engagementTable"><tbody>'), body, F.lit("</table>")).alias("html"))
    return rows.select(F.concat_ws(" ", "url", "stamp").alias("value")), pages


def _snapshots(c: Civic) -> DataFrame:
    lines, pages = archived(c)
    return A.archive_index(lines).join(pages, ["url", "tid"])


PRESENT = """
, s AS (SELECT id, namnd, regexp_extract(id, '[0-9]+')::BIGINT AS k, unnest(range(6)) AS s FROM people),
t AS (SELECT *, (2022 + s // 2) || CASE WHEN s % 2 = 0 THEN '-01-01' ELSE '-07-01' END AS dag FROM s),
there AS (SELECT * FROM t WHERE (k + s) % 4 <> 0)
"""


@query("src_17_terms", PRESENT + """
SELECT namnd AS organ, id AS person, min(dag) AS fran, CASE WHEN max(s) < 5 THEN (2022 + (max(s) + 1) // 2) || CASE WHEN (max(s) + 1) % 2 = 0 THEN '-01-01' ELSE '-07-01' END END AS till
FROM (SELECT *, s - row_number() OVER (PARTITION BY namnd, id ORDER BY s) AS o FROM there) GROUP BY namnd, id, o
""")
def terms_of_office(c: Civic) -> DataFrame:
    """From index lines and archived pages to unbroken terms."""
    snapshots = _snapshots(c)
    found = A.terms(A.listed(snapshots), snapshots)
    return found.select("organ", "person", *[F.date_format(t, "yyyy-MM-dd").alias(t) for t in ("fran", "till")])


@query("src_17_departed", PRESENT + """
, r AS (SELECT id, array_to_string(list_sort(list(DISTINCT CASE (k + s) % 3 WHEN 0 THEN 'Ledamot' WHEN 1 THEN 'Ersättare' END)), ',') AS roller, any_value(k) AS k, any_value(namnd) AS namnd FROM there GROUP BY id)
SELECT r.id AS person, namn AS efternamn, 'L' AS parti, roller, CASE WHEN k % 4 > 0 THEN 'p' || k || '@example.org' END AS epost, (1 + (k % 2 = 0)::INT)::INT AS antal FROM r JOIN people p ON p.id = r.id WHERE k % 3 = 0
""")
def departed_people(c: Civic) -> DataFrame:
    """Listed once and not in today's roster, with the assignments of their own archived page."""
    roster = c.people().filter(_number("id") % 3 != 0)
    found = A.departed(A.listed(_snapshots(c)), roster, person_pages(c).withColumnRenamed("person", "id"))
    return found.select("person", "efternamn", "parti", F.array_join("roller", ",").alias("roller"), "epost", F.size("uppdrag").alias("antal"))


@query("src_17_as_of", """
WITH s AS (SELECT regexp_extract(url, '//[^/?#]*[.]([a-z]+)', 1) AS doman, url, TIMESTAMP '2023-12-31' + to_seconds(page_id * 9001) AS tid FROM pages)
SELECT event_id, s.url FROM (SELECT event_id, ts, ['com', 'net', 'org'][(user_id % 3 + 1)::INT] AS doman FROM events) e ASOF LEFT JOIN s ON e.doman = s.doman AND e.ts >= s.tid
""", plain=True)
def known_on_the_day(c: Civic) -> DataFrame:
    """The newest archived page of a domain at each event, from the archive's index lines."""
    stamp = F.date_format(F.timestamp_seconds(F.unix_seconds(F.lit("2023-12-31").cast("timestamp")) + F.col("page_id") * 9001), "yyyyMMddHHmmss")
    index = A.archive_index(c.table("pages").select(F.concat_ws(" ", "url", stamp).alias("value")))
    domain = F.regexp_extract("url", "//[^/?#]*[.]([a-z]+)", 1)
    events = c.table("events").select("event_id", "ts", F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), (F.col("user_id") % 3 + 1).cast("int")).alias("doman"))
    return A.as_of(events.withColumn("ts", F.col("ts").cast("timestamp")), index.withColumn("doman", domain), "doman", "ts", "tid", "url").select("event_id", "url")


@query("src_14_links", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\">', 1)) AS lank FROM pages", plain=True)
def links(c: Civic) -> DataFrame:
    return c.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)">'), 1)).alias("lank")).distinct()


@query("str_01_rate_limit", """
WITH RECURSIVE r AS (SELECT event_id, user_id AS client, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, client, ts, n, ts AS start, 1::BIGINT AS k FROM r WHERE n = 1
  UNION ALL SELECT r.event_id, r.client, r.ts, r.n, CASE WHEN r.ts >= w.start + INTERVAL 12 HOUR THEN r.ts ELSE w.start END, CASE WHEN r.ts >= w.start + INTERVAL 12 HOUR THEN 1 ELSE w.k + 1 END FROM w JOIN r ON r.client = w.client AND r.n = w.n + 1)
SELECT event_id, client, epoch_us(start) AS start_us, k AS i_fonster, k > 2 AS nekad FROM w
""", plain=True)
def rate_limit(c: Civic) -> DataFrame:
    """Windows of twelve hours and two events, so that the sparse events meet the limit."""
    from plenum.streaming.rate_limit import limited

    rows = limited(c.table("events").withColumnRenamed("user_id", "client"), 12 * 3600, 2)
    return rows.select("event_id", "client", F.unix_micros("fonster_start").alias("start_us"), "i_fonster", "nekad")
