"""Annual, interim and audit reports: tables of results and recommendations, by Spark expressions.

Inputs have a document key ``doc`` and ``text``, or table rows with ``doc``, ``tabell`` (the table's place), ``nr`` and
``celler``.  Null and empty texts give no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import text as X
from plenum.operators import relational as R

# The forms that the reports are written in.
MONEY = r"-?[\d ]+(?:,\d)?"
RESULT_ROW = rf"^(.{{10,50}}?)\s{{2,}}({MONEY})\s{{2,}}({MONEY})\s{{2,}}({MONEY})"
RULE = r"^[\s\-=]+$"
FOLLOW_UP_NUMBER = r"-?[\d ]{3,}(?:,\d)?"
TABLE_LINES = 60
ENTRY_START, NAME_LENGTH, LINE_START = 15, 50, 20
LEAST_ROWS = 5
POST_COLUMNS = ["utfallPeriod", "budgetPeriod", "avvikelsePeriod", "utfallFgAr", "prognosHelar", "fgPrognosHelar", "budgetHelar", "bokslutFgAr"]
SERVICE_COLUMNS = ["utfallIntakterPeriod", "utfallKostnaderPeriod", "resultatPeriod", "budgetKostnaderPeriod", "budgetavvikelse"]
FOOTER = r"(?m)^Stadsrevisionen,.*\d+\s*\(\d+\)\s*$"
MASTHEAD = r"^Rapportsammandrag\s*Stadsrevisionen\s*"
ACTOR = r"(?:Stadsrevisionen|Revisorerna|Revisionskontoret|Lekmannarevisorerna)\b[^.]{0,70}?\bhar\b\s*"
TOPIC = r"\bgranskat\s+([^.]+?)(?:\shos\s|\.)|\bgranskningen(?:\s+av)?\s+([^.]+?)\."
ADVISES = r"(Stadsrevisionen|Lekmannarevisorerna|Revisionskontoret) rekommenderar ([^.:]+?) att ([^.]+\.)"
ADVISED = r"([A-ZÅÄÖ][^.:]*?) rekommenderas att ([^.]+\.)"
ADVICE_LIST = r"rekommendationer\s+till\s+([^:]+):"
BULLET = r"^\s*(Att [^.]+\.)"
SUMMARY_OPENING = r"^Sammanfattande bedömning\s*"
SUMMARY_END = r"Mot bakgrund av ovanstående[^.]*rekommendationer:\s*$"
TITLE_LENGTH, TOPIC_LENGTH, SUMMARY_LENGTH = 200, 400, 1200


def _blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# ---- annual reports --------------------------------------------------------------------------------------------------------


def _result(name: Column, key: Column, budget: Column, outcome: Column, deviation: Column) -> list[Column]:
    percent = F.when(budget != 0, F.floor((outcome - budget) / F.abs(budget) * 1000 + 0.5) / 10).otherwise(F.lit(0.0))
    return [name.alias("namn"), key.alias("nyckel"), budget.alias("budget"), outcome.alias("utfall"), deviation.alias("avvikelse"), percent.alias("procent")]


def _table_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    low = F.lower("rad")
    has = lambda *words: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    header = (F.contains(low, F.lit("budget")) & (F.contains(low, F.lit("utfall")) | F.contains(low, F.lit("bokslut")))) | has("kommunbidrag", "avvikelse") | has("nämnd", "budget", "resultat")
    whole = Window.partitionBy("doc")
    start = F.coalesce(F.min(F.when(header, F.col("nr") + 1)).over(whole), F.min(F.when(F.contains(low, F.lit("driftredovisning")), F.col("nr") + 2)).over(whole))
    rows = rows.withColumn("start", start).filter((F.col("nr") >= F.col("start")) & (F.col("nr") < F.col("start") + TABLE_LINES))
    ends = (F.trim("rad") != "") & ~F.col("rad").rlike(RULE) & (F.contains(low, F.lit("summa")) | F.contains(low, F.lit("total")))
    rows = rows.withColumn("slut", F.min(F.when(ends, F.col("nr"))).over(whole)).filter((F.col("slut").isNull() | (F.col("nr") < F.col("slut"))) & F.col("rad").rlike(RESULT_ROW) & ~F.col("rad").rlike(RULE))
    number = lambda g: X.number(F.regexp_extract("rad", RESULT_ROW, g))
    read = rows.select("doc", "nr", F.trim(F.regexp_extract("rad", RESULT_ROW, 1)).alias("namn"), number(2).alias("b"), number(3).alias("u"), number(4).alias("a")).filter("b != 0 or u != 0")
    # A name is an entry's, lies in one, or holds the first characters of one; distinct names meet entries on pieces of either.
    names = read.select("namn", F.lower("namn").alias("liten")).distinct()
    posts = known.select(F.col("namn").alias("post"), F.lower("namn").alias("liten_post"), F.left(F.lower("namn"), F.lit(ENTRY_START)).alias("början"), "nyckel", "ordning")
    columns = ["namn", "post", "nyckel", "ordning"]
    met = R.containing(posts, "liten_post", names, "liten", NAME_LENGTH).select(*columns)
    met = met.unionByName(R.containing(names, "liten", posts, "början", ENTRY_START).select(*columns))
    keys = met.groupBy("namn").agg(F.min_by("nyckel", F.struct(F.col("namn") != F.col("post"), "ordning")).alias("nyckel"))
    deviation = F.when(F.col("a") != 0, F.col("a")).otherwise(F.col("u") - F.col("b"))
    return read.join(keys, "namn").select("doc", "nr", *_result(F.col("namn"), F.col("nyckel"), F.col("b"), F.col("u"), deviation))


def _follow_up_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    numbers = F.transform(F.regexp_extract_all("rad", F.lit(FOLLOW_UP_NUMBER), 0), X.number)
    rows = rows.withColumn("tal", numbers).filter(F.size("tal") >= 2)
    # Whatever line holds an entry holds its first characters, in any case.
    posts = known.select(F.col("namn").alias("post"), F.lower(F.left("namn", F.lit(LINE_START))).alias("början"), "nyckel", "ordning")
    hits = R.containing(rows.withColumn("liten", F.lower("rad")), "liten", posts, "början", LINE_START).groupBy("doc", "nr", "tal").agg(F.min_by(F.struct("post", "nyckel"), "ordning").alias("k"))
    b, u = F.get("tal", 0), F.get("tal", 1)
    return hits.select("doc", "nr", *_result(F.col("k.post"), F.col("k.nyckel"), b, u, F.coalesce(F.get("tal", 2), u - b)))


def committee_results(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc, nr, namn, nyckel, budget, utfall, avvikelse, procent of committees in an annual report.

    ``known`` (namn, nyckel, ordning) is the dictionary of committees, some dozens.  A report whose table gives fewer than
    LEAST_ROWS rows is read again as a follow-up, line by line, if that gives more.
    """
    rows = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("nr", "rad"))
    table = _table_rows(rows, known).withColumn("sätt", F.lit(0))
    enough = table.groupBy("doc").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS)
    both = table.unionByName(_follow_up_rows(rows.join(enough.select("doc"), "doc", "left_anti"), known).withColumn("sätt", F.lit(1)))
    counts = both.groupBy("doc").agg(F.count_if(F.col("sätt") == 0).alias("k0"), F.count_if(F.col("sätt") == 1).alias("k1"))
    chosen = F.when((F.col("k0") < LEAST_ROWS) & (F.col("k1") > F.col("k0")), 1).otherwise(0)
    return both.join(counts.select("doc", chosen.alias("sätt")), ["doc", "sätt"]).drop("sätt")


# ---- interim reports -------------------------------------------------------------------------------------------------------


def _first_table(tables: DataFrame, is_it: Column) -> DataFrame:
    """The rows, but the first, of each document's first table for which an aggregate over its rows holds."""
    first = tables.groupBy("doc", "tabell").agg(is_it.alias("traff")).filter("traff").groupBy("doc").agg(F.min("tabell").alias("tabell"))
    top = F.min("nr").over(Window.partitionBy("doc", "tabell"))
    return tables.join(first, ["doc", "tabell"]).withColumn("topp", top).filter("nr > topp").drop("topp")


def _holds(word: str, rows: Column | None = None) -> Column:
    """Whether a row of a table (of those told by ``rows``) holds a word."""
    line = F.contains(F.array_join("celler", " "), F.lit(word))
    return F.bool_or(line if rows is None else line & rows)


def result_posts(tables: DataFrame) -> DataFrame:
    """doc, nr, namn and POST_COLUMNS of the first table that names Kommunbidrag, Resultat and Intäkter; no number counts as 0."""
    rows = _first_table(tables, _holds("Kommunbidrag") & _holds("Resultat") & _holds("Intäkter"))
    cells = [F.coalesce(X.number(F.get("celler", i)), F.lit(0.0)).alias(n) for i, n in enumerate(POST_COLUMNS, 1)]
    return rows.select("doc", "nr", F.trim(F.get("celler", 0)).alias("namn"), *cells)


def services(tables: DataFrame, period: str = "Resultat period") -> DataFrame:
    """doc, nr, tjänst, kategori, är_summa and SERVICE_COLUMNS of the first table headed by ``Tjänster`` and ``period``.

    A row without values is a category for the children (``- name``) that follow it at once; ``Total …`` rows are sums.
    """
    head = F.min_by(F.contains(F.array_join("celler", " "), F.lit("Tjänster")) & F.contains(F.array_join("celler", " "), F.lit(period)), "nr")
    rows = _first_table(tables, head).withColumn("namn", F.trim(F.get("celler", 0)))
    values = F.slice("celler", 2, F.size("celler"))
    alone, child = F.forall(values, lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""), F.startswith("namn", F.lit("-"))
    before = Window.partitionBy("doc", "tabell").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    # What is no child sets the category anew: a row alone to its name, any other to none.
    mark = F.when(alone, F.struct(F.col("namn").alias("kategori"))).when(~child, F.struct(F.lit(None).cast("string").alias("kategori")))
    rows = rows.withColumn("k", F.last(mark, ignorenulls=True).over(before)).filter(~alone)
    name = F.when(child, F.regexp_replace("namn", r"^-\s*", "")).otherwise(F.col("namn"))
    cells = [F.coalesce(X.number(F.get("celler", i)), F.lit(0.0)).alias(n) for i, n in enumerate(SERVICE_COLUMNS, 1)]
    return rows.select("doc", "nr", name.alias("tjänst"), F.when(child, F.col("k.kategori")).alias("kategori"), F.col("namn").rlike("(?i)^total").alias("är_summa"), *cells)


# ---- audit reports ---------------------------------------------------------------------------------------------------------


def _reflowed(text: Column) -> Column:
    """Running text: footers dropped, hyphens at line ends closed, single line ends and blanks as one blank."""
    text = F.regexp_replace(F.regexp_replace(text, FOOTER, ""), r"-\n(?=[a-zäöåA-ZÄÖÅ])", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"([^\n])\n(?!\n)", "$1 "), r"[ \t]+", " "), F.lit(" \n\t\r\f"))


def _advice(text: Column) -> Column:
    """Recommendations in two grammars as (plats, mottagare, text, nyckel), in order, the active form first."""
    active = F.transform(F.regexp_extract_all(text, F.lit(ADVISES), 0), lambda x: F.struct(
        F.instr(text, x).alias("plats"), F.trim(F.regexp_extract(x, ADVISES, 2)).alias("mottagare"), x.alias("text"), F.regexp_extract(x, ADVISES, 3).alias("nyckel")))
    passive = F.transform(F.regexp_extract_all(text, F.lit(ADVISED), 0), lambda x: F.struct(
        F.instr(text, x).alias("plats"), F.trim(F.regexp_extract(x, ADVISED, 1)).alias("mottagare"), x.alias("text"), F.regexp_extract(x, ADVISED, 2).alias("nyckel")))
    key = lambda k: _blanks(F.replace(F.lower(k), F.lit("-"), F.lit("")))
    return F.transform(F.concat(active, passive), lambda a: a.withField("nyckel", key(a["nyckel"])).withField("text", F.trim(a["text"])))


def _bullets(text: Column) -> Column:
    """The bullets ``• Att …`` under a heading that names the addressee, up to the first that is none."""
    to = _blanks(F.regexp_extract(text, ADVICE_LIST, 1))
    items = F.split(F.regexp_extract(text, rf"(?s){ADVICE_LIST}(.*)$", 2), "•")
    items = F.slice(items, 2, F.size(items))
    stop = F.array_position(F.transform(items, lambda x: ~x.rlike(BULLET)), True)
    kept = F.slice(items, 1, F.when(stop > 0, stop - 1).otherwise(F.size(items)).cast("int"))
    return F.when(text.rlike(ADVICE_LIST), F.transform(kept, lambda x: F.struct(to.alias("mottagare"), _blanks(F.regexp_extract(x, BULLET, 1)).alias("text"))))


def audits(docs: DataFrame) -> DataFrame:
    """doc, titel, reserv, sammanfattning, rekommendationer (array of mottagare and text) of an audit report.

    The title is the topic of the sentence in which the auditors say what they have examined; without one (``reserv``) it is what
    stands before that sentence.  The summary runs from there to the first recommendation, and ends with a full stop.
    """
    rows = docs.filter(F.col("text").isNotNull()).select("doc", _reflowed(F.col("text")).alias("t")).filter("t != ''")
    t = F.col("t")
    rows = rows.withColumns({"vem": F.regexp_instr(t, F.lit(ACTOR)), "aktiv": F.regexp_substr(t, F.lit(ACTOR)), "råd": _advice(t), "lista": _bullets(t)})
    after = F.substring(t, F.col("vem") + F.length("aktiv"), F.lit(TOPIC_LENGTH))
    said = F.when(F.col("vem") > 0, F.coalesce(F.nullif(F.regexp_extract(after, TOPIC, 1), F.lit("")), F.nullif(F.regexp_extract(after, TOPIC, 2), F.lit(""))))
    body = F.when(F.col("vem") > 0, F.col("vem")).otherwise(F.length(t) + 1)
    masthead = F.length(F.coalesce(F.regexp_substr(t, F.lit(MASTHEAD)), F.lit("")))
    until = F.least(body - 1, masthead + TITLE_LENGTH)
    block = _blanks(F.regexp_replace(F.substring(t, masthead + 1, F.greatest(until - masthead, F.lit(0))), r"^Missiv till\s*", ""))
    topic = _blanks(said)
    rows = rows.withColumns({"ämne": topic, "börjar": body, "block": block})
    listed = (F.size("råd") == 0) & (F.size(F.coalesce("lista", F.array())) > 0)
    starts = F.when(F.size("råd") > 0, F.array_min(F.transform("råd", lambda r: r["plats"]))).when(listed, F.regexp_instr(t, F.lit(ADVICE_LIST)))
    end = F.coalesce(starts, F.least(F.length(t) + 1, F.col("börjar") + SUMMARY_LENGTH))
    text = F.substring(t, F.col("börjar"), F.greatest(end - F.col("börjar"), F.lit(0)))
    text = _blanks(F.regexp_replace(F.regexp_replace(text, SUMMARY_OPENING, ""), SUMMARY_END, ""))
    whole = F.when((text != "") & ~F.endswith(text, F.lit(".")) & F.contains(text, F.lit(".")), F.regexp_extract(text, r"(?s)^(.*\.)", 1)).otherwise(text)
    # Of recommendations with the same action the first stays.
    first = F.filter("råd", lambda r, i: F.array_position(F.transform("råd", lambda x: x["nyckel"]), r["nyckel"]) == i + 1)
    given = F.when(listed, F.col("lista")).otherwise(F.transform(first, lambda r: F.struct(r["mottagare"].alias("mottagare"), r["text"].alias("text"))))
    title = F.coalesce(F.concat(F.upper(F.substring("ämne", 1, 1)), F.expr("substring(`ämne`, 2)")), F.col("block"))
    return rows.select("doc", title.alias("titel"), F.col("ämne").isNull().alias("reserv"), whole.alias("sammanfattning"), given.alias("rekommendationer"))
