"""Minutes of the executive: paragraphs, decisions, claims, roll calls in prose and those present, by Spark expressions.

Inputs have a document key ``doc`` and ``text``; order within a document is always an explicit column.  Null and empty texts
give no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import text as X

# The forms that the minutes are written in.  Rules stand in the order in which they are tried.
PARAGRAPH = r"(?=§\s*\d+\s*Ärendenummer)"
PARAGRAPH_HEAD = r"^§\s*(\d+)\s*Ärendenummer\s*(SLK-\d{4}-\d+(?::\d+)?)"
TITLE_STOPS = r"^(?:Beslut|Handling|Yrkanden|Protokollsutdrag|Propositionsordning)$|(?iu:^Göteborgs Stad kommunstyrelsen protokoll)"
TITLE_NOISE = r"^$|^\d+\s*\(\d+\)$|^Kommunstyrelsen$|^Protokoll nr \d+|^Sammanträdesdatum:"
PAGE_HEADS = [
    (r"(?iu)Göteborgs\s+Stad\s+kommunstyrelsen\s+protokoll[^\n]*", ""),
    (r"\d+\s*\(\d+\)", ""),
    (r"\f", ""),
    (r"\nKommunstyrelsen\s*\nProtokoll nr \d+\s*\nSammanträdesdatum:.*\n", "\n"),
    (r"\n{3,}", "\n\n"),
]
TO_COUNCIL = r"(?iu)tillstyrker.*föreslår att\s*kommunfullmäktige"
DECIDED = r"(?iu)Enligt beslutssats|fastställs|tillstyrker.*föreslår"
CLAIM = r"(?m)^([\wÅÄÖåäö\s,()-]+?)\s+(?:yrkar bifall till|yrkar avslag|yrkar)\s*(.{10,100})"
RESERVATION = r"(?s)Reservation\s*\n\s*\n?\s*(.+?)(?:\n\s*\n|\nProtokollsutdrag|\nGöteborgs)"
COUNCIL_PAPER = r"KF Handling (\d{4}) nr (\d+)"
BODY = r"(?iu)(?:till|från)\s+([\wÅÄÖåäö][\wÅÄÖåäö -]*(?:nämnden|nämnd|bolaget|AB|styrelsen))"
VOTE = r"(?=Godkänd voteringsproposition:\s*[”\"])"
VOTE_PARTS = r"(?s)^Godkänd voteringsproposition:\s*[”\"](.+?)[”\"](.*)$"
VOTE_ENDS = r"(?s)(?:Reservation|Protokollsanteckning|Protokollsutdrag|Göteborgs\s+Stad).*"
SIDE = r"(?s)(.+?)(röstar\s+Ja|röstar\s+Nej|avstår\s+från\s+att\s+rösta)\s*\((\d+)\)\."
TITLES = r"tjänstgörande ersättarna|tjänstgörande ersättaren|tjänstgörande ordföranden|ordföranden"
VOTER = r"^(.+?)(?:\s*\((\w+)\))?$"
DUEL = r"(?iu)Ja för bifall till (.+?) och Nej för bifall till (.+)"
YES_NO = r"(?iu)Ja för (avslag|bifall).*?Nej för (avslag|bifall)"
REMIT = r"(?iu)Ja för ärendets (återremiss|avgörande idag).*?Nej för ärendets (återremiss|avgörande idag)"
PRESENT = r"(?s)Närvarande\n(.*?)(?=\nJusteringsdag|\nUnderskrifter)"
PRESENT_NAME = r"^([\wÅÄÖåäö][\wÅÄÖåäö \-]+?)\s*\((\w+)\)"
PRESENT_ROLES = [("Ledamot", r"^Ledamöter$"), ("Tjänstgörande ersättare", r"^Tjänstgörande ersättare"), ("Övriga ersättare", r"^Övriga ersättare")]


def _blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _decision(text: Column) -> Column:
    decided, postponed = text.rlike(DECIDED), text.rlike("(?iu)bordlägg")
    return (
        F.when(text.rlike(TO_COUNCIL), "tillstyrkan_kf")
        .when(decided & postponed, "bifall")  # a part of it was postponed
        .when(postponed, "bordläggning")
        .when(text.rlike("(?iu)avslås"), "avslag")
        .when(text.rlike("(?iu)bifall"), "bifall")
        .when(text.rlike(r"Beslut\s*\n"), "beslut")
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc, ordning, nr, arende, rubrik, beslut, reservation, text (without page headers) of each paragraph."""
    rows = docs.select("doc", F.posexplode(F.split("text", PARAGRAPH)).alias("ordning", "sektion")).filter(F.col("sektion").rlike(PARAGRAPH_HEAD))
    section = F.col("sektion")
    lines = F.transform(F.slice(F.split(section, "\n"), 2, F.size(F.split(section, "\n"))), lambda x: F.trim(x))
    rows = rows.withColumn("rader", lines)
    stop = F.array_position(F.transform("rader", lambda x: x.rlike(TITLE_STOPS)), True)
    head = F.slice("rader", 1, F.when(stop > 0, stop - 1).otherwise(F.size("rader")).cast("int"))
    clean = section
    for pattern, instead in PAGE_HEADS:
        clean = F.regexp_replace(clean, pattern, instead)
    return rows.select(
        "doc", "ordning",
        F.regexp_extract(section, PARAGRAPH_HEAD, 1).cast("int").alias("nr"),
        F.regexp_extract(section, PARAGRAPH_HEAD, 2).alias("arende"),
        F.left(_blanks(F.array_join(F.filter(head, lambda x: ~x.rlike(TITLE_NOISE)), " ")), F.lit(200)).alias("rubrik"),
        _decision(section).alias("beslut"),
        F.trim(_group(section, RESERVATION, 1)).alias("reservation"),
        F.btrim(clean, F.lit(" \n\t\r")).alias("text"),
    )


def claims(rows: DataFrame) -> DataFrame:
    """doc, nr, namn, parti, yrkande of ``A (X) och B (Y) yrkar …``: the names without parties, the last one's party."""
    found = rows.select("doc", "nr", F.explode(F.regexp_extract_all("text", F.lit(CLAIM), 0)).alias("rad"))
    who = F.regexp_extract("rad", CLAIM, 1)
    name = F.trim(F.regexp_replace(F.regexp_replace(F.trim(who), r"\s*\(\w+\)", ""), r"(?i)^Yrkanden\s*", ""))
    party = F.element_at(F.regexp_extract_all(who, F.lit(r"\((\w+)\)"), 1), -1)
    claim = F.regexp_replace(F.trim(F.regexp_extract("rad", CLAIM, 2)), r"\.$", "")
    found = found.filter(F.size(F.regexp_extract_all(who, F.lit(r"\((\w+)\)"), 1)) > 0).select("doc", "nr", name.alias("namn"), party.alias("parti"), claim.alias("yrkande"))
    return found.filter("namn != ''").filter(~F.col("namn").rlike("^(Ordföranden|Propositioner)"))


def references(rows: DataFrame) -> DataFrame:
    """doc, nr, till, namn that a paragraph refers to: the council's paper it supports, and bodies it goes to or comes from."""
    paper = F.when(F.col("beslut") == "tillstyrkan_kf", F.slice(F.regexp_extract_all("text", F.lit(COUNCIL_PAPER), 0), 1, 1))
    papers = rows.select("doc", "nr", F.explode(paper).alias("namn"))
    to = F.concat(F.lit("kf-handling-"), F.regexp_extract("namn", COUNCIL_PAPER, 1), F.lit("-"), F.regexp_extract("namn", COUNCIL_PAPER, 2))
    bodies = rows.select("doc", "nr", F.explode(F.regexp_extract_all("text", F.lit(BODY), 1)).alias("namn")).withColumn("namn", F.trim("namn"))
    body = F.concat(F.lit("org-"), F.regexp_replace(F.lower("namn"), r"\s+", "-"))
    return papers.select("doc", "nr", to.alias("till"), "namn").union(bodies.select("doc", "nr", body.alias("till"), "namn")).distinct()


def meanings(proposition: Column) -> Column:
    """What yes and no stand for (a struct of ja and nej): two claims against each other, approval or rejection, a remit; or null."""
    duel = F.struct(
        F.concat(F.lit("bifall: "), F.trim(F.regexp_extract(proposition, DUEL, 1))).alias("ja"),
        F.concat(F.lit("bifall: "), F.regexp_replace(F.trim(F.regexp_extract(proposition, DUEL, 2)), r"\.$", "")).alias("nej"),
    )
    lowered = lambda p: F.struct(*[F.lower(F.regexp_extract(proposition, p, i)).alias(n) for i, n in ((1, "ja"), (2, "nej"))])
    return F.when(proposition.rlike(DUEL), duel).when(proposition.rlike(YES_NO), lowered(YES_NO)).when(proposition.rlike(REMIT), lowered(REMIT))


def roll_calls(rows: DataFrame) -> DataFrame:
    """A row per roll call of a paragraph (doc, nr, text): votering (from 1), proposition, ja_betyder, nej_betyder, ja, nej,
    avstar, verifierad, roster (array of rost, namn, parti).

    A paragraph may hold several, each up to the next heading or the next one's proposition.  ``verifierad``: every side has as
    many names as it says, and the proposition's meaning is known.
    """
    blocks = rows.select("doc", "nr", F.posexplode(F.split("text", VOTE)).alias("votering", "block")).filter(F.col("block").rlike(VOTE_PARTS))
    rest = F.regexp_replace(F.regexp_extract("block", VOTE_PARTS, 2), VOTE_ENDS, "")
    sides = F.regexp_extract_all(F.regexp_replace(rest, r"^\s*\.\s*", " "), F.lit(SIDE), 0)
    place = F.row_number().over(Window.partitionBy("doc", "nr").orderBy("votering"))
    blocks = blocks.select("doc", "nr", place.alias("votering"), _blanks(F.regexp_extract("block", VOTE_PARTS, 1)).alias("proposition"), sides.alias("sidor"))

    def side(x: Column) -> Column:
        verb = F.regexp_extract(x, SIDE, 2)
        cast = F.when(F.contains(verb, F.lit("Ja")), "ja").when(F.contains(verb, F.lit("Nej")), "nej").otherwise("avstår")
        listed = F.regexp_replace(_blanks(F.regexp_extract(x, SIDE, 1)), rf"\)\s+({TITLES})\b", "), $1")
        names = F.transform(F.split(listed, r",|\s+och\s+|\s+samt\s+"), lambda n: F.trim(F.regexp_replace(F.trim(n), rf"(?iu)^(?:{TITLES})\s+", "")))
        names = F.transform(F.filter(names, lambda n: n != ""), lambda n: F.struct(cast.alias("rost"), F.trim(F.regexp_extract(n, VOTER, 1)).alias("namn"), F.regexp_extract(n, VOTER, 2).alias("parti")))
        return F.struct(cast.alias("rost"), F.regexp_extract(x, SIDE, 3).cast("int").alias("antal"), names.alias("namn"))

    read = blocks.withColumn("lista", F.transform("sidor", side)).withColumn("betyder", meanings(F.col("proposition")))
    last = lambda rost: F.coalesce(F.try_element_at(F.transform(F.filter("lista", lambda s: s["rost"] == rost), lambda s: s["antal"]), F.lit(-1)), F.lit(0))
    return read.select(
        "doc", "nr", "votering", "proposition", F.col("betyder.ja").alias("ja_betyder"), F.col("betyder.nej").alias("nej_betyder"),
        last("ja").alias("ja"), last("nej").alias("nej"), last("avstår").alias("avstar"),
        (F.forall("lista", lambda s: F.size(s["namn"]) == s["antal"]) & F.col("betyder").isNotNull()).alias("verifierad"),
        F.flatten(F.transform("lista", lambda s: s["namn"])).alias("roster"),
    )


def votes(calls: DataFrame, people: DataFrame) -> DataFrame:
    """person, doc, nr, typ of every vote in ``roll_calls`` by someone in ``people`` (person, namn), each once a paragraph."""
    cast = calls.select("doc", "nr", F.inline("roster")).withColumn("nyckel", F.lower("namn"))
    known = people.select("person", F.lower("namn").alias("nyckel")).dropDuplicates(["nyckel"])
    return cast.join(known, "nyckel").select("person", "doc", "nr", F.concat(F.lit("röstade_"), "rost").alias("typ")).distinct()


def present(docs: DataFrame) -> DataFrame:
    """doc, roll, namn, parti of those present: a role heading holds for the names under it, members come first."""
    rows = docs.select("doc", F.posexplode(F.split(F.regexp_extract("text", PRESENT, 1), "\n")).alias("nr", "rad")).withColumn("rad", F.trim("rad"))
    so_far = Window.partitionBy("doc").orderBy("nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.nullif(X.first_match(F.col("rad"), PRESENT_ROLES, ""), F.lit(""))
    held = rows.withColumn("roll", F.coalesce(F.last(heading, ignorenulls=True).over(so_far), F.lit("Ledamot")))
    names = held.filter(F.col("rad").rlike(PRESENT_NAME) & heading.isNull() & ~F.col("rad").rlike("^(Övriga närvarande|Via Teams)"))
    return names.select("doc", "roll", F.trim(F.regexp_extract("rad", PRESENT_NAME, 1)).alias("namn"), F.regexp_extract("rad", PRESENT_NAME, 2).alias("parti"))
