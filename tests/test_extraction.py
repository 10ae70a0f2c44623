"""Text extraction, search, files, sinks, streams and value semantics on small literal input. All names are invented."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from plenum.functions import semantics as S
from plenum.functions import text as X
from plenum.operators import executive as K
from plenum.operators import extraction as E
from plenum.operators import graph as G
from plenum.operators import relational as R
from plenum.operators import reports
from plenum.operators.search import search
from plenum.plans.metrics import procedural
from plenum.sources import files, sinks
from plenum.streaming.merge import merging


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc string, text string")


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


PROTOCOL = """Kommunfullmäktige
§ 1 Ärendenummer SLK-2024-0012
Motion om
cykelbanor
Beslut
Yrkandet enligt bifall till kommunstyrelsens förslag. 41 Ja mot 38 Nej
Anna Ek (V) yrkar bifall till motionen.
Bo Alm (M) deltar inte i handläggningen.
§ 2 1435/22
Frågestund
med många frågor
Beslut
Klockan är 22, återstående ärenden ska bordläggas.
§ 2 1435/22 forts.
mer
§ 3
Remiss
Beslut
Återremiss enligt lag (1991:900). Byggnämnden får i uppdrag att svara. Bordlagt den 2024-01-02, § 7
"""


def test_protocol(spark):
    rows = E.decided(E.sections(docs(spark, PROTOCOL)))
    assert values(rows, "nr", "arende", "rubrik", "beslut", "orsak", "ja", "nej") == [
        (1, "SLK-2024-0012", "Motion om cykelbanor", "bifall", None, 41, 38),
        (2, "1435/22", "Frågestund", "bordläggning", "tid", None, None),
        (3, None, "Remiss", "återremiss", None, None, None),
    ]
    assert values(E.motions(rows), "nr", "namn", "parti", "yrkande") == [(1, "Anna Ek", "V", "bifall till motionen")]
    assert values(E.recusals(rows), "nr", "namn", "parti") == [(1, "Bo Alm", "M")]
    assert values(E.references(rows), "nr", "typ", "till") == [(3, "bordlagd_från", "kf-2024-01-02-§7"), (3, "regleras_av", "lag-1991:900"), (3, "uppdrag_till", "org-byggnämnden")]


def test_empty_and_null_documents(spark):
    empty = docs(spark, "", None)
    for f in (E.sections, E.attendance, E.annex_votes, E.speeches, E.budget_rows, E.amounts, E.companies, E.postponed_ranges, E.older_annex_votes, E.presence_lists, K.paragraphs, K.present, reports.audits):
        assert f(empty).count() == 0, f.__name__


def test_ranges_and_attendance(spark):
    assert values(E.postponed_ranges(docs(spark, "§§ 4–6 bordläggs på grund av tid.")), "nr") == [(4,), (5,), (6,)]
    rows = E.attendance(docs(spark, "Närvarande\nAnna Ek (V) 14:44–21:43\nBo Alm (M)\nnågot annat"))
    assert values(rows, "namn", "parti", "tid") == sorted([("Anna Ek", "V", "14:44–21:43"), ("Bo Alm", "M", None)], key=lambda r: r[0])


ANNEX = """  BILAGA 1
Ärende: 13:1
Ärendemening: Motion om träd
Antal Ja: 1
Antal Nej: 1
Resultat
Namn   Parti   Röst
Anna Maria
Ek-Lund (V)   Ja
Bo Alm (M)    Nej
Bilaga 2
Ärende: 13:2
Antal Ja: 1
Resultat
Bo Alm (M)   Ja
Anna Ek (V)  Ja
"""


def test_annex(spark):
    rows = E.annex_votes(docs(spark, ANNEX))
    assert values(rows, "arende", "bas", "namn", "parti", "rost", "radera") == [
        ("13:1", "13", "Anna Maria Ek-Lund", "V", "ja", False), ("13:1", "13", "Bo Alm", "M", "nej", False),
        ("13:2", "13", "Anna Ek", "V", "ja", True), ("13:2", "13", "Bo Alm", "M", "ja", True),
    ]
    assert {r.arende for r in E.main_votes(rows).collect()} == {"13:2"}


def calls(spark, text):
    return K.roll_calls(docs(spark, text).select("doc", F.lit(7).alias("nr"), "text")).orderBy("votering").collect()


def test_roll_call_rejects_or_approves(spark):
    text = """Omröstning

Godkänd voteringsproposition: ”Ja för avslag och Nej för bifall till yrkandet från
V.”
Anna Ek (V), Bo Alm (S),
tjänstgörande ersättaren Cia Dal (MP) och
ordföranden Dan Falk (S) röstar
Ja (4).
Eva Gran (M) och Finn-Ove Hall (KD) röstar Nej (2).

Protokollsanteckning

Gun Ivar (L) röstar Nej (9)."""
    (call,) = calls(spark, text)
    assert (call.ja, call.nej, call.avstar, call.ja_betyder, call.nej_betyder, call.verifierad) == (4, 2, 0, "avslag", "bifall", True)
    assert call.proposition == "Ja för avslag och Nej för bifall till yrkandet från V."
    assert [(r.rost, r.namn, r.parti) for r in call.roster] == [("ja", "Anna Ek", "V"), ("ja", "Bo Alm", "S"), ("ja", "Cia Dal", "MP"), ("ja", "Dan Falk", "S"), ("nej", "Eva Gran", "M"), ("nej", "Finn-Ove Hall", "KD")]


def test_roll_call_duel_with_abstentions_and_names_without_party(spark):
    text = """Godkänd voteringsproposition: "Ja för bifall till Anna Eks yrkande och Nej för bifall
till Bo Alms och Cia Dals yrkande."
Dan Falk (V), Eva
Gran (MP), tjänstgörande ersättarna Hans Ung (S) och Ida Via (V)
samt ordföranden Jan Dahl röstar Ja (5).
Bo Alm (D) röstar Nej (1).
Gun Ivar (M) tjänstgörande ersättaren Rut Wik (M) avstår från att rösta (2).
Göteborgs Stad Kommunstyrelsen protokoll
49 (62)"""
    (call,) = calls(spark, text)
    assert (call.ja_betyder, call.nej_betyder) == ("bifall: Anna Eks yrkande", "bifall: Bo Alms och Cia Dals yrkande")
    assert (call.ja, call.nej, call.avstar, call.verifierad) == (5, 1, 2, True)
    assert ("ja", "Eva Gran", "MP") in call.roster and ("ja", "Jan Dahl", "") in call.roster and ("avstår", "Rut Wik", "M") in call.roster


def test_several_roll_calls_and_remits(spark):
    text = """Godkänd voteringsproposition: "Ja för ärendets avgörande idag och Nej för ärendets återremiss".
Anna Ek (V) röstar Ja (1).
Godkänd voteringsproposition: "Ja för något helt annat."
Bo Alm (M) röstar Ja (2).
Reservation
Cia Dal (S) röstar Nej (1)."""
    first, second = calls(spark, text)
    assert (first.votering, first.ja_betyder, first.nej_betyder, first.ja, first.verifierad) == (1, "avgörande idag", "återremiss", 1, True)
    assert (second.votering, second.ja_betyder, second.verifierad, second.ja, second.nej) == (2, None, False, 2, 0)
    assert [r.namn for r in first.roster] == ["Anna Ek"] and [r.namn for r in second.roster] == ["Bo Alm"]
    people = spark.createDataFrame([("p1", "anna ek"), ("p2", "Bo Alm")], "person string, namn string")
    both = K.roll_calls(docs(spark, text + "\n" + text).select("doc", F.lit(7).alias("nr"), "text"))
    assert values(K.votes(both, people), "person", "typ") == [("p1", "röstade_ja"), ("p2", "röstade_ja")]
    assert calls(spark, "ingen omröstning") == [] and calls(spark, None) == []


EXECUTIVE = """Närvarande
Anna Ek (V)
Tjänstgörande ersättare
Bo Alm (M) §§ 1-3
Övriga ersättare
Cia Dal (S)
Övriga närvarande
Justeringsdag: 3
§ 1 Ärendenummer SLK-2024-00012
Göteborgs hamn
45 (60)
och broar
Beslut
Kommunstyrelsen tillstyrker förslaget och föreslår att
kommunfullmäktige beslutar. KF Handling 2024 nr 31.
Yrkanden
Anna Ek (V) och Bo Alm (M) yrkar bifall till förslaget i sin helhet.
Reservation

Cia Dal (S) reserverar sig.

Ärendet går till byggnämnden för svar.
§ 2 Ärendenummer SLK-2024-00013:2
Remiss
Beslut
Ärendet bordläggs.
§ 3 Ärendenummer SLK-2024-00014
Tredje
Enligt beslutssats i delen, resten bordläggs.
"""


def test_executive_minutes(spark):
    rows = K.paragraphs(docs(spark, EXECUTIVE))
    assert values(rows, "nr", "arende", "rubrik", "beslut", "reservation") == [
        (1, "SLK-2024-00012", "Göteborgs hamn och broar", "tillstyrkan_kf", "Cia Dal (S) reserverar sig."),
        (2, "SLK-2024-00013:2", "Remiss", "bordläggning", None),
        (3, "SLK-2024-00014", "Tredje Enligt beslutssats i delen, resten bordläggs.", "bifall", None),
    ]
    assert "(60)" not in rows.filter("nr = 1").first().text
    assert values(K.claims(rows), "nr", "namn", "parti", "yrkande") == [(1, "Anna Ek och Bo Alm", "M", "förslaget i sin helhet")]
    assert values(K.references(rows), "nr", "till") == [(1, "kf-handling-2024-31"), (1, "org-byggnämnden")]
    assert values(K.present(docs(spark, EXECUTIVE)), "roll", "namn", "parti") == [("Ledamot", "Anna Ek", "V"), ("Tjänstgörande ersättare", "Bo Alm", "M"), ("Övriga ersättare", "Cia Dal", "S")]


def test_older_annex(spark):
    row = "{:<30}{:<10}{:<10}{:<15}{}".format
    body = [row("Namn", "Parti", "Plats", "Roll", "Röst"), row("Anna Maria Ek-Lundgren", "V", "1", "Ordförande", "Ja"), "Bo Alexander", row("Almqvist von Berg Stor", "M", "2", "Ledamot", "Nej"), "Spår", "", row("Cia Katarina Dahlberg", "SD", "3", "Ledamot", "Frånvarande")]
    text = "Början\nBilaga 2 \nÄrende: 13\nÄrendemening: Motion om\nträd\nAntal Ja: 1\nAntal Nej: 1\nResultat\n" + "\n".join(body) + "\nBilaga 3\nÄrende: 14\nAntal Nej: 2\nResultat\n" + body[1]
    got = values(E.older_annex_votes(docs(spark, text)), "arende", "mening", "ja", "nej", "franv", "namn", "parti", "rost")
    assert got == [
        ("13", "Motion om träd", 1, 1, 0, "Anna Maria Ek-Lundgren", "V", "ja"),
        ("13", "Motion om träd", 1, 1, 0, "Bo Alexander Almqvist von Berg Stor", "M", "nej"),
        ("13", "Motion om träd", 1, 1, 0, "Cia Katarina Dahlberg", "SD", "frånvarande"),
    ]


def test_presence_lists(spark):
    text = "Tjänstgörande ersättare\nBo Alm (M), dan falk (S)\nDan Falk (S)\nÖvriga ersättare\nX Y (S)\nBilaga 1\nPlats  Ledamot  Ersättare\n 1   Ek, Anna       Alm, Bo     V     14:41   22:01\n 2   Dal, Cia     S     14:00 15:00\nBilaga 2\n 3   Ej, Med     S     14:00 15:00\n"
    assert values(E.presence_lists(docs(spark, text)), "namn", "parti", "ankom", "utgick", "roll") == sorted([
        ("Anna Ek", "V", "14:41", "22:01", "ledamot"), ("Bo Alm", "V", "14:41", "22:01", "ersättare"), ("Cia Dal", "S", "14:00", "15:00", "ledamot"), ("dan falk", "S", None, None, "ersättare"),
    ])


def test_speeches(spark):
    text = "Yttrandeprotokoll 2024\n 4. Skolor i staden\nAnna Ek (V)\nTack ordförande, detta\n12\när viktigt.\nBo Alm (M)\nKort.\n250. inte en rubrik\nAnna Ek (V)\nJag håller inte med om det.\n"
    assert values(E.speeches(docs(spark, text)), "ordning", "talare", "parti", "arende", "arendetitel", "text") == [
        (1, "Anna Ek", "V", 4, "Skolor i staden", "Tack ordförande, detta är viktigt."),
        (2, "Anna Ek", "V", 4, "Skolor i staden", "Jag håller inte med om det."),
    ]


def test_tables(spark):
    assert values(E.budget_rows(docs(spark, "Skola och barn   1 020,5\nSumma   3\n")), "namn", "mnkr") == [("Skola och barn", 1020.5)]
    assert values(E.assignments(docs(spark, "Byggnämnden får i uppdrag att plantera träd.")), "mottagare", "uppdrag") == [("Byggnämnden", "plantera träd")]


KNOWN = [("Förskolenämnden", "n1", 1), ("Grundskolenämnden", "n2", 2), ("Byggnadsnämnden", "n3", 3), ("Idrottsnämnden i staden", "n4", 4), ("Kulturnämnden", "n5", 5)]


def test_committee_results(spark):
    known = spark.createDataFrame(KNOWN, "namn string, nyckel string, ordning int")
    table = ["Nämnd   Budget   Utfall   Avvikelse", "-----", "Förskolenämnden   5 361   5 320   -41", "Grundskolenämnden   10 547,5   10 612   65", "Byggnadsnämnden   100   90   0", "Idrottsnämnden   10   12   2", "Kulturnämnden   1   1   0,5", "Okänd nämnd här   7   8   9", "Summa nämnder", "Förskolenämnden   1   2   3"]
    got = values(reports.committee_results(docs(spark, "Text\n" + "\n".join(table)), known), "namn", "nyckel", "budget", "utfall", "avvikelse", "procent")
    assert got == [("Byggnadsnämnden", "n3", 100.0, 90.0, -10.0, -10.0), ("Förskolenämnden", "n1", 5361.0, 5320.0, -41.0, -0.8), ("Grundskolenämnden", "n2", 10547.5, 10612.0, 65.0, 0.6), ("Idrottsnämnden", "n4", 10.0, 12.0, 2.0, 20.0), ("Kulturnämnden", "n5", 1.0, 1.0, 0.5, 0.0)]
    follow_up = "I år\nFörskolenämnden 100 mot 120 nu\nGrundskolenämnden har 200, 220, 25 kr\nKulturnämnden utan tal"
    got = values(reports.committee_results(docs(spark, follow_up), known), "namn", "nyckel", "budget", "utfall", "avvikelse")
    assert got == [("Förskolenämnden", "n1", 100.0, 120.0, 20.0), ("Grundskolenämnden", "n2", 200.0, 220.0, 25.0)]


def test_interim_tables(spark):
    tables = [
        [["Annat"], ["Resultat", "1"]],
        [["", "P", "B"], ["Intäkter", "373,6", "1 000", "", "1", "2", "3", "4", "5"], ["Kommunbidrag", "9,4"], ["Resultat ", "22,5", "3,0", "19,5"]],
        [["Tjänster", "Resultat period"], ["Vård", "", ""], ["- Hemtjänst", "1,0", "2", "3", "4", "5"], ["- Boende", "1"], ["Ensam", "3", "4"], ["- Löst", "6"], ["Total vård", "1", "2"]],
    ]
    rows = spark.createDataFrame([("d", k, i, x) for k, t in enumerate(tables) for i, x in enumerate(t)], "doc string, tabell int, nr int, celler array<string>")
    assert values(reports.result_posts(rows), "namn", "utfallPeriod", "budgetPeriod", "avvikelsePeriod", "bokslutFgAr") == [("Intäkter", 373.6, 1000.0, 0.0, 5.0), ("Kommunbidrag", 9.4, 0.0, 0.0, 0.0), ("Resultat", 22.5, 3.0, 19.5, 0.0)]
    assert values(reports.services(rows), "nr", "tjänst", "kategori", "är_summa", "resultatPeriod", "budgetavvikelse") == [
        (2, "Hemtjänst", "Vård", False, 3.0, 5.0), (3, "Boende", "Vård", False, 0.0, 0.0), (4, "Ensam", None, False, 0.0, 0.0), (5, "Löst", None, False, 0.0, 0.0), (6, "Total vård", None, True, 0.0, 0.0),
    ]
    assert reports.services(rows, "helår").count() == 0


def test_audits(spark):
    text = """Rapportsammandrag
Stadsrevisionen
Missiv till ansvariga nämnder och till alla bolagsstyrelser i den berörda koncernen
Stadsrevisionen har granskat användning av verksamhetsfor-
don hos nämnderna. Det finns brister.
Stadsrevisionen, Fordon   1 (2)
Revisionskontoret rekommenderar nämnden Norr att ta fram ru-tiner. Bolaget AB rekommenderas att se över avtal. Nämnden Norr rekommenderas att ta fram rutiner.
"""
    (r,) = reports.audits(docs(spark, text)).collect()
    assert (r.titel, r.reserv) == ("Användning av verksamhetsfordon", False)
    assert r.sammanfattning == "Stadsrevisionen har granskat användning av verksamhetsfordon hos nämnderna. Det finns brister."
    assert [(x.mottagare, x.text) for x in r.rekommendationer] == [("nämnden Norr", "Revisionskontoret rekommenderar nämnden Norr att ta fram ru-tiner."), ("Bolaget AB", "Bolaget AB rekommenderas att se över avtal.")]
    listed = "Rapportsammandrag\nStadsrevisionen\nMissiv till nämnden för de många mycket viktiga och ytterst vidlyftiga frågorna i staden\nRevisorerna har i år sett allt. Vi lämnar följande rekommendationer till nämnden Syd: • Att spara pengar. • Att mäta. Slut. • nej • Att inte räknas."
    (r,) = reports.audits(docs(spark, listed)).collect()
    assert (r.titel, r.reserv) == ("nämnden för de många mycket viktiga och ytterst vidlyftiga frågorna i staden", True) and r.sammanfattning == "Revisorerna har i år sett allt."
    assert [(x.mottagare, x.text) for x in r.rekommendationer] == [("nämnden Syd", "Att spara pengar."), ("nämnden Syd", "Att mäta.")]


def test_reports(spark):
    assert values(E.amounts(docs(spark, "kostar 1 234,5 mnkr och 7 kr nu")), "nr", "belopp", "enhet") == [(0, 1234.5, "mnkr"), (1, 7.0, "kr")]
    assert values(E.companies(docs(spark, "av Norra Bygg AB och Norra Bygg AB.")), "bolag") == [("Norra Bygg AB",)]
    assert values(E.pages_with(docs(spark, "a b\fB c A\fc"), ["A", "b"]), "sida") == [(1,), (2,)]


def test_handlings(spark):
    rows = docs(spark, "Enligt handling 2024 nr 7 och Handling 2024  nr 7.").select("doc", F.lit(1).alias("nr"), "text")
    urls = spark.createDataFrame([("2024 nr 7", "u")], "handling string, url string")
    texts = spark.createDataFrame([("u", "text")], "url string, innehall string")
    assert values(E.handling_texts(rows, urls, texts).distinct(), "nr", "handling", "innehall") == [(1, "2024 nr 7", "text")]


def test_recipients(spark):
    known = spark.createDataFrame([("Kretslopp och vattennämnden", "k"), ("Skolnämnden", "s"), ("Norra Bolaget AB", "n"), ("A", "a"), ("B", "b"), ("C", "c"), ("D", "d"), ("E", "e")], "namn string, mal string")
    cases = [(1, "Norra Bolaget AB och kretslopp och vattennämnden"), (2, "okänd och A"), (3, "A, B och C"), (4, "A och B och C och D och E"), (5, "kretslopp- och vattennämnden och Skolnämnd, A"), (6, "A och okänd och B"), (7, None), (8, "")]
    got = values(E.recipients(spark.createDataFrame(cases, "id int, mottagare string"), known), "id", "mal")
    assert got == [(1, "k"), (1, "n"), (3, "a"), (3, "b"), (3, "c"), (4, "a"), (4, "b"), (4, "c"), (4, "d"), (4, "e"), (5, "a"), (5, "k"), (5, "s"), (6, "a")]


def test_catalogue_and_pdfs(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps([{"id": "a", "titel": "A", "fil": "a.txt", "taggar": ["x"]}, {"id": "b", "titel": "B", "fil": "saknas.txt"}]))
    (tmp_path / "a.txt").write_text("rad ett\nrad två")
    assert values(files.catalogue(spark, str(tmp_path)), "id", "titel", "innehall") == [("a", "A", "rad ett\nrad två")]
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "ok.pdf").write_bytes(b"%PDF-1.7 x")
    (folder / "html.pdf").write_bytes(b"<html>")
    (folder / "tom.pdf").write_bytes(b"")
    assert [r.path.rsplit("/", 1)[1] for r in files.pdfs(spark, str(folder)).collect()] == ["ok.pdf"]


def test_guarded_replacement(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    with pytest.raises(ValueError, match="89 new rows"):
        sinks.replace_guarded(spark.range(89), path)
    assert spark.read.parquet(path).count() == 100
    sinks.replace_guarded(spark.read.parquet(path).filter("id < 95"), path)  # reads what it replaces
    assert spark.read.parquet(path).count() == 95 and sorted(x.name for x in tmp_path.iterdir()) == ["t"]


def test_search(spark):
    rows = spark.createDataFrame([(1, "Cyklarna på vägen"), (2, "En cykel och en bil"), (3, "bilar")], "id int, text string")
    assert [r.id for r in search(rows, "id", "text", "bilar", take=5).collect()] == [3, 2]


def test_mentions(spark):
    from plenum.operators import mentions as M

    texts = spark.createDataFrame([(1, "xa lilla huset vid den stora sjön här; ab"), (2, "ab ab\ncd e"), (3, None), (4, "")], "id long, text string")
    names = [(7, "a lilla huset vid den stora sjö"), (8, "ab"), (9, ""), (10, "saknas helt"), (11, "b\ncd"), (12, "huset  vid den"), (13, "lilla huset vid"), (14, "a lilla huset här"), (15, None), (16, "sjön här; ab")]
    got = values(M.mentions(texts, "id", "text", spark.createDataFrame(names, "nr long, namn string"), "nr", "namn"), "id", "nr", "plats")
    assert got == [(1, 7, 2), (1, 8, 40), (1, 13, 4), (1, 16, 30), (2, 8, 1), (2, 11, 5)]
    assert M.mentions(texts, "id", "text", spark.createDataFrame([], "nr long, namn string"), "nr", "namn").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_mentions_by_brute_force(spark, seed):
    """Names that are cut anywhere out of the texts, with blanks of several kinds, and others."""
    import random

    from plenum.operators import mentions as M

    rng = random.Random(seed)
    texts = ["".join(rng.choice(["ab", "abc", "c", "åäö", "lång", " ", " ", "  ", "\n", "\t"]) for _ in range(rng.choice([0, 3, 20, 60]))) for _ in range(25)] + [None, "ab", " "]
    names = ["", " ", "  ", "ab", "c ab", " c", "ab ", "saknas", None, "ab"]
    for _ in range(40):
        t = rng.choice([t for t in texts if t])
        i = rng.randrange(len(t))
        names.append(t[i : i + rng.choice([1, 2, 5, 9, 14, 30])])
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    n = spark.createDataFrame(list(enumerate(names)), "nr int, namn string")
    want = sorted((i, k, x.index(y) + 1) for i, x in enumerate(texts) for k, y in enumerate(names) if x and y and y in x)
    assert values(M.mentions(t, "id", "text", n, "nr", "namn"), "id", "nr", "plats") == want


def test_prefixes_and_pieces(spark):
    names = spark.createDataFrame([("grundskolan", 1), ("grundskolan i norr", 2), ("kort", 3), ("annat", 4)], "namn string, k int")
    entries = spark.createDataFrame([("grundskolan i syd", 1), ("grundskolan", 2), ("kortare", 3), ("grund", 0)], "post string, plats int")
    assert values(R.best_prefix_match(names, "namn", entries, "post", "plats"), "k", "plats") == [(1, 2), (2, 0)]
    parts = spark.createDataFrame([("sko",), ("n",), ("",), (None,), ("grundskolan i norr",)], "del string")
    assert values(R.containing(names, "namn", parts, "del", 5).distinct(), "k", "del") == [(1, "n"), (1, "sko"), (2, "n"), (2, "sko"), (4, "n")]
    rows = spark.createDataFrame([("a", 5), ("b", 3), (None, 2), ("c", 1)], "namn string, v long")
    assert sorted(map(tuple, R.top_and_rest(rows, "namn", "v", 2).collect())) == [("a", 5), ("b", 3), ("Övrigt", 3)]
    assert R.top_and_rest(rows, "namn", "v", 9).count() == 4


def test_values(spark):
    assert one(spark, S.half_up(F.lit(-2.5))) == -2 and one(spark, S.half_up(F.lit(1.005), 2)) == 1.0
    assert spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "x int").agg(S.upper_median(F.col("x")).alias("m")).first().m == 3
    assert [S.page_limit(x, 100) for x in ("0", "-5", "12abc", None, "999")] == [50, 1, 12, 50, 100]
    assert one(spark, S.or_else(F.lit(0), F.lit(None).cast("int"), F.lit(7))) == 7
    assert one(spark, F.lit("abåbo").rlike(S.ascii_word("ab"))) is True  # å is no word character there
    assert one(spark, X.number(F.lit("−1 234,5"))) == -1234.5 and one(spark, X.number(F.lit("x"))) == 0.0
    assert one(spark, X.slug(F.lit("Å-b  (c)!"))) == "å-b-c" and one(spark, X.slug_ascii(F.lit("Åäö é"))) == "aao-e"
    assert one(spark, X.company(F.lit("Norra Bygg AB (publ)"))) == "norra bygg"
    assert one(spark, X.organisation(F.lit("Staden Nämnd för X"), "Staden")) == "nämnden för x"
    assert one(spark, X.month_of_title(F.lit("Fakturor Mars 2024"))) == one(spark, X.month_of_title(F.lit("f_202403.csv"))) == "2024-03"
    assert one(spark, X.composed(F.lit("Å B"))) == "å b"
    assert one(spark, X.reflowed(F.lit("ett ord-\nslut\nrad\n\n\nny"))) == "ett ordslut rad\n\nny"


def test_merge(spark):
    nodes = spark.createDataFrame([("a", "organisation", "A"), ("b", "organisation", "B"), ("p", "politiker", "P")], "id string, typ string, label string")
    edges = spark.createDataFrame([("p", "b", "x"), ("p", "b", "x"), ("a", "b", "y")], "from_id string, to_id string, typ string")
    aliases = spark.createDataFrame([("b", "a", "A")], "alias string, id string, label string")
    n, e = G.merged(nodes, edges, aliases)
    assert values(n, "id", F.array_join("aliases", ",")) == sorted([("a", "b"), ("p", None)], key=str)
    assert values(e, "from_id", "to_id") == [("p", "a"), ("p", "a")]
    with pytest.raises(ValueError):
        R.guarded(89, 100)
    R.guarded(90, 100)


def test_procedural(spark):
    long = [("s1", "A", 900), ("s2", "B", 800), ("s3", "C", 700)]
    chair = [(f"c{i}", "Chair", 40) for i in range(4)]
    rows = [(k, "d1", "1", who, n) for k, who, n in long + chair] + [("solo", "d1", "2", "Chair", 500), ("other", "d2", "2", "Chair", 500), ("talk", "d1", "3", "A", 500)]
    got = procedural(spark.createDataFrame(rows, "key string, datum string, arende string, talare string, langd int"))
    assert values(got, "key") == [("c0",), ("c1",), ("c2",), ("c3",), ("solo",)]


def test_files(spark, tmp_path):
    at = tmp_path / "g"
    at.mkdir()
    (at / "a.json").write_text(json.dumps({"nodes": [{"id": "n", "typ": "t", "label": "old", "data": {"v": 1}}], "edges": [{"from": "n", "to": "m", "typ": "e"}]}))
    (at / "b.json").write_text(json.dumps({"nodes": [{"id": "n", "typ": "t", "label": "new", "data": {"v": 1.5}}], "edges": [], "more": 1}))
    nodes, edges = files.graph(spark, str(at))
    assert values(nodes, "id", "label", F.variant_get("data", "$.v", "double")) == [("n", "new", 1.5)]
    assert values(edges, "from_id", "to_id") == [("n", "m")]
    assert files.optional(spark, str(at / "none.json"), files.GRAPH).count() == 0
    csv = tmp_path / "f"
    csv.mkdir()
    (csv / "utf8.csv").write_bytes("﻿Förvaltning; Leverantör ;Organisationsnummer;Kontotext;Belopp SEK\r\nSkola;Bygg å AB;556;;1 000,5\r\n\r\n".encode())
    (csv / "latin.csv").write_bytes("Leverantör;Förvaltning;Organisationsnummer;Kontotext;Belopp\nÖst AB;Park;557;El;2\n".encode("latin-1"))
    (csv / "other.csv").write_text("a;b\n1;2\n")
    assert values(files.invoices(spark, str(csv)), "förvaltning", "leverantör", "orgnr", "konto", "belopp") == [("Park", "Öst AB", "557", "El", 2.0), ("Skola", "Bygg å AB", "556", "Okänt", 1000.5)]
    (tmp_path / "k.json").write_text(json.dumps({"values": [{"kpi": "N1", "period": 2020, "values": [{"gender": "K", "value": 1}, {"gender": "T", "value": 2}]}]}))
    assert values(files.kpis(spark, str(tmp_path / "k.json")), "kpi", "år", "värde") == [("N1", 2020, 2.0)]
    (tmp_path / "j.json").write_text(json.dumps({"dimension": {"Tid": {"category": {"index": {"2020": 0, "2021": 1}}}}, "value": [5, 6]}))
    assert values(files.json_stat(spark, str(tmp_path / "j.json")), "år", "värde") == [("2020", 5.0), ("2021", 6.0)]
    (at / "kf-2024-01-02.json").write_text(json.dumps({"datum": "2024-01-02", "anföranden": []}))
    assert values(files.dated_files(spark, str(at), files.DEBATE), "fil_datum") == [("2024-01-02",)]
    meetings = {"år": 2024, "sammanträden": [{"datum": "2024-01-02", "handlingar": [{"titel": "Kallelse", "url": "u0"}, {"titel": "PROTOKOLL a", "url": "u1"}, {"titel": "Protokoll b", "url": "u2"}]}]}
    (tmp_path / "m.json").write_text(json.dumps(meetings))
    assert values(files.first_handling(spark, str(tmp_path / "m.json"), "protokoll"), "datum", "url") == [("2024-01-02", "u1")]
    sinks.write_graph(nodes.drop("data"), edges.drop("data"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).first().label == "new"
    assert json.loads(sinks.graph_document(nodes.drop("data"), edges.drop("data", "label")).first().value)["edges"][0]["from_id"] == "n"
    with pytest.raises(KeyError):
        sinks.tenant("x", frozenset({"y"}))


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def test_merging_batches(spark, tmp_path):
    merge = merging(spark, str(tmp_path / "t"), "id", "seq", ["mail"])
    merge(spark.createDataFrame([(1, 1, "a", "m"), (2, 1, "b", None)], "id int, seq int, namn string, mail string"), 0)
    merge(spark.createDataFrame([(1, 2, "c", None), (1, 1, "x", None), (3, 1, "d", None)], "id int, seq int, namn string, mail string"), 1)
    got = spark.read.parquet(str(tmp_path / "t/version=1"))
    assert values(got, "id", "namn", "mail", "historisk") == [(1, "c", "m", False), (2, "b", None, True), (3, "d", None, False)]
