"""Archive index lines and pages to terms of office. All names and addresses are invented."""

import datetime
import random

from pyspark.sql import functions as F

from plenum.operators import archive as A


def day(n, h=0):
    return datetime.datetime(2023, 1, 1, h) + datetime.timedelta(days=n)


def table(*people):
    rows = "".join(f'<tr><td><a href="/person/{i}?x=1">{last}</a><td>{first}<td>{party}<td>{role}' for i, first, last, party, role in people)
    return f'<table id="engagementTable"><tbody>{rows}</table>'


def test_index_lines(spark):
    lines = ["https://x.example/organisation/o1 20230101120000", " https://x.example/person/p-9?a=b   20230102000000 ", "", "https://x.example/organisation/o1", "u 2023", "u 20231301000000", "https://x.example/organisation/o1 20230101120000"]
    got = sorted(map(tuple, A.archive_index(spark.createDataFrame([(x,) for x in lines], "value string")).collect()))
    assert got == [("https://x.example/organisation/o1", day(0, 12), "o1"), ("https://x.example/person/p-9?a=b", day(1), "p-9")]


def test_lines_and_pages_to_terms(spark):
    ann, bo, empty = ("u1", "Ann", "Ek", "Liberalerna", "Ledamot"), ("u2", "Bo", "Alm", "Okända", ""), ()
    pages = [("o1", 0, (ann, bo)), ("o1", 10, (ann,)), ("o1", 20, (ann, bo)), ("o1", 30, empty), ("o1", 40, (bo, bo)), ("o2", 5, (ann,))]
    lines = spark.createDataFrame([(f"https://x.example/organisation/{o} {day(d):%Y%m%d%H%M%S}",) for o, d, _ in pages], "value string")
    html = spark.createDataFrame([(f"https://x.example/organisation/{o}", day(d), table(*p)) for o, d, p in pages], "url string, tid timestamp, html string")
    snapshots = A.archive_index(lines).join(html, ["url", "tid"])
    seen = A.listed(snapshots)
    got = sorted((r.organ, r.person, r.fran, r.till) for r in A.terms(seen, snapshots).collect())
    assert got == [("o1", "u1", day(0), day(30)), ("o1", "u2", day(0), day(10)), ("o1", "u2", day(20), day(30)), ("o1", "u2", day(40), None), ("o2", "u1", day(5), None)]
    people = {r.person: (r.fornamn, r.efternamn, r.parti, r.roller, r.forst, r.sist) for r in A.accumulated(seen).collect()}
    assert people == {"u1": ("Ann", "Ek", "L", ["Ledamot"], day(0), day(20)), "u2": ("Bo", "Alm", "Okända", [], day(0), day(40))}
    roster = spark.createDataFrame([("u1",)], "id string")
    page = '<table id="engagementTable"><tr><td><a href="/organisation/o1">N</a><td>L<td>2023<td></table><a href="mailto:b">b@x.example</a>'
    gone = A.departed(seen, roster, spark.createDataFrame([("u2", page)], "id string, html string")).collect()
    assert [(r.person, r.epost, [u.asDict() for u in r.uppdrag]) for r in gone] == [("u2", "b@x.example", [{"organisation": "N", "organisation_id": "o1", "roll": "L", "fran": "2023", "till": None}])]
    bare = A.departed(seen, roster, spark.createDataFrame([], "id string, html string")).first()
    assert (bare.epost, bare.uppdrag) == (None, [])


def test_as_of_by_a_loop(spark):
    rng = random.Random(2)
    snapshots = [(rng.choice("aab"), day(rng.randrange(40), rng.randrange(24)), f"v{i:03}") for i in range(40)]
    events = [(i, rng.choice("aaabc"), day(rng.randrange(-5, 60), rng.randrange(24))) for i in range(300)]
    e = spark.createDataFrame(events, "n int, k string, ts timestamp")
    s = spark.createDataFrame(snapshots, "k string, tid timestamp, v string")
    got = {r.n: (r.k, r.v) for r in A.as_of(e, s, "k", "ts", "tid", "v").collect()}
    for n, k, ts in events:
        before = [(t, v) for key, t, v in snapshots if key == k and t <= ts]
        assert got[n] == (k, max(before)[1] if before else None)
    assert len(got) == 300
    plan = A.as_of(e, s, "k", "ts", "tid", "v")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 1  # the one row with the last piece
    assert A.as_of(e.limit(0), s, "k", "ts", "tid", "v").count() == 0 and A.as_of(e, s.limit(0), "k", "ts", "tid", "v").count() == 300


def test_older_pages_and_periods(spark):
    link = lambda i, text: f'<a href="viewPerson.jsf?id={i}&x=1" class="n"> {text}</a>'
    pages = spark.createDataFrame([("2018-2022", link(1, "Ek") + link(2, "Alm") + link(1, "Ann  Maria") + link(2, "Bo")), ("2014-2018", link(3, "Ensam")), ("x", None)], "period string, html string")
    seen = A.old_names(pages, "period")
    assert sorted(map(tuple, seen.collect())) == [("2018-2022", "ann maria ek"), ("2018-2022", "bo alm")]
    roster = spark.createDataFrame([("p1", "Ann Maria", "Ek", ["2022-2026"]), ("p2", "Bo", "Alm", ["2018-2022"]), ("p3", "BO", "ALM", None)], "id string, fornamn string, efternamn string, perioder array<string>")
    assert sorted(map(tuple, A.added_periods(roster, seen).collect())) == [("p1", "2018-2022"), ("p3", "2018-2022")]
    assert spark.range(1).select(A.party_code(F.lit(" Miljöpartiet de gröna ")).alias("x")).first().x == "MP"
