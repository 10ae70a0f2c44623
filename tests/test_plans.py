"""Plans without nested loops, and operators that are compared with a loop."""

import pytest

from plenum.operators import extraction as E
from plenum.operators import reports
from plenum.plans.registry import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["jon_10_token_subset", "jon_12_dictionary", "jon_13_containment", "jon_14_mentions", "jon_25_annex_merge", "txt_10_attendance_edges", "txt_19_results", "grf_12_recipients", "grf_17_active"])
def test_no_nested_loops(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_committees_of_reports_without_nested_loops(spark):
    known = spark.createDataFrame([("Förskolenämnden", "n1", 1)], "namn string, nyckel string, ordning int")
    text = plan(reports.committee_results(spark.createDataFrame([("d", "x")], "doc string, text string"), known))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_names_are_resolved_in_order(spark):
    people = [("p1", "Anna", "Ek Alm", 1), ("p2", "Bo", "Alm", 2), ("p3", "Anna Maria", "Ek", 3), ("p4", "Anna", "Ek", 4), ("p5", "Cia Lo", "Dahl Berg", 5), ("p6", "Cia", "Dahl", 6)]
    roster = spark.createDataFrame(people, "person string, fornamn string, efternamn string, plats int")
    names = ["Ek, Anna", "Anna Ek", "Alm, Bo", "Maria Ek", "Dahl, Cia", "Dahl, Lo", "Berg Dahl, Cia Lo Extra", "Okänd, Anna", "Bo", "", "Ek"]
    rows = spark.createDataFrame([(n,) for n in names], "namn string")
    got = {r.namn: r.person for r in E.resolved(rows, roster).collect()}
    # A part of a double surname counts, the first of the roster wins, then all words of either among the other's.
    assert got == {"Ek, Anna": "p1", "Anna Ek": "p1", "Alm, Bo": "p2", "Maria Ek": "p3", "Dahl, Cia": "p6", "Dahl, Lo": "p5", "Berg Dahl, Cia Lo Extra": "p5", "Bo": "p2", "Ek": "p1"}


def test_wide_attendance(spark):
    text = "Ek, Före    S   9:00   10:00\nBilaga 1\nx\nPlats   Ledamot\nEk, Anna    FP   9:05   21:00\nAlm-Dahl Bo   V    14:44 22:01 mera\n 3  Numrerad, Cia   S   9:00  10:00\nKort, Rad X 9:00 10:00\n"
    docs = spark.createDataFrame([("a", text), ("b", "Ek, Anna    S   9:00   10:00"), ("c", None), ("d", "")], "doc string, text string")
    got = sorted(map(tuple, E.wide_attendance(docs).collect()))
    assert got == [("a", 0, "Ek, Anna", "FP", "9:05", "21:00"), ("a", 1, "Alm-Dahl Bo", "V", "14:44", "22:01")]
