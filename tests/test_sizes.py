"""What small tables do not show: results on other values, and rows, tables and plans that must not grow faster than their input."""

import os

import duckdb

from plenum.plans.registry import oracle_sql, queries
from plenum.sources import files

SF = "/root/testdata/sf0.001"


def changed(tmp_path, **tables):
    """The smallest tables with some of them replaced by the rows of a SELECT."""
    for name in os.listdir(SF):
        select, path = tables.get(name.removesuffix(".parquet")), tmp_path / name
        if select:
            duckdb.sql(f"COPY ({select}) TO '{path}' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{name}", path)
    return str(tmp_path)


def by_sql(name, sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return con.sql(oracle_sql()[name]).fetchall()


def test_both_ends_with_people_of_the_set_who_are_in_debt(spark, tmp_path):
    sf = changed(tmp_path, supplier=f"SELECT s_suppkey, s_name, s_suppkey::INT AS s_nationkey, -1.0 AS s_acctbal FROM '{SF}/supplier.parquet'")
    got = sorted(map(tuple, queries()["set_06_both_ends"](spark, sf).collect()))
    assert got == sorted(by_sql("set_06_both_ends", sf)) == [("politiker-2", "nämnd-nation_2")]


def test_invoice_files_are_read_in_splits(spark, tmp_path):
    at = tmp_path / "å b+c"
    at.mkdir()
    head = "Leverantör;Förvaltning;Organisationsnummer;Kontotext;Belopp"
    (at / "utf8.csv").write_bytes(f"﻿{head}\r\n{''.join(f'Öst {i};Park;557;El;{i} 000,5' + chr(13) * (i % 2) + chr(10) for i in range(300))}{head}\n\n".encode())
    # Only the last line tells that this is Latin-1; a lone carriage return ends no line.
    (at / "latin.csv").write_bytes(f"{head}\n{''.join(f'A{chr(13)}b{i};Park;557;;{i}' + chr(10) for i in range(300))}Öst;Park;557;El;7".encode("latin-1"))
    (at / "other.csv").write_text("a;b\n" + "1;2\n" * 300)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        read = files.invoices(spark, str(at))
        assert read.rdd.getNumPartitions() > 10
        got = sorted((*r.fil.rsplit("/", 2)[1:], r["leverantör"], r.konto, r.belopp) for r in read.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [("å b+c", "utf8.csv", f"Öst {i}", "El", i * 1000 + 0.5) for i in range(300)] + [("å b+c", "utf8.csv", "Leverantör", "Kontotext", 0.0)]
    want += [("å b+c", "latin.csv", f"A\rb{i}", "Okänt", float(i)) for i in range(300)] + [("å b+c", "latin.csv", "Öst", "El", 7.0)]
    assert got == sorted(want)  # only a file's first line is its head


def test_postings_are_made_without_a_shuffle(spark):
    from plenum.operators import index as I

    docs = spark.createDataFrame([(1, "Vägen och vägar, vägen"), (2, None), (3, "och i att"), (4, "Å " * 700_000 + "slut")], "doc int, text string")
    rows = I.postings(docs, "doc", "text")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc, r.stam, len(r.platser), r.platser[0], r.platser[-1], r.langd) for r in rows.collect())
    assert got == [(1, "väg", 3, 1, 3, 3), (4, "slut", 1, 700_001, 700_001, 700_001), (4, "å", 700_000, 1, 700_000, 700_001)]


def test_links_meet_labels_once_and_are_added_to_components(spark, monkeypatch):
    import random

    from plenum.llm import jaccard as J

    rng, met = random.Random(3), []
    named = J._named
    monkeypatch.setattr(J, "_named", lambda edges, labels, end: (met.append(edges.count()), named(edges, labels, end))[1])
    name = lambda k: b"%03d" % k
    # A hub with many links from both sides, a path, and random links; then a second lot that joins some of them.
    lots = [[(150, k) for k in range(100, 200) if k != 150] + [(k, k + 1) for k in range(200, 212)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(40)], [(150, 200), (3, 212), (300, 301)]]
    labels, of = None, {}
    for lot in lots:
        labels = J._components(spark.createDataFrame([(name(a), name(b)) for a, b in lot if a != b], "sig binary, other binary"), labels)
        for a, b in lot:
            if a != b:
                x, y = of.setdefault(a, a), of.setdefault(b, b)
                of = {k: min(x, y) if v in (x, y) else v for k, v in of.items()}
        rows = labels.collect()
        assert len(rows) == len(of) and {bytes(r.sig): bytes(r.comp) for r in rows} == {name(k): name(v) for k, v in of.items()}
    assert sum(met) < 3 * sum(map(len, lots))


ANNEX = "BILAGA 2\nÄrende: 7:1\nAntal Ja: 2\nAntal Nej: 0\nResultat\nNamn  Parti  Röst\n{}BILAGA 3\nÄrende: 8\nResultat\nEk, Bo   (V)   Ja\n"
OLD_ANNEX = "Bilaga 2 \nÄrende: 7\nÄrendemening: Motion\nom x\nAntal Ja: 2\nResultat\nNamn  Parti\n{}Bilaga 3 \nÄrende: 8\nAntal Nej: 1\nResultat\n"


def test_annexes_are_read_without_sorts_or_shuffles(spark):
    from plenum.operators import extraction as E

    docs = lambda text: spark.createDataFrame([("a", text), ("b", None), ("c", "")], "doc string, text string")
    body = "Anna\n\nSidnamn\nMaria | + Ek   (S)   Ja\nNamn  S  Nej\n  Alm \\1 $2  M  Nej\r\nKvar\n"
    rows = E.annex_votes(docs(ANNEX.format(body)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Sort", "Window", "Join"))
    want = [("a", "7:1", "7", "Alm \\1 $2", "M", "nej", False), ("a", "7:1", "7", "Anna Sidnamn Maria | + Ek", "S", "ja", False), ("a", "8", "8", "Ek, Bo", "V", "ja", True)]
    assert sorted(map(tuple, rows.collect())) == want
    line = lambda name, rost: f"{name:30}S         12        Ledamot        {rost}\n"
    body = f"Lös\n\n Anna\n{line('Maria | + Ek', 'Ja')}\nBort\nNamn x\n{line('Alm $2, Bo Alexander', 'Frånvarande')}{line(' ' * 25, 'Nej')}Kvar\n"
    rows = E.older_annex_votes(docs(OLD_ANNEX.format(body)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Sort", "Window", "Join"))
    got = sorted((r.doc, r.arende, r.mening, r.ja, r.nej, r.namn, r.parti, r.rost) for r in rows.collect())
    assert got == [("a", "7", "Motion om x", 2, 0, name, "S", rost) for name, rost in (("", "nej"), ("Alm $2, Bo Alexander", "frånvarande"), ("Anna Maria | + Ek", "ja"))]


def test_annexes_of_many_lines(spark):
    from plenum.operators import extraction as E

    text = "BILAGA 2\nÄrende: 7\nResultat\n" + "".join(f"Del {i}\nX   (S)   Ja\n" for i in range(50_000))
    rows = E.annex_votes(spark.createDataFrame([("a", text)], "doc string, text string"))
    assert {(r.namn, r.radera) for r in rows.collect()} == {(f"Del {i} X", True) for i in range(50_000)}


def test_ends_are_looked_up_without_sorting_edges(spark, monkeypatch):
    from plenum.operators import relational as R

    monkeypatch.setattr(R, "ROWS_A_TASK", 10)
    edges = spark.createDataFrame([("a", "b", 1), ("a", "b", 1), ("a", "x", 2), ("x", "b", 3), (None, "b", 4), ("b", None, 5), ("b", "a", 6)], "from_id string, to_id string, nr int")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    for rows in (None, 11, 95):
        known = R.known_ends(edges, nodes, rows)
        assert known.columns == R.known_ends(edges, nodes).columns and sorted(r.nr for r in known.collect()) == [1, 1, 6]
        text = known._jdf.queryExecution().executedPlan().toString()
        assert rows is None or "SortMergeJoin" not in text and "Sort " not in text
        assert (", 10)" in text) == (rows == 95)
    text = queries()["jon_17_integrity"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text


def test_keys_and_references_are_checked_in_one_shuffle(spark):
    from plenum.sources import sinks

    nodes = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", None), ("y", "x")], "from_id string, to_id string")
    references = [("edges", "from_id", "nodes", "id"), ("edges", "to_id", "nodes", "id")]
    broken = lambda n, keys: [sorted(map(tuple, f.collect()), key=str) for f in sinks.faults({"nodes": n, "edges": edges}, keys, references)]
    assert broken(nodes("a", "b", "x", "y", "z"), {"nodes": "id"}) == [[]]
    assert broken(nodes("a", "b", "b", None), {"nodes": "id"}) == [[(0, "b"), (0, None), (1, "y"), (2, "x")]]
    assert broken(nodes("a", "b", "b", None), {}) == [[(0, "y"), (1, "x")]]
    text = sinks.faults({"nodes": nodes("a"), "edges": edges}, {"nodes": "id"}, references)[0]._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text and "Sort" not in text
