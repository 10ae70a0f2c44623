"""Trees of any depth, quarantine, and tables that are changed in part or as one. All names are invented."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from plenum.operators import checks as K
from plenum.operators import graph as G
from plenum.sources import sinks
from plenum.streaming.merge import merging_changes


def tree(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, parent string")


def files(path, part=None):
    return {(p.parent.name, p.name) for p in pathlib.Path(path).rglob("part-*.parquet") if part is None or p.parent.name == part}


# ---- trees ----


def by_walking(rows, depth=None):
    out, level = [], [(i, (i,)) for i, p in sorted({r for r in rows if r[1] is None})]
    while level:
        out += level
        level = [(i, (*way, i)) for top, way in level for i, p in sorted(set(rows)) if p == top and i not in way]
    return sorted((i, len(way) - 1, "/".join(way)) for i, way in out if depth is None or len(way) - 1 <= depth)


@pytest.mark.parametrize("seed", range(3))
def test_flattened_by_walking(spark, seed):
    rng = random.Random(seed)
    rows = [("r0", None), ("r1", None), ("a", "a"), ("b", "c"), ("c", "b"), ("under", "c"), ("lost", "nowhere")]
    names = ["r0", "r1"]
    for k in range(25):
        for parent in rng.sample(names, rng.choice([1, 1, 1, 2])):
            rows.append((f"n{k}", parent))
        names.append(f"n{k}")
    rows += [("n3", "n9"), ("n3", "n9")]  # a cycle below a root, if n9 is below n3; repeated rows
    walks = G.flattened(tree(spark, *rows))
    assert sorted(map(tuple, walks.collect())) == by_walking(rows)
    assert sorted(map(tuple, G.flattened(tree(spark, *rows), 2).collect())) == by_walking(rows, 2)
    assert {r.id for r in G.unreached(tree(spark, *rows), walks).collect()} == {"a", "b", "c", "under", "lost"}


def test_a_deep_tree_takes_few_rounds(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(300)]
    got = {r.id: r.depth for r in G.flattened(tree(spark, *rows)).collect()}
    assert got == {f"n{k}": k for k in range(300)}
    assert G.flattened(tree(spark)).count() == 0 and G.flattened(tree(spark, ("a", "b"), ("b", "a"))).count() == 0


def test_active_items(spark):
    items = spark.createDataFrame([("/",), ("/a",), ("/a/b/",), (None,), ("/a/bc",)], "href string")
    paths = ["/", "/a", "/a/", "/a/b/c/d", "/a/bcd", "/x", "/a/bc", "", None, "//"]
    pages = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "n int, path string")
    got = {r.n: r.aktiv for r in G.active_items(items, pages).collect()}
    assert [got[i] for i in range(10)] == ["/", "/a", "/a", "/a/b", "/a", None, "/a/bc", "/", None, "/"]


# ---- quarantine ----


def test_good_and_broken_lines(spark):
    lines = ['{"id": "p1", "n": 3}', '{"id": "x", "n": 3}', '{"id": "p2"}', '{"id": "p3", "n": "tre"}', '{"id": "p4"', "", None, "[]", '{"id": "p5", "n": 1, "more": {"a": 1}}']
    rows = K.checked_lines(spark.createDataFrame(list(enumerate(lines)), "at int, rad string"), "rad", "id string, n int", {"id": "^p", "n": None})
    got = {r["at"]: (r.post.id if r.post else None, r.brister) for r in rows.collect()}
    assert got[0] == ("p1", []) and got[8] == ("p5", []) and got[1] == ("x", ["id"]) and got[2] == ("p2", ["n"])
    assert all(got[i][1] == ["_trasig"] for i in (3, 4, 6)) and all(got[i][1] for i in (5, 7)) and len(got) == 9


@pytest.mark.parametrize("whole", [False, True])
def test_good_and_broken_files(spark, tmp_path, whole):
    (tmp_path / "in").mkdir()
    for name, text in (("a.json", '{"id": "p1", "n": 3}'), ("b.json", '{"id": "p2", "n"'), ("c.json", '{"id": "p3", "n": null}')):
        (tmp_path / "in" / name).write_text(text)
    rows = K.checked_files(spark, str(tmp_path / "in"), "id string, n int", {"id": "^p", "n": None}, whole)
    good, bad = K.write_checked(rows, str(tmp_path / "out"))
    assert [(r.id, r.n, r.fil) for r in good.collect()] == [("p1", 3, "a.json")] and good.columns == ["id", "n", "fil"]
    assert sorted((r.fil, r.brister, r._trasig) for r in bad.collect()) == [("b.json", ["_trasig"], '{"id": "p2", "n"'), ("c.json", ["n"], None)]


# ---- tables ----


CHANGES = "id int, seq int, namn string, mail string, borta boolean"


def test_changes_touch_their_folders_only(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = merging_changes(spark, f"file://{path}", "id", "seq", ["mail"], "borta", 8)
    merge(spark.createDataFrame([(i, 0, f"n{i}", f"m{i}", False) for i in range(60)], CHANGES), 0)
    before = files(path)
    changes = [(1, 2, "ny", None, False), (1, 1, "gammal", "x", False), (2, 1, None, None, True), (99, 1, "z", None, None), (98, 1, "y", None, True)]
    merge(spark.createDataFrame(changes, CHANGES), 1)
    got = {r.id: (r.namn, r.mail, r.historisk) for r in spark.read.parquet(path).collect()}
    assert len(got) == 62 and got[1] == ("ny", "m1", False) and got[2] == ("n2", "m2", True) and got[3] == ("n3", "m3", False) and got[99] == ("z", None, False) and got[98] == ("y", None, True)
    touched = {r.m for r in spark.createDataFrame([(1,), (2,), (99,), (98,)], "id int").select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("m")).collect()}
    after = files(path)
    assert {f for f, _ in before - after} <= {f"mapp={m}" for m in touched} and {f"mapp={m}" for m in touched} == {f for f, _ in after - before}
    merge(spark.createDataFrame(changes, CHANGES), 1)  # once more
    assert {r.id: (r.namn, r.mail, r.historisk) for r in spark.read.parquet(path).collect()} == got
    now = files(path)
    merge(spark.createDataFrame([], CHANGES), 2)
    assert files(path) == now
    merge(spark.createDataFrame([(2, 3, "åter", None, False)], CHANGES), 3)
    assert spark.read.parquet(path).filter("id = 2").first().asDict()["historisk"] is False


def test_changes_as_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, k, f"n{i}-{k}", None, False) for i in range(k, 6)], CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge = merging_changes(spark, f"file://{tmp_path}/t", "id", "seq", ["mail"], "borta", 4)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    assert {r.id: r.namn for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {0: "n0-0", 1: "n1-1", **{i: f"n{i}-2" for i in range(2, 6)}}


def test_enrichment_leaves_other_files_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"d{i % 5}" if i % 5 else None, "gammal" if i == 7 else None) for i in range(40)]
    spark.createDataFrame(rows, "id int, dag string, text string").repartition("dag").write.partitionBy("dag").parquet(path)
    before = files(path)
    add = spark.createDataFrame([(2, "b"), (2, "a"), (7, "x"), (5, "c"), (500, "y"), (None, "z")], "id int, text string")
    sinks.enrich_in_place(add, path, "dag", "id")
    got = {r.id: (r.dag, r.text) for r in spark.read.parquet(path).collect()}
    assert got == {i: (d, {2: "a", 5: "c"}.get(i, t)) for i, d, t in rows}
    assert {f for f, _ in before - files(path)} == {"dag=d2", "dag=__HIVE_DEFAULT_PARTITION__"}
    now = files(path)
    sinks.enrich_in_place(add, path, "dag", "id")
    assert files(path) == now  # nothing is lacking any more
    sinks.enrich_in_place(spark.createDataFrame([(1, "https://x.example")], "id int, url string"), path, "dag", "id")
    assert {r.id: r.url for r in spark.read.option("mergeSchema", True).parquet(path).filter("url is not null").collect()} == {1: "https://x.example"}
    sinks.enrich_in_place(spark.createDataFrame([(3, "https://y.example")], "id int, url string"), path, "dag", "id")
    assert {r.id: r.url for r in spark.read.option("mergeSchema", True).parquet(path).filter("url is not null").collect()} == {1: "https://x.example", 3: "https://y.example"}


def test_a_snapshot_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", None)], "f string, t string")
    keys, references = {"nodes": "id"}, [("edges", "f", "nodes", "id"), ("edges", "t", "nodes", "id")]
    sinks.rebuild({"nodes": nodes, "edges": edges}, path, keys, references)
    first = sinks.snapshot(spark, path, "nodes").inputFiles()
    for bad_nodes, bad_edges in ((nodes, edges.union(spark.createDataFrame([("a", "x")], "f string, t string"))), (nodes.union(nodes), edges), (nodes.union(spark.createDataFrame([(None,)], "id string")), edges)):
        with pytest.raises(ValueError, match="edges.t|nodes.id"):
            sinks.rebuild({"nodes": bad_nodes, "edges": bad_edges}, path, keys, references)
        assert sinks.snapshot(spark, path, "nodes").inputFiles() == first
    sinks.rebuild({"nodes": nodes.filter("id = 'a'"), "edges": edges.filter("t is null")}, path, keys, references)
    assert [r.id for r in sinks.snapshot(spark, path, "nodes").collect()] == ["a"] and sinks.snapshot(spark, path, "edges").count() == 1
