"""The inverted index: reads few folders, is appended to; covers and fragments by brute force. All texts are invented."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from plenum.operators import index as I
from plenum.operators.search import STOP_WORDS, search, stem


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc int, text string")


def built(spark, path, *texts):
    I.append(docs(spark, *texts), "doc", "text", path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_index_gives_what_a_scan_gives_and_grows_by_appends(spark, tmp_path):
    rng = random.Random(1)
    words = ["vägen", "vägar", "skolan", "skolor", "och", "budget", "budgeten", "park", "8"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 12, 60]))) for _ in range(80)] + [None, "", "och att i"]
    path = f"file://{tmp_path}/index"
    all_docs = docs(spark, *texts)
    for k in range(3):
        I.append(all_docs.filter(F.col("doc") % 3 == k), "doc", "text", path)
        for question in ("väg skola", "budgeten", "parker och budget", "saknas"):
            want = search(all_docs.filter(F.col("doc") % 3 <= k), "doc", "text", question).select("doc", "poang")
            assert sorted(map(tuple, I.ranked(spark, path, "doc", question).select("doc", "poang").collect())) == sorted(map(tuple, want.collect()))
    assert I.ranked(spark, path, "doc", "och att").count() == 0  # nothing but stop words


def test_a_question_reads_the_folders_of_its_stems_only(spark, tmp_path):
    path = built(spark, f"file://{tmp_path}/index", *[f"ord{i} namn{i}" for i in range(200)])
    rows = I.occurrences(spark, path, "ord7 namn9")
    text = plan(rows)
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", text, re.S)
    assert "mapp" in filters[1] and "stam" in filters[2]
    folders = {r.mapp for r in spark.range(1).select(F.explode(F.array(*[I._folder(stem(F.lit(w))) for w in ("ord7", "namn9")])).alias("mapp")).collect()}
    assert {*map(int, re.search(r"mapp#\d+ IN \(([\d,]+)\)", filters[1])[1].split(","))} == folders
    assert spark.read.parquet(path).select("mapp").distinct().count() > 40


@pytest.mark.parametrize("seed", range(4))
def test_shortest_cover_by_brute_force(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 3, 4])
    cases = [sorted({(rng.randrange(1, 40), rng.randrange(n)) for _ in range(rng.randrange(0, 14))}) for _ in range(30)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, hits array<struct<plats:int,nr:int>>")
    got = {r.i: r.c for r in rows.select("i", I.shortest_cover(F.col("hits"), F.lit(n)).alias("c")).collect()}
    for i, hits in enumerate(cases):
        covers = [b - a + 1 for a, b in itertools.product({p for p, _ in hits}, repeat=2) if a <= b and {k for p, k in hits if a <= p <= b} == set(range(n))]
        assert got[i] == (min(covers) if covers else None)


def brute_fragment(text, stems, stemmed):
    pieces = re.findall(r"[^\W_]+|(?:[\W_])+", text)
    is_word = lambda x: bool(re.match(r"[^\W_]", x))
    at = [j for j, x in enumerate(pieces) if is_word(x)]
    number = [stems.index(stemmed[pieces[j].lower()]) if pieces[j].lower() not in STOP_WORDS and stemmed[pieces[j].lower()] in stems else -1 for j in at]
    best = None
    for i, k in enumerate(number):
        if k >= 0:
            here = [x for x in number[i : i + 60] if x >= 0]
            best = max(best or (0, 0, 0), (len(set(here)), len(here), -i))
    if best is None:
        return None
    begin = max(0, min(-best[2], len(at) - 20))
    last = min(begin + 60, len(at)) - 1
    hit = {j for j, k in zip(at, number, strict=True) if k >= 0}
    return "".join(f"<b>{pieces[j]}</b>" if j in hit else pieces[j] for j in range(at[begin], at[last] + 1))


def test_fragments_by_brute_force(spark):
    rng = random.Random(3)
    words = ["Vägen", "skolor", "SKOLAN", "och", "park", "é8", "budgetar", *[f"x{i}" for i in range(25)]]
    texts = ["".join(rng.choice(["", "(", " – "]) + rng.choice(words) + rng.choice([" ", ", ", ".\n", " – "]) for _ in range(rng.choice([1, 5, 19, 21, 59, 61, 200, 400]))) for _ in range(40)]
    texts = [re.sub(r"(?<=\w)(?=[A-Z(])", " ", t) for t in texts] + ["", "...", "skola", None]
    question = "väg skolan budget"
    vocabulary = sorted({w.lower() for t in texts if t for w in re.findall(r"[^\W_]+", t)} | set(I.asked(question)))
    stemmed = {r.w: r.s for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    stems = list(dict.fromkeys(stemmed[w] for w in I.asked(question)))
    got = {r.doc: r.f for r in docs(spark, *texts).select("doc", I.fragment(F.col("text"), question).alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (brute_fragment(t, stems, stemmed) if t is not None else None)


def test_a_search_page(spark, tmp_path):
    texts = ["Vägen till skolor är ny. " + "fyll " * 80, "skolor " + "fyll " * 50 + "vägen", "bara skolor", "fyll " * 90 + "Skola, väg (ny)."]
    path = built(spark, f"file://{tmp_path}/index", *texts)
    hits = I.ranked(spark, path, "doc", "skola väg").orderBy(F.desc("tathet"), "doc").limit(2)
    page = I.headlines(docs(spark, *texts), "doc", "text", hits, "skola väg").orderBy(F.desc("tathet"), "doc").collect()
    assert [(r.doc, r.tathet) for r in page] == [(0, 1.0), (3, 1.0)]  # stop words leave no gap
    found = {r.doc: r.utdrag for r in page}
    assert found[0].startswith("<b>Vägen</b> till <b>skolor</b> är ny. fyll") and found[3].endswith("<b>Skola</b>, <b>väg</b> (ny")
    assert len(found[3].split()) == 20
