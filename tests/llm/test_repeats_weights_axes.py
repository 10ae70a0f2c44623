"""Repeated strings, importance weights and whitening against brute force and linear algebra, and on awkward input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plenum.llm import importance, queries, suffix_sort, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, chunk long, raw string, n long, score string, rank int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "r", 2, "s", 3) for i, t in enumerate(texts)], SCHEMA)


# ---- repeated strings ----


def brute_repeats(texts, threshold):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(x[i : i + threshold] for x in raw for i in range(len(x) - threshold + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - threshold + 1):
            if counts[x[i : i + threshold]] > 1:
                gone[i : i + threshold] = b"\1" * threshold
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(x), spans, bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    return out


def found_repeats(df, threshold):
    rows = suffix_sort.repeats(df, threshold).collect()
    return sorted((r.doc_id, r.n_bytes, [(s.first, s.last) for s in r.spans], bytes(r.kept)) for r in rows)


def invented(seed, letters):
    rng, texts = random.Random(seed), []
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 50, 300])))
        if texts and rng.random() < 0.6:
            other = rng.choice(texts)
            i = rng.randrange(len(other) + 1)
            text += other[i : i + rng.randrange(60)] + text[:20]
        if rng.random() < 0.1:
            text = "x" * rng.randrange(100) + text + "abc" * rng.randrange(40)
        texts.append(text)
    return [*texts, None, "", texts[5], texts[5]]


@pytest.mark.parametrize("seed,threshold,letters", [(0, 8, "abcdefgh"), (1, 20, "ab"), (2, 50, "abcdé€"), (3, 3, "ab"), (4, 1, "abc")])
def test_repeats_by_brute_force(spark, seed, threshold, letters, monkeypatch):
    monkeypatch.setattr(suffix_sort, "CHUNK", 300)
    texts = invented(seed, letters)
    assert found_repeats(frame(spark, texts), threshold) == [(i, *x) for i, x in enumerate(brute_repeats(texts, threshold))]


@pytest.mark.parametrize("block", [40, 128, 1 << 19])
def test_runs_cover_every_window_once(block, monkeypatch):
    monkeypatch.setattr(suffix_sort, "BLOCK", block)
    monkeypatch.setattr(suffix_sort, "_sums", {})
    rng = random.Random(block)
    pieces = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (30, 0, 19, 20, 21, 200, 5)]
    sizes = np.array([*map(len, pieces)])
    begins = np.cumsum(sizes) - sizes
    want = sorted(b + i for b, n in zip(begins.tolist(), sizes.tolist(), strict=True) for i in range(n - 20 + 1))
    for depth in suffix_sort.depths(20):
        first, last, digit, _ = suffix_sort.runs(np.frombuffer(b"".join(pieces), np.uint8), sizes, depth, 20)
        assert sorted(i for a, b in zip(first.tolist(), last.tolist(), strict=True) for i in range(a, b)) == want
        raw = b"".join(pieces)
        by_window = {}
        for a, b, d in zip(first.tolist(), last.tolist(), digit.tolist(), strict=True):
            for i in range(a, b):
                assert by_window.setdefault(raw[i : i + 20], d) == d  # equal windows meet under one digit


def test_depths_rise_to_the_threshold():
    assert suffix_sort.depths(200) == [100, 167, 189, 197, 200] and suffix_sort.depths(1) == [1]
    for t in range(1, 400):
        assert suffix_sort.depths(t) == sorted({*suffix_sort.depths(t)}) and suffix_sort.depths(t)[0] >= 1


def test_repeats_of_long_and_periodic_texts(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefghij ") for _ in range(1_300_000))
    texts = [long, "y" + long[600_000:600_250], "x" * 5000, "abc" * 200, long[1_299_801:], long[-200:]]
    got = {r[0]: r for r in found_repeats(frame(spark, texts), 200)}
    assert got[0][2] == [(600_000, 600_250), (1_299_800, 1_300_000)] and got[1][2] == [(1, 251)]
    assert got[2][2] == [(0, 5000)] and got[3][2] == [(0, 600)] and got[4][2] == [] and got[5][2] == [(0, 200)]
    assert got[0][3].decode() == long[:600_000] + long[600_250:1_299_800]


def test_a_passage_that_all_texts_share(spark, monkeypatch):
    monkeypatch.setattr(suffix_sort, "CHUNK", 20_000)
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(700))
    texts = [f"{i} {rng.random()} " + passage + f" {rng.random()} {i}" for i in range(300)]
    got = found_repeats(frame(spark, texts), 200)
    assert got == [(i, *x) for i, x in enumerate(brute_repeats(texts, 200))]
    state = suffix_sort.over_cores(frame(spark, texts).select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(suffix_sort._chunked(20_000), suffix_sort.CHUNKS)
    entries = state.drop("ids").mapInArrow(suffix_sort._entries(100, 200), suffix_sort.ENTRIES)
    most, chunks = entries.groupBy("digit").count().agg(F.max("count")).first()[0], entries.select("chunk").distinct().count()
    assert most <= chunks < 30  # a row per chunk, not per text


def test_awkward_texts(spark):
    texts = [None, "", "é" * 150, "é" * 150, "z" * 199, "z" * 199, "\0" * 300, "a" * 200]
    assert found_repeats(frame(spark, texts), 200) == [(i, *x) for i, x in enumerate(brute_repeats(texts, 200))]
    assert suffix_sort.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(None, "q" * 100 + "r" * 150)] * 2 + [(None, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, len(r.kept)) for r in suffix_sort.repeats(twice).collect()) == [(0, 0), (250, 0), (250, 0)]
    with pytest.raises(ValueError):
        suffix_sort.repeats(twice, 0)


def test_repeats_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: x for d, x in zip(docs, brute_repeats([d.text for d in docs], 200), strict=True)}
    for r in queries.queries()["op11_suffix_sort"](spark, SF).collect():
        size, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


# ---- importance ----


@given(st.binary(max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_by_pattern(raw):
    text = raw.decode("utf-8", "ignore")
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [w.decode() for w in importance.words(text.encode())] == WORD.findall(lower)


@given(st.integers(1, 200), st.data())
@settings(max_examples=60, deadline=None)
def test_planes_sum_exactly(width, data):
    counts = np.array(data.draw(st.lists(st.lists(st.integers(0, 1 << 40), min_size=width, max_size=width), min_size=1, max_size=3)), np.int64)
    gain = np.array(data.draw(st.lists(st.integers(-(1 << 15), 1 << 15), min_size=width, max_size=width)), np.int64)
    positive, negative = (importance.planes(np.maximum(sign * gain, 0)[None]) for sign in (1, -1))
    assert importance.weighed(counts, positive, negative).tolist() == (counts @ gain).tolist()


def brute_weights(texts, target, longest=1):
    def buckets(text):
        found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(found), [zlib.crc32(" ".join(found[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(found) - n + 1)]

    mine, theirs = [buckets(t) for t in texts], Counter(b for t in target for b in buckets(t)[1])
    own = Counter(b for _, x in mine for b in x)
    s_all, t_all = sum(own.values()) + 10000.0, sum(theirs.values()) + 10000.0
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1.0) * s_all / ((own[b] + 1.0) * t_all)))
    return [(n, len(x), sum(map(gain, x)) // len(x) if x else 0) for n, x in mine]


def gumbel(doc_id):
    h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


@pytest.mark.parametrize("longest", [1, 3])
def test_weights_and_ranks_by_brute_force(spark, longest):
    rng = random.Random(longest)
    texts = [" ".join(rng.choice(["ett", "två", "TRE", "4", "fem-sex", "Ärende"]) for _ in range(rng.choice([0, 5, 25, 60, 3000]))) for _ in range(150)] + [None, ""]
    target = ["tre tre fem", "ärende 4", None]
    want = [(i, *w, w[2] + gumbel(i)) for i, w in enumerate(brute_weights(texts, target, longest))]
    eligible = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0]))
    ranks = {w[0]: k + 1 for k, w in enumerate(eligible[: 10 * len(eligible) // 100])}
    got = importance.resampled(frame(spark, texts), spark.createDataFrame([(t,) for t in target], "text string"), longest).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(*w, ranks.get(w[0])) for w in want]


def test_resampling_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = con.sql(queries.oracle_sql()["op12_resampling"])
    df = queries.queries()["op12_resampling"](spark, SF)
    assert df.columns == sql.columns and {*map(str, sql.types)} == {"BIGINT"} and {k for _, k in df.dtypes} == {"bigint"}
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(sql.fetchall())
    docs = con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    weights = brute_weights([t for _, t in docs], [t for (t,) in con.sql("SELECT text FROM benchmark").fetchall()])
    assert [(r[0], r[1], r[2]) for r in got] == [(d, n, w) for (d, _), (_, n, w) in zip(docs, weights, strict=True)]


def test_repeated_rows_are_drawn_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(importance, "LOT", 7)
    long, short = "word " * 30, "few words"
    rows = [(None, long)] * 40 + [(3, long)] * 25 + [(k, short) for k in range(10)] + [(4, None)]
    out = importance.resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"), percent=50).collect()
    assert len(out) == len(rows) and sorted(r.rank for r in out if r.rank) == [*range(1, 33)]
    first = max((3, None), key=gumbel)  # equal weights
    assert [r.doc_id for r in sorted((r for r in out if r.rank), key=lambda r: r.rank)][:25] == [first] * 25
    assert importance.resampled(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")).count() == 0


def test_drawn_rows_come_back_unchanged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"weight": F.lit("w"), "bucket": F.lit(1)})
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    ranks = {r.doc_id for r in importance.resampled(docs, target).filter("rank is not null").collect()}
    out = importance.drawn(docs, target)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == ranks


# ---- whitening ----


def vectors(spark, matrix, extra=()):
    rows = [(i, [float(v) for v in x], i, "n") for i, x in enumerate(matrix)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, x string")


def by_linear_algebra(matrix, k):
    x = np.floor(64 * np.asarray(matrix, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return c @ axes / np.sqrt(values), values / np.trace(c.T @ c / n), ((n * x - sums) ** 2).sum(axis=1)


@pytest.mark.parametrize("dims,n,k", [(6, 90, 4), (40, 300, 12), (90, 200, 8)])
def test_whitened_by_linear_algebra(spark, dims, n, k):
    rng = np.random.default_rng(dims)
    matrix = rng.standard_normal((n, dims)) * np.linspace(0.5, 6, dims) + 3
    bad = [(None, None, 0, ""), (900, None, 0, ""), (901, [], 0, ""), (902, [1.0] * (dims - 1) + [None], 0, ""), (903, [1.0] * (dims - 1) + [float("nan")], 0, ""), (904, [float("inf")] * dims, 0, ""), (905, [1.0], 0, "")]
    out = whitening.whitened(vectors(spark, matrix, bad), k).orderBy("vec_id", "component").collect()
    white, explained, deviation = by_linear_algebra(matrix, k)
    got = np.array([r.whitened for r in out]).reshape(n, k)
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-9
    assert [int(r.deviation) for r in out[::k]] == deviation.tolist() and {r.n for r in out} == {n}
    assert np.allclose([r.explained for r in out[:k]], explained, rtol=1e-12) and out[0].identity_error < 1e-12


def test_whitening_query_by_linear_algebra(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    white, explained, deviation = by_linear_algebra([r.embedding for r in rows], 32)
    df = queries.queries()["op13_whitening"](spark, SF).orderBy("vec_id", "component")
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    out = df.collect()
    got = np.array([r.whitened for r in out]).reshape(len(rows), 32)
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-8
    assert [r.deviation for r in out[::32]] == deviation.tolist() and np.allclose([r.explained for r in out[:32]], explained)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-10


@pytest.mark.parametrize("dims,k", [(1, 1), (2, 2), (64, 32), (150, 5), (200, 32)])
def test_eigenpairs_to_double_precision(dims, k):
    rng = np.random.default_rng(k)
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    values = np.sort(rng.exponential(1, dims))[::-1] + 0.01
    values[: min(3, dims)] = values[0]  # a multiple eigenvalue
    a = (q * values) @ q.T
    theta, axes, residual = whitening.jacobi_davidson(lambda block: a @ block, dims, k)
    assert np.abs(theta - values[:k]).max() < 1e-12 * values[0] and residual < 1e-12 * values[0]
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12


def test_minres_is_optimal_in_its_krylov_space():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a, right = a + a.T, rng.standard_normal((30, 4))
    for steps in (1, 3, 6):
        x = whitening.minres(lambda block: a @ block, right, steps, 0)
        for j in range(4):
            krylov = [right[:, j]]
            for _ in range(steps - 1):
                krylov.append(a @ krylov[-1])
            basis = np.linalg.qr(np.array(krylov).T)[0]
            best = np.linalg.lstsq(a @ basis, right[:, j])[0]
            assert np.linalg.norm(a @ x[:, j] - right[:, j]) == pytest.approx(np.linalg.norm(a @ basis @ best - right[:, j]), rel=1e-8)
    assert not whitening.minres(lambda block: a @ block, np.zeros((30, 2)), 5, 0).any()


def test_degenerate_vectors(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [[1.0, 2.0]] * 5)).count() == 0  # nothing varies
    out = whitening.whitened(vectors(spark, [[1.0, 0.0, 5.0], [2.0, 0.0, 5.0], [4.0, 1.0, 5.0]] * 2)).collect()
    assert {r.component for r in out} == {1, 2} and len(out) == 12 and out[0].identity_error < 1e-12  # repeated rows, a constant dimension
    huge = np.array([[10**6, 0], [0, 10**6]])
    exact = whitening.deviations(np.array([[2 * 10**9, 5], [1, 7]]) * 10, 10**6, huge.sum(axis=0))
    assert [int(d) for d in exact] == [sum((10**6 * 10 * a - 10**6) ** 2 for a in row) for row in ([2 * 10**9, 5], [1, 7])]


def test_parts_are_added_in_groups(spark):
    rows = spark.range(1000).repartition(30).select(F.array("id", F.lit(1).cast("long")).alias("x"))
    assert whitening._added(rows, lambda x: x.sum(axis=0), whole=True).tolist() == [499500, 1000]
    assert whitening._added(rows.limit(0), lambda x: x.sum(axis=0)) is None
