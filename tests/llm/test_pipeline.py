"""The corpus pipeline against brute force, stage by stage, and on rows with nulls and repeats."""

import re
from collections import Counter

import zstandard

import corpus_pipeline
from plenum.llm import mixing, packing, quality, tokens
from plenum.llm.scratch import stored
from tests.llm.test_operators import AWKWARD, SCHEMA, SF, brute_components


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)

    kept = stored(stages["quality rules"](spark, docs, SF))
    want = {r.doc_id for r in docs.collect() if quality.measure(r.text, packer)[-1]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want

    unique = stored(stages["exact dedup"](spark, kept, SF))
    first = {}
    for r in sorted(kept.collect()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(first.values())

    far = stored(stages["n-gram Jaccard join"](spark, unique, SF))
    rows = sorted(unique.collect())
    _, comp = brute_components([r.text for r in rows])
    assert far.columns == docs.columns and sorted(r.doc_id for r in far.collect()) == sorted({rows[c].doc_id for c in comp})

    mix = stored(stages["mixing sources"](spark, far, SF))
    copies = {r.doc_id: r.copies for r in mixing.mixed(far).collect()}
    assert mix.columns == docs.columns and Counter(r.doc_id for r in mix.collect()) == {k: v for k, v in copies.items() if v}

    out = stages["packing"](spark, mix, SF).collect()
    encode = tokens.encoder(tokens.vocabulary_path()).encode
    assert sum(r.length for r in out) == sum(len(encode(r.text)) // 4 for r in mix.collect())
    ends = Counter()
    for r in out:
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert max(ends.values()) <= packing.SIZE and sum(ends.values()) == sum(r.length for r in out)

    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in out)


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD * 2 + [(50, " ".join(f"word{i}" for i in range(40)), None, None, 1, 1, "", "", 1, 1, 1, "")], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stored(stage(spark, df, SF), name.replace(" ", "_"))
    assert {r.doc_id for r in df.collect()} <= {50, 9, 8, None}
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() >= df.count() - 1
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
