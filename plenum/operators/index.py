"""An inverted index of stems as a partitioned table, and ranked search through it.

A row is a document's occurrences of one stem: their places, counted in stems of the document.  Rows lie in folders by a hash of the
stem, sorted by it, so a question reads the folders of its own stems only and skips most of each by Parquet's statistics.  A stem that
most documents have is as many rows as documents, never one list.  New documents are appended; the table needs no rewriting.

Rank: the share of the question's stems among a document's (as in ``search``), and cover density, the number of the question's stems
over the length of the shortest run of words that holds them all.
"""

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators.search import ENDING, STOP_WORDS, WORD, stem

#: Folders of an index.
FOLDERS = 64
#: Of a fragment, words at most and at least.
MOST_WORDS = 60
LEAST_WORDS = 20


def asked(question: str) -> list[str]:
    """The question's words that count, once each, in lower case."""
    return [w for w in dict.fromkeys(re.findall(r"[^\W_]+", question.lower())) if w not in STOP_WORDS]


def _folder(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(FOLDERS)).cast("int")


#: Words that are grouped at a time, and words whose stems a Python worker keeps.
STEP_WORDS = 1 << 19
KEPT_WORDS = 150_000
_ending, _known = re.compile(ENDING), {}


def _stem_of(word: str) -> str | None:
    """``stem`` in Python; None for a stop word."""
    if len(_known) > KEPT_WORDS:
        _known.clear()
    if word not in _known:
        _known[word] = None if word in STOP_WORDS else _ending.sub(r"\1", word)
    return _known[word]


def _grouped(keys: pa.Array, words: pa.Array) -> pa.RecordBatch:
    """Rows of ``postings`` of some documents, of their words in order."""
    doc, coded = pc.list_parent_indices(words).to_numpy(), words.flatten().dictionary_encode()
    of_word = [_stem_of(w) for w in coded.dictionary.to_pylist()]
    stems_ = sorted({s for s in of_word if s is not None})
    number = {s: i for i, s in enumerate(stems_)}
    nr = np.array([number.get(s, -1) for s in of_word], np.int64)[coded.indices.to_numpy()]
    doc, nr = doc[nr >= 0], nr[nr >= 0]
    langd = np.bincount(doc, minlength=len(keys))
    place = np.arange(1, len(doc) + 1) - (np.cumsum(langd) - langd)[doc]
    both = doc * len(stems_) + nr
    order = np.argsort(both, kind="stable")
    start = np.flatnonzero(np.diff(both[order], prepend=-1))
    doc, nr = doc[order][start], nr[order][start]
    places = pa.ListArray.from_arrays(pa.array(np.append(start, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), pa.array(stems_, pa.string()).take(pa.array(nr)), places, pa.array(langd[doc], pa.int32())], ["key", "stam", "platser", "langd"])


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP_WORDS, "right")))
            yield _grouped(batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin))
            begin = end


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, stam, platser (1, 2, ...: places among the document's stems, stop words not counted), langd (their number).

    A document is one row, so its words are grouped where it is read: nothing is shuffled, and a stem is found once per word of a batch.
    """
    words = docs.select(F.col(key).alias("key"), F.regexp_extract_all(F.lower(text), F.lit(WORD), 0).alias("ord"))
    rows = words.mapInArrow(_per_document, f"key {docs.schema[key].dataType.simpleString()}, stam string, platser array<int>, langd int")
    return rows.withColumnRenamed("key", key)


def append(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Write the documents' postings beside those that the index at ``path`` already has; a document is indexed once."""
    rows = postings(docs, key, text).withColumn("mapp", _folder(F.col("stam")))
    # A folder's rows come from several tasks: a frequent stem's would be too many for one.
    dealt = rows.repartition("mapp", F.pmod(F.xxhash64(key), F.lit(4)))
    dealt.sortWithinPartitions("mapp", "stam", key).write.mode("append").option("compression", "zstd").partitionBy("mapp").parquet(path)


def _stems(question: str) -> list[Column]:
    """The question's stems as constants."""
    return [stem(F.lit(w)) for w in asked(question)]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def occurrences(spark: SparkSession, path: str, question: str) -> DataFrame:
    """The index's rows of the question's stems, with ``nr``, the stem's number in the question; reads their folders only."""
    index, wanted = spark.read.parquet(path), _stems(question)
    if not wanted:
        return index.limit(0).withColumn("nr", F.lit(0))
    rows = index.filter(F.col("mapp").isin(*map(_folder, wanted)) & F.col("stam").isin(*wanted))
    return rows.withColumn("nr", (F.array_position(F.array_distinct(F.array(*wanted)), F.col("stam")) - 1).cast("int"))


def shortest_cover(hits: Column, n: Column) -> Column:
    """Length in words of the shortest run that holds all ``n`` stems, of ``hits`` (plats, nr) in order; null if none does.

    One sweep: the last place of each stem so far; the run that ends here begins at the earliest of them.
    """
    start = F.struct(F.array_repeat(F.lit(0), n).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(at: Column, hit: Column) -> Column:
        last = F.transform(at["last"], lambda x, i: F.when(i == hit["nr"], hit["plats"]).otherwise(x))
        return _let(last, lambda x: F.struct(x.alias("last"), F.least(at["best"], F.when(F.array_min(x) > 0, hit["plats"] - F.array_min(x) + 1)).alias("best")))

    return F.aggregate(hits, start, step, lambda at: at["best"])


def ranked(spark: SparkSession, path: str, key: str, question: str) -> DataFrame:
    """key, poang, tathet, traffar (plats, nr in order) of documents that hold every stem of the question."""
    rows, wanted = occurrences(spark, path, question), _stems(question)
    n = F.size(F.array_distinct(F.array(*wanted))) if wanted else F.lit(1)
    per = rows.groupBy(key).agg(F.max("langd").alias("langd"), F.collect_list(F.struct("nr", "platser")).alias("x")).filter(F.size("x") == n)
    hits = F.array_sort(F.flatten(F.transform("x", lambda r: F.transform(r["platser"], lambda p: F.struct(p.alias("plats"), r["nr"].alias("nr"))))))
    per = per.select(key, "langd", hits.alias("traffar"))
    score = F.floor(F.size("traffar") / F.col("langd") * 1e6 + 0.5) / 1e6
    density = F.floor(n / shortest_cover(F.col("traffar"), n) * 1e6 + 0.5) / 1e6
    return per.select(key, score.alias("poang"), density.alias("tathet"), "traffar")


def fragment(text: Column, question: str) -> Column:
    """The passage of MOST_WORDS words that holds most of the question's stems, hits in <b> and </b>.

    Of passages that begin at a hit, the one with most different stems, then most hits, then the first; near the end of a text it
    begins earlier so that it has LEAST_WORDS words.  What stands between words is kept as it is; without a hit, null.
    """
    wanted = F.array_distinct(F.array(*_stems(question))) if asked(question) else F.array().cast("array<string>")
    number = lambda w: F.when(F.lower(w).isin(*STOP_WORDS), -1).otherwise(F.array_position(wanted, stem(F.lower(w))).cast("int") - 1)

    def scored(places: Column) -> Callable[[Column, Column], Column]:
        def score(h: Column, i: Column) -> Column:
            here = F.filter(F.slice(places, i + 1, F.lit(MOST_WORDS)), lambda x: x["at"] < h["at"] + MOST_WORDS)
            return _let(here, lambda x: F.struct(F.size(F.array_distinct(F.transform(x, lambda y: y["nr"]))).alias("stems"), F.size(x).alias("hits"), (-h["at"]).alias("at")))

        return score

    def cut(pieces: Column, lead: Column, found: Column, best: Column) -> Column:
        begin = F.greatest(F.lit(0), F.least(-best["at"], F.size(found) - LEAST_WORDS))
        n = F.least(F.lit(MOST_WORDS), F.size(found) - begin)
        is_hit = lambda i: (i % 2 == 0) & (F.get(found, begin + F.floor(i / 2).cast("int")) >= 0)
        passage = F.slice(pieces, lead + begin * 2 + 1, n * 2 - 1)
        return F.array_join(F.transform(passage, lambda x, i: F.when(is_hit(i), F.concat(F.lit("<b>"), x, F.lit("</b>"))).otherwise(x)), "")

    def of(pieces: Column, lead: Column) -> Column:
        words = F.filter(pieces, lambda _, i: (i - lead) % 2 == 0)  # words and what is between them alternate
        places = lambda found: F.filter(F.transform(found, lambda s, i: F.struct(i.alias("at"), s.alias("nr"))), lambda h: h["nr"] >= 0)
        best = lambda found: _let(places(found), lambda p: F.array_max(F.transform(p, scored(p))))
        return _let(F.transform(words, number), lambda found: _let(best(found), lambda b: F.when(b.isNotNull(), cut(pieces, lead, found, b))))

    pieces = F.regexp_extract_all(text, F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}]+"), 0)
    return _let(pieces, lambda p: _let(F.when(F.get(p, 0).rlike(f"^{WORD}"), 0).otherwise(1), lambda lead: of(p, lead)))


def headlines(docs: DataFrame, key: str, text: str, hits: DataFrame, question: str) -> DataFrame:
    """``hits`` with ``utdrag``, a fragment of each document's text."""
    return hits.join(docs.select(key, F.col(text).alias("_text")), key).select(*hits.columns, fragment(F.col("_text"), question).alias("utdrag"))
