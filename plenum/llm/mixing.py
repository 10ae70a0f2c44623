"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Each document expects a number of copies: its source's target over its size, which is the same for all of a source, but for its few
large documents.  Their expectation is adjusted first: one of more than 1 / LARGE of its source expects a whole number, so that no
chance decides on it, and the others share what that leaves of the target.  Then all documents go the same way.  Expected copies are
prefix-summed within the source, large documents first, then in order of size class and of a hash; one random offset is added, and a
document is emitted once per integer boundary that its own step crosses.  The offset is the one of OFFSETS seeded and evenly spaced
ones whose words come nearest to the target.

The prefix sum is in two levels, so no task holds a source: sums within blocks of (source, size class, slot of the hash), and
over the blocks before.  The table of blocks is what one task per source sorts.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.scratch import KEY, ROW, emitted, key_of, over_cores, spread, stored

# Weights of the sources in code-point order, repeating; all targets' share of all sizes; a source's most.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: A source has fewer than so many documents of more than 1 / LARGE of its size.
LARGE = 50
OFFSETS = 16
#: Rows of a source meet what is known of the source in so many lots.
RUNS = 64
BLANK = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def size_class(size: Column) -> Column:
    """Sortable: the number of binary digits, then the first three of them."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 3))


def targets(sources: DataFrame) -> DataFrame:
    """``key, source_size`` with ``target``: a share by weight, at most MOST sizes, the excess reshared by weight.

    Resharing until no target is above its limit ends at one level per unit of weight: sources with the least limit per weight
    stop, in that order, and the rest is shared among the others.  The table has a row per source.
    """
    place = F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("double")
    earlier = Window.orderBy("stops", "key").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy()
    level = (F.col("wanted") - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / (F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    return (
        sources.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(MOST))
        .withColumn("stops", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(all_of) * F.lit(SHARE))
        .withColumn("level", level)  # if all sources before stop; it rises up to the first that does not, then falls
        .withColumn("target", F.least("most", F.col("weight") * F.max("level").over(all_of)))
        .select("key", "source_size", "target")
    )


def _whole(sizes: Column, source_size: Column, target: Column) -> Column:
    """Whole copies for sizes in falling order: an array of them, the words they take, and the words they have.

    A document's share of what is left to take is rounded, within what leaves the documents after it a share of 0 to MOST.
    """
    start = F.struct(F.array().cast("array<long>").alias("copies"), target.alias("left"), source_size.cast("double").alias("rest"))

    def next_(at: Column, size: Column) -> Column:
        share = F.floor(at["left"] / at["rest"] + 0.5)
        low = F.ceil((at["left"] - MOST * (at["rest"] - size)) / size)
        high = F.floor(at["left"] / size)
        fitting = F.when(low <= high, F.least(high, F.greatest(low, share))).otherwise(F.floor(at["left"] / size + 0.5))
        n = F.least(F.lit(int(MOST)).cast("long"), F.greatest(F.lit(0).cast("long"), fitting))
        return F.struct(F.concat(at["copies"], F.array(n)).alias("copies"), (at["left"] - n * size).alias("left"), (at["rest"] - size).alias("rest"))

    return F.aggregate(sizes, start, next_)


def copies(sized: DataFrame) -> DataFrame:
    """``sized`` (ROW, doc_id, source, size, tie, stored) with source_size, target and copies (0, 1 or 2).

    Rows of equal source, doc_id, size and tie are taken for the same and change places at will; all others are ordered alike
    in every run.
    """
    digits = max(1, round(math.log(max(1.0, sized.count() ** 0.5 / 64), 16)))  # of the hash, that split a size class
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("z"))  # null after all names
    mark = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    block = F.concat(size_class(F.col("size")), F.substring(mark, 1, digits))
    placed = sized.withColumns({"key": key, "mark": mark, "block": block, "run": F.pmod(F.xxhash64(ROW), F.lit(RUNS))})
    totals = stored(targets(placed.groupBy("key").agg(F.sum("size").alias("source_size"))), "targets")

    # Large documents: at most LARGE - 1 a source, so their sizes are a short array.
    order = ["mark", "doc_id", "tie", ROW]
    placed = stored(spread(placed, totals, ["key"]), "placed")
    large = placed.filter(F.col("size") * LARGE > F.col("source_size"))
    listed = F.reverse(F.array_sort(F.collect_list(F.struct("size", *order))))
    whole = large.groupBy("key", "source_size", "target").agg(listed.alias("rows"))
    whole = whole.withColumn("done", _whole(F.col("rows.size"), F.col("source_size"), F.col("target")))
    rows = F.arrays_zip(F.col(f"rows.{ROW}").alias(ROW), F.col("done.copies").alias("whole"))
    adjusted = whole.select(F.explode(rows).alias("row")).select(f"row.{ROW}", "row.whole")
    rest = totals.join(whole.select("key", "done.left", "done.rest"), "key", "left").withColumns(
        {"left": F.coalesce("left", "target"), "rest": F.coalesce("rest", F.col("source_size").cast("double"))}
    )
    each = F.when(F.col("rest") > 0, F.least(F.lit(MOST), F.greatest(F.lit(0.0), F.col("left") / F.col("rest")))).otherwise(F.lit(0.0))
    rest = stored(rest.select("key", "left", each.alias("each")), "shares")

    # All documents: what is expected up to and with each of them, whole copies (w) and shares of ``each`` (k), in two levels.
    shares = F.col("whole").isNull().cast("long")
    expects = placed.join(adjusted, ROW, "left").withColumns({"share": shares, "whole": F.coalesce("whole", F.lit(0)), "block": F.when(F.col("whole").isNull(), F.col("block")).otherwise("")})
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = expects.groupBy("key", "block").agg(F.sum("share").alias("k"), F.sum("whole").alias("w"))
    before = blocks.select("key", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("k", "w")])
    inside = Window.partitionBy("key", "block").orderBy("mark", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = expects.withColumns({"k": F.sum("share").over(inside), "w": F.sum("whole").over(inside)}).join(before, ["key", "block"])
    summed = stored(summed.select("key", "run", *sized.columns, "source_size", "target", "share", "whole", (F.col("k") + F.col("k_before")).alias("k"), (F.col("w") + F.col("w_before")).alias("w")), "summed")

    shift = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), "key")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))

    def emitted_at(offset: Column) -> Column:
        crossed = lambda k, w: w + F.floor(F.col("each") * k + offset)  # noqa: E731  whole copies shift a boundary by whole numbers
        return (crossed(F.col("k"), F.col("w")) - crossed(F.col("k") - F.col("share"), F.col("w") - F.col("whole"))).cast("long")

    tried = F.transform(F.sequence(F.lit(0), F.lit(OFFSETS - 1)), lambda j: emitted_at((j + shift) / F.lit(float(OFFSETS))) * F.col("size"))
    words = spread(summed.filter("share = 1"), rest, ["key"]).select("key", "left", F.posexplode(tried).alias("j", "words")).groupBy("key", "left", "j").agg(F.sum("words").alias("words"))
    nearest = words.groupBy("key").agg(F.min_by("j", F.struct(F.abs(F.col("words") - F.col("left")), "j")).alias("j"))
    chosen = rest.join(nearest, "key", "left").select("key", "each", ((F.coalesce("j", F.lit(0)) + shift) / F.lit(float(OFFSETS))).alias("offset"))
    return spread(summed, chosen, ["key"]).select(*sized.columns, "source_size", "target", emitted_at(F.col("offset")).alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, copies.

    Null sources are a source of their own, ordered last; null and empty texts have size 0 and take no words; rows with the
    same id are separate documents, ordered by their texts; an empty table gives no rows.  Other columns are not read.  A source
    whose documents are so few and unequal that no numbers of copies make its target comes as near as they allow.
    """
    tie = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("tie")
    docs = over_cores(docs.select("doc_id", "source", "text"))
    sized = stored(docs.select(F.monotonically_increasing_id().alias(ROW), F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), tie), "sizes")
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns unchanged, each as often as the mix takes it."""
    rows = docs.select(*key_of(docs), "doc_id", "source", n_words(F.col("text")).alias("size")).withColumns({ROW: F.monotonically_increasing_id(), "tie": F.struct(*KEY)})
    return emitted(docs, copies(stored(rows, "sizes")), "copies")
