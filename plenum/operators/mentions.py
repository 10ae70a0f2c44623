"""Which texts hold which names or passages, and where first."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a name's inside that a text must have, and characters of a name's end or of a single word by which it meets words.
ANCHORS = 3
PIECE = 8
BLANK = PIECE + 1


def _keys(names: DataFrame, name_key: str, name: str) -> DataFrame:
    """name_key, _h (of the name), _need, _n, _k: what a text's words must have for the name to be in the text.

    The first and last word of a name may be parts of longer ones in the text; those between are whole words there, and the longest of
    them are keys (_n = 0).  Without any, the last word begins a word of the text (_n > 0: so many of its characters), and a single
    word lies somewhere in one (_n < 0).  A name of blanks alone has no word, so each text meets it (_n = BLANK, _k is empty).
    """
    w = F.split(F.col(name), r"\s+")
    inner = F.array_distinct(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))
    longest = F.slice(F.reverse(F.array_sort(F.transform(inner, lambda x: F.struct(F.length(x).alias("l"), x.alias("k"))))), F.lit(1), F.lit(ANCHORS))
    last, first = F.element_at(w, -1), F.get(w, 0)
    begins, within = F.left(last, F.lit(PIECE)), F.left(F.when(F.size(w) == 1, last).otherwise(first), F.lit(PIECE))
    key = lambda n, k: F.array(F.struct(n.alias("n"), k.alias("k")))
    keys = (
        F.when(F.size(inner) > 0, F.transform(longest, lambda x: F.struct(F.lit(0).alias("n"), x["k"].alias("k"))))
        .when((F.size(w) == 2) & (last != ""), key(F.length(begins), begins))
        .when(within != "", key(-F.length(within), within))
        .otherwise(key(F.lit(BLANK), F.lit("")))
    )
    found = names.filter(F.length(name) > 0).select(name_key, F.xxhash64(name).alias("_h"), keys.alias("x")).distinct()
    return found.select(name_key, "_h", F.size("x").alias("_need"), F.explode("x").alias("x")).select(name_key, "_h", "_need", F.col("x.n").alias("_n"), F.col("x.k").alias("_k"))


def _pieces(words: Column, n: int) -> Column:
    """Of a text's words those that names are looked up by: whole ones, their beginnings, or all their pieces of a length."""
    if n == BLANK:
        return F.array(F.lit(""))
    if not n:
        return words
    if n > 0:
        return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.left(w, F.lit(n))))
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + n + 1), lambda i: F.substring(w, i, F.lit(-n)))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= -n), of)))


def mentions(docs: DataFrame, key: str, text: str, names: DataFrame, name_key: str, name: str) -> DataFrame:
    """key, name_key, plats (1-based, of the first hit): one row per pair; empty names and null texts give none.

    Names and texts meet in equi-joins on a text's distinct words; texts that have all keys of a name are compared with it.
    """
    keys = _keys(names, name_key, name)
    # Texts have pieces of those lengths only that some name has: at most 2 * PIECE + 2 numbers.
    lengths = sorted(r[0] for r in keys.select("_n").distinct().collect())
    texts = docs.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))
    if not lengths:
        return texts.join(names.select(name_key).limit(0), F.lit(False)).select(key, name_key, F.lit(0).cast("long").alias("plats"))
    words = F.array_distinct(F.split("_text", r"\s+"))
    if lengths == [0]:
        met = texts.select(key, F.lit(0).alias("_n"), F.explode(words).alias("_k"))
    else:
        of = lambda w: F.array(*[F.struct(F.lit(n).alias("n"), _pieces(w, n).alias("k")) for n in lengths])
        met = texts.select(key, F.inline(F.transform(F.array(words), of)[0])).select(key, F.col("n").alias("_n"), F.explode("k").alias("_k"))
    hits = met.join(keys, ["_n", "_k"]).groupBy(key, name_key, "_h", "_need").agg(F.count("*").alias("_met")).filter("_met >= _need")
    full = names.filter(F.length(name) > 0).select(name_key, F.xxhash64(name).alias("_h"), F.col(name).alias("_name")).distinct()
    pairs = hits.select(key, name_key, "_h").join(texts, key).join(full, [name_key, "_h"])
    return pairs.select(key, name_key, F.instr("_text", F.col("_name")).cast("long").alias("plats")).filter("plats > 0")
