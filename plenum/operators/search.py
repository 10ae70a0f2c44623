"""Full-text search: all stems of a question, a documented score, a fragment.

Words are runs of letters and digits, lower-cased; a light Swedish stemmer drops one of the longest common endings.  There is
no ranking function to match, so the score is the question's stems' frequency in the text, over the text's words.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
# Endings by length, and words that do not count.
ENDING = r"^(.{3,}?)(?:heterna|heten|arna|erna|orna|ande|ende|aste|arne|are|ade|ast|het|ar|er|or|en|et|na|ns|a|e|s)$"
STOP_WORDS = ("och", "i", "att", "det", "som", "en", "på", "är", "av", "för", "med", "till", "den", "ett", "om")


def stem(word: Column) -> Column:
    return F.regexp_replace(word, ENDING, "$1")


def stems(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
    return F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), stem)


def search(docs: DataFrame, key: str, text: str, question: str, take: int | None = None) -> DataFrame:
    """key, poang (score), utdrag of rows that hold every stem of the question; best first if ``take`` is given."""
    import re

    asked = [w for w in dict.fromkeys(re.findall(r"[^\W_]+", question.lower())) if w not in STOP_WORDS]
    wanted = [stem(F.lit(w)) for w in asked]
    rows = docs.select(key, text, F.transform(F.array(stems(F.col(text))), lambda s: s)[0].alias("_s"))
    for w in wanted:
        rows = rows.filter(F.array_contains("_s", w))
    hits = F.size(F.filter("_s", lambda s: s.isin(*wanted)))
    rows = rows.select(key, F.col(text), (F.floor(hits / F.size("_s") * 1e6 + 0.5) / 1e6).alias("poang"))
    first = asked[0] if asked else ""
    at = F.regexp_instr(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}]){first[:4]}"))
    out = rows.select(key, "poang", F.trim(F.substring(F.col(text), F.greatest(at - 80, F.lit(1)), F.lit(240))).alias("utdrag"))
    return out.orderBy(F.col("poang").desc(), key).limit(take) if take else out
