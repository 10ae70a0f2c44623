"""Text normalisers and parsers as Column expressions."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions.semantics import ascii_word

# Month names in order.
MONTHS = ("januari", "februari", "mars", "april", "maj", "juni", "juli", "augusti", "september", "oktober", "november", "december")
# Legal forms that company names carry.
LEGAL_FORMS = ("aktiebolag", "ab", "hb", "kb", "ek för", "ekonomisk förening", "publ")


def month_number(name: Column) -> Column:
    """1..12 for a month's name in any case, else null."""
    found = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name))
    return F.when(found > 0, found.cast("int"))


def dated(day: Column, month_name: Column, year: Column) -> Column:
    """yyyy-mm-dd from a day, a month's name and a year; null if the month is none."""
    return F.concat_ws("-", year.cast("string"), F.lpad(month_number(month_name).cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))


def month_of_title(title: Column) -> Column:
    """yyyy-mm from six digits, else from a month's name and a year, else null."""
    six = F.regexp_extract(title, r"((?:19|20)\d{2})(0[1-9]|1[0-2])", 0)
    year = F.regexp_extract(title, r"((?:19|20)\d{2})", 1)
    name = F.regexp_extract(F.lower(title), "(" + "|".join(MONTHS) + ")", 1)
    by_name = F.when((year != "") & (name != ""), F.concat(year, F.lit("-"), F.lpad(month_number(name).cast("string"), 2, "0")))
    return F.when(six != "", F.concat(F.substring(six, 1, 4), F.lit("-"), F.substring(six, 5, 2))).otherwise(by_name)


def number(text: Column) -> Column:
    """A number with blanks between thousands and a decimal comma; 0 for anything else."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[\s\u00a0]+", ""), "[−–]", "-")
    return F.coalesce(F.regexp_replace(bare, ",", ".").try_cast("double"), F.lit(0.0))


def slug(text: Column, keep: str = r"\p{L}\p{N}") -> Column:
    """Lower case, everything but ``keep`` as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), f"[^{keep}]+", "-"), "^-+|-+$", "")


def slug_ascii(text: Column) -> Column:
    """As slug, with å, ä, ö and é as plain letters."""
    return slug(F.translate(F.lower(text), "åäöéü", "aaoeu"), "a-z0-9")


def slug_compact(text: Column) -> Column:
    """As slug for ASCII letters and å, ä, ö, with punctuation dropped rather than dashed."""
    bare = F.regexp_replace(F.lower(text), r"[^a-zåäö0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[\s-]+", "-"), "^-+|-+$", "")


def company(name: Column) -> Column:
    """Lower case without legal forms, punctuation and doubled blanks."""
    bare = F.regexp_replace(F.lower(name), r"\(publ\)|\(fb\)", " ")
    bare = F.regexp_replace(bare, r"[.,/&()'\"-]", " ")
    bare = F.regexp_replace(bare, ascii_word("|".join(LEGAL_FORMS)), " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def organisation(label: Column, city_prefix: str) -> Column:
    """Lower case without the city, ``nämnd`` in the definite form at the end or in front of ``för``."""
    bare = F.regexp_replace(F.regexp_replace(label, r"[\r\n]+", " "), f"^{city_prefix} ", "")
    bare = F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))
    bare = F.when(bare.endswith("nämnd"), F.concat(bare, F.lit("en"))).otherwise(bare)
    return F.regexp_replace(bare, "^nämnd för ", "nämnden för ")


def plain(text: Column) -> Column:
    """Lower case, anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def without_bracket(label: Column) -> Column:
    """A label without a bracket at its end."""
    return F.regexp_replace(label, r"\s*\([^)]+\)$", "")


def speaker(label: Column) -> Column:
    """What stands before the first bracket, or the label."""
    name = F.regexp_extract(label, r"^(.+?)\s*\(", 1)
    return F.when(name != "", name).otherwise(label)


def stable_id(key: Column) -> Column:
    """A name-based identifier in the shape of a version-5 UUID, from SHA-1."""
    h = F.sha1(key.cast("binary"))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def excerpt(text: Column, at: Column, length: Column, before: int = 60, after: int = 100) -> Column:
    """What surrounds the 1-based place ``at``, with blanks collapsed and dots where text was cut."""
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + length + after, F.length(text) + 1)
    cut = F.trim(F.regexp_replace(F.substring(text, start, end - start), r"\s+", " "))
    return F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), cut, F.when(end <= F.length(text), F.lit("…")).otherwise(F.lit("")))


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule (name, regular expression) that matches, rules in order."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def all_matches(text: Column, rules: list[tuple[str, str]]) -> Column:
    """An array of the names of all rules that match, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules]))


def reflowed(text: Column) -> Column:
    """Wrapped lines joined to paragraphs: hyphens at line ends closed, single line ends as blanks, more as a paragraph."""
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(\p{Ll})-\n(\p{Ll})", "$1$2")
    text = F.regexp_replace(text, r"[ \t]*\n[ \t]*\n\s*", "\u0001")
    return F.trim(F.replace(F.regexp_replace(text, r"[ \t]*\n[ \t]*", " "), F.lit("\u0001"), F.lit("\n\n")))


@F.pandas_udf(T.StringType())
def composed(names: pd.Series) -> pd.Series:
    """Unicode composed form, blanks collapsed, lower case; Spark has no built-in for it."""
    return names.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()).lower())
