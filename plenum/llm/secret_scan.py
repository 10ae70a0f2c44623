"""Secret scan: patterns for known forms, and a token-efficiency test for random strings.

Base kinds (leftmost, non-overlapping per kind): ``assign`` a key word, a separator and a value, ``access`` an access-key
id, ``hex`` a long run of hexadecimal digits.  The method adds kind ``random``: runs of key characters whose characters per
token under a byte-level BPE vocabulary are few.  Words and their compounds, in whatever language, take 2 characters a token
or more; random strings take less.  Known digests, UUIDs and plain numbers are left out first; in a run
shaped like an identifier, each letter part that is a word by that measure is left out.
"""

import base64
import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.scratch import free_name, over_cores

# The base kinds, in the order in which kinds at one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ of 20 or more characters: a run's first AKIA starts its longest match
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 or more
ASSIGN_MIN = 6
KINDS = ("assign", "access", "hex", "random")

#: A whole run, also one after or before an equals sign (name=value, ?sig=value); one or two at its end are padding.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Known digests and identifiers: hexadecimal of a digest's length with or without its name, UUIDs, digits with separators, and
#: hexadecimal numbers of up to 64 bits.
KNOWN = re.compile(
    r"(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-_/]?)?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|(?:urn[-_/])?(?:uuid[-_/])?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9+/_=-]+|0x[0-9a-f]{1,16}",
    re.I,
)
#: Shape of identifiers made of words: letter parts between separators or before digits, each of one case or capitalised.
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}(?:[_/+-]+(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+))*[_/+=-]*")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A part of a run that says nothing: a word, a number, a number with an exponent or unit, or a word and a number.
PLAIN = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]*(?:[A-Z]?[a-z]+|[A-Z])?|[0-9]+[a-zA-Z]{1,2}")
SEPARATORS = re.compile(r"[_/+=-]+")
#: Letters in parts that are no words, from which a run of that shape is reported, and characters in parts that are not PLAIN, from
#: which any other is; abbreviations and numbers in identifiers have fewer.
ODD_LETTERS = 12
#: Shortest run of that shape that is reported: shorter made-up words take as many tokens as random letters.
LONG_WORDS = 20
CHARS_PER_TOKEN = 2.0
VOCABULARY = "byte_bpe_50k.tiktoken"

RESULT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)
_open: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    if path not in _open:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _open[path] = tiktoken.Encoding("plenum", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _open[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) in code points, by start and then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def odd_letters(run: str, vocabulary: str) -> int:
    """Letters of a run in parts with few characters a token, as they stand and in lower case: such parts are no words."""
    tokens = lambda x: len(encoding(vocabulary).encode_ordinary(x))
    return sum(len(x) for x in PART.findall(run) if len(x) < CHARS_PER_TOKEN * min(tokens(x), tokens(x.lower())))


def is_alphabet(run: str) -> bool:
    """Whether half of the characters follow the one before them, as in lists of letters and digits."""
    return 2 * sum(ord(b) - ord(a) == 1 for a, b in zip(run, run[1:], strict=False)) >= len(run)


def odd_characters(run: str, vocabulary: str) -> int:
    """Characters of a run in parts between separators that are neither PLAIN nor words by their characters a token."""
    tokens = lambda x: len(encoding(vocabulary).encode_ordinary(x))
    parts = [x for x in SEPARATORS.split(run) if x and (len(x) >= ODD_LETTERS or not PLAIN.fullmatch(x))]
    return sum(len(x) for x in parts if len(x) < CHARS_PER_TOKEN * tokens(x))


def is_random(run: str, vocabulary: str) -> bool:
    core = run.strip("_/+-")
    if KNOWN.fullmatch(run) or KNOWN.fullmatch(core) or is_alphabet(core):
        return False
    if WORDS.fullmatch(core):
        return len(run) >= LONG_WORDS and odd_letters(run, vocabulary) >= ODD_LETTERS
    return len(core) < CHARS_PER_TOKEN * len(encoding(vocabulary).encode_ordinary(core)) and odd_characters(core, vocabulary) >= ODD_LETTERS


def random_spans(text: str, base: list[tuple[int, int, int]], vocabulary: str) -> list[tuple[int, int, int]]:
    """Random strings that touch no base span."""
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, e, _ in base), max))  # furthest end of the base spans so far
    return [
        (m.start(), m.end(), 3)
        for m in CANDIDATE.finditer(text)
        if not ((i := bisect_left(starts, m.end())) and reach[i - 1] > m.start()) and is_random(m[0], vocabulary)
    ]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(text: str | None, vocabulary: str) -> tuple:
    text = text or ""
    base = base_spans(text)
    spans = sorted(base + random_spans(text, base, vocabulary), key=lambda x: (x[0], x[2]))
    counts = [sum(k == i for _, _, k in spans) for i in range(len(KINDS))]
    return (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))


def scanned(docs: DataFrame, text: str = "text", vocabulary: str | None = None, into: str = "secrets") -> DataFrame:
    """``docs`` with one column ``into`` (a struct of RESULT), for whole texts.

    Null counts as empty: no spans, and the digest of the empty string.  Rows are independent.  A column
    of that name stays, and the new one gets an underscore behind its own.  ``vocabulary`` is the path of a tiktoken rank file
    that every worker can read.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf(RESULT)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(t if isinstance(t, str) else None, vocabulary) for t in texts], columns=RESULT.names)

    return over_cores(docs).withColumn(free_name(into, docs.columns), found(F.col(text)))
