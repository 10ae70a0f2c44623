"""Token ids of whole texts with a cache per word.

The vocabulary's pre-tokeniser never joins characters across white space and normalises character by character, so a text's
ids are its white-space separated words' ids, one after the other.  Words recur, so most of them are looked up.  A trailing
run of ``.,;:!?`` after a letter is always a pre-token of its own and is looked up apart.

A word of letters that is new is one pre-token.  Its merges are the same ones, but run faster, over the same vocabulary as
ranks of byte strings in which a zero byte marks the end of a word: pairs with the mark have the lowest ranks of all pairs, so
the mark joins the last byte first, as the vocabulary wants it.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
CACHED_WORDS = 1_000_000
LONGEST_CACHED = 64
_PUNCTUATION = b".,;:!?"
_open: dict[str, "WordEncoder"] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _marked(path: str) -> tiktoken.Encoding:
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    byte = _byte_of()
    ranks = {}
    for token, i in vocabulary.items():
        bare = token.removesuffix("</w>")
        if all(c in byte for c in bare) and not token.startswith("<|"):
            ranks[bytes(byte[c] for c in bare) + (b"\0" if bare != token else b"")] = i
    return tiktoken.Encoding("marked", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})


class _Words(dict):
    """bytes of a word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.marked = _marked(path).encode_ordinary

    def whole(self, text: str) -> bytes:
        if text.isascii():
            one = text.isalpha()
        else:
            one = text.isalpha() and "Σ" not in text and unicodedata.is_normalized("NFC", text) and text.lower().isalpha()
        if one:
            ids = self.marked(text.lower() + "\0")
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > LONGEST_CACHED:
            return self.whole(word.decode("utf-8", "surrogatepass"))
        core = word.rstrip(_PUNCTUATION)
        if len(core) < len(word) and core and (core[-1:].isalpha() or core.decode("utf-8", "surrogatepass")[-1].isalpha()):
            ids = self[core] + self[word[len(core) :]]
        else:
            ids = self.whole(word.decode("utf-8", "surrogatepass"))
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str):
        self._ids_of = _Words(path).__getitem__

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text (null: none), then END_ID, as little-endian unsigned 32-bit integers."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if b"<|" not in raw:  # special tokens are matched before letters are lowered
            raw = raw.lower()  # ASCII letters only
        return b"".join(map(self._ids_of, raw.split())) + END_ID.to_bytes(4, "little")


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def encoder(path: str) -> WordEncoder:
    """One per Python worker and vocabulary."""
    if path not in _open:
        _open[path] = WordEncoder(path)
    return _open[path]
