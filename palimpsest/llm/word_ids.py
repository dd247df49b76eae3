"""Token ids of whole texts by the tokenizers library, one call for each distinct pre-token.

A byte-level BPE file encodes each pre-token on its own, so the ids of a text are the ids of its pre-tokens in order.
Texts repeat their words: splitting with a regular expression and asking the library for unseen words only is several times
faster than handing it whole texts, and gives the same ids (tests compare both over whole texts).
"""

from __future__ import annotations

import json
import re

import regex

#: Longer words are encoded anew each time, so that a cache of words is bounded in bytes too.
KEPT_LENGTH = 64
#: Unicode White_Space, letters and numbers below U+02B0, for the quick form of the split pattern.
_SPACE = r"\t-\r \x85\xa0  -     　"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_NUMBER = "0-9²³¹¼-¾"


def _pattern(letter: str, number: str, space: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


_QUICK = re.compile(_pattern(_LETTER, _NUMBER, _SPACE))
_FULL = regex.compile(_pattern(r"\p{L}", r"\p{N}", _SPACE))
_WIDE = re.compile("[^\x00-ʯ]")


def split_words(text: str) -> list[str]:
    """The pre-tokens of a text under the byte-level pattern."""
    return (_FULL if _WIDE.search(text) else _QUICK).findall(text)


def byte_alphabet() -> dict[int, str]:
    """Byte to character of the byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_file(path: str) -> dict:
    """A tokenizer file as JSON, if it is byte-level BPE without any setting that would change the ids of a pre-token."""
    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    plain = model["type"] == "BPE" and not any(model.get(k) for k in odd) and not spec.get("normalizer")
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only a plain byte-level BPE file is supported")
    if any(a.get(k) for a in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("only added tokens that match as they stand are supported")
    return spec


class WordIds:
    """ids(text) as little-endian unsigned integers of `width` bytes. The cache is emptied at cache_words; results don't depend on it."""

    def __init__(self, path: str, cache_words: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = read_file(path)
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.size = self.tokenizer.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        self.code = [i.to_bytes(self.width, "little") for i in range(self.size)]
        self.table = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.model, self.most, self.cache = self.tokenizer.model, cache_words, {}

    def _word(self, word: str) -> bytes:
        mapped = word.encode("utf-8").decode("latin-1").translate(self.table)
        found = b"".join([self.code[t.id] for t in self.model.tokenize(mapped)])
        if len(self.cache) >= self.most:
            self.cache.clear()
        if len(word) <= KEPT_LENGTH:
            self.cache[word] = found
        return found

    def ids(self, text: str) -> bytes:
        if not (self.special and any(a in text for a in self.added)):
            return self._plain(text)
        return b"".join(self.added[p].to_bytes(self.width, "little") if p in self.added else self._plain(p) for p in self.special.split(text))

    def _plain(self, text: str) -> bytes:
        words = split_words(text)
        found = list(map(self.cache.get, words))
        if None in found:
            new = {w: self._word(w) for w in {w for w, f in zip(words, found, strict=True) if f is None}}
            found = [new[w] if f is None else f for w, f in zip(words, found, strict=True)]
        return b"".join(found)


_loaded: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
