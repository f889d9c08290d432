"""Exact encoding with a memo of pre-tokens.

Both supported vocabularies cut a text into pre-tokens that are merged
independently.  The encoder cuts with an equivalent pattern, looks each
pre-token up in a memo of bounded size and has the library merge only those not
seen yet.  Texts with characters for which the cutting could differ (anything
but common Latin text), or with the text of a special token, go whole to the
library.  Results are those of the library in every case.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Characters that normalisation leaves alone and whose classes below are sure.
_UNSURE = re.compile("[^\t\n\r -~¡-ÿ‐-‧€]|<\\|")
_LETTER = "a-zªµºß-öø-ÿ"
_UPPER = "A-ZÀ-ÖØ-Þ"
_DIGIT = "0-9²³¹¼-¾"
_SUFFIX = "'(?:s|t|re|ve|m|ll|d)"
_PATTERNS = {
    "word": re.compile(f"{_SUFFIX}|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+"),
    "byte": re.compile(f"{_SUFFIX}| ?[{_LETTER}{_UPPER}]+| ?[{_DIGIT}]+| ?[^\\s{_LETTER}{_UPPER}{_DIGIT}]+|\\s+(?!\\S)|\\s+"),
}
#: As "word", each pre-token with the white space before it.
SPACED_WORD = re.compile(f"\\s*(?:{_PATTERNS['word'].pattern})|\\s+")


def sure(text: str) -> bool:
    """Whether the fast cutting is known to be that of the library."""
    return _UNSURE.search(text) is None


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Memo(dict):
    """A look-up of bounded size that makes what it lacks."""

    def __init__(self, make: Callable[[str], object], entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key: str):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.make(key)
        return value


class MemoEncoder:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        self.kind = None
        if pre.get("type") == "ByteLevel" and not normal and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.kind = "byte"
        elif pre.get("type") == "Sequence" and [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "word"
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))
        self.memo = Memo(lambda word: b"".join([struct.pack("<I", t.id) for t in self.merge(word)]), entries)

    def merge(self, word: str) -> list:
        """Tokens of one pre-token: the merges alone, without cutting."""
        return self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))

    def library(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in out]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One byte string for each text; a null text counts as empty."""
        if self.kind is None:
            return self.library([t or "" for t in texts])
        find, lower, get = _PATTERNS[self.kind].findall, self.kind == "word", self.memo.__getitem__
        out: list[bytes] = []
        for t in texts:
            if not t:
                out.append(b"")
            elif not sure(t):
                out += self.library([t])
            else:
                out.append(b"".join(map(get, find(t.lower() if lower else t))))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> MemoEncoder:
    """One encoder for each worker process and vocabulary file."""
    return MemoEncoder(path)
