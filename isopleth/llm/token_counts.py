"""Exact token counts of every prefix of a text, by dynamic programming.

``P[i]``, the count for the first ``i`` characters, is ``P[s] + c(text[s:i])``
where ``s`` starts the pre-token that holds character ``i``: complete pre-tokens
keep their counts, and ``c`` is the count of the cut one alone.  For common
pre-tokens ``c`` is computed once for each distinct prefix and kept in a bounded
memo.  For all others it is a dynamic program over their bytes: two neighbouring
tokens are right if merging their text gives just the two of them, and a row of
tokens is right if all its neighbours are, so that the last token of a prefix
follows from the last tokens of shorter ones.  The program is linear in the text,
whatever the length of a pre-token, and branches where a character may still be
composed with the next one.

The counts are stored as steps from one character to the next, one byte each
(four where one is not enough).  A truncation to a budget or the cost of a cut is
a search or a look-up in them; nothing is encoded again.

Cases: a null text counts as empty and gives zeros; texts that normalisation
changes, special tokens and pre-tokens of any length have exact counts at every
character; repeated rows are kept; other columns stay out of the result.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import columns, materialize, spread
from .encode import SPACED_WORD, Memo, MemoEncoder, encoder, sure

#: Characters of a pre-token whose prefixes are counted through the memo.
LONGEST = 64
TABLE = "doc_id long, n_bytes long, n_tokens long, n_chars long, steps binary"
#: Pre-tokens that an apostrophe begins, without it.
_SUFFIXES = frozenset({"s", "t", "re", "ve", "m", "ll", "d"})


@lru_cache(maxsize=1)
def _composing() -> frozenset[str]:
    """Characters that normalisation may join to the one before them."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.combining(c):
            out.add(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


class Pairs:
    """Which tokens may stand beside each other, for a vocabulary of ranked merges."""

    def __init__(self, vocabulary: str, end: str):
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.known, self.end = model["vocab"], end
        self.inner = {t for t in self.known if not t.endswith(end)}
        self.final = {t.removesuffix(end) for t in self.known if t.endswith(end) and t != end}
        self.widest = max(map(len, self.inner | self.final))
        self.right = Memo(self._right, 500_000)

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols after all merges, lowest rank first and leftmost among equals."""
        while len(symbols) > 1:
            at, best = min(((i, self.rank.get(p, 1 << 60)) for i, p in enumerate(pairwise(symbols))), key=lambda x: (x[1], x[0]))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _right(self, pair: tuple[str, str, bool]) -> bool:
        """Whether merging the text of (left, right, right is final) gives these two."""
        left, right, final = pair
        symbols = [*left, *right]
        if final:
            symbols[-1] += self.end
        return self.merged(symbols) == ([left] if left else []) + [right + self.end * final]


class _Run:
    """One pre-token as its bytes come in; ``last`` and ``count`` go by bytes so far."""

    def __init__(self, pairs: Pairs):
        self.pairs, self.text, self.last, self.count = pairs, "", [""], [0]

    def add(self, letters: str) -> None:
        for c in letters:
            self.text += c
            n = len(self.text)
            self.last.append(self._token(n, self.pairs.inner, False))
            self.count.append(self.count[n - len(self.last[n])] + 1)

    def _token(self, n: int, known: set[str], final: bool) -> str:
        for size in range(min(n, self.pairs.widest), 0, -1):
            token = self.text[n - size : n]
            if token in known and self.pairs.right[self.last[n - size], token, final]:
                return token
        raise ValueError(f"no token ends {self.text!r}")

    def total(self) -> int:
        """Tokens of the pre-token if it ended here."""
        n = len(self.text)
        return self.count[n - len(self._token(n, self.pairs.final, True))] + 1 if n else 0

    def cut(self, n: int) -> None:
        self.text = self.text[:n]
        del self.last[n + 1 :], self.count[n + 1 :]


class _Walk:
    """Pre-tokens of a normalised text as its characters come in."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter
        self.closed, self.kind, self.run, self.tail = 0, "", _Run(counter.pairs), ""

    def state(self) -> tuple:
        return self.closed, self.kind, self.run, len(self.run.text), self.tail

    def back(self, state: tuple) -> None:
        self.closed, self.kind, self.run, n, self.tail = state
        self.run.cut(n)

    def close(self) -> None:
        self.closed, self.kind, self.run, self.tail = self.count(), "", _Run(self.counter.pairs), ""

    def count(self) -> int:
        return self.closed + self.run.total()

    def add(self, c: str) -> None:
        kind = self.counter.kinds[c]
        # after an apostrophe that began a pre-token: its suffix, or letters of their own
        if self.tail:
            suffix = self.tail[1:] + c
            if suffix in _SUFFIXES:
                self.back(self.before)
                self.run = _Run(self.counter.pairs)
                self.run.add(self.counter.letters("'" + suffix))
                self.kind, self.tail = "suffix", ""
                return
            if self.tail == "'" and any(s.startswith(suffix) for s in _SUFFIXES):
                self.close()
                self.run.add(self.counter.letters(c))
                self.kind, self.tail = "letter", "'" + c
                return
            self.tail = ""
        if kind == "space":
            self.close()
            return
        if kind != self.kind or kind == "number":
            self.close()
            if c == "'":
                self.before, self.tail = self.state(), "'"
        self.run.add(self.counter.letters(c))
        self.kind = kind


class PrefixCounter:
    """Prefix counts for one vocabulary."""

    def __init__(self, encoder: MemoEncoder, path: str, entries: int = 250_000):
        if encoder.kind != "word":
            raise ValueError("the prefix table needs a vocabulary of words with ends")
        self.encoder = encoder
        self.pairs = Pairs(path, "</w>")
        self.known = Memo(self._count, 2 * entries)
        self.steps = Memo(self._steps, entries)
        self.normal = Memo(encoder.tokenizer.normalizer.normalize_str, entries)
        self.kinds = Memo(self._kind, entries)
        special = sorted((t.content for t in encoder.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else re.compile(r"(?!)")

    def letters(self, text: str) -> str:
        """The printable letters that stand for the bytes of a text."""
        return text.encode().decode("latin-1").translate(self.encoder.letters)

    def _kind(self, c: str) -> str:
        """letter, number, space or other, as the library's own cutting has it."""
        pieces = lambda s: len(self.encoder.tokenizer.pre_tokenizer.pre_tokenize_str(s))
        apart = pieces(f"a{c}a")
        if apart < 3:
            return ("letter", "space")[apart - 1]
        return "number" if pieces(f"a{c}{c}a") == 4 else "other"

    def _count(self, piece: str) -> int:
        # a cut suffix such as 'r of 're is two pre-tokens; any other piece is one
        if piece[0] == "'" and piece[1:2] and piece[1:] not in _SUFFIXES and piece[1:] in ("r", "v", "l"):
            return len(self.encoder.merge("'")) + len(self.encoder.merge(piece[1:]))
        return len(self.encoder.merge(piece))

    def _steps(self, word: str) -> bytes:
        """How the count changes with each character of a pre-token and the white space before it."""
        piece = word.lstrip()
        if len(piece) <= LONGEST:
            known = self.known
            counts = [known[piece[:i]] for i in range(1, len(piece) + 1)]
        else:
            run, counts = _Run(self.pairs), []
            for c in piece:
                run.add(self.letters(c))
                counts.append(run.total())
        steps = [b - a for a, b in pairwise([0, *counts])]
        return struct.pack(f"<{len(word)}i", *[0] * (len(word) - len(piece)), *steps)

    def _walk(self, text: str) -> list[int]:
        """Counts for 1 to len(text) characters of any text."""
        out, walk, held, start, composing = [], _Walk(self), "", (), _composing()
        ends = {m.end(): m for m in self.special.finditer(text)}
        specials: list[tuple[int, int]] = [(m.start(), m.end()) for m in ends.values()]
        counts_at = {}
        begins = {a for a, _ in specials}
        for i, c in enumerate(text):
            if i in begins:
                counts_at[i] = out[-1] if out else 0
            if held and c not in composing:
                held = ""
            if held:
                walk.back(start)
            else:
                start = walk.state()
            held += c
            for x in self.normal[held]:
                walk.add(x)
            out.append(walk.count())
            if i + 1 in ends:  # a special token is one id, and nothing joins across it
                walk = _Walk(self)
                walk.closed, held = counts_at[ends[i + 1].start()] + 1, ""
                out[-1] = walk.closed
        return out

    def count(self, text: str | None) -> np.ndarray:
        """Steps of the count with each character: their running sum counts every prefix."""
        if not text:
            return np.zeros(0, np.int32)
        if sure(text):
            return np.frombuffer(b"".join(map(self.steps.__getitem__, SPACED_WORD.findall(text.lower()))), "<i4")
        out, at = [], 0
        # white space keeps its neighbours apart, so that stretches between are independent
        for m in _STRETCH.finditer(text):
            part = m[0]
            if sure(part):
                out.append(np.frombuffer(b"".join(map(self.steps.__getitem__, SPACED_WORD.findall(part.lower()))), "<i4"))
            else:
                out.append(np.diff(np.asarray([0, *self._walk(part)])))
            at = m.end()
        assert at == len(text)
        return np.concatenate(out).astype("<i4")


_STRETCH = re.compile(r"[ \t\r\n]*[^ \t\r\n]*")


def pack(steps: np.ndarray) -> bytes:
    """Steps in one byte each, or four if some need them, told apart by the length."""
    small = not len(steps) or (steps.min() >= -128 and steps.max() <= 127)
    return steps.astype("i1" if small else "<i4").tobytes()


def unpack(data: bytes, n_chars: int) -> np.ndarray:
    """Counts for 0 to ``n_chars`` characters."""
    steps = np.frombuffer(data, "i1" if len(data) == n_chars else "<i4")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def fit(counts: np.ndarray, budget: int) -> int:
    """The longest prefix, in characters, of at most ``budget`` tokens."""
    return len(counts) - 1 if counts[-1] <= budget else int(np.flatnonzero(counts <= budget)[-1])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(encoder(path), path)


def prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The prefix table, one row a document (see ``pack`` for ``steps``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = some.column(1).to_pylist()
                found = [table.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                        pa.array([int(s.sum()) for s in found], pa.int64()),
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array([pack(s) for s in found], pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "n_chars", "steps"],
                )

    doc_id, text = columns(docs, "doc_id", "text")
    return spread(docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))).mapInArrow(run, TABLE)


def store(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The prefix table, written to the shared folder and read back."""
    return materialize(prefix_counts(docs, vocabulary), "prefixes")


def truncations(table: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars, the longest prefix within
    ``budget`` tokens, looked up in a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpack(s, n) for s, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            total, chars = [int(c[-1]) for c in found], [fit(c, budget) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(chars, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "fit_chars"])

    looked = table.select("doc_id", "n_bytes", "n_chars", "steps").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fit_chars long")
    return looked.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "fit_chars")
