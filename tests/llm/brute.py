"""Plain versions of the operators, for tables small enough to hold."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

SPACE_WORDS = re.compile("[^ \t-\r]+")
PLAIN_WORDS = re.compile("[^\x00-/:-`{-\x7f]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@lru_cache
def tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


def encode(name: str, text: str | None) -> list[int]:
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def fingerprint(text: str | None) -> int:
    words = SPACE_WORDS.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text: str | None, size: int = 5) -> set[str]:
    words = SPACE_WORDS.findall(lower(text or ""))
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def wide_fingerprint(text: str | None, words: int = 8) -> int:
    """One integer of ``words`` times 64 bits."""
    out, hashes = 0, [xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    for k in range(words):
        mixed = []
        for h in hashes:
            z = (h + k * 0x9E3779B97F4A7C15) % 2**64
            if k:
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
                z ^= z >> 31
            mixed.append(z)
        out |= sum(1 << b for b in range(64) if 2 * sum(z >> b & 1 for z in mixed) > len(mixed)) << 64 * k
    return out


def wide_components(ids: list[int], prints: list[int], most: int) -> list[int]:
    """Smallest id reachable over links of ``most`` differing bits."""
    label = list(ids)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= most]
    while any(label[i] != label[j] for i, j in pairs):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


def survivors(docs: list[tuple[int, str | None]], most: int, similarity: float = 0.8) -> list[tuple[int, str | None]]:
    """The document with the smallest id of each component of links: equal prints, or
    ``most`` differing bits at most and sets of shingles that similar."""
    docs = sorted(docs)
    prints, sets = [wide_fingerprint(t) for _, t in docs], [shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= most and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if prints[i] == prints[j] or near(i, j)]
    while any(label[i] != label[j] for i, j in pairs):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return [d for i, d in enumerate(docs) if label[i] == i]


def components(ids: list[int], prints: list[int], most: int = 4) -> list[int]:
    """Smallest id reachable from each one."""
    if not ids:
        return []
    p = np.asarray(prints, np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None]) <= most
    label = np.asarray(ids)
    while True:
        new = np.where(near, label[None], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], window: int = 8) -> dict[int, tuple]:
    patterns = defaultdict(set)
    for name, text in items:
        words = tuple(PLAIN_WORDS.findall(lower(text or "")))
        if words and name is not None:
            m = min(window, len(words))
            for i in range(len(words) - m + 1):
                patterns[words[i : i + m]].add(str(name))
    sizes = {len(p) for p in patterns}
    out = {}
    for doc, text in docs:
        words, hit, found = tuple(PLAIN_WORDS.findall(lower(text or ""))), set(), set()
        for m in sizes:
            for i in range(len(words) - m + 1):
                if (p := words[i : i + m]) in patterns:
                    hit |= set(range(i, i + m))
                    found |= patterns[p]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(words), len(hit), len(found), digest, len(found) >= 2)
    return out


def pages(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    groups = defaultdict(list)
    for page, html in rows:
        if len(raw := (html or "").encode()) >= 1000:
            groups[raw].append(page)
    out = {}
    for page, html in rows:
        raw = (html or "").encode()
        top = max(groups[raw]) if raw in groups else page
        out[page] = (len(raw), hashlib.sha1(raw).hexdigest(), "response" if page == top else "revisit", None if page == top else top)
    return out


def neighbours(vectors: dict[int, list[float]], queries: list[int], k: int = 10) -> dict[int, list[tuple[float, int]]]:
    ids = list(vectors)
    x = np.asarray([vectors[i] for i in ids], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - np.asarray(vectors[q], float)) ** 2).sum(1))
        out[q] = sorted((s, i) for s, i in zip(d.tolist(), ids, strict=True) if i != q)[:k]
    return out


class PlainKneserNey:
    """Interpolated Kneser-Ney over the characters of words, by dictionaries."""

    def __init__(self, texts: list[str], order: int, discount: float, letters: int):
        self.order, self.discount, self.letters, self.costs = order, discount, letters, {}
        words = defaultdict(int)
        for t in texts:
            for w in letter_words(t):
                words[w] += 1
        self.counts = {n: defaultdict(int) for n in range(1, order + 1)}
        for n in range(1, order + 1):
            if n == order:
                for w, c in words.items():
                    for g in self.grams(w, n):
                        self.counts[n][g] += c
            else:
                for g, _ in {(g, f) for w in words for g, f in zip(self.grams(w, n), self.grams(w, n + 1), strict=True)}:
                    self.counts[n][g] += g[0] != "\x02"
                for w, c in words.items():
                    for g in self.grams(w, n):
                        self.counts[n][g] += c * (g[0] == "\x02")
        self.total = {n: defaultdict(int) for n in self.counts}
        self.kinds = {n: defaultdict(int) for n in self.counts}
        for n, table in self.counts.items():
            for g, c in table.items():
                self.total[n][g[:-1]] += c
                self.kinds[n][g[:-1]] += 1

    @staticmethod
    def grams(word: str, n: int) -> list[str]:
        marked = f"\x02{word}\x03"
        return [marked[max(0, i - n + 1) : i + 1] for i in range(1, len(marked))]

    def p(self, gram: str, n: int) -> float:
        if not n:
            return 1 / (self.letters + 2)
        g = gram[-n:]
        total = self.total[n][g[:-1]]
        if not total:
            return self.p(gram, n - 1)
        return max(0, self.counts[n][g] - self.discount) / total + min(1, self.discount * self.kinds[n][g[:-1]] / total) * self.p(gram, n - 1)

    def entropy(self, text: str) -> float:
        words = letter_words(text)
        for w in words:
            if w not in self.costs:
                self.costs[w] = -sum(np.log(self.p(g, self.order)) for g in self.grams(w, self.order))
        return sum(self.costs[w] for w in words) / sum(len(w) + 1 for w in words)


def letter_words(text: str | None) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def languages(docs: list[tuple[int, str | None, str | None]], order: int = 5, discount: float = 0.75, slack: float = 1.8) -> dict[int, tuple[str, float, bool]]:
    """(language, score, rejected) of each document, for tables so small that every
    usable one is a training text."""
    by = defaultdict(list)
    for d, t, lang in docs:
        if lang is not None and letter_words(t) and zlib.crc32(str(d).encode()) % 4 != 2:
            signed = int.from_bytes(xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42).to_bytes(8, "little"), "little", signed=True)
            by[lang].append((not 200 <= len(t.encode()) <= 20_000, signed, d, t[:20_000]))
    fitted, held = defaultdict(list), []
    for lang, rows in by.items():
        assert len(rows) <= 500
        for rank, (outside, _, _, t) in enumerate(sorted(rows), 1):
            if rank % 5 == 0 and not (outside and not all(r[0] for r in rows)):
                held.append((lang, t))
            else:
                fitted[lang].append(t)
    letters = len({c for texts in fitted.values() for t in texts for w in letter_words(t) for c in w})
    names = sorted(fitted)
    models = [PlainKneserNey(fitted[n], order, discount, letters) for n in names]
    costs = [(names.index(lang), np.array([m.entropy(t) for m in models])) for lang, t in held]
    loss = lambda s: np.mean([np.log(np.exp(-s * (e - e.min())).sum()) + s * (e[i] - e.min()) for i, e in costs])
    sharpness = min((2.0**k for k in range(-2, 4)), key=loss)
    worst = max(e[i] for i, e in costs)
    limits = [slack * max((e[i] for i, e in costs if i == k), default=worst) for k in range(len(names))]
    out = {}
    for d, t, _ in docs:
        if not letter_words(t):
            out[d] = ("und", 0.0, True)
            continue
        e = np.array([m.entropy(t) for m in models])
        best = int(e.argmin())
        out[d] = (names[best], 1 / np.exp(-sharpness * (e - e[best])).sum(), bool(e[best] > limits[best]))
    return out
