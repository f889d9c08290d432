"""Language identification with interpolated Kneser-Ney character models.

A text is scored word by word (a word is a maximal run of letters, between
boundary marks), so the cost of a word is known once and kept in a bounded memo.
Each order's n-grams of all languages lie in one sorted array of 64-bit hashes;
beside it stand, a column a language, the discounted probability of the n-gram
and the weight that its context gives to the next lower order.  An n-gram counts by how many longer ones end in
it, or by how often it occurs if it begins a word; a context that the word's
beginning cuts short stands for itself at every order above.  The language
with the lowest cross-entropy a character wins; a text whose cross-entropy is
beyond what held-back training texts show is rejected.

The model is fitted on a bounded sample: of each language at most ``TRAIN`` +
``CALIBRATE`` texts with a letter, those of ``SIZES`` bytes first and then those
with the smallest hash of doc_id.  Of a text at most ``SIZES[1]`` characters are
read, so a language's budget is 500 x 20,000 characters.

Cases: a null text or one without a letter gives ``und``, score 0 and is
rejected; without labelled rows every text is ``und``; ties go to the language
that sorts first; repeated rows are kept; other columns ride along only in
``keep``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import columns, spread

TRAIN, CALIBRATE, SIZES, ORDER, DISCOUNT = 400, 100, (200, 20_000), 5, 0.75
MEMO = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_BASE, _MIX = 0xD6E8FEB86659FD93, np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters, in lower case."""
    found = _WORD.findall(text.lower()) if text else []
    if "".join(found).isalpha():
        return found
    # the pattern also takes numerals such as superscripts and fractions
    return "".join([c if c.isalpha() else " " for w in found for c in (*w, " ")]).split()


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _hashes(some: list[str], lags: range, shift: int) -> list[np.ndarray]:
    """Zeros, then for each growing set of lags a hash of the characters that far
    back, at every place of ``^word$`` after the first mark; none reach past it."""
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in some]).encode("utf-32-le"), "<u4").astype(np.uint64)
    place = np.arange(len(codes))
    place = place - np.maximum.accumulate(np.where(codes == 2, place, 0))
    inside, h = codes != 2, np.zeros(len(codes), np.uint64)
    out = [h[inside]]
    with np.errstate(over="ignore"):
        for k in lags:
            back = np.concatenate([np.zeros(k, np.uint64), codes])[: len(codes)]
            h = h + np.where(place >= k, (back + np.uint64(1)) * np.uint64(pow(_BASE, k + 1, 2**64)), np.uint64(0))
            out.append(((h ^ (h >> np.uint64(shift))) * _MIX)[inside])
    return out


def _grams(some: list[str], order: int) -> list[np.ndarray]:
    return _hashes(some, range(order), 31)


def _contexts(some: list[str], order: int) -> list[np.ndarray]:
    return _hashes(some, range(1, order), 29)


@dataclass
class Model:
    """Sorted hash arrays by order, with a column for each language."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    sharpness: float = 1.0
    limits: tuple[float, ...] = ()

    def costs(self, some: list[str]) -> np.ndarray:
        """For each word: nats in each language, then its characters."""
        order = len(self.grams)
        grams, contexts = _grams(some, order), _contexts(some, order)
        p = np.full((len(grams[0]), len(self.languages)), self.floor)
        for k in range(order):
            p = _find(*self.contexts[k], contexts[k], 1.0) * p + _find(*self.grams[k], grams[k + 1], 0.0)
        sizes = np.asarray([len(w) + 1 for w in some])
        nats = np.add.reduceat(-np.log(p), np.cumsum(sizes) - sizes, axis=0)
        return np.column_stack([nats, sizes]).astype("<f4")


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where((keys[at] == asked)[:, None], values[at], missing)


def fit(texts: list[tuple[str, str]], order: int = ORDER, discount: float = DISCOUNT) -> Model | None:
    """A model from (language, text) pairs."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in texts:
        counts[lang].update(words(text))
    languages = sorted(lang for lang, c in counts.items() if c)
    if not languages:
        return None
    letters = {x for c in counts.values() for w in c for x in w}
    grams = [(defaultdict(lambda: np.zeros(len(languages)))) for _ in range(order)]
    contexts = [(defaultdict(lambda: np.full(len(languages), 1.0))) for _ in range(order)]
    for column, lang in enumerate(languages):
        some = list(counts[lang])
        sizes = [len(w) + 1 for w in some]
        times = np.repeat(np.asarray([counts[lang][w] for w in some], float), sizes)
        place = np.concatenate([np.arange(1, n + 1) for n in sizes])
        g, c = _grams(some, order), _contexts(some, order)
        for k in range(order, 0, -1):
            keys, first, inverse = np.unique(g[k], return_index=True, return_inverse=True)
            if k == order:
                n = np.bincount(inverse, times)
            else:  # in how many longer n-grams each one ends
                longer = np.unique(g[k + 1], return_index=True)[1]
                n = np.bincount(inverse[longer], minlength=len(keys)).astype(float)
                # nothing comes before the beginning of a word: there how often counts
                n = np.where(place[first] < k, np.bincount(inverse, times), n)
            ctx, of = np.unique(c[k - 1][first], return_inverse=True)
            total, kinds = np.bincount(of, n), np.bincount(of)
            for key, value in zip(keys.tolist(), ((n - discount).clip(0) / total[of]).tolist(), strict=True):
                grams[k - 1][key][column] = value
            for key, value in zip(ctx.tolist(), (np.minimum(1, discount * kinds / total)).tolist(), strict=True):
                contexts[k - 1][key][column] = value
    return Model(languages, [_sorted(x) for x in grams], [_sorted(x) for x in contexts], 1 / (len(letters) + 2))


def _sorted(table: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.asarray(list(table), np.uint64)
    by = np.argsort(keys)
    return keys[by], np.stack(list(table.values()))[by]


class Scorer:
    def __init__(self, model: Model, entries: int = MEMO):
        self.model, self.entries, self.memo = model, entries, {}
        self.width = len(model.languages) + 1

    def entropies(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text nats a character in each language; None without a letter."""
        cut = [words(t) for t in texts]
        memo = self.memo
        missing = list({w for some in cut for w in some if w not in memo})
        if len(memo) + len(missing) > self.entries:
            memo.clear()
            missing = list({w for some in cut for w in some})
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            memo.update(zip(part, map(np.ndarray.tobytes, self.model.costs(part)), strict=True))
        out = []
        for some in cut:
            total = np.frombuffer(b"".join(map(memo.__getitem__, some)), "<f4").reshape(-1, self.width).sum(0, dtype=float)
            out.append(total[:-1] / total[-1] if some else None)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, its cross-entropy, whether it is rejected, for each text."""
        return [self._decide(e) for e in self.entropies(texts)]

    def _decide(self, e: np.ndarray | None) -> tuple[str, float, float | None, bool]:
        if e is None:
            return "und", 0.0, None, True
        best = int(e.argmin())
        score = 1 / np.exp(-self.model.sharpness * (e - e[best])).sum()
        return self.model.languages[best], float(score), float(e[best]), bool(self.model.limits and e[best] > self.model.limits[best])


def calibrate(model: Model, texts: list[tuple[str, str]], slack: float = 1.8) -> Model:
    """Sharpness of the scores, and the cross-entropy beyond which a text is rejected:
    ``slack`` times the largest one of held-back texts in their own language."""
    scorer, rows, own = Scorer(model), [], defaultdict(list)
    for (lang, _), e in zip(texts, scorer.entropies([t for _, t in texts]), strict=True):
        if e is not None and lang in model.languages:
            i = model.languages.index(lang)
            rows.append((e, i))
            own[i].append(e[i])
    if rows:
        e, true = np.stack([r[0] for r in rows]), np.asarray([r[1] for r in rows])
        gap = e - e.min(1, keepdims=True)

        def loss(s):
            return (np.log(np.exp(-s * gap).sum(1)) + s * gap[np.arange(len(true)), true]).mean()

        model.sharpness = float(min((2.0**k for k in range(-2, 4)), key=loss))
    worst = max((x for v in own.values() for x in v), default=np.inf)
    model.limits = tuple(float(slack * max(own.get(i, [worst]))) for i in range(len(model.languages)))
    return model


def train(docs: DataFrame, train: int = TRAIN, calibration: int = CALIBRATE, sizes: tuple[int, int] = SIZES) -> Model | None:
    """Fit on the documents that are not held out and have a language."""
    doc_id, text, lang = columns(docs, "doc_id", "text", "lang")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), lang.alias("lang")).where("lang is not null and doc_id is not null")
    fit_rows = rows.where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")).withColumn("outside", ~F.octet_length("text").between(*sizes))
    least = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("outside", "hash", "doc_id"))
    few = fit_rows.select("doc_id", "lang", "outside", F.xxhash64("doc_id").alias("hash"))
    # first within 64 and then 4 parts of each language, so that no task sees many rows of one
    for parts in (64, 4):
        few = few.withColumn("part", F.pmod(F.hash("doc_id"), F.lit(parts))).withColumn("rank", least("lang", "part")).where(F.col("rank") <= train + calibration)
    chosen = few.withColumn("rank", least("lang")).where(F.col("rank") <= train + calibration).select("doc_id", "lang", "outside", "rank")
    # at most train + calibration rows a language
    chosen = F.broadcast(chosen.groupBy("doc_id", "lang").agg(F.min_by("outside", "rank").alias("outside"), F.min("rank").alias("rank")))
    found = fit_rows.join(chosen, ["doc_id", "lang", "outside"]).dropDuplicates(["doc_id", "lang"])
    some = found.select("lang", "rank", "outside", F.substring("text", 1, sizes[1]).alias("text")).collect()
    some.sort(key=lambda r: (r["lang"], r["rank"]))
    inside = {r["lang"] for r in some if not r["outside"]}
    every = max(2, (train + calibration) // max(1, calibration))
    # limits come from texts of the usual sizes where a language has them
    held = [not r["rank"] % every and not (r["outside"] and r["lang"] in inside) for r in some]
    model = fit([(r["lang"], r["text"]) for r, h in zip(some, held, strict=True) if not h])
    return calibrate(model, [(r["lang"], r["text"]) for r, h in zip(some, held, strict=True) if h]) if model else None


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected and the kept columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    doc_id, text = columns(docs, "doc_id", "text")
    kept = keep or []
    slim = docs.select(text.alias("_text"), doc_id.cast("long").alias("_doc"), *(docs[f"`{c}`"].alias(f"_k{i}") for i, c in enumerate(kept)))
    made = "_lang string, _score double, _entropy double, _rejected boolean"
    schema = ", ".join([made, *(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found = scorer.predict(some.column(0).to_pylist()) if scorer else [("und", 0.0, None, True)] * some.num_rows
                out = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*out, *some.columns[1:]], ["_lang", "_score", "_entropy", "_rejected", *some.schema.names[1:]])

    return spread(slim).mapInArrow(run, schema).select(
        F.col("_doc").alias("doc_id"), held_out(F.col("_doc")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"),
        F.col("_entropy").alias("cross_entropy"), F.col("_rejected").alias("rejected"), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)),
    )


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    names = [f"k_{i}" for i in range(len(docs.columns))]
    plain = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names, strict=True)), *(docs[f"`{c}`"].alias(c) for c in ("doc_id", "text")))
    found = identify(plain, model, keep=names).where("not rejected")
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
