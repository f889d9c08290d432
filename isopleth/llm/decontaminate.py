"""Benchmark decontamination by Wu-Manber search over words.

Texts become words; a pattern is a window of consecutive item words.  For the
patterns of one length ``m`` a shift table over blocks of two words says how far
the search may jump: a block in no pattern allows ``m - 1`` words, one that ends
at pattern place ``q`` allows ``m - q``.  Only where the shift is zero is the
bucket of the block, as the suffix of its patterns, opened and each pattern
compared word by word.

The items are a stated set.  They are collected in blocks of at most
``block_items`` ids and ``block_bytes`` of text, so that neither the driver nor
an executor ever holds more patterns than that; every block is searched over
all documents, whose texts are written at most once.

Cases: a null, empty or wordless text has no words and no hits; a null or
wordless item has no windows; an item shorter than a window is one window;
repeated items count as one id, equal items with different ids all count;
repeated documents are kept; other columns ride along only in ``keep``.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import columns, materialize, spread

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) maximal runs of ASCII letters, digits and non-ASCII."""
    return text.encode().translate(_TABLE).split() if text else []


class WuManber:
    """Patterns of one length, each a tuple of words with the items that hold it."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.shift: dict[tuple[bytes, ...] | bytes, int] = {}
        self.buckets: dict[tuple[bytes, ...] | bytes, list[tuple[tuple[bytes, ...], set[str]]]] = defaultdict(list)
        for p, items in patterns.items():
            for q in range(self.block, self.length + 1):
                b = p[q - self.block : q]
                self.shift[b] = min(self.shift.get(b, self.length), self.length - q)
            self.buckets[p[-self.block :]].append((p, items))
        # a word that ends no block allows the longest jump without building one
        self.last = {b[-1] for b in self.shift}

    def search(self, w: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(place of the last word, items) of every occurrence."""
        m, shift, last, two = self.length, self.shift, self.last, self.block == 2
        far, i, n = m - self.block + 1, m - 1, len(w)
        while i < n:
            x = w[i]
            if x not in last:
                i += far
                continue
            b = (w[i - 1], x) if two else (x,)
            step = shift.get(b, far)
            if step:
                i += step
                continue
            for p, items in self.buckets[b]:
                if p[0] == w[i - m + 1] and tuple(w[i - m + 1 : i + 1]) == p:
                    yield i, items
            i += 1


def build(items: list[tuple[str, str | None]], window: int) -> list[WuManber]:
    """A searcher for each pattern length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for name, text in items:
        w = words(text)
        if w:
            m = min(window, len(w))
            for i in range(len(w) - m + 1):
                by_length[m][tuple(w[i : i + m])].add(name)
    return [WuManber(p) for p in by_length.values()]


def _item_blocks(items: DataFrame, block_items: int, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of bounded size, read through Spark one partition at a time."""
    item_id, text = columns(items, "item_id", "text")
    block, held = [], 0
    rows = items.select(item_id.cast("string"), text, F.octet_length(text)).where(item_id.isNotNull() & text.isNotNull())
    for name, t, size in rows.toLocalIterator():
        if block and (len(block) >= block_items or held + size > block_bytes):
            yield block
            block, held = [], 0
        block.append((name, t))
        held += size
    yield block


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 2, block_items: int = 20_000, block_bytes: int = 4 << 20, keep: list[str] | None = None, keep_text: str | None = None
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    spans (first and last hit word of each maximal run), the kept columns and, under
    the name ``keep_text``, the text, which goes through the search once only.

    Each block's patterns travel as one broadcast of bounded size.  With one block
    a single pass finds everything.  With more, the documents are numbered and
    written once; every block reads them and gives only the rows it hits, and one
    join brings those back.
    """
    kept = keep or []
    doc_id, text = columns(docs, "doc_id", "text")
    slim = spread(docs.select(text.alias("_text"), doc_id.cast("long").alias("_doc"), *(docs[f"`{c}`"].alias(f"_k{i}") for i, c in enumerate(kept))))
    blocks = _item_blocks(items, block_items, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        state = _search(slim, block, window, "_text", bool(keep_text))
    else:
        numbered = materialize(slim.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        hits = []
        for some in chain([block, after], blocks):
            hits.append(_search(numbered.select("_text", "_row"), some, window, "_text").drop("_words").where("size(_found) > 0"))
        once = materialize(reduce(DataFrame.unionByName, hits), "hits")
        # a row and block give one line at most, so a group is no larger than the number of blocks
        both = once.groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("_found"))).alias("_found"), F.array_sort(F.flatten(F.collect_list("_spans"))).alias("_spans"))
        words_of = _search(numbered, [], window, "_text", bool(keep_text)).drop("_found", "_spans")
        none = {"_found": F.array().cast("array<string>"), "_spans": F.array().cast(_SPANS)}
        state = words_of.join(both.withColumn("_spans", _merged("_spans")), "_row", "left").withColumns({c: F.coalesce(c, e) for c, e in none.items()})
    names = F.array_join(F.array_sort("_found"), ",")
    return state.select(
        F.col("_doc").alias("doc_id"),
        F.col("_words").alias("n_words"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda t, s: t + s["last"] - s["first"] + 1).alias("n_hit"),
        F.size("_found").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("_found") >= min_items).alias("contaminated"),
        F.col("_spans").alias("spans"),
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)),
        *([F.col("_text").alias(keep_text)] if keep_text else []),
    )


_SPANS = "array<struct<first:int,last:int>>"


def _merged(spans: str) -> Column:
    """Sorted spans of several blocks as maximal runs."""
    run = lambda first, last: F.struct(first.alias("first"), last.alias("last"))

    def add(out: Column, s: Column) -> Column:
        end = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(run(end["first"], F.greatest(end["last"], s["last"]))))
        return F.when((F.size(out) > 0) & (s["first"] <= F.try_element_at(out, F.lit(-1))["last"] + 1), joined).otherwise(F.concat(out, F.array(run(s["first"], s["last"]))))

    return F.aggregate(spans, F.array().cast(_SPANS), add)


_BUILT: dict[str, list[WuManber]] = {}


def _search(docs: DataFrame, block: list[tuple[str, str | None]], window: int, text: str, keep_text: bool = False) -> DataFrame:
    """``docs``, without the text unless it is kept, and _words, _found and _spans.

    A worker process builds the tables of a block once and keeps the last ones.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    others = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "_words long, _found array<string>, _spans " + _SPANS])
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from isopleth.llm import decontaminate as here

        if name not in here._BUILT:
            here._BUILT.clear()
            here._BUILT[name] = build(shared.value, window)
        searchers = here._BUILT[name]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                counts, items, spans = [], [], []
                for t in some.column(text).to_pylist():
                    w, found, runs = words(t), set(), []
                    for s in searchers:
                        for end, names in s.search(w):
                            found |= names
                            runs.append((end - s.length + 1, end))
                    counts.append(len(w))
                    items.append(list(found))
                    spans.append(merge(runs))
                made = [pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in others), *made], [*(f.name for f in others), "_words", "_found", "_spans"])

    return docs.mapInArrow(run, schema)


def merge(runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Maximal runs of the words that any of the inclusive ranges covers."""
    out: list[dict[str, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1]["last"] + 1:
            out[-1]["last"] = max(b, out[-1]["last"])
        else:
            out.append({"first": a, "last": b})
    return out


def clean(docs: DataFrame, items: DataFrame, min_items: int = 1, **options) -> DataFrame:
    """The documents that hold windows of fewer than ``min_items`` items, with all
    their columns; by default a single occurring window removes a document."""
    names = [f"k_{i}" for i in range(len(docs.columns))]
    of_text = names[[c.lower() for c in docs.columns].index("text")]
    others = [n for n in names if n != of_text]
    plain = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names, strict=True) if n != of_text), *(docs[f"`{c}`"].alias(c) for c in ("doc_id", "text")))
    found = contamination(plain, items, keep=others, keep_text=of_text, min_items=min_items, **options).where("not contaminated")
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
