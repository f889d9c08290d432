"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints are made per document; equal ones are summed up first, so that a
group of copies is one row from there on.  Each print is dealt to keys such that
prints to be linked meet in one, and the prints of a key are searched with the
index of ``gray_index``, whatever their number; the links of a forest that connects
them leave, fewer than prints.  Components are then joined with rounds of joins and
aggregations over written tables.  Keys get longer as prints get more, so that a
key holds about ``ROWS`` unrelated ones at every size of the corpus.

``near_duplicates`` links 64-bit prints at ``most`` differing bits exactly: the
bits are cut into blocks, and there is a key for every choice of blocks so small
that two linked prints must agree on one of them.

``deduplicate`` goes by similarity: prints of ``WIDE`` words of 64 bits estimate
the Jaccard similarity of the sets of shingles, and keys are sampled bits, in so
many tables that a pair at the threshold meets in none with a probability of
``MISS`` at most.  In every key the links of a spanning forest of least differences
and, near the threshold, ``SPARE`` more of a print leave; those count whose sets of shingles are as
similar as asked, exactly.  Two groups that only links below the threshold join are
thus apart again.  What tables, ``reach`` and forests leave out, ``set_join`` finds:
all pairs of different components that are as similar, so that no link is lost.

Cases: a null, empty or wordless text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle; repeated rows are kept; a
null doc_id is no one's component_id (a group of null ids alone has a null one);
no documents give no rows; other columns are ignored by ``near_duplicates`` and
kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import gray_index, set_join
from ._shared import broadcast_few, columns, discard, fresh, lookup_skewed, materialize, partitions_for, spread

#: Unrelated prints that a key holds, as keys are long.
ROWS = 128
#: Words of a wide print, and the share of pairs at the threshold that no key brings together.
WIDE, MISS = 8, 0.01
#: Links near the threshold that a print gives besides those of a forest.
SPARE = 2
#: Documents of the sample that tells common shingles, and the most of those that are told.
SAMPLE, COMMON = 2048, 1 << 17
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, as unsigned 64-bit integers."""
    from xxhash import xxh64_intdigest as h

    words = text.encode().translate(_LOWER).split() if text else []
    plain = b" ".join(words)
    n = max(1, len(words) - shingle + 1) if words else 0
    edge = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    starts, ends = edge[:n].tolist(), (edge[min(shingle, len(words)) :] - 1).tolist()
    return np.fromiter((h(plain[a:b], 42) for a, b in zip(starts, ends, strict=bool(words))), np.uint64, n)


def _majority(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included."""
    return int(_majority(shingle_hashes(text, shingle))[0])


def wide_fingerprint(text: str | None, shingle: int = 5, words: int = WIDE) -> np.ndarray:
    """SimHash of the set of shingles in several words: further hashes of a shingle
    come from its first one by a mixing step each."""
    return _wide(np.unique(shingle_hashes(text, shingle)), words)


def _wide(h: np.ndarray, words: int = WIDE) -> np.ndarray:
    out = []
    for k in range(words):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        if k:
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        out.append(_majority(z))
    return np.concatenate(out)


def differing_share(similarity: float) -> float:
    """Expected share of SimHash bits in which two sets of that Jaccard similarity differ."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def reach(similarity: float, words: int = WIDE) -> int:
    """Most differing bits of a pair that may be linked: the expected number at
    ``similarity`` and two standard deviations, so that few pairs above the threshold
    are lost to chance; pairs below it are told by their shingles."""
    p = differing_share(similarity)
    return int(64 * words * p + 2 * math.sqrt(64 * words * p * (1 - p)))


def ladder(similarity: float, words: int = WIDE) -> tuple[int, ...]:
    """Differing bits by which links are taken in turn, the last being ``reach``."""
    steps = (similarity + (1 - similarity) * part for part in (0.75, 0.5, 0.25, 0.0))
    most = [int(64 * words * differing_share(x)) for x in steps]
    return (*most, (most[-1] + reach(similarity, words)) // 2, reach(similarity, words))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and the fingerprint (a signed long), materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t for at in range(0, batch.num_rows, 500) for t in batch.column(1).slice(at, 500).to_pylist())
            made = pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "print"])

    doc_id, text = columns(docs, "doc_id", "text")
    slim = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))
    return materialize(spread(slim).mapInArrow(run, "doc_id long, print long"), "prints")


def wide_fingerprints(docs: DataFrame, row: str, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """doc_id, the long ``row``, the wide fingerprint with a digest of the set of shingles
    behind it, and the set's prefix, size and bitmaps (see ``set_join``), materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            prints, prefixes, sizes, bits, long = [], [], [], [], []
            for at in range(0, batch.num_rows, 500):
                for t in batch.column(2).slice(at, 500).to_pylist():
                    h = np.unique(shingle_hashes(t, shingle))
                    prints.append(_wide(h).tobytes() + xxh3_128_digest(h.tobytes()))
                    prefixes.append(set_join.packed(set_join.prefix(h, similarity, common)))
                    sizes.append(len(h))
                    bits.append(set_join.bitmap(h).tobytes())
                    long.append(set_join.long_bitmap(h))
            made = [pa.array(prints, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(long, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["doc_id", "row", "print", "prefix", "size", "bits", "long"])

    doc_id, number, text = columns(docs, "doc_id", row, "text")
    slim = docs.select(doc_id.cast("long").alias("doc_id"), number.alias("row"), text.alias("text"))
    return materialize(spread(slim).mapInArrow(run, "doc_id long, row long, print binary, prefix binary, size long, bits binary, long binary"), "prints")


def block_plan(n: int, most: int) -> tuple[int, ...]:
    """Widths of the blocks of which two prints must agree on all but ``most``: the
    fewest blocks whose keys hold about ``ROWS`` of ``n`` prints, 12 more than ``most`` at most."""
    for blocks in range(most + 1, most + 13):
        widths = tuple(64 // blocks + (i < 64 % blocks) for i in range(blocks))
        if n >> sum(sorted(widths)[: blocks - most]) <= ROWS:
            break
    return widths


def _block_keys(widths: tuple[int, ...], most: int) -> Column:
    """One number for every choice of blocks, holding the choice and its bits."""
    starts = np.cumsum([0, *widths]).tolist()
    keys = []
    for number, chosen in enumerate(combinations(range(len(widths)), len(widths) - most)):
        key = F.lit(number).cast("long")
        for b in chosen:
            part = F.shiftrightunsigned("print", starts[b]).bitwiseAND(F.lit((1 << widths[b]) - 1).cast("long"))
            key = F.shiftleft(key, widths[b]).bitwiseOR(part)
        keys.append(key)
    return F.array(*keys)


def deal_blocks(most: int) -> Callable[[DataFrame, int], DataFrame]:
    """(node, print) of one word dealt to the keys in which all links of ``most`` bits lie."""
    return lambda prints, n: prints.select("node", "print", F.explode(_block_keys(block_plan(n, most), most)).alias("key"))


def table_plan(n: int, similarity: float) -> tuple[int, int]:
    """Sampled bits a key, for about ``ROWS`` of ``n`` prints in one, and tables."""
    bits = max(0, math.ceil(math.log2(max(1, n) / ROWS)))
    together = (1 - differing_share(similarity)) ** bits
    return bits, 1 if not bits else math.ceil(math.log(MISS) / math.log1p(-together))


def deal_samples(similarity: float) -> Callable[[DataFrame, int], DataFrame]:
    """(node, print) of wide prints dealt to one key a table."""

    def deal(prints: DataFrame, n: int) -> DataFrame:
        bits, tables = table_plan(n, similarity)
        rng = np.random.default_rng(11)
        places = [np.sort(rng.choice(64 * WIDE, bits, replace=False)) for _ in range(tables)]
        powers = np.int64(1) << np.arange(bits, dtype=np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    some = batch.slice(at, 1000)
                    raw = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(-1, 8 * WIDE)
                    of = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
                    for table, p in enumerate(places):
                        key = (of[:, p] @ powers) * tables + table
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(key)], ["node", "print", "key"])

        return prints.select("node", "print").mapInArrow(run, "node long, print binary, key long")

    return deal


def _words(column: pa.Array) -> np.ndarray:
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
    return column.to_numpy().view(np.uint64).reshape(-1, 1)


def edges_of(key: np.ndarray, node: np.ndarray, words: np.ndarray, levels: tuple[int, ...], counts=None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the components of whole keys; of links that are yet to be
    verified (several levels) also the nearest of each node."""
    _, a, b = gray_index.forest(words, levels, key, counts, spare=SPARE if len(levels) > 1 else 0)
    return node[a], node[b]


def _linked(dealt: DataFrame, levels: tuple[int, ...], n: int, hot: int, batch_rows: int = 1 << 16) -> DataFrame:
    """Edges (a, b) within equal keys of (node, print, key); a key of more than ``hot``
    rows leaves its rows instead, as (node, null, key)."""

    batch_rows = min(batch_rows, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows, over = 0, None

        def edges(key, node, words):
            a, b = edges_of(key, node, words, levels)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])

        def passed(key, node):
            return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(key)], ["a", "b", "key"])

        for batch in batches:
            node, words, key = batch.column(0).to_numpy(), _words(batch.column(1)), batch.column(2).to_numpy()
            if over is not None:  # the rest of a key that was given up
                cut = int(np.searchsorted(key, over, "right"))
                if cut:
                    yield passed(key[:cut], node[:cut])
                node, words, key = node[cut:], words[cut:], key[cut:]
            if not len(key):
                continue
            over = None
            held.append((key, node, words))
            rows += len(key)
            if rows <= batch_rows or (held[0][0][0] == key[-1] and rows <= hot):
                continue  # more rows, or the rest of a long key, may come
            key, node, words = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield edges(key[:cut], node[:cut], words[:cut])
            held, rows = [(key[cut:], node[cut:], words[cut:])], len(key) - cut
            if rows > hot:
                over = key[-1]
                yield passed(*held[0][:2])
                held, rows = [], 0
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.select("node", "print", "key").repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long")


def links(prints: DataFrame, levels: tuple[int, ...], deal: Callable[[DataFrame, int], DataFrame] | None = None, hot: int = 1 << 18) -> DataFrame:
    """Edges (a, b) that connect the nodes of (node, print), whose prints are distinct,
    as all links within ``levels[-1]`` bits do; fewer than one a print and key.

    A key of more than ``hot`` prints is cut into parts, and each pair of parts is
    searched by itself, so that no task holds more than twice ``hot`` of them.
    """
    spark = prints.sparkSession
    dealt = (deal or deal_blocks(levels[-1]))(prints, prints.count())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), partitions_for(prints, 1))
    found = materialize(_linked(dealt, levels, n, hot), "links")
    edges, large = found.where("key is null").select("a", "b"), found.where("key is not null").select(F.col("a").alias("node"), "key")
    if large.take(1):
        parts = large.groupBy("key").agg(F.ceil(F.count("*") * 2 / hot).alias("_parts"))
        # a key here has more than ``hot`` rows: few keys
        cut = large.join(F.broadcast(parts), "key").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_parts")))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
        pairs = cut.select("node", "key", "_own", other.alias("_other"))
        pair = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
        again = pairs.select("node", pair.alias("key")).join(prints.select("node", "print"), "node")
        edges = edges.unionByName(_linked(again, levels, n, 1 << 62).select("a", "b"))
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connect(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), materialised.

    In each round every node tells its neighbours and itself the smallest node it
    sees; the new edges connect what the old ones did.  Nothing but row counts and
    sums reaches the driver.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    before: tuple[DataFrame, ...] = ()
    while True:
        now = materialize(now, "edges")
        discard(*before)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count("*").alias("_n")), "lows")
        inner = seen.where("low != a")
        if not inner.where("_n > 1").take(1) and not now.join(inner.select(F.col("a").alias("b")), "b", "left_semi").take(1):
            # every edge leads from a node with one neighbour to a root
            discard(now)
            return seen.select(F.col("a").alias("node"), F.col("low").alias("root"))
        before = (now, seen)
        told = lookup_skewed(both, seen, "a", "_n")
        ends = told.select(F.explode(F.array("a", "b")).alias("x"), "low").where("x != low")
        now = ends.select(F.greatest("x", "low").alias("a"), F.least("x", "low").alias("b")).distinct()


def _with_best(by_doc: DataFrame, find: Callable[[DataFrame], DataFrame], best: Column) -> DataFrame:
    """``by_doc`` and component_id: the minimum ``best`` over the component of a row's
    print, or null where that print has this row alone and is its own best.

    ``find`` gives the edges between the nodes of (node, print, first, _copies); a node
    is a print of one word, or the row of a wide one's best.
    """
    grouped = by_doc.groupBy("print").agg(best.alias("first"), F.count("*").alias("_copies"))
    node = F.col("print") if dict(by_doc.dtypes)["print"] == "bigint" else F.col("first.row")
    groups = materialize(grouped.withColumn("node", node), "groups")
    member = groups.join(connect(find(groups)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    member = materialize(member.select("print", "root", "first", "_copies"), "members")
    found = member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_prints")).where("_prints > 1")
    known = lookup_skewed(member, materialize(found, "components"), "root", "_prints")
    known = known.select("print", F.coalesce("component_id", "first").alias("component_id"), "first", "_copies").where("_copies > 1 or not (component_id <=> first)").drop("first")
    return lookup_skewed(by_doc, materialize(known, "known"), "print", "_copies")


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    out = _with_best(fingerprints(docs, shingle), lambda groups: links(groups, (most,)), F.min("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` with the sorted distinct hashes of the shingles of ``text`` in its place."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "shingles array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in others), pa.array(sets, pa.list_(pa.int64()))], [*(f.name for f in others), "shingles"])

    return rows.mapInArrow(run, schema)


def common_shingles(docs: DataFrame, row: str, shingle: int) -> np.ndarray:
    """Shingles that many documents have, ascending in number, by a sample of
    ``SAMPLE`` documents or every 64th: a good order for ``set_join.prefix``, which is
    exact in any."""
    share = min(1.0, max(SAMPLE / max(1, docs.count()), 1 / 64))
    text, number = columns(docs, "text", row)
    some = docs.where(F.pmod(F.xxhash64(number), F.lit(1 << 20)) < int(share * (1 << 20))).select(text.alias("text"))
    counts = shingle_sets(spread(some), shingle).select(F.explode("shingles").alias("shingle")).groupBy("shingle").count()
    found = counts.where("count > 3").orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()["shingle"]
    return found.to_numpy().view(np.uint64)[::-1].copy()


def verified(edges: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The edges (a, b) whose nodes, of (node, text), have sets of shingles as similar,
    materialised."""
    edges = materialize(edges, "candidates")
    ends = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    sets = materialize(shingle_sets(texts.join(broadcast_few(ends), "node", "left_semi"), shingle), "sets")
    told, sides = edges, []
    for end in ("a", "b"):
        degrees = edges.groupBy(end).agg(F.count("*").alias("_n"))
        side = sets.select(F.col("node").alias(end), F.col("shingles").alias(f"_{end}")).join(degrees, end)
        sides.append(materialize(side, f"sets-{end}"))
        told = lookup_skewed(told, sides[-1], end, "_n", hot=64)  # few sets at once are broadcast
    discard(sets)
    common = F.size(F.array_intersect("_a", "_b"))
    out = materialize(told.where(common >= F.lit(similarity) * (F.size("_a") + F.size("_b") - common)).select("a", "b"), "verified")
    discard(edges, ends, *sides)
    return out


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of similar texts, with all its columns: one with the
    smallest doc_id.

    Rows are told apart by a number that is written with them, so that a doc_id
    may be null or stand in several components; a row without one stays only if
    its component has none.
    """
    row = fresh(docs, "_row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    prints = wide_fingerprints(numbered, row, shingle, similarity, common_shingles(numbered, row, shingle))
    number, text = columns(numbered, row, "text")
    texts = numbered.select(number.alias("node"), text.alias("text"))

    def find(groups: DataFrame) -> DataFrame:
        wide = groups.select("node", F.substring("print", 1, 8 * WIDE).alias("print"))
        near = connect(verified(links(wide, ladder(similarity), deal_samples(similarity)), texts, shingle, similarity))
        prefixes = prints.select(F.col("row").alias("node"), "prefix").join(groups.select("node"), "node", "left_semi")
        bitmaps = prints.select(F.col("row").alias("node"), "size", "bits")
        known = near.select(F.col("node").alias("a"), F.col("root").alias("b"))
        missed = set_join.crossing_pairs(prefixes, near, bitmaps, similarity)
        if missed is None:
            return known
        close = set_join.still_close(missed, prints.select(F.col("row").alias("node"), "size", "long"), similarity)
        return known.unionByName(verified(close, texts, shingle, similarity))

    found = _with_best(prints.select("doc_id", "row", "print"), find, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")))
    gone = materialize(found.where("component_id.row != row").select(F.col("row").alias(row)), "gone")
    return numbered.join(broadcast_few(gone), row, "left_anti").drop(row)
