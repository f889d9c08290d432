"""An exact join of sets by Jaccard similarity, for pairs that are not connected yet.

Two sets of a similarity of t or more share an element among the first
n - ceil(t n) + 1 of each, in any order that holds for all sets.  Here elements that
many sets have come last, and the others go by their hash, so that a set meets few
that are not like it.  The elements are dealt packed, many in a row; those of one set
alone or of sets too different in size, nearly all, end there.  Of the others those that lie in several components
are searched: pairs in reach by their sizes are told by bitmaps that hold for each bit
whether an odd number of elements fell on it.  As many bits differ as elements at
most, so that no pair is lost.  Sets of more elements than bits fill such a bitmap and
are told again, once a pair, by one with a bit an element at least.  The sets of what is
left are for the caller to compare.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import discard, lookup_skewed, materialize, partitions_for

#: Bytes of an element that are dealt; where these agree by chance, more pairs are compared.
BYTES = 5
#: Bits of a bitmap, and the most of one for a long set.
BITS, LONGEST = 2048, 1 << 24
#: Pairs that are compared at once.
_CHUNK = 1 << 15


def prefix(elements: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first of the sorted distinct uint64 ``elements``, those in ``common`` last and
    in its order, of which similar sets share one."""
    n = len(elements)
    most = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if not len(common) or not most:
        return elements[:most]
    by = np.argsort(common)
    at = np.minimum(np.searchsorted(common, elements, sorter=by), len(common) - 1)
    often = common[by[at]] == elements
    first = elements[~often][:most]
    return np.concatenate([first, common[np.sort(by[at[often]])[: most - len(first)]]])


def packed(elements: np.ndarray) -> bytes:
    """The lowest ``BYTES`` bytes of each element."""
    return elements.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return out.view("<i8").ravel()


def _planes(numbers: np.ndarray) -> bytes:
    """Longs with their bytes by rank, as neighbours have the high ones in common."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def shared_elements(prefixes: DataFrame, similarity: float) -> DataFrame:
    """(element, node) for the elements that the prefixes of several of (node, prefix)
    have, if their sizes, which those of the prefixes tell, allow the similarity."""
    n = max(int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions_for(prefixes, 2))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                some = batch.slice(at, 5000)
                raw = some.column(1).to_pylist()
                element = unpacked(b"".join(raw))
                long = np.array([len(x) // BYTES for x in raw], np.int64)
                node, size = np.repeat(some.column(0).to_numpy(), long), np.repeat(long, long)
                part = element % n
                by = np.argsort(part, kind="stable")
                element, node, size, part = element[by], node[by], size[by], part[by]
                cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
                spans = list(zip(cuts, cuts[1:], strict=False))
                rows = [part[[a for a, _ in spans]], [packed(element[a:b]) for a, b in spans], *([_planes(x[a:b]) for a, b in spans] for x in (node, size))]
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], ["part", "elements", "nodes", "sizes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (unpacked, _of_planes, _of_planes)
        held: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in read]
        for batch in batches:
            for column, of, into in zip(batch.columns[1:], read, held, strict=True):
                into += map(of, column.to_pylist())
        element, node, size = map(np.concatenate, held)
        del held
        by = np.lexsort((size, element))
        element, node, size = element[by], node[by], size[by]
        # n elements have a prefix of floor((1 - t) n) + 1; the next in size is the nearest
        near = (element[1:] == element[:-1]) & (size[:-1] > similarity * (size[1:] - 1) - 1e-9)
        kept = np.zeros(len(element), bool)
        kept[1:] |= near
        kept[:-1] |= near
        element, node = element[kept], node[kept]
        for at in range(0, len(element), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(element[at : at + (1 << 16)]), pa.array(node[at : at + (1 << 16)])], ["element", "node"])

    dealt = prefixes.select("node", "prefix").mapInArrow(deal, "part long, elements binary, nodes binary, sizes binary")
    return dealt.repartition(n, "part").mapInArrow(meet, "element long, node long")


def bitmap(elements: np.ndarray, wide: int = BITS) -> np.ndarray:
    """For each of ``wide`` places whether an odd number of the uint64 elements fall on it."""
    places = (elements >> np.uint64(40)) % np.uint64(wide)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=wide) & 1)


def long_bitmap(elements: np.ndarray) -> bytes | None:
    """For sets of more than ``BITS`` elements a bitmap of as many places or more, a power of two."""
    n = len(elements)
    return bitmap(elements, min(LONGEST, 1 << (n - 1).bit_length())).tobytes() if n > BITS else None


def may_be_similar(a: bytes, b: bytes, sizes: int, similarity: float) -> bool:
    """Whether two long bitmaps of sets with ``sizes`` elements in all allow the
    similarity; a wider one is folded to the places of the other."""
    n = min(len(a), len(b)) // 8
    x, y = (np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, n), axis=0) for raw in (a, b))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= int((1 - similarity) / (1 + similarity) * sizes + 1e-9)


def close_pairs(key: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, bits: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes with one key and different roots whose sizes and bitmaps allow the similarity."""
    by = np.lexsort((size, key))
    key, node, root, size, bits = key[by], node[by], root[by], size[by], bits[by]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    wide = int(size.max()) + 2
    limit = np.minimum((size / similarity + 1e-9).astype(np.int64), wide - 1)
    n = np.arange(len(key))
    many = np.searchsorted(group * wide + size, group * wide + limit, "right") - n - 1
    ends = np.cumsum(many)
    for at in range(0, int(ends[-1]), _CHUNK):
        pair = np.arange(at, min(at + _CHUNK, int(ends[-1])))
        a = np.searchsorted(ends, pair, "right")
        b = a + 1 + pair - (ends[a] - many[a])
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
        most = ((1 - similarity) / (1 + similarity) * (size[a] + size[b]) + 1e-9).astype(np.int64)
        diff = np.zeros(len(a), np.int64)
        for part in range(0, bits.shape[1], 8):
            diff += np.bitwise_count(bits[a, part : part + 8] ^ bits[b, part : part + 8]).sum(1, dtype=np.int64)
            left = diff <= most
            a, b, most, diff = a[left], b[left], most[left], diff[left]
        if len(a):
            found = np.unique(np.stack([np.maximum(node[a], node[b]), np.minimum(node[a], node[b])], 1), axis=0)
            yield found[:, 0], found[:, 1]


def crossing_pairs(prefixes: DataFrame, roots: DataFrame, bitmaps: DataFrame, similarity: float, hot: int = 1 << 13, batch_rows: int = 1 << 14) -> DataFrame | None:
    """Pairs (a, b) of nodes in different components of (node, root), among them all
    that are as similar; none at all if no element lies in two components.

    ``prefixes`` has (node, prefix), ``bitmaps`` (node, size, bits), and a node without
    a root is its own.  An element of more than ``hot`` nodes is cut into
    parts, and each pair of parts is searched by itself.
    """
    shared = shared_elements(prefixes, similarity).join(roots, "node", "left")
    shared = materialize(shared.select("element", "node", F.coalesce("root", "node").alias("root")), "shared")
    mixed = shared.groupBy("element").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_n")).where("_low != _high")
    mixed = materialize(mixed.select("element", F.ceil(F.col("_n") * 2 / hot).alias("_parts"), (F.col("_n") > hot).alias("_hot")), "mixed")
    if not mixed.take(1):
        return None
    crossing = shared.join(mixed, "element")
    key = F.col("element")
    plain = crossing.where("not _hot").select(key.alias("key"), "node", "root")
    if mixed.where("_hot").take(1):
        own = F.pmod(F.xxhash64("node"), F.col("_parts"))
        cut = crossing.where("_hot").select("element", "node", "root", own.alias("_own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_other"))
        plain = plain.unionByName(cut.select(F.xxhash64("element", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "node", "root"))
    plain = materialize(plain, "crossing")
    told = plain.join(bitmaps, "node")
    n = max(int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions_for(plain, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in close_pairs(*rows, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, BITS // 64)
            held.append((*(c.to_numpy() for c in batch.columns[:4]), bits))
            if sum(len(x[0]) for x in held) < batch_rows or held[0][0][0] == held[-1][0][-1]:
                continue  # more rows, or the rest of a long key, may come
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            stop = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from pairs([x[:stop] for x in rows])
            held = [tuple(x[stop:] for x in rows)]
        if held:
            yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)])

    dealt = told.select("key", "node", "root", "size", "bits").repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def still_close(pairs: DataFrame, bitmaps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose long bitmaps, of (node, size, long), allow the similarity or
    of which one has none, materialised."""
    pairs = materialize(pairs, "pairs")
    told, sides = pairs, []
    for end in ("a", "b"):
        degrees = pairs.groupBy(end).agg(F.count("*").alias("_n"))
        side = bitmaps.where("long is not null").select(F.col("node").alias(end), F.col("size").alias(f"_size_{end}"), F.col("long").alias(f"_long_{end}"))
        sides.append(materialize(side.join(degrees, end), f"long-{end}"))
        told = lookup_skewed(told, sides[-1], end, "_n", hot=64)  # few bitmaps at once are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for at in range(0, batch.num_rows, 500):
                sizes, x, y = (c.to_pylist() for c in batch.slice(at, 500).columns[2:])
                kept += [n is None or may_be_similar(p, q, n, similarity) for n, p, q in zip(sizes, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    told = told.select("a", "b", (F.col("_size_a") + F.col("_size_b")).alias("sizes"), "_long_a", "_long_b")
    out = materialize(told.mapInArrow(run, "a long, b long"), "close")
    discard(pairs, *sides)
    return out
