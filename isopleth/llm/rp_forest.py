"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample: each node takes, of a few random
directions, the one along which its sample spreads most, and splits at the
median.  All vectors are then routed to leaves.  A query walks all trees through
one shared priority queue, nearest branches (by the squared margins crossed so
far) first, until the leaves it has reached should hold its share of all rows and
those of one tree do hold more than ``k``.  How many rows a leaf holds is counted
first: leaves make buckets of at most about ``bucket_rows`` rows, and a larger leaf
is cut into several.  Every vector goes to one bucket a tree; the queries that
reached a bucket are streamed past it, and candidates ranked by exact distances.

Equal vectors are one class from the start.  Of a class only its ``k`` + 1
smallest ids can be in any answer, so no more are carried; nothing is lost.

Cases: vectors that are null, zero, of another length than most, or that hold
null or non-finite components take no part; repeated rows are candidates as often
as they occur, save that a query never finds its own id; with fewer candidates
than ``k`` all are returned; no vectors give no rows; distances that overflow are
infinite and tie; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import columns, lookup_skewed, materialize

#: Vectors that the trees are fitted on, at most twice so many.
SAMPLE = 20_000
#: Vectors of the sample whose exact neighbours set the number of leaves to visit.
PROBES = 128
#: Vectors (kind 0) and queries (kind 1) as they meet in a bucket.
MET = ["key", "kind", "id", "first", "leaf", "leaves", "raw"]
FOUND = pa.schema([("query", pa.int64()), ("class", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])


@dataclass
class Forest:
    """Heap-ordered complete trees: ``planes[t, node]`` and ``cuts[t, node]``."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        out = np.zeros((len(self.planes), len(x)), np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts, strict=True)):
            at = out[t]
            for _ in range(self.depth):
                at[:] = 2 * at + 1 + (np.einsum("ij,ij->i", x, planes[at]) > cuts[at])
            at -= 2**self.depth - 1
        return out

    def search(self, x: np.ndarray, visits: int, counts: np.ndarray | None = None, least: int = 0) -> Iterator[list[tuple[int, int]]]:
        """For each row the (tree, leaf) pairs it reaches first: ``visits``, or more until
        those of one tree hold ``least`` rows by ``counts[tree, leaf]``."""
        trees, inner = len(self.planes), 2**self.depth - 1
        if not inner:
            yield from ([(t, 0) for t in range(min(trees, visits))] for _ in x)
            return
        counts = np.zeros((trees, inner + 1), np.int64) if counts is None else counts
        for at in range(0, len(x), 256):
            margins = np.einsum("ij,tnj->itn", x[at : at + 256], self.planes) - self.cuts
            for row in margins:
                queue, out, held = [(0.0, t, 0) for t in range(trees)], [], [0] * trees
                while queue and (len(out) < visits or max(held) < least):
                    far, t, node = heapq.heappop(queue)
                    margin = row[t]
                    while node < inner:
                        m = float(margin[node])
                        left = 2 * node + 1
                        heapq.heappush(queue, (far + m * m, t, left if m > 0 else left + 1))
                        node = left + 1 if m > 0 else left
                    out.append((t, node - inner))
                    held[t] += int(counts[t, node - inner])
                yield out


def fit(sample: np.ndarray, trees: int, depth: int, tries: int = 16, seed: int = 7) -> Forest:
    rng, inner, dim = np.random.default_rng(seed), 2**depth - 1, sample.shape[1]
    planes, cuts = np.zeros((trees, inner, dim)), np.zeros((trees, inner))
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            some = members.pop(node)
            c = rng.standard_normal((tries, dim))
            c /= np.linalg.norm(c, axis=1, keepdims=True)
            p = sample[some] @ c.T
            best = int(p.std(0).argmax()) if len(some) else 0
            planes[t, node], cuts[t, node] = c[best], np.median(p[:, best]) if len(some) else 0
            right = p[:, best] > cuts[t, node]
            members[2 * node + 1], members[2 * node + 2] = some[~right], some[right]
    return Forest(planes, cuts, depth)


def leaf_costs(forest: Forest, x: np.ndarray) -> np.ndarray:
    """(row, tree, leaf): the squared margins crossed on the way, by which the queue
    orders leaves."""
    cost = np.zeros((len(x), len(forest.planes), 1))
    for level in range(forest.depth):
        at = slice(2**level - 1, 2 ** (level + 1) - 1)
        margin = np.einsum("ij,tnj->itn", x, forest.planes[:, at]) - forest.cuts[:, at]
        right = margin > 0
        both = np.stack([cost + np.where(right, margin**2, 0), cost + np.where(right, 0, margin**2)], axis=3)
        cost = both.reshape(*cost.shape[:2], -1)
    return cost


def calibrate(forest: Forest, sample: np.ndarray, k: int, target: float) -> float:
    """The part of one tree's leaves (all trees have ``len(planes)`` such parts) that
    must be visited to reach ``target`` of the ``k`` nearest within the sample."""
    n, leaves = len(sample), 2**forest.depth
    if n < 2:
        return float(len(forest.planes))
    of = forest.route(sample)
    places = []
    for i in np.unique(np.linspace(0, n - 1, min(PROBES, n)).astype(int)):
        near = ((sample - sample[i]) ** 2).sum(1)
        near[i] = np.inf
        best = np.argpartition(near, min(k, n - 1) - 1)[: min(k, n - 1)]
        cost = leaf_costs(forest, sample[i : i + 1])[0]
        nth = np.searchsorted(np.sort(cost.ravel()), cost[np.arange(len(of))[:, None], of[:, best]], "right")
        places.append(nth.min(0))
    return float(np.quantile(np.concatenate(places), target, method="higher")) / leaves


def leaf_counts(classes: DataFrame, forest: Forest) -> np.ndarray:
    """Rows by (tree, leaf): trees times leaves numbers, which the sample bounds."""
    shared, leaves = classes.sparkSession.sparkContext.broadcast(forest), 2**forest.depth

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(shared.value.planes) * leaves, np.int64)
        for b in batches:
            if b.num_rows:
                of = shared.value.route(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1))
                out += np.bincount((of + np.arange(len(of))[:, None] * leaves).ravel(), minlength=len(out))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])

    got = classes.select("vec").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(forest.planes) * leaves, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(-1, leaves)


def bucket_plan(counts: np.ndarray, bucket_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each (tree, leaf) its first bucket and over how many it is dealt; the number
    of buckets.  Neighbouring small leaves of a tree share one."""
    base, parts, number = np.zeros_like(counts), np.ones_like(counts), 0
    for t, row in enumerate(counts.tolist()):
        room = 0
        for leaf, n in enumerate(row):
            if n > bucket_rows:
                base[t, leaf], parts[t, leaf], room = number, -(-n // bucket_rows), 0
                number += int(parts[t, leaf])
                continue
            if n > room:
                number, room = number + 1, bucket_rows
            base[t, leaf], room = max(0, number - 1), room - n
    return base, parts, number + 1


class _Bucket:
    """Vectors of some leaves, in order of their leaf."""

    def __init__(self, held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        leaf = t.column("leaf").to_numpy()
        by = np.argsort(leaf, kind="stable")
        self.leaf = leaf[by]
        self.x = np.frombuffer(b"".join(t.column("raw").to_pylist()), np.float64).reshape(len(leaf), -1)[by]
        self.names, self.firsts = t.column("id").to_numpy()[by], t.column("first").to_numpy()[by]

    def rank(self, probes: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The ``k`` + 1 nearest of each query in the leaves it reached."""
        out = []
        for query, reached, raw in zip(*(probes.column(c).to_pylist() for c in ("id", "leaves", "raw")), strict=True):
            ends = np.searchsorted(self.leaf, [reached, np.asarray(reached) + 1])
            at = np.concatenate([np.arange(a, b) for a, b in ends.T.tolist()])
            with np.errstate(over="ignore"):
                score = np.sqrt(((self.x[at] - np.frombuffer(raw, np.float64)) ** 2).sum(1))
            if len(at) > k + 1:
                keep = score <= np.partition(score, k)[k]
                at, score = at[keep], score[keep]
            best = np.lexsort((self.firsts[at], score))[: k + 1]
            out.append((np.full(len(best), query), self.names[at[best]], self.firsts[at[best]], score[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=FOUND)


def _classes(vectors: DataFrame, keep: int) -> DataFrame:
    """class, vec, ids (the ``keep`` smallest) and first of all distinct usable vectors."""
    vec_id, raw = columns(vectors, "vec_id", "embedding")
    rows = vectors.select(vec_id.cast("long").alias("vec_id"), raw.cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))) & F.exists("vec", lambda v: v != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(good, F.lit(False)))
    # adding zero makes -0.0 and 0.0 one value
    rows = rows.withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0)))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vec") == (sizes[0]["n"] if sizes else -1))
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= keep)
    groups = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return rows, materialize(groups.select(F.monotonically_increasing_id().alias("class"), "vec", "ids", F.col("ids")[0].alias("first")), "classes")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, trees: int = 6, leaf_rows: int = 64, target: float = 0.96, bucket_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows, classes = _classes(vectors, k + 1)
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = materialize(queries.groupBy("vec").agg(F.count("*").alias("_copies")), "asked")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = -(-n // SAMPLE)
    some = classes.where(F.pmod(F.xxhash64("first", "class"), F.lit(part)) == 0).select("vec").limit(2 * SAMPLE).toArrow()
    sample = some.column("vec").combine_chunks().flatten().to_numpy().reshape(some.num_rows, -1)
    if not some.num_rows:
        sample = np.asarray(classes.select("vec").first()["vec"])[None]
    leaf = max(leaf_rows, 4 * n // max(1, len(sample)))
    depth = max(0, round(math.log2(max(1, n / leaf))))
    forest = fit(sample, trees, depth)
    leaves = 2**depth
    visits = max(1, math.ceil(calibrate(forest, sample, k, target) * leaves))
    counts = leaf_counts(classes, forest)
    base, parts, buckets = bucket_plan(counts, bucket_rows)
    shared = spark.sparkContext.broadcast((forest, counts, base, parts))  # SAMPLE bounds all of it

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, _, base, parts = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            names = b.column(0).to_numpy()
            for t, leaf in enumerate(forest.route(x)):
                key = base[t, leaf] + names % parts[t, leaf]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(x), np.int32)), b.column(0), b.column(2), pa.array(leaf), pa.nulls(len(x), pa.list_(pa.int64())), raw], MET)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, counts, base, parts = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                x = some.column(1).flatten().to_numpy().reshape(some.num_rows, -1)
                ids, rows = some.column(0).to_pylist(), [r.tobytes() for r in x]
                by: dict[tuple[int, int], list[int]] = {}
                for i, reached in enumerate(forest.search(x, visits, counts, k + 1)):
                    for t, leaf in reached:
                        for part in range(parts[t, leaf]):
                            by.setdefault((i, int(base[t, leaf]) + part), []).append(leaf)
                n = len(by)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key for _, key in by], pa.int64()), pa.array(np.ones(n, np.int32)), pa.array([ids[i] for i, _ in by], pa.int64()), pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.int64()), pa.array(list(by.values()), pa.list_(pa.int64())), pa.array([rows[i] for i, _ in by], pa.binary()),
                    ], MET,
                )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come bucket by bucket, in each its vectors before its queries."""
        now, held, index = None, [], None
        for b in batches:
            key, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(key * 2 + kind)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if at == end:
                    continue
                some = b.slice(at, end - at)
                if key[at] != now:
                    now, held, index = key[at], [], None
                if not kind[at]:
                    held.append(some)
                    continue
                if index is None and held:
                    index, held = _Bucket(held), []
                if index is not None:
                    yield index.rank(some, k)

    met = "key long, kind int, id long, first long, leaf long, leaves array<long>, raw binary"
    index = classes.select("class", "vec", "first").mapInArrow(routed, met)
    wanted = asked.join(classes, "vec").select("class", "vec")
    probes = wanted.mapInArrow(probing, met)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets, trees * n * sample.shape[1] >> 23))
    dealt = index.unionByName(probes).repartition(n_parts, "key").sortWithinPartitions("key", "kind")
    found = dealt.mapInArrow(rank, "query long, class long, first long, score double").distinct()
    near = Window.partitionBy("query").orderBy("score", "first")
    best = found.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k + 1)
    pairs = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    top = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("nth") <= k + 1)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("hits"))
    answers = lists.join(classes.select(F.col("class").alias("query"), "vec"), "query").join(asked, "vec").select("vec", "hits", "_copies")
    each = lookup_skewed(queries, materialize(answers, "answers"), "vec", "_copies")
    own = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id")), 1, k)
    return each.select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
