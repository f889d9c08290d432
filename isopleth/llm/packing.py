"""Order-preserving packing by dynamic programming with a monotone queue.

Documents in ascending doc_id are one stream of ids.  Cuts may fall at the end
of a document (free), of a sentence (a small penalty) or, in runs without one,
at every ``HARD_EVERY`` ids (a larger penalty).  With ``dp[j]`` the least cost
of the stream up to cut ``j``, at position ``p[j]``,

    dp[j] = min over p[j] - p[i] <= capacity of  dp[i] + capacity - (p[j] - p[i])  + penalty[j]

so the best ``i`` minimises ``dp[i] + p[i]`` in a sliding window, which a
monotone queue yields in constant amortised time.  A block's tail may be cut
into powers of two, which need no padding.

Cases: a null or empty text is the end id alone; documents longer than the
capacity span sequences; repeated doc_ids are ordered by text; no documents give
no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .encode import encoder
from .token_files import ordered

SENTENCE_PENALTY, HARD_PENALTY, HARD_EVERY = 4, 24, 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may fall, with 0 and the end, and their penalties."""
    total = len(ids)
    penalty = np.full(total + 1, 255, np.uint8)
    penalty[1:][ends_sentence[ids]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = 0
    known = np.flatnonzero(penalty != 255)
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > HARD_EVERY)
    if len(wide):
        count = (gaps[wide] - 1) // HARD_EVERY
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        penalty[np.repeat(known[wide], count) + step * HARD_EVERY] = HARD_PENALTY
        known = np.flatnonzero(penalty != 255)
    return known, penalty[known]


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, capacity: int = 2048) -> list[int]:
    """Cut positions of least cost, from 0 to the end of the stream."""
    p, c = positions.tolist(), penalties.tolist()
    dp, back = [0] * len(p), [0] * len(p)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # dp + p, p, index
    for j in range(1, len(p)):
        here = p[j]
        least = here - capacity
        while queue[0][1] < least:
            queue.popleft()
        key, _, i = queue[0]
        value = key + capacity - here + c[j]
        dp[j], back[j] = value, i
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, j))
    total = p[-1]
    best, tail, j = None, 0, len(p) - 1
    while j >= 0 and total - p[j] <= capacity:  # the last sequences
        rest = total - p[j]
        cost = dp[j] + min(capacity - rest, (rest.bit_count() - 1) * HARD_PENALTY if rest else 0) * bool(rest)
        if best is None or cost < best:
            best, tail = cost, j
        j -= 1
    cuts, rest = [], total - p[tail]
    if rest and (rest.bit_count() - 1) * HARD_PENALTY < capacity - rest:
        at = total
        for k in range(rest.bit_length()):
            if rest >> k & 1:
                cuts.append(at)
                at -= 1 << k
    elif rest:
        cuts.append(total)
    j = tail
    while j:
        cuts.append(p[j])
        j = back[j]
    return [0, *reversed(cuts)]


@lru_cache(maxsize=4)
def sentence_ends(vocabulary: str) -> np.ndarray:
    """For each id, whether its text ends a sentence or a line."""
    t = encoder(vocabulary).tokenizer
    table = np.zeros(t.get_vocab_size() + 1, bool)
    for word, i in t.get_vocab().items():
        table[i] = word.rstrip("Ġ\"')»").endswith((".", "!", "?", "Ċ"))
    return table


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, block_tokens: int = 1 << 20) -> DataFrame:
    """One row a piece: its document, place there, sequence and place there."""
    end = np.asarray([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, is_end = encoder(vocabulary).encode, sentence_ends(vocabulary)
        sequence = TaskContext.get().partitionId() << 40
        names, parts, sizes, total = [], [], [], 0

        def block():
            nonlocal sequence
            raw = b"".join(parts)
            ids = np.frombuffer(raw, "<u4")
            ends = np.cumsum(np.asarray(sizes, np.int64))
            cuts = np.asarray(choose_cuts(*candidates(ids, ends, is_end), capacity), np.int64)
            edges = np.union1d(cuts, ends)
            first = np.concatenate([[0], edges[:-1]])
            first, last = first[edges > first], edges[edges > first]
            doc, seq = np.searchsorted(ends, first, "right"), np.searchsorted(cuts, first, "right") - 1
            view, at = memoryview(raw), (first * 4).tolist()
            sums = [zlib.crc32(view[a:b]) for a, b in zip(at, (last * 4).tolist(), strict=True)]
            lengths = np.asarray(sizes, np.int64)
            out = {
                "doc_id": pa.array(names, pa.int64()).take(pa.array(doc)), "start": first - (ends - lengths)[doc], "length": last - first,
                "ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": lengths[doc], "sequence_id": seq + sequence, "offset": first - cuts[seq],
            }
            sequence += len(cuts) - 1
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for name, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    names.append(name)
                    parts += (ids, end)
                    sizes.append(len(ids) // 4 + 1)
                    total += sizes[-1]
                    if total >= block_tokens:
                        yield block()
                        names, parts, sizes, total = [], [], [], 0
        if names:
            yield block()

    return ordered(docs).mapInArrow(pack, PIECES)
