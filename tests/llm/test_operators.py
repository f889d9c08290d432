"""The parts of the operators against plain versions, exact round trips and damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from isopleth.llm import _shared, decontaminate, elias_fano, encode, gray_index, language_id, packing, queries, rp_forest, set_join, simhash, token_counts, token_files, url_filter, warc
from tests.llm import brute


@given(st.lists(st.integers(0, 2**40), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    values = sorted(values)
    coded = elias_fano.EliasFano(elias_fano.encode(np.asarray(values, np.uint64)))
    assert coded.values().tolist() == values
    for i in range(0, len(values), 37):
        assert coded.select(i) == values[i]
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_space():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000)).astype(np.uint64)
    bits = len(elias_fano.encode(values)) * 8 / len(values)
    assert bits < 2.2 + math.log2(int(values[-1]) / len(values))


def test_token_file_damage_is_seen():
    data = token_files.pack_file([None, 3, 9], np.array([1, 4, 2]), np.arange(7, dtype="<u4").tobytes())
    names, bounds, ids = token_files.unpack_file(data)
    assert (names, bounds.tolist(), ids.tolist()) == ([None, 3, 9], [0, 1, 5, 7], list(range(7)))
    with pytest.raises(ValueError):
        token_files.unpack_file(data[:-1] + b"x")


def test_single_documents_are_read_by_select(tmp_path):
    rng = np.random.default_rng(2)
    for top in (60_000, 70_000):
        lengths = rng.integers(1, 40, 700)
        ids = rng.integers(0, top, lengths.sum()).astype("<u4")
        names = [None, None, *np.cumsum(rng.integers(0, 9, 698)).tolist()]
        names[2] = -5
        path = f"{tmp_path}/{top}.tok"
        token_files.put_file(path, token_files.pack_file(names, lengths, ids.tobytes()))
        file, ends = token_files.TokenFile(path), np.cumsum(lengths)
        assert len(file) == 700
        for i in (0, 1, 2, 3, 255, 256, 257, 511, 698, 699):
            assert file.doc_id(i) == names[i] and file.span(i) == (ends[i] - lengths[i], ends[i])
            assert file.ids(i).tolist() == ids[ends[i] - lengths[i] : ends[i]].tolist()
        with pytest.raises(IndexError):
            file.ids(700)
        file.close()


def test_repeated_and_missing_ids_are_cut_into_many_parts(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sizes = token_files.ordered(docs).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 1000
    rows = [r for b in token_files.ordered(docs).toLocalIterator() for r in [b]]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)


ODD = st.text(st.sampled_from("abzAZéÀß'sreTt 019.,!?\n\t …“”日İ½²<|>🙂"), max_size=60)


@given(st.lists(ODD, max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoders_match_the_library(texts):
    for name, path in (("word_bpe_49k.json", queries.WORD_BPE), ("byte_bpe_50k.json", queries.BYTE_BPE)):
        made = encode.encoder(path).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in made] == [brute.encode(name, t) for t in texts]


def check_prefixes(text: str) -> None:
    steps = token_counts.counter(queries.WORD_BPE).count(text)
    counts = token_counts.unpack(token_counts.pack(steps), len(text))
    want = [len(brute.encode("word_bpe_49k.json", text[:i])) for i in range(len(text) + 1)]
    assert counts.tolist() == want
    for budget in (0, 1, 3, 7):
        assert token_counts.fit(counts, budget) == max(i for i, n in enumerate(want) if n <= budget)


@given(st.one_of(ODD, st.text(st.sampled_from("aabe\u0301\u0308'srevl"), max_size=120), st.text("aab", min_size=60, max_size=150), st.text(max_size=40)))
@settings(max_examples=200, deadline=None)
def test_every_prefix_count(text):
    check_prefixes(text)


@pytest.mark.parametrize("text", ["İstanbul is big", "a<|b", "x" * 600, "no<|endoftext|>yes <|startoftext|><|endoftext|", "हिन्दी में 'restaurant've", "e\u0301" * 90, "한국어\u1112\u1161\u11ab", "日本語のテキスト" * 40, "don't'" * 30, "\u2003 \u00a0x"])
def test_every_prefix_count_of_hard_texts(text):
    check_prefixes(text)


def test_prefix_counts_of_very_long_pre_tokens():
    table = token_counts.counter(queries.WORD_BPE)
    for text in ("x" * 50_000, "ab" * 20_000, "テキスト" * 5_000):
        counts = token_counts.unpack(token_counts.pack(table.count(text)), len(text))
        for i in (1, 999, 12_345, len(text)):
            assert counts[i] == len(brute.encode("word_bpe_49k.json", text[:i]))


@given(st.lists(st.integers(1, 9), min_size=1, max_size=14), st.integers(9, 16))
@settings(max_examples=80, deadline=None)
def test_cuts_cost_least(gaps, capacity):
    positions = np.cumsum([0, *gaps])
    penalties = np.array([(0, 4, 24)[i * 7 % 3] for i in range(len(positions))])
    penalties[0] = 0

    def cost(cuts):
        return sum(capacity - (b - a) + penalties[positions.tolist().index(b)] for a, b in zip(cuts, cuts[1:], strict=False))

    cuts = packing.choose_cuts(positions, penalties, capacity)
    assert cuts[0] == 0 and cuts[-1] == positions[-1] and all(0 < b - a <= capacity for a, b in zip(cuts, cuts[1:], strict=False))
    # up to where the tail begins, no other choice of cuts is cheaper
    inner = [c for c in cuts if c in positions]
    for stop in inner[1:-1]:
        best = {0: 0}
        for j, p in enumerate(positions[1:], 1):
            best[p] = min((best[a] + capacity - (p - a) + penalties[j] for a in positions[:j] if p - a <= capacity), default=math.inf)
        assert cost(inner[: inner.index(stop) + 1]) == best[stop]


@pytest.mark.parametrize("n, flips", [(1, 2), (40, 3), (700, 6), (700, 30)])
def test_gray_index_components(n, flips):
    rng = np.random.default_rng(n + flips)
    seeds = rng.integers(0, 2**64, 20, np.uint64)
    values = seeds[rng.integers(0, 20, n)]
    for _ in range(flips):
        values = np.where(rng.random(n) < 0.5, values ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64)), values)
    values = np.unique(values)
    got = gray_index.components(values, 4)
    want = brute.components(list(range(len(values))), values.tolist())
    assert len(set(zip(got.tolist(), want, strict=True))) == len(set(got.tolist())) == len(set(want))
    rank = gray_index.gray_rank(np.arange(64, dtype=np.uint64))
    order = np.arange(64)[np.argsort(rank)]
    assert all((int(a) ^ int(b)).bit_count() == 1 for a, b in zip(order, order[1:], strict=False))


@pytest.mark.parametrize("words", [1, 8])
def test_gray_index_keeps_keys_apart(words):
    rng = np.random.default_rng(words)
    base = rng.integers(0, 2**64, (9, words), np.uint64)
    values = base[rng.integers(0, 9, 900)]
    for _ in range(4):
        values[:, rng.integers(words)] ^= np.where(rng.random(900) < 0.5, np.uint64(1) << rng.integers(0, 64, 900, np.uint64), np.uint64(0))
    keys, counts = np.sort(rng.integers(0, 12, 900)), Counter()
    got, _, _ = gray_index.forest(values, (3,), keys, counts)
    for key in range(12):
        at = np.flatnonzero(keys == key)
        whole = [sum(int(w) << 64 * k for k, w in enumerate(row)) for row in values[at]]
        want = brute.wide_components(at.tolist(), whole, 3)
        assert len(set(zip(got[at].tolist(), want, strict=True))) == len(set(got[at].tolist())) == len(set(want))
    # most pairs of nodes within keys were never brought down to single values
    assert 0 < counts["links"] and counts[0] < sum(n * (n - 1) // 2 for n in np.bincount(keys))


def test_every_link_comes_from_the_gray_index(spark):
    """At sf0.1 the keys of the query, searched by the index alone, give all links."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    prints = simhash.fingerprints(docs).select(F.col("print").alias("node"), "print").distinct()
    values = np.array([r.node for r in prints.collect()])
    dealt = simhash.deal_blocks(4)(prints, len(values)).toPandas().sort_values("key")
    counts = Counter()
    a, b = simhash.edges_of(dealt["key"].to_numpy(), dealt["node"].to_numpy(), dealt["print"].to_numpy().view(np.uint64).reshape(-1, 1), (4,), counts)
    at = {int(v): i for i, v in enumerate(values)}
    labels = gray_index.join_labels(len(values), np.array([at[x] for x in a.tolist()]), np.array([at[x] for x in b.tolist()]))
    assert labels.tolist() == brute.components(list(range(len(values))), values.view(np.uint64).tolist())
    assert counts["links"] >= len(a) > 0 and counts[2] > 0  # three levels of nodes were used


def test_similar_texts_are_linked_and_others_not(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts, pairs = [], []
    for _ in range(150):
        words = [word() for _ in range(200)]
        changed = list(words)
        for i in rng.sample(range(200), rng.randint(1, 14)):
            changed[i] = word()
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(changed)]
    likeness = [len(brute.shingles(texts[a]) & brute.shingles(texts[b])) / len(brute.shingles(texts[a]) | brute.shingles(texts[b])) for a, b in pairs]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert all(a in kept for a, _ in pairs)
    above = [b not in kept for (_, b), j in zip(pairs, likeness, strict=True) if j >= 0.8]
    below = [b not in kept for (_, b), j in zip(pairs, likeness, strict=True) if j < 0.8]
    assert len(above) > 20 and np.mean(above) > 0.9 and len(below) > 20 and not any(below)


def test_weak_links_do_not_join_groups(spark):
    """A chain of similar texts is one group; a text that is only nearly similar to two
    groups joins neither, though its print is close to both."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    words, chain = [word() for _ in range(300)], []
    for k in range(12):
        chain.append(" ".join(words))
        words[k * 20 : k * 20 + 12] = [word() for _ in range(12)]
    base = [word() for _ in range(400)]
    change = lambda places: " ".join(word() if i in places else w for i, w in enumerate(base))
    star = [change(set(rng.sample(range(400), 7))) for _ in range(25)] + [" ".join(base)]  # alike through the base alone
    far = [change(set(rng.sample(range(400), 14))) for _ in range(6)]
    docs = list(enumerate(chain + star + far))
    sets = [brute.shingles(t) for _, t in docs]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert alike(0, 1) >= 0.8 > alike(0, 11) and all(alike(i, 37) >= 0.8 for i in range(12, 37)) and max(alike(i, 37) for i in range(38, 44)) < 0.8
    kept = sorted(tuple(r) for r in simhash.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert kept == brute.survivors(docs, simhash.reach(0.8)) and [d for d, _ in kept] == [0, 12, *range(38, 44)]


def test_no_similar_pair_is_left_out(spark):
    """Short texts whose prints differ by more than ``reach``, and a dense group of texts
    that are almost similar, where a forest gives nearer links that then fail."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = [" ".join(word() for _ in range(8)) for _ in range(40)]
    texts += [f"{t} {word()}" for t in texts]
    base = [word() for _ in range(300)]
    change = lambda of, n: [word() if i in places else w for places in [set(rng.sample(range(300), n))] for i, w in enumerate(of)]
    for _ in range(60):
        words = change(base, 9)
        texts += [" ".join(words), " ".join(change(words, 6))]
    docs = list(enumerate(texts))
    want = brute.survivors(docs, 64 * simhash.WIDE)
    assert len(want) < len(brute.survivors(docs, simhash.reach(0.8))) - 10 and all(d not in dict(want) for d in range(40, 80))
    assert sorted(map(tuple, simhash.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == want


def test_set_join_finds_every_crossing_pair(spark):
    rng = np.random.default_rng(12)
    pool = np.sort(rng.integers(0, 2**64, 4000, np.uint64))
    bases = [rng.choice(pool, n, replace=False) for n in (1, 4, 5, 30, 30, 200, 900)]
    sets = []
    for i in range(210):
        kept = bases[i % 7][rng.random(len(bases[i % 7])) < rng.choice([1.0, 0.97, 0.9, 0.8])]
        sets.append(np.unique(np.concatenate([kept, pool[rng.integers(0, 4000, rng.integers(0, 2 + len(kept) // 9))]])))
    sets.append(np.zeros(0, np.uint64))
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    roots = {i: i - i % 14 for i in range(0, 211, 3)}
    root = lambda i: roots.get(i, i)
    want = {(a, b) for a in range(210) for b in range(a) if root(a) != root(b) and len(sets[a]) and len(sets[b]) and alike(sets[a], sets[b])}
    assert len(want) > 500
    bitmaps = spark.createDataFrame([(i, len(s), set_join.bitmap(s).tobytes()) for i, s in enumerate(sets)], "node long, size long, bits binary")
    for common in (np.zeros(0, np.uint64), rng.permutation(np.concatenate(bases[2:5]))):
        prefixes = spark.createDataFrame([(i, set_join.packed(set_join.prefix(s, 0.8, common))) for i, s in enumerate(sets)], "node long, prefix binary")
        for hot, batch_rows in ((1 << 13, 1 << 14), (6, 10)):
            found = set_join.crossing_pairs(prefixes, spark.createDataFrame(list(roots.items()), "node long, root long"), bitmaps, 0.8, hot, batch_rows)
            got = [tuple(r) for r in found.collect()]
            assert want <= set(got) and len(got) == len(set(got)) and all(root(a) != root(b) for a, b in got)
    one = spark.createDataFrame([(0, bases[3][:8].tobytes()[: 5 * set_join.BYTES])], "node long, prefix binary")
    assert set_join.crossing_pairs(one, spark.createDataFrame([], "node long, root long"), bitmaps, 0.8) is None


def test_set_join_prefixes_and_bitmaps():
    e = np.arange(1, 11, dtype=np.uint64) * np.uint64(1 << 50)
    common = np.array([e[1], np.uint64(7), e[0]])
    assert set_join.prefix(e, 0.8, common[:0]).tolist() == e[:3].tolist() and set_join.prefix(e, 0.8, common).tolist() == e[2:5].tolist()
    assert set_join.prefix(e[:3], 0.1, common).tolist() == [e[2], e[1], e[0]] and len(set_join.prefix(e[:0], 0.8, common)) == 0
    assert set_join.unpacked(set_join.packed(e + np.uint64(5))).tolist() == [5] * 10
    other = np.concatenate([e[:6], e[:3] + np.uint64(1 << 44)])
    assert np.bitwise_count(set_join.bitmap(e) ^ set_join.bitmap(other)).sum() <= 7


def test_long_bitmaps_lose_no_similar_pair(spark):
    rng = np.random.default_rng(6)
    bases = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (1900, 2200, 3900, 4300, 9000)]
    sets = [b[rng.random(len(b)) < share] for b in bases for share in (1, 0.97, 0.93, 0.88, 0.82, 0.7, 0.5)]
    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    share = {(a, b): alike(sets[a], sets[b]) for a in range(35) for b in range(a)}
    bitmaps = spark.createDataFrame([(i, len(s), set_join.long_bitmap(s)) for i, s in enumerate(sets)], "node long, size long, long binary")
    got = {tuple(r) for r in set_join.still_close(spark.createDataFrame(list(share), "a long, b long"), bitmaps, 0.8).collect()}
    short = {i for i, s in enumerate(sets) if len(s) <= set_join.BITS}
    assert {p for p, x in share.items() if x >= 0.8 or short & set(p)} <= got
    assert not {p for p, x in share.items() if x < 0.6 and not short & set(p)} & got
    widths = {len(set_join.long_bitmap(sets[i])) for p in got - {p for p in got if short & set(p)} for i in p}
    assert len(short) > 5 and len(widths) > 2
    assert set_join.still_close(spark.createDataFrame([], "a long, b long"), bitmaps, 0.8).count() == 0


def test_sets_of_long_unlike_texts_are_not_compared(spark, monkeypatch):
    """Long texts that share a passage fill a small bitmap, so that it tells none of them apart."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = []
    for _ in range(4):
        passage = [word() for _ in range(1500)]
        texts += [" ".join(passage + [word() for _ in range(4500)]) for _ in range(3)]
    near = texts[0].split()
    near[3000:3040] = [word() for _ in range(40)]
    docs, compared, verified = list(enumerate([*texts, " ".join(near)])), [], simhash.verified

    def counted(edges, *args):
        compared.append(edges.count())
        return verified(edges, *args)

    monkeypatch.setattr(simhash, "verified", counted)
    kept = sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert kept == list(range(12)) and len(compared) == 2 and sum(compared) <= 3


def test_clean_carries_the_text_once(spark, monkeypatch):
    rows = [(1, "one two three", 7), (2, None, 8), (3, "a plain text", 9), (None, "four FIVE", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, n long")
    items = spark.createDataFrame([("x", "two three"), ("y", "four five")], "item_id string, text string")
    seen, search = [], decontaminate._search

    def counted(docs, *args):
        seen.append([t for _, t in docs.dtypes].count("string"))
        return search(docs, *args)

    monkeypatch.setattr(decontaminate, "_search", counted)
    for blocks in (20_000, 1):
        out = decontaminate.clean(docs, items, block_items=blocks)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows[1:3]
    assert seen == [1] * 4


def test_few_keys_are_broadcast_and_more_are_not(spark):
    rows, keys = spark.range(1000).toDF("k"), spark.range(10).toDF("k")
    for how, want in (("left_semi", 10), ("left_anti", 990)):
        for most, broadcast in ((10, True), (9, False)):
            joined = rows.join(_shared.broadcast_few(keys, most), "k", how)
            hinted = "strategy=broadcast" in joined._jdf.queryExecution().logical().toString()
            assert hinted == broadcast and joined.count() == want


def test_forests_connect_and_have_no_cycles():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, (30, 8), np.uint64)
    values = base[rng.integers(0, 30, 1200)]
    for _ in range(40):
        values[:, rng.integers(8)] ^= np.where(rng.random(1200) < 0.5, np.uint64(1) << rng.integers(0, 64, 1200, np.uint64), np.uint64(0))
    keys = rng.integers(0, 5, 1200)
    labels, a, b = gray_index.forest(values, (10, 20, 30), keys)
    diff = np.bitwise_count(values[a] ^ values[b]).sum(1)
    assert len(a) == 1200 - len(set(labels.tolist())) and (diff <= 30).all() and (keys[a] == keys[b]).all()
    again = gray_index.join_labels(1200, a, b)
    assert len(set(zip(again.tolist(), labels.tolist(), strict=True))) == len(set(labels.tolist()))
    # the forest is one of least differences, by levels: what 10 bits connect, its links of 10 bits connect
    for most in (10, 20):
        inner = gray_index.join_labels(1200, a[diff <= most], b[diff <= most])
        want = gray_index.components(values, most, keys)
        assert len(set(zip(inner.tolist(), want.tolist(), strict=True))) == len(set(want.tolist())) == len(set(inner.tolist()))


def test_keys_grow_with_the_corpus():
    for n in (10**3, 10**6, 10**9):
        widths = simhash.block_plan(n, 4)
        assert sum(widths) == 64 and n >> sum(sorted(widths)[: len(widths) - 4]) <= simhash.ROWS
        bits, tables = simhash.table_plan(n, 0.8)
        assert n / 2**bits <= simhash.ROWS and (1 - (1 - simhash.differing_share(0.8)) ** bits) ** tables <= simhash.MISS
    # tables grow like the fourth root of the number of prints
    assert simhash.table_plan(10**9, 0.8)[1] < 6 * simhash.table_plan(10**6, 0.8)[1]


def test_hot_keys_are_searched_in_parts(spark):
    rng = np.random.default_rng(3)
    base = np.uint64(0xABCDEF0123456789)
    near = np.array([base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(64) for b in range(a)])
    values = np.unique(np.concatenate([near[rng.permutation(len(near))[:600]], rng.integers(0, 2**64, 300, np.uint64)])).view(np.int64)
    prints = spark.createDataFrame([(int(v), int(v)) for v in values], "node long, print long")
    want = brute.components(list(range(len(values))), values.view(np.uint64).tolist())
    for hot in (1 << 18, 50):
        found = simhash.links(prints, (4,), hot=hot).collect()
        at = {int(v): i for i, v in enumerate(values)}
        labels = gray_index.join_labels(len(values), np.array([at[r.a] for r in found]), np.array([at[r.b] for r in found]))
        assert labels.tolist() == want


def test_connect_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000)]
    got = {r.node: r.root for r in simhash.connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(301))


def test_deduplicate_keeps_one_of_repeated_rows(spark):
    rows = [(1, "one two three four five six", "a"), (1, "one two three four five six", "b"), (2, "one two three four five six", "c"), (None, "one two three four five six", "d"), (9, "quite another text with other words", "e")]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, _gone string")).collect()
    assert sorted(r.doc_id for r in out) == [1, 9]


def test_deduplicate_keeps_one_row_of_each_component(spark):
    rng = random.Random(3)
    a, b, c, d, e, f = (" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(6))
    near = f.rsplit(" ", 1)[0] + " other"
    assert 0 < (simhash.fingerprint(f) ^ simhash.fingerprint(near)).bit_count() <= 4
    assert 0 < (brute.wide_fingerprint(f) ^ brute.wide_fingerprint(near)).bit_count() <= simhash.reach(0.8)
    rows = [(None, a), (1, a), (None, b), (None, c), (None, c), (5, d), (5, e), (3, e), (7, c[:200]), (7, b[:200]), (9, near), (None, f)]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, a), (None, b), (None, c), (5, d), (3, e), (7, c[:200]), (7, b[:200]), (9, near)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is null").collect()
    assert sorted(str(r.component_id) for r in found) == ["1", "9", "None", "None", "None"]


def test_fingerprints_of_odd_texts():
    for text in (None, "", "  \t", "a", "A b", "é É x y z", "w " * 70_000, "x y " * 40_000 + "end"):
        assert simhash.fingerprint(text) == brute.fingerprint(text)
        assert int.from_bytes(simhash.wide_fingerprint(text).tobytes(), "little") == brute.wide_fingerprint(text)


def test_wu_manber_blocks_agree(spark):
    docs = [(i, " ".join(random.Random(i).choices("abcdef", k=200))) for i in range(12)] + [(99, None)]
    items = [(f"i{k}", " ".join(random.Random(100 + k).choices("abcdef", k=k % 12))) for k in range(40)]
    want = brute.contamination(docs, items, window=4)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    spans = None
    for block in (1000, 15, 3):
        rows = decontaminate.contamination(*frames, window=4, block_items=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want
        spans = spans or {r.doc_id: r.spans for r in rows}
        assert {r.doc_id: r.spans for r in rows} == spans
    # texts are written once, whatever the number of blocks
    plan = decontaminate.contamination(*frames, window=4, block_items=3)._jdf.queryExecution().toString()
    assert plan.count("_text") and "hits-" in plan


def test_one_planted_item_removes_a_document(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    items = [(f"i{k}", text(20 if k else 5)) for k in range(6)]
    clean = [(i, text(80)) for i in range(12)] + [(50, None), (51, ""), (52, items[1][1].rsplit(" ", 13)[0])]
    planted = [(100 + k, f"{text(30)}, {t.upper()}! {text(30)}") for k, (_, t) in enumerate(items)]
    planted += [(200, " ".join(items[3][1].split()[4:12]))]  # a single window
    frames = spark.createDataFrame(clean + planted, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(*frames).collect()) == sorted(i for i, _ in clean)
    assert decontaminate.clean(*frames, min_items=2).count() == len(clean + planted)


def test_scratch_lies_on_the_shared_file_system(spark, monkeypatch):
    from isopleth.llm import _shared

    said = {"spark.checkpoint.dir": "/checkpoints"}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: said.get(key, default))
    assert _shared.scratch(spark, "x").startswith("file:///checkpoints/x-")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    default = hadoop.get("fs.defaultFS")
    try:
        hadoop.set("fs.defaultFS", "nowhere://host/")
        with pytest.raises(Exception, match="nowhere"):
            _shared.scratch(spark, "x")  # asks the default file system, not the local one
    finally:
        hadoop.set("fs.defaultFS", default)
    said.clear()
    monkeypatch.setattr(_shared, "_LOCAL", {})
    monkeypatch.setattr(type(spark.sparkContext), "master", "spark://elsewhere:7077", raising=False)
    monkeypatch.setitem(spark.sparkContext.__dict__, "master", "spark://elsewhere:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.scratch(spark, "x")
    assert token_files.arrow_uri("s3a://b/k") == "s3://b/k" and token_files.arrow_uri("hdfs://h/k") == "hdfs://h/k"


def test_costs_match_plain_kneser_ney():
    texts = [("p", "the cat sat on the mat the end"), ("q", "un chat noir et un chien blanc"), ("p", "that then")]
    model, order, d = language_id.fit(texts), language_id.ORDER, language_id.DISCOUNT
    counts = defaultdict(Counter)
    for lang, text in texts:
        counts[lang].update(text.split())
    letters = {c for w in counts.values() for x in w for c in x}
    plain = {lang: brute.PlainKneserNey([t for k, t in texts if k == lang], order, d, len(letters)) for lang in counts}

    for word in ("the", "chat", "zebra", "x", "cattle"):
        row = model.costs([word])[0]
        for i, lang in enumerate(model.languages):
            nats = plain[lang].entropy(word) * (len(word) + 1)
            assert abs(row[i] - nats) < 1e-3
        assert row[-1] == len(word) + 1


def test_rejection_of_other_scripts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scorer = language_id.Scorer(language_id.train(docs))
    assert scorer.predict(["ዘመን ተለዋዋጭ ነው ሰላም ለሁሉም ይሁን"])[0][3]
    assert scorer.predict(["zxqj qzxv jjxq wqzx vvkq zzxj"])[0][3]


def test_forest_costs_order_the_search():
    x = np.random.default_rng(0).standard_normal((900, 12))
    forest = rp_forest.fit(x, 3, 5)
    cost = rp_forest.leaf_costs(forest, x[:5])
    for c, reached in zip(cost, forest.search(x[:5], 40), strict=True):
        seen = [c[t, leaf] for t, leaf in reached]
        assert np.allclose(seen, np.sort(c.ravel())[:40])
    of = forest.route(x[:5])
    assert all(cost[i, t, of[t, i]] == 0 for i in range(5) for t in range(3))


def test_few_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (3, [2.0, 2.0]), (100, [4.0, 4.0]), (4, [1.0])]
    got = rp_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [(1, 100, 0.0), (2, 3, 1.0), (3, 100, math.sqrt(13))]


def degenerate(kind: str) -> np.ndarray:
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 6))
    if kind == "offset with ties":
        return 1e7 + np.round(x)
    if kind == "outliers":
        x[:40] *= 1e6
    if kind == "overflow":
        x *= 1e200
    if kind == "one direction":
        x = np.outer(rng.integers(0, 400, 2000), np.ones(6)) + 1
    if kind == "one dense leaf":
        x[:1800] = 5 + 1e-9 * x[:1800]
    return x


@pytest.mark.parametrize("kind", ["offset with ties", "outliers", "overflow", "one direction", "one dense leaf"])
@pytest.mark.parametrize("bucket_rows", [20_000, 50])
def test_degenerate_vectors(spark, kind, bucket_rows):
    x = degenerate(kind)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in rp_forest.nearest(frame, bucket_rows=bucket_rows, leaf_rows=16).collect():
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    with np.errstate(over="ignore"):
        want = {q: np.sort(np.sqrt(((np.delete(x, q, 0) - x[q]) ** 2).sum(1)))[:10] for q in range(0, 2000, 100)}
    assert sorted(got) == sorted(want)
    hits = 0
    for q, near in want.items():
        found = sorted(got[q])
        assert [n for n, _, _ in found] == list(range(1, 11)) and len({i for *_, i in found} - {q}) == 10
        hits += sum(s <= near[-1] for _, s, _ in found)
    assert hits >= 0.9 * 200


def test_a_query_goes_on_until_it_has_enough_candidates():
    x = np.random.default_rng(1).standard_normal((640, 5))
    forest = rp_forest.fit(x, 2, 6)
    counts = np.stack([np.bincount(leaf, minlength=64) for leaf in forest.route(x)])
    for reached in forest.search(x[:20], 1, counts, 35):
        held = [sum(counts[t, leaf] for t, leaf in reached if t == tree) for tree in range(2)]
        before = [sum(counts[t, leaf] for t, leaf in reached[:-1] if t == tree) for tree in range(2)]
        assert max(held) >= 35 > max(before)
    assert all(len(r) == 128 for r in forest.search(x[:3], 1, counts, 10**6))


def test_buckets_hold_leaves_and_large_leaves_are_cut():
    counts = np.array([[5, 5, 0, 95, 7, 30], [1, 1, 1, 1, 1, 1]])
    base, parts, n = rp_forest.bucket_plan(counts, 10)
    assert parts.tolist() == [[1, 1, 1, 10, 1, 3], [1] * 6]
    held = Counter()
    for t in range(2):
        for leaf in range(6):
            for part in range(parts[t, leaf]):
                held[base[t, leaf] + part] += counts[t, leaf] / parts[t, leaf]
    assert max(held.values()) <= 10 and max(held) < n
    assert not set(base[0].tolist()) & set(base[1].tolist())


def test_temporal_join_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.com", "x.a.com", "b.org", "deep.x.a.com"]
    captures = [(i, f"http://{rng.choice(hosts)}/p/{rng.randint(0, 3)}", date(2024, 1, 1) + timedelta(rng.randint(0, 300))) for i in range(300)]
    captures += [(900, None, date(2024, 5, 1)), (901, "http://a.com/", None), (902, "junk", date(2024, 5, 1))]
    keys = ["d:a.com", "d:x.a.com", "d:org", "u:b.org/p", "u:b.org/p/2", None]
    entries = [(rng.choice(keys), rng.choice(["add", "remove"]), date(2023, 12, 1) + timedelta(rng.randint(0, 300))) for _ in range(120)] + [("d:b.org", "add", None)]

    def active(day):
        out = {}
        for key in filter(None, keys):
            events = sorted({(d, a == "add") for k, a, d in entries if k == key and d})
            on = since = None
            for d in sorted({d for d, _ in events if d <= day}):
                now = all(a for e, a in events if e == d)
                if now and not on:
                    since = d
                on = now
            if on:
                out[key] = since
        return out

    frame = spark.createDataFrame([(*c, c[0]) for c in captures], "id long, url string, fetched_on date, matched long")
    listed = spark.createDataFrame(entries, "key string, action string, day date")
    for few, size in ((50_000, 1 << 24), (0, 1 << 24), (50_000, 10)):
        got = {r.id: r for r in url_filter.filter_urls(frame, listed, broadcast_keys=few, broadcast_bytes=size).collect()}
        assert len(got) == len(captures)
        for i, url, day in captures:
            if not url or not day or "://" not in url:
                assert (got[i].blocked, got[i].n_active) == (False, 0)
                continue
            host, _, path = url.removeprefix("http://").partition("/")
            parts, labels = [p for p in path.split("/") if p], host.split(".")
            mine = {f"d:{'.'.join(labels[k:])}" for k in range(len(labels))} | {f"u:{host}/{'/'.join(parts[: k + 1])}" for k in range(len(parts))}
            hits = {k: s for k, s in active(day).items() if k in mine}
            assert got[i].n_active == len(hits) and got[i].blocked == bool(hits)
            if hits:
                best = max(hits, key=lambda k: (len(k), k))
                assert (got[i].matched, got[i].listed_since) == (best, hits[best])


HOSTS = {
    "http://user:pw@evil.com/a": "evil.com", "http://a@b@EVIL.com:80/": "evil.com", "https://evil.com.:443/x": "evil.com", "http://[::1]:8080/p": "[::1]", "http://u@[2001:DB8::ff.1]/": "[2001:db8::ff.1]",
    "http://evil.com?x@y": "evil.com", "http://evil.com/@other": "evil.com", "ftp://..": "", "http://": "", "mailto:a@evil.com": "", "http://a.b#@c.d": "a.b",
}


def test_hosts_cannot_hide(spark):
    rows = spark.createDataFrame([(u,) for u in HOSTS], "url string").select("url", url_filter.host_of(F.col("url")).alias("host"), url_filter.keys_of(F.col("url")).alias("keys")).collect()
    assert {r.url: r.host for r in rows} == HOSTS
    keys = {r.url: r["keys"] for r in rows}
    assert keys["http://user:pw@evil.com/a"] == ["d:com", "d:evil.com", "u:evil.com/a"] and keys["http://[::1]:8080/p"] == ["d:[::1]", "u:[::1]/p"] and keys["ftp://.."] is None
    listed = spark.createDataFrame([("d:evil.com", "add", date(2024, 1, 1))], "key string, action string, day date")
    frame = spark.createDataFrame([(u, date(2024, 2, 1)) for u in HOSTS], "url string, fetched_on date")
    assert {r.url for r in url_filter.filter_urls(frame, listed).collect() if r.blocked} == {u for u, h in HOSTS.items() if h == "evil.com"}


def test_very_long_urls(spark):
    urls = ["http://a.com/" + "s/" * 60_000, "http://" + "x." * 60_000 + "a.com/p/q/r", "http://a.com/p/q/r/" + "y" * 200_000]
    frame = spark.createDataFrame([(i, u, date(2024, 2, 1)) for i, u in enumerate(urls)], "id long, url string, fetched_on date")
    listed = spark.createDataFrame([("u:a.com/s/s", "add", date(2024, 1, 1)), ("u:a.com/p/q/r", "add", date(2024, 1, 1)), ("d:x.a.com", "add", date(2024, 1, 2))], "key string, action string, day date")
    got = {r.id: (r.matched, r.n_active) for r in url_filter.filter_urls(frame, listed).collect()}
    assert got == {0: ("u:a.com/s/s", 1), 1: ("d:x.a.com", 1), 2: ("u:a.com/p/q/r", 1)}
    assert {r.blocked for r in url_filter.filter_urls(frame, listed.limit(0)).collect()} == {False}


def test_salvage(spark):
    pages = [(i, f"http://h/{i}", ("body %d " % i) * 200 if i % 3 else "same " * 400) for i in range(30)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(frame).first().path
    data = bytearray(token_files.get_file(path))
    whole = warc.read_archive(bytes(data))
    assert len(whole.records) == 30 and not whole.gaps
    starts = [at for at, _ in whole.records]
    data[starts[4] + 40] ^= 0xFF  # a damaged member
    cut = bytes(data[: starts[10]]) + b"junk between" + bytes(data[starts[10] : starts[20]]) + bytes(data[starts[21] - 5 :])
    found = warc.read_archive(cut)
    ids = {warc.page_of(r.headers["WARC-Record-ID"]) for _, r in found.records}
    order = [warc.page_of(r.headers["WARC-Record-ID"]) for _, r in whole.records]
    assert ids == set(order) - {order[4], order[20]}
    covered = sum(b - a for a, b, _ in found.gaps)
    assert len(found.gaps) == 3 and covered == (starts[5] - starts[4]) + len(b"junk between") + 5
    # records without compression, with a bad length in the middle
    plain = [warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": warc.page_uri(k)}, b"x" * k) for k in (5, 6, 7)]
    broken = plain[0] + plain[1].replace(b"Content-Length: 6", b"Content-Length: 99999") + plain[2]
    found = warc.read_archive(broken)
    assert [warc.page_of(r.headers["WARC-Record-ID"]) for _, r in found.records] == [5, 7]
    assert found.gaps[0][:2] == (len(plain[0]), len(plain[0]) + len(plain[1]) + 4)
    folder = warc.make_folder, path.rsplit("/", 1)[0]
    token_files.put_file(f"{folder[1]}/cut.warc.gz", cut)
    manifest = spark.createDataFrame([(f"{folder[1]}/cut.warc.gz",)], "path string")
    assert warc.read_gaps(manifest).count() == 3
    rows = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert all(rows[i].html == dict((p, h) for p, _, h in pages)[i] for i in rows if rows[i].record_type == "response")


def _found(data: bytes) -> list[str]:
    return [r.headers["WARC-Record-ID"] for _, r in warc.read_archive(data).records]


def _plain_record(name: str, block: bytes = b"some text", **more: str) -> bytes:
    return warc.record_bytes({"WARC-Type": "resource", "WARC-Record-ID": name, **{k.replace("_", "-"): v for k, v in more.items()}}, block)


def test_members_of_several_records_keep_the_valid_ones():
    three = [_plain_record(n, n.encode() * 50) for n in "abc"]
    broken = three[1].replace(b"b" * 50, b"b" * 49 + b"x")
    whole = gzip.compress(three[0] + broken + three[2])
    found = warc.read_archive(whole + gzip.compress(_plain_record("d")))
    assert [r.headers["WARC-Record-ID"] for _, r in found.records] == ["a", "c", "d"]
    assert found.gaps == [(0, len(whole), "block digest differs")]
    # a member that breaks off keeps what came before
    long = gzip.compress(b"".join(_plain_record(n, random.Random(n).randbytes(9000)) for n in "efg"))
    found = warc.read_archive(long[: len(long) - 5000] + gzip.compress(_plain_record("h")))
    assert [r.headers["WARC-Record-ID"] for _, r in found.records] == ["e", "f", "h"]
    assert found.gaps[0][:2] == (0, len(long) - 5000)


def test_headers_in_any_case_and_folded():
    record = _plain_record("a").replace(b"WARC-Record-ID", b"warc-record-id").replace(b"Content-Length", b"content-length").replace(b"WARC-Type: resource", b"WARC-Type:\r\n resource")
    found = warc.read_archive(record)
    assert found.records[0][1].headers["WARC-Type"] == "resource" and not found.gaps
    for length in (b"-1", b"1_0", "٣".encode(), b""):
        assert not _found(record.replace(b"content-length: 9", b"content-length: " + length))


def test_digests_by_their_algorithm():
    block = b"some text"
    sha256, sha1, md5 = (hashlib.new(n, block).digest() for n in ("sha256", "sha1", "md5"))
    good = ["sha256:" + sha256.hex(), "SHA-256:" + base64.b32encode(sha256).decode(), "sha1:" + sha1.hex(), "md5:" + md5.hex(), "sha256:" + base64.b64encode(sha256).decode(), "blake9:what", "none"]
    bad = ["sha256:" + sha1.hex(), "sha1:" + sha1.hex()[:-1] + "g", "md5:"]
    for digests, count in ((good, 1), (bad, 0)):
        for digest in digests:
            record = re.sub(rb"WARC-Block-Digest: [^\r]*", b"WARC-Block-Digest: " + digest.encode(), _plain_record("a", block))
            assert len(_found(record)) == count, digest


def test_records_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>body"
    records = [
        warc.record_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:1>"}, b"software: x"),
        warc.record_bytes({"WARC-Type": "request", "WARC-Record-ID": "<urn:uuid:2>", "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n"),
        warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:6c2ea2f7-0000-4000-8000-000000000001>", "WARC-Target-URI": "http://a/", "Content-Type": "application/http"}, http),
        warc.record_bytes({"WARC-Type": "revisit", "WARC-Record-ID": "odd"}, b""),
        warc.record_bytes({"WARC-Type": "resource", "WARC-Record-ID": warc.page_uri(7), "WARC-Payload-Digest": "md5:" + hashlib.md5(b"zz").hexdigest()}, b"zz"),
        warc.record_bytes({"WARC-Type": "resource", "WARC-Record-ID": warc.page_uri(8), "WARC-Payload-Digest": "md5:" + hashlib.md5(b"other").hexdigest()}, b"zz"),
        warc.record_bytes({}, b"no type"),
    ]
    path = f"{tmp_path}/other.warc"
    token_files.put_file(path, b"".join(records))
    manifest = spark.createDataFrame([(path,)], "path string")
    rows = [(r.record_type, r.page_id, r.payload_bytes, r.html) for r in warc.read_archives(manifest).collect()]
    assert rows == [("response", None, 7, "<p>body"), ("revisit", None, None, None), ("resource", 7, 2, "zz")]
    at = sum(map(len, records[:5]))
    assert [tuple(r)[1:] for r in warc.read_gaps(manifest).collect()] == [(at, at + len(records[5]), "payload digest differs")]


def test_prefix_table_is_kept(spark):
    docs = spark.createDataFrame([(1, "Hello there, world"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in token_counts.store(docs, queries.WORD_BPE).collect()}
    assert token_counts.unpack(rows[1].steps, 18).tolist() == [len(brute.encode("word_bpe_49k.json", "Hello there, world"[:i])) for i in range(19)]
    assert rows[2].n_chars == 0


def test_nothing_reads_columns_it_does_not_need(spark):
    plan = token_files.ordered(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_skewed_lookup(spark):
    from isopleth.llm._shared import lookup_skewed, materialize

    left = spark.range(5000).withColumn("key", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id") % 50))
    right = materialize(left.where("key is not null").groupBy("key").agg(F.count("*").alias("w"), F.max("id").alias("top")), "right")
    got = lookup_skewed(left, right, "key", "w", hot=10)
    want = left.join(right.drop("w"), "key", "left").select(*got.columns)
    assert got.count() == 5000 and not got.exceptAll(want).take(1)


def test_languages_of_short_or_long_texts_are_learned(spark):
    rng = random.Random(4)
    letters = {"long": "abcdef", "mid": "ghijkl", "short": "mnopqr"}
    text = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(n))
    rows = [(i * 3 + j, text(lang, n), lang) for i in range(30) for j, (lang, n) in enumerate((("long", 4000), ("mid", 100), ("short", 12)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == ["long", "mid", "short"]
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()} == {i: lang for i, _, lang in rows}
    for lang in ("long", "short"):
        some = docs.where(F.col("lang") == lang)
        assert language_id.keep_identified(some, language_id.train(some)).count() == 30
