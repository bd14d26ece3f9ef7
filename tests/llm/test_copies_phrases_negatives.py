"""Exact duplicates, phrase mining and hard negatives against brute force."""

import collections
import hashlib
import itertools
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import SCHEMA, awkward
from threadloom.llm import exact_dedup, hard_negatives, phrase_mining, topk_search

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# --- 11: exact duplicates --------------------------------------------------------------------------------

def brute_copies(rows):
    """(doc_id, keep_id, group_size, kept, digest) of (doc_id, text) rows, sorted."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()].append(i)
    out = []
    for h, ids in groups.items():
        ids.sort(key=lambda i: (i is None, 0 if i is None else -i))
        out += [(i, ids[0], len(ids), k == 0, h) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def copies(df, **options):
    return sorted((tuple(r) for r in exact_dedup.mark_copies(df, **options).select(exact_dedup.COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("counters", [None, 4])
def test_copies_awkward(spark, counters):
    rows = awkward() + [(50 + k, "Äpfel ÄPFEL", None, 0.1, "y", k) for k in range(3)] + [(60, "äpfel äpfel", None, 0.1, "y", 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert copies(df, counters=counters) == brute_copies([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("counters", [3, 16])
def test_copies_with_hot_groups(spark, counters):
    """One text fills a third of the rows, others are frequent, most are alone; the split changes nothing."""
    rng = random.Random(counters)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice([f"warm {i % 7}", f"alone {i}", f"Pair {i // 2}"])) for i in range(1200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert copies(df, counters=counters) == brute_copies(rows)


def test_frequent_digests_have_all_heavy_ones_and_a_bound(spark):
    rows = [(b"h" if i % 4 == 0 else b"w%d" % (i % 30) if i % 2 else b"x%d" % i,) for i in range(3000)]
    df = spark.createDataFrame(rows, "digest binary").repartition(9)
    found = {bytes(r.digest) for r in exact_dedup.frequent_digests(df, 20).collect()}
    true = collections.Counter(r[0] for r in rows)
    assert {d for d, n in true.items() if n > 2 * len(rows) / 20} <= found and len(found) < 20


def test_summary_falls_short_by_its_bound_only():
    rng = np.random.default_rng(1)
    keys = rng.zipf(1.3, 20_000) % 500
    summary = exact_dedup.MisraGries(30)
    for part in np.array_split(keys, 40):
        summary.add(pa.array([b"%d" % k for k in part], pa.binary()))
    held = dict(zip(summary.held["digest"].to_pylist(), summary.held["n"].to_pylist()))
    assert len(held) <= 30
    for k, n in collections.Counter(keys.tolist()).items():
        assert n - len(keys) / 31 <= held.get(b"%d" % k, 0) <= n


def test_distinct_documents_keep_their_columns(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = exact_dedup.distinct_documents(df)
    assert got.columns == df.columns
    want = [(r[0], r[4]) for r in brute_copies([(r[0], r[1]) for r in rows]) if r[3]]
    have = [(r.doc_id, hashlib.sha256((r.text or "").translate(FOLD).encode()).hexdigest()) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_copies_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.mark_copies(empty).count() == 0 and exact_dedup.distinct_documents(empty).count() == 0


# --- 12: phrases -----------------------------------------------------------------------------------------

def brute_phrases(rows, longest, least, top):
    """The definition with Python integers and strings; rows of (text, lang)."""
    count, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und" if lang is None else lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    count["und" if lang is None else lang, tuple(words[i:i + k])] += 1
    found = {g: a for g, a in count.items() if len(g[1]) > 1 and a >= least}
    inside = collections.Counter()
    for (lang, g), a in found.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                inside[lang, g[i:i + k]] = max(inside[lang, g[i:i + k]], a)
    rows = []
    for (lang, g), a in found.items():
        if 100 * inside[lang, g] >= 100 * a:
            continue
        score, _, l, r = min((1000 * a * total[lang] // (count[lang, g[:k]] * count[lang, g[k:]]), k, count[lang, g[:k]], count[lang, g[k:]])
                             for k in range(1, len(g)))
        rows.append((lang, " ".join(g), a, l, r, total[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, k + 1, *r[1:]) for k, r in enumerate(best)]
    return sorted(out)


def mined(df, *options):
    return sorted(tuple(r) for r in phrase_mining.mine_phrases(df, *options).collect())


@pytest.mark.parametrize("longest,least,top", [(5, 4, 2000), (3, 2, 7), (2, 3, 2000), (7, 6, 50)])
def test_phrases_random(spark, longest, least, top):
    rng = random.Random(longest)
    vocabulary = ["the", "The", "of", "new", "York", "stock", "exchange", "é", "ÉTÉ", "été", "no-break space", "a b", "x", "y"]
    weights = [9, 3, 8, 5, 5, 3, 3, 1, 1, 1, 1, 1, 2, 2]
    texts = [("".join(w + rng.choice([" "] * 8 + ["\t", ", ", ".", "\n", "  ", " ;", "\x0b", "\x1c"]) for w in rng.choices(vocabulary, weights, k=rng.randrange(60))),
              rng.choice(["en", "fr", None, "und", "en"])) for _ in range(120)]
    texts += [("new York stock exchange. " * 30, "en"), (None, "en"), ("", None), (" \t\n", "xx"), ("a a a a a a a", "fr")] * 2
    df = spark.createDataFrame([(t, la, 1, "p") for t, la in texts], "text string, lang string, n int, phrase string").repartition(4)
    assert mined(df, longest, least, top) == brute_phrases(texts, longest, least, top)


def test_phrases_survive_bursts_and_spills(spark, monkeypatch):
    """A tiny trie bursts and spills all the time; counts stay the same."""
    rng = random.Random(9)
    texts = [(" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(200))), "en") for _ in range(60)]
    df = spark.createDataFrame(texts, "text string, lang string").repartition(2)
    held = phrase_mining.name_filter(df.limit(0).selectExpr("0L AS name"))
    assert not phrase_mining.read_filter(held).holds(np.array([5], np.uint64)).any()
    runs = phrase_mining.count_phrases(df, phrase_mining.same_piece, 2, 4, 3, 5, entries=50)
    got = {(r["size"], bytes(r["key"])): r["f"] for r in runs.collect()}
    count = collections.Counter(g for t, _ in texts for w in [t.split()] for k in (2, 3, 4) for i in range(len(w) - k + 1) for g in [tuple(w[i:i + k])])
    assert sorted(got.values()) == sorted(n for n in count.values() if n >= 3)
    assert collections.Counter(k for k, _ in got) == collections.Counter(len(g) for g, n in count.items() if n >= 3)


def test_trie_against_a_counter():
    rng = random.Random(2)
    trie, want, got = phrase_mining.HatTrie(burst=6), collections.Counter(), collections.Counter()
    for _ in range(60):
        batch = collections.Counter(b"".join(rng.randrange(1, 9).to_bytes(8, "big") for _ in range(4)) for _ in range(50))
        trie.add(list(batch), list(batch.values()))
        want.update(batch)
        assert trie.size == sum(trie.under.values())
        if trie.size > 120:
            run = list(trie.spill(40))
            assert [k for k, _ in run] == sorted(k for k, _ in run) and trie.size <= 40
            for k, n in run:
                got[k] += n
    for k, n in trie.spill(0):
        got[k] += n
    assert got == want and trie.size == 0


def test_filter_has_no_false_negatives(spark):
    names = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 5000)
    held = phrase_mining.name_filter(spark.createDataFrame([(int(n),) for n in names], "name long"))
    bits = phrase_mining.read_filter(held)
    assert bits.holds(names.view(np.uint64)).all()
    assert bits.holds(np.random.default_rng(4).integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.05
    small = phrase_mining.name_filter(spark.createDataFrame([(int(n),) for n in names], "name long"), most_bits=1 << 16)
    assert phrase_mining.read_filter(small).holds(names.view(np.uint64)).all()


def test_phrases_of_nothing(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(None, None), ("one", "en")], "text string, lang string"), 5, 1) == []


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 64 bits; the division is exact all the same."""
    row = spark.sql("SELECT div(CAST(1000 AS DECIMAL(4,0)) * (CAST(987654321987 AS DECIMAL(19,0)) * CAST(1234567890123456 AS DECIMAL(19,0))), "
                    "CAST(999999999989 AS DECIMAL(19,0)) * CAST(987654321999 AS DECIMAL(19,0))) AS s").first()
    assert row.s == 1000 * 987654321987 * 1234567890123456 // (999999999989 * 987654321999)


# --- 13: hard negatives ----------------------------------------------------------------------------------

def brute_negatives(rows, n_positives=5, n_negatives=3, low=50, high=95):
    """rows of (id, label, vector, is_anchor)."""
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None]
    dot = lambda a, b: max(-hard_negatives.LIMIT, min(hard_negatives.LIMIT, sum(x * y for x, y in zip(a, b))))
    out = []
    for a, anchor in enumerate(ok):
        if not anchor[3]:
            continue
        scored = sorted(((-dot(anchor[2], r[2]), r[0], r[1]) for k, r in enumerate(ok) if k != a), key=lambda s: s[:2])
        for s, pid, _ in [s for s in scored if s[2] == anchor[1]][:n_positives]:
            near = [t for t in scored if t[2] != anchor[1] and low * -s <= 100 * -t[0] <= high * -s][:n_negatives]
            out += [(anchor[0], pid, k + 1, t[1], -s, -t[0]) for k, t in enumerate(near)]
    return sorted(out)


VECTORS = "id long, label int, vector array<bigint>, is_anchor boolean"


def mined_negatives(spark, rows, parts=4, **options):
    df = spark.createDataFrame(rows, VECTORS).repartition(parts).withColumn("rank", F.lit("x"))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, **options).collect())


@pytest.mark.parametrize("seed", range(3))
def test_negatives_random(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 37)
    monkeypatch.setattr(hard_negatives, "TILE", 16)
    centres = rng.normal(0, 40, (5, 12))
    rows = []
    for i in range(260):
        label = int(rng.integers(0, 5)) if rng.random() < 0.7 else 2  # one label is hot
        v = centres[label if rng.random() < 0.7 else int(rng.integers(0, 5))] + rng.normal(0, 25 if seed else 1, 12)
        rows.append((i, label, np.floor(v).astype(int).tolist(), i % 7 == 0))
    assert mined_negatives(spark, rows) == brute_negatives(rows)
    assert mined_negatives(spark, rows, n_positives=2, n_negatives=1, low=20, high=100) == brute_negatives(rows, 2, 1, 20, 100)


def test_negatives_awkward(spark):
    """Nulls, no length, short vectors, ties, repeated rows and ids, huge components, labels with one row."""
    rng = np.random.default_rng(8)
    v = lambda: rng.integers(-9, 9, 6).tolist()
    rows = [(i, i % 3, v(), i % 5 == 0) for i in range(40)]
    rows += [(0, 0, rows[0][2], True), (0, 0, rows[0][2], True), (None, 1, v(), True), (41, None, v(), True), (42, 1, None, True),
             (43, 1, [0] * 6, True), (44, 2, [0] * 6, True), (45, 2, [5, 5], True), (46, 7, v(), True), (47, 1, [], True), (48, 0, v(), None),
             (49, 0, [1 << 40, -(1 << 41)], True), (50, 1, [1 << 40, -(1 << 41)], False), (51, 0, [(1 << 63) - 1] * 6, True),
             (52, 0, [(1 << 63) - 1] * 6, False), (53, 2, [1 << 62] * 6, True), (-5, 2, rows[7][2], True), (7, 2, rows[7][2], False)]
    assert mined_negatives(spark, rows) == brute_negatives(rows)


def test_negatives_of_nothing(spark):
    assert mined_negatives(spark, []) == []
    assert mined_negatives(spark, [(1, 1, [1, 2], False), (2, 1, [1, 2], None)]) == []
    assert mined_negatives(spark, [(1, 1, [1, 2], True)]) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (4, 16))
    x = np.floor(centres[rng.integers(0, 4, 400)] + rng.normal(0, 10, (400, 16))).astype(np.int64)
    references = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    angles, lengths = hard_negatives.angles_to(x, references)
    low, high = hard_negatives.score_bounds(angles, lengths, angles, lengths)
    exact = hard_negatives.products(x, x)
    assert (low <= exact).all() and (exact <= high).all()
    fifth = -np.sort(-exact, axis=1)[:, 5]
    assert (high >= fifth[:, None]).mean() < 0.6  # the rest is never scored


def test_query_vectors_are_quantised_as_stated(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan"), 1.0],), (None,), ([1e30, -1e30],)], "e array<double>")
    got = [r.v for r in df.select(topk_search.quantised(F.col("e")).alias("v")).collect()]
    assert got == [[128, -1], None, None, [(1 << 63) - 1, -(1 << 63)]]
