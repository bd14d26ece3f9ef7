"""The training-data operators against brute force, on small tables and on awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from threadloom.llm import (backoff_lm, binary_tokens, decontam, host_graph, jaccard_join, language_id, packing,
                            queries, suffix_dedup, topk_search, warc)
from threadloom.llm.common import ChunkTokenizer, in_fold

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))  # about 300 kB


def numbered(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def awkward():
    """doc_id, text and clashing extra columns: nulls, blanks, very long texts, repeated rows, repeated ids."""
    rng = random.Random(3)
    base = numbered(rng, 300)
    words = base.split()
    words[150] = "changed"
    shared = numbered(rng, 120)
    texts = [(1, base), (2, base.upper()), (3, " ".join(words)), (4, None), (5, ""), (6, " \t\n "), (7, "Ünïcode ß Ñandú"),
             (8, LONG), (9, "one two"), (10, "ONE  two"), (11, shared + " " + numbered(rng, 60)),
             (12, numbered(rng, 60) + " " + shared), (13, "a" * 1500), (None, base), (None, None), (1, base), (9, numbered(rng, 50)),
             (-4, "😀 emoji " * 90), (14, "%%% 123 ,.;")]
    return [(i, t, "en" if k % 2 else None, 0.5, "x", k) for k, (i, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, score double, shard string, sequence_id int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


# --- 1: repeated strings ------------------------------------------------------------------------------

def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                gone[p:p + length] = True
        left = bytes(b for b, g in zip(d, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(d), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("length", [400, 60])
def test_repeats_awkward(spark, docs, length):
    rows = [r for r in awkward() if r[1] != LONG]
    some = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = suffix_dedup.remove_repeats(some, length, carry=("score", "shard", "sequence_id")).collect()
    want = sorted((r[5], *w) for r, w in zip(rows, brute_repeats([r[1] for r in rows], length)))
    assert sorted((r.sequence_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    for r in got:
        assert sum(s.length for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


@pytest.mark.parametrize("seed", range(4))
def test_repeats_random(spark, seed):
    """Pieces of all kinds of lengths around the limit, in poor and rich alphabets."""
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghijklmnop é"
    pool = ["".join(rng.choices(letters, k=rng.choice([20, 39, 40, 41, 60, 150]))) for _ in range(12)]
    texts = ["".join(rng.choice([rng.choice(pool), "".join(rng.choices(letters, k=rng.randrange(50)))]) for _ in range(rng.randrange(12)))
             for _ in range(40)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 40).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == list(brute_repeats(texts, 40))


def test_repeats_empty(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_transform_orders_suffixes():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 3, 60).astype(np.uint64)
    doc = np.repeat(np.arange(6), 10)
    gaps = np.where(np.append(doc[1:] != doc[:-1], True), 0, rng.integers(1, 3, 60))
    suffix, before, longer = suffix_dedup.transform(grams, gaps, doc)
    key = lambda i: [(int(grams[j]), int(gaps[j])) for j in range(i, min(i + 8, 10 * (doc[i] + 1)))]
    assert [key(i) for i in suffix] == sorted(map(key, range(60)))
    for row, i in enumerate(suffix):
        assert longer[row] == -1 if i % 10 == 0 else suffix[longer[row]] == i - 1


# --- 2: Jaccard join -------------------------------------------------------------------------------------

def brute_components(rows, k=4, percent=85):
    """(size, component) per row: exact sets, all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        ids = [x for x in (low.get(find(i)), d) if x is not None]
        low[find(i)] = min(ids) if ids else None
    return [(len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies(seed):
    """Families around the threshold: each member changes some words of another."""
    rng = random.Random(seed)
    rows = []
    for n in (3, 4, 5, 8, 20, 45, 46, 90, 300):
        members = [numbered(rng, n).split()]
        for _ in range(9):
            words = list(rng.choice(members))
            for _ in range(rng.choice([0, 1, 1, 2, max(1, n // 60)])):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[], ["new"], [words[at], "more"], [f"q{rng.randrange(99)}"]])
            members.append(words)
        rows += [" ".join(m) for m in members]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, each, block", [(0, 64, 2048), (1, 64, 2048), (1, 1, 2048), (2, 1, 4)])
def test_jaccard_near_copies(spark, seed, each, block):
    rows = near_copies(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join.linked_documents(frame, each=each, block=block).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_components(rows)


def test_jaccard_crowd_around_no_centre(spark):
    """A chain of copies, each linked to its neighbours only, and documents that share a passage but do not link."""
    rng = random.Random(5)
    words, rows = numbered(rng, 60).split(), []
    for i in range(90):
        words = list(words)
        words[(7 * i) % 60] = f"step{i}"
        rows.append(" ".join(words))
    passage = numbered(rng, 40)
    rows += [passage + " " + numbered(rng, 12 + i % 5) for i in range(80)]
    rows = list(enumerate(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent, each, block in ((85, 64, 2048), (60, 2, 8), (75, 1, 16)):
        got = jaccard_join.linked_documents(frame, 4, percent, each, block).orderBy("doc_id").collect()
        assert [(r.n_shingles, r.component_id) for r in got] == brute_components(rows, 4, percent)


def test_bitmap_bounds_hold():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 5, 40, 41, 300, 700, 710)]
    n, maps = np.array([len(x) for x in sets]), [jaccard_join.bitmap(x) for x in sets]
    bound = jaccard_join.most_shared_of_all(maps, maps, n, n)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            exact = len(np.intersect1d(x, y))
            single = min(jaccard_join.most_shared(maps[i], maps[j], n[i]), jaccard_join.most_shared(maps[j], maps[i], n[j]))
            assert exact <= bound[i, j] == single


def test_jaccard_awkward(docs, empty):
    rows = [(r[0], r[1]) for r in awkward()]
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.linked_documents(docs).collect()), key=key)
    assert got == sorted(((d, *c) for (d, _), c in zip(rows, brute_components(rows))), key=key)
    assert jaccard_join.linked_documents(empty).count() == 0


def test_jaccard_one_per_component(docs, empty):
    kept = jaccard_join.one_per_component(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and ids[9] == 2 and ids[None] == 1
    assert jaccard_join.one_per_component(empty).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5, 6, 7, 40, 333])
def test_entries_find_every_pair(size):
    """Two sets at the threshold always share an entry that one of them probes."""
    rng = np.random.default_rng(size)
    bands = jaccard_join.Bands(85)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2 ** 63, size, dtype=np.uint64))
        b = a
        for _ in range(size):  # random changes while the pair still links
            c = np.setdiff1d(b, rng.choice(b, 1)) if rng.random() < 0.5 and len(b) > 1 else np.union1d(b, rng.integers(0, 2 ** 63, 1, dtype=np.uint64))
            if 100 * len(np.intersect1d(a, c)) < 85 * len(np.union1d(a, c)):
                break
            b = c
        band = min(bands.of(len(a)), bands.of(len(b)))
        assert max(bands.of(len(a)), bands.of(len(b))) - band <= 1
        (ea, pa), (eb, pb) = (jaccard_join.entries(x, band, *bands.shape(band)) for x in (a, b))
        assert set(ea[pa]) & set(eb) or set(eb[pb]) & set(ea)


# --- 3, 9: tokens ------------------------------------------------------------------------------------------

def ids_of(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_encode_like_the_library(name):
    texts = ["a  b", " a", "a ", "a\n b", "a \nb", "don't 12.5 x,y... Σας ΣΑΣ İx ﬁ e\u0301 A\u030a", "<|endoftext|> x", "", "\u00a0 a\u2003b",
             "it's.'s &c ß straße", LONG[:5000], "日本語 テキスト", "a\x1cb \x1c c", "\u212b K ſ", "o\n\np", "x\r\ny"]
    rng = random.Random(5)
    texts += ["".join(rng.choices(" \n\tab'sé,.1Ñ&\u0301", k=40)) for _ in range(400)]
    chunks = ChunkTokenizer(public_tokenizers.path(name), limit=50)
    for a in range(0, len(texts), 7):
        for text, got in zip(texts[a:a + 7], chunks.encode(texts[a:a + 7])):
            assert list(got) == chunks.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_records_round_trip(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder, manifest = binary_tokens.write_records(docs, path, files=3)
    rows = sorted(((r[0], r[1]) for r in awkward()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = ids_of("word_bpe_49k.json", [t for _, t in rows])
    read = binary_tokens.read_records(spark, folder, rows_per_task=2).orderBy("part", "row").collect()
    assert [(r.doc_id, bytes(r.ids)) for r in read] == [(d, w.tobytes()) for (d, _), w in zip(rows, want)]
    start, expected = 0, []
    for (d, _), w in zip(rows, want):
        expected.append((d, start, len(w), zlib.crc32(w.tobytes())))
        start += len(w)
    got = binary_tokens.record_summary(spark, folder).orderBy("part", "row").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected
    folder, manifest = binary_tokens.write_records(empty, path)
    assert manifest.count() == 0 and binary_tokens.record_summary(spark, folder).count() == 0


def test_records_notice_damage():
    import io

    good = binary_tokens.frame(b"payload")
    assert binary_tokens.read_frame(io.BytesIO(good).read) == b"payload"
    for i in range(len(good)):
        with pytest.raises(ValueError):
            binary_tokens.read_frame(io.BytesIO(good[:i] + bytes([good[i] ^ 1]) + good[i + 1:]).read)
    with pytest.raises(ValueError):
        binary_tokens.read_frame(io.BytesIO(good[:-1]).read)


@pytest.mark.parametrize("seed", range(5))
def test_shortest_pack_first(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(30)}
    packs = packing.shortest_pack_first(counts, 64)
    used = collections.Counter()
    for lengths, n in packs:
        assert sum(lengths) <= 64 and n > 0
        used.update({length: n * c for length, c in collections.Counter(lengths).items()})
    assert used == counts
    # no two packs would fit into one
    open_packs = sorted(sum(p) for p, n in packs for _ in range(min(n, 2)))
    assert len(open_packs) < 2 or open_packs[0] + open_packs[1] > 64 or min(counts) > 64 - open_packs[0]


def check_packs(rows, ids, size):
    """Every id once, places gapless, checksums right. `ids` by (doc_id, crc of all ids) with its copies."""
    per = collections.defaultdict(list)
    for r in rows:
        per[r.sequence_id].append((r.offset, r.length))
    for pieces in per.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    got = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    want = collections.Counter((d, a, len(w[a:a + size]), zlib.crc32(w[a:a + size].tobytes()), len(w)) for d, w in ids for a in range(0, len(w), size))
    assert got == want
    assert sorted(per) == list(range(len(per)))


def test_packing_awkward(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(docs, path, 256, with_ids=True)
    rows = packed.collect()
    ids = list(zip([r[0] for r in awkward()], ids_of("byte_bpe_50k.json", [r[1] for r in awkward()])))
    check_packs(rows, ids, 256)
    for r in packing.sequences(packed, 256).collect():
        assert len(r.ids) == 4 * (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 256)
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_query(spark):
    rows = queries.QUERIES["op9_packing"](spark, SF).collect()
    texts = table("documents")
    check_packs(rows, list(zip([d[0] for d in texts], ids_of("byte_bpe_50k.json", [d[1] for d in texts]))), 2048)


# --- 4: language -------------------------------------------------------------------------------------------

def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_awkward(spark, docs, empty):
    net = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"), epochs=2)
    rows = {r.sequence_id: r for r in language_id.identify(docs, net).collect()}
    assert len(rows) == len(awkward())
    for row in awkward():
        letters = any(c.isalpha() for c in row[1] or "")
        got = rows[row[5]]
        assert (got.lang_pred == "und") == (not letters) and (got.score > 0) == letters
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.train(empty) is None and language_id.identify(empty, net).count() == 0


def test_language_many_copies(spark):
    """A text that fills most of the table takes no place of the other texts of its language."""
    n, i = 60_000, F.col("id")
    tables = [spark.range(n).select(F.lit("bb").alias("lang"), F.lit("zq zq zq").alias("text")),
              spark.range(300).select(F.lit("bb").alias("lang"), F.concat(F.lit("bcd bcd bcd "), i.cast("string")).alias("text")),
              spark.range(300).select(F.lit("aa").alias("lang"), F.concat(F.lit("eio eio eio "), i.cast("string")).alias("text")),
              spark.range(3).select(F.lit("cc").alias("lang"), F.concat(F.lit("uxu uxu "), i.cast("string")).alias("text"))]
    rows = tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])
    net = language_id.train(rows, per_language=20, epochs=20)
    assert net.languages == ["aa", "bb", "cc"]
    found = language_id.identify(tables[1].unionByName(tables[2]), net)
    assert found.filter("lang <> lang_pred").count() == 0
    chosen = language_id.sample(rows, 20, 100, 128, 6, 7).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in chosen} == {"aa": 20, "bb": 20, "cc": 3}


def test_language_whole_texts(spark):
    """Windows come from the whole text, not from its first 20,000 characters."""
    rows = spark.createDataFrame([("aa", "a" * 20_000 + "z" * 60_000)], "lang string, text string")
    windows = [bytes(r.windows) for r in language_id.sample(rows, 20, 100, 128, 60, 7).collect()]
    assert len(windows) == 1 and windows[0].count(b"z") > windows[0].count(b"a") > 0


def test_language_against_a_plain_forward_pass(spark, docs):
    """Every prediction by loops over bytes, filters and windows."""
    net = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"), epochs=1)
    filters, e, widest = net.kernel.shape[1], net.embed.shape[1], net.widest

    def forward(text):
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        data = text.lower().encode("utf-8", "replace")
        total = np.zeros(len(net.languages))
        for at in range(0, len(data), net.window):
            part = data[at: at + net.window]
            vectors = [net.embed[b].astype(float) for b in part.ljust(net.window, b"\0")] + [net.embed[0].astype(float)] * (widest - 1)
            hidden = [max(0.0, max(sum(float(vectors[p + k] @ net.kernel[k * e: (k + 1) * e, f]) for k in range(widest)) for p in range(net.window)) + net.bias[f])
                      for f in range(filters)]
            logits = np.array(hidden) @ net.out.astype(float) + net.out_bias
            p = np.exp(logits - logits.max())
            total += p / p.sum() * len(part)
        mean = total / len(data)
        return net.languages[int(mean.argmax())], float(mean.max())

    some = [r for r in awkward() if r[1] is None or len(r[1]) < 700]
    got = {r.sequence_id: (r.lang_pred, r.score) for r in language_id.identify(docs, net).collect()}
    for r in some:
        lang, score = forward(r[1])
        assert got[r[5]][0] == lang and abs(got[r[5]][1] - score) < 1e-4


def test_language_gradients():
    net = language_id.fit(["abc abd"] * 3 + ["xyz xyw"] * 3, ["a"] * 3 + ["x"] * 3, window=8, embedding=3, widths=(1, 2), filters=2, epochs=0)
    x, of, _ = language_id.windows_of(["abc abd", "xyz xyw"], 8)
    y, weight = np.array([0, 1]), np.ones(2, np.float32)

    def loss():
        return -np.log(net.probabilities(x).astype(float)[[0, 1], y]).mean()

    for name, gradient in language_id._gradients(net, x, y, weight).items():
        values = getattr(net, name)
        for at in itertools.islice(np.ndindex(values.shape), 0, values.size, max(1, values.size // 9)):
            if abs(gradient[at]) < 1e-4:
                continue
            old = values[at]
            values[at] = old + 1e-2
            up = loss()
            values[at] = old - 1e-2
            down = loss()
            values[at] = old
            assert (up - down) / 2e-2 == pytest.approx(gradient[at], rel=0.15, abs=2e-3)


# --- 5: language model ---------------------------------------------------------------------------------------

def brute_scores(rows, held, order, masses):
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b" end"] for _, t in rows]
    counts = [collections.Counter() for _ in range(order)]
    for t, h in zip(tokens, held):
        for n in range(order):
            if not h:
                counts[n].update(tuple(t[i:i + n + 1]) for i in range(len(t) - n))
    total, kinds = sum(counts[0].values()), len(counts[0])

    def p(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 1) / (total + kinds + 1)
        m = masses[len(gram) - 2]
        return (counts[len(gram) - 1][gram] + m * p(gram[1:])) / (counts[len(gram) - 2][gram[:-1]] + m)

    for t in tokens:
        base = sum(math.log10(p((w,))) for w in t)
        score = sum(math.log10(p(tuple(t[max(0, i - order + 1):i + 1]))) for i in range(len(t)))
        yield len(t), sum(counts[0][(w,)] > 0 for w in t), total, base, score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_awkward(spark, docs, order):
    rows = [(r[0], r[1]) for r in awkward() if r[1] != LONG]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = backoff_lm.score_texts(frame, in_fold(F.col("doc_id"), 7, 2), order, (50.0, 5.0)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:5], round(r[-1], 6))
    want = sorted([(d, h, *w) for (d, _), h, w in zip(rows, held, brute_scores(rows, held, order, (50.0, 5.0)))], key=key)
    for a, b in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-8)


@pytest.mark.parametrize("words", [4, 60])
def test_lm_a_shard_per_document(spark, words):
    """N-grams that one shard alone holds or learned, beside those that many share; copies; all counts are exact."""
    rng = np.random.default_rng(words)
    rows = [(i, " ".join(f"w{w}" for w in rng.integers(0, words, rng.integers(0, 12)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:10]]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = backoff_lm.score_texts(frame, in_fold(F.col("doc_id"), 7, 2), 3, (5.0, 2.0), shard_bytes=1).collect()
    want = {d: w for (d, _), w in zip(rows, brute_scores(rows, held, 3, (5.0, 2.0)))}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:5] == want[r.doc_id][:3] and tuple(r)[5:] == pytest.approx(want[r.doc_id][3:], abs=1e-8)


def test_lm_without_training(spark, docs, empty):
    got = backoff_lm.score_texts(docs.limit(5), F.lit(True)).collect()
    assert len(got) == 5 and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in got)
    assert backoff_lm.score_texts(empty, F.lit(False)).count() == 0


def test_lm_beats_base(spark):
    rows = queries.QUERIES["op5_lm_score"](spark, SF).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_query_order(spark):
    """The registered query scores with contexts of up to two words."""
    rows = [(d, t) for d, t, *_ in table("documents")]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    want = {d: w for (d, _), w in zip(rows, brute_scores(rows, held, 3, (200.0, 20.0)))}
    got = queries.QUERIES["op5_lm_score"](spark, SF).collect()
    assert len(got) == len(rows) and all(r.score == pytest.approx(want[r.doc_id][-1], abs=1e-6) for r in got)


def test_lm_small_shards(spark, docs):
    one, many = (backoff_lm.score_texts(docs, in_fold(F.col("doc_id"), 7, 2), 3, shard_bytes=n).collect() for n in (1 << 30, 5000))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:5], round(r[-1], 6))
    for a, b in zip(sorted(map(tuple, one), key=key), sorted(map(tuple, many), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-8)


# --- 6: top-k --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("scale", [256, 1 << 28])
def test_topk_against_brute_force(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(int(i), None if i == 7 else [float(x) if x > -2.5 else None for x in rng.normal(size=rng.choice([6, 9]))]) for i in range(120)]
    rows += [(50, [1.0] * 9), (50, [1.0] * 9), (3, [float("nan")] * 9), (4, [float("inf"), 1.0]), (None, [1.0] * 9), (5, []), (200, [0.25] * 9)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = topk_search.exact_top_k(frame.select("id", topk_search.quantised(F.col("embedding"), scale).alias("vector")), F.col("id") % 50 == 0, 5, size=16)
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, (i, v) in enumerate(usable):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(usable) if c != q)
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 5.0]), (3, [0.5, 0.5])], "id long, v array<double>").select(
        "id", topk_search.quantised(F.col("v")).alias("vector"))
    big = (1 << 63) - 1  # scores beyond 64 bits count as the largest number
    assert [tuple(r) for r in topk_search.exact_top_k(huge, F.col("id") == 0).orderBy("rank").collect()] == [(0, 1, 1, big), (0, 2, 3, big), (0, 3, 2, -big)]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, v array<double>").select("id", topk_search.quantised(F.col("v")).alias("vector"))
    assert [tuple(r) for r in topk_search.exact_top_k(few, F.col("id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk_search.exact_top_k(few.limit(0), F.col("id") % 50 == 0).count() == 0


# --- 7: urls -----------------------------------------------------------------------------------------------------

def link(*hosts):
    return "<p>" + "".join(f'<a href="https://{h}/x">t</a>' for h in hosts)


def test_urls(spark):
    pages = [(1, "HTTP://WWW.Example.COM/en/a?b", None), (2, "https://blog.example.com/en/", ""), (3, "http://a.net/es/1", link("hub.org")),
             (4, "http://mirror.org/", link("a.net", "A.net", "bad.net")), (5, "http://bad.net/fr/", link("bad.net")), (6, None, link("a.net")),
             (7, "no scheme", link("a.net")), (8, "x://far.org#frag", link("mirror.org")), (9, "http://hub.org?q=1", None),
             (10, "http://nocom/", None), (11, "http://com", None), (12, "ftp://shop.com/", link("far.org", "trusted.org")), (12, "ftp://shop.com/", None)]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, host string")
    got = sorted(tuple(r) for r in host_graph.judge_urls(frame, queries.URL_RULES).collect())
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(pages)
    assert by[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and by[2][2:] == ("example.com/en/", "block")
    assert by[3][2:] == ("net/es/", "block") and by[6] == ("", "", None, "allow") and by[7] == ("", "", None, "allow")
    assert by[8][0:2] == ("far.org", "") and by[10][2] is None and by[11][2] is None and by[12][2:] == ("com/", "allow")
    assert by[4][3] == "block"  # links to blocked hosts and nothing else speaks for it
    assert by[9][3] == "allow"  # a link from a blocked host is no fault of its own
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert sorted(con.execute(queries.ORACLES["op7_url_filter"]).fetchall(), key=str) == sorted(got, key=str)
    assert host_graph.judge_urls(frame.limit(0), queries.URL_RULES).count() == 0
    assert host_graph.judge_urls(frame, []).filter("rule is not null").count() == 0


def test_rank_sums(spark):
    """One round by hand: half of the spread mass goes to each of two links."""
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in host_graph.propagate(edges, seeds, 0.5, 1).collect()}
    assert got == {"a": (0.5, 0.25), "b": (0.125, 0.5), "c": (0.125, 0.0)}


# --- 8: WARC -----------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    big, accents = "x" * 1500, "é" * 500
    pages = [(1, "http://a/", big), (2, None, big), (3, "http://b/\r\nX: y", None), (4, "u", accents), (5, "u", accents + "\r\n\r\nWARC/1.1"),
             (6, "u", accents), (None, "u", big), (None, "u", "y" * 2000), (None, "v", "y" * 2000), (9, "u", "z" * 999), (10, "u", "z" * 999),
             (11, "u", big), (11, "u", big), (12, "u", LONG)]
    frame = spark.createDataFrame([(*p, 7) for p in pages], "page_id long, url string, html string, refers_to int").repartition(4)
    folder, manifest = warc.write_warc(warc.mark_revisits(frame), roll=3000, shards=3)
    got = warc.read_warc(spark, folder, payload=True).collect()
    assert sum(r.n_records for r in manifest.collect()) == len(pages) == len(got)
    assert all(r.n_bytes <= 3000 or r.n_records == 1 for r in manifest.collect())
    response = {big: 11, accents: 6, "y" * 2000: None}
    want = []
    for i, url, html in pages:
        data = (html or "").encode()
        to = response.get(html)
        revisit = to is not None and to != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None, None if revisit else data))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None)
                   for r in got), key=str) == sorted(want, key=str)
    again, _ = warc.write_warc(warc.mark_revisits(frame), roll=3000, shards=3)
    listed = lambda f: sorted((r.file, r.n_bytes, r.first_id, r.last_id) for r in spark.read.parquet(f"{f}/manifest.parquet").collect())
    assert listed(folder) == listed(again)
    other, _ = warc.write_warc(warc.mark_revisits(frame.repartition(7, "url")), roll=3000, shards=3)
    content = lambda f: {r.file: open(f"{f}/{r.file}".removeprefix("file:"), "rb").read() for r in spark.read.parquet(f"{f}/manifest.parquet").collect()}
    assert content(folder) == content(again) == content(other) and len(content(folder)) >= 3
    nothing, manifest = warc.write_warc(warc.mark_revisits(frame.limit(0)))
    assert manifest.count() == 0 and warc.read_warc(spark, nothing).count() == 0


def test_warc_shards_are_the_same_bytes_for_any_partitioning(spark):
    """A third of all rows share one id, with payloads of their own."""
    rows = [(i if i % 3 else 5, f"http://h{i % 9}/{i}", f"page {i} " * (i % 40)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    content = []
    for parts in (2, 9):
        folder, manifest = warc.write_warc(warc.mark_revisits(frame.repartition(parts)), shards=8)
        listed = manifest.collect()
        assert sum(r.n_records for r in listed) == 3000 and max(r.n_records for r in listed) <= 375  # the hot id is cut as well
        content.append({r.file: open(f"{folder}/{r.file}".removeprefix("file:"), "rb").read() for r in listed})
    assert content[0] == content[1]


# --- 10: decontamination -------------------------------------------------------------------------------------------

def plain_alignment(a, b):
    best, rows = 0, [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, rows[-1][j] + (1 if x == y else -1), rows[-1][j + 1] - 1, row[-1] - 1))
        rows.append(row)
        best = max(best, *row)
    return best


def test_alignment_scores():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randrange(2, 6) for _ in range(rng.randint(1, 9))] for _ in range(2))
        left, right = np.zeros((1, 12), np.uint64), np.ones((1, 12), np.uint64)
        left[0, :len(a)], right[0, :len(b)] = a, b
        score, first, last = (int(x[0]) for x in decontam.align(left, right))
        assert score == plain_alignment(a, b)
        if score:
            assert plain_alignment(a, b[first:last]) == score


def test_leaks(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["der", "wal", "im", "feld"]) + str(rng.randrange(400)) for _ in range(n))
    items = [(i, filler(40) + ".") for i in range(30)] + [(30, None), (31, ""), (32, "der"), (33, items_twin := filler(25)), (33, items_twin)]
    words = items[3][1].split()
    edited = list(words)
    for at in (4, 11, 19, 27, 33):
        edited[at] = "other"
    edited[21:21] = ["two", "more"]
    half = words[:12]
    texts = [(1, filler(500)), (2, filler(200) + " " + items[0][1].upper().replace(" ", ",\n") + " " + filler(50)),
             (3, filler(300) + " " + " ".join(edited) + " " + filler(30)), (4, " ".join(half) + " " + filler(200)), (5, None), (6, ""),
             (7, items[5][1]), (None, filler(20) + " " + items[6][1]), (7, items[5][1]), (8, LONG + " " + items[9][1]), (9, items_twin)]
    texts += [(100 + i, filler(30) + " " + items[12][1]) for i in range(60)]  # most documents hold the same item
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame([(*b, "x") for b in items], "item_id long, text string, doc_id string")
    got = decontam.find_leaks(docs, bench).collect()
    pairs = collections.Counter((r.doc_id, r.item_id) for r in got)
    assert pairs == collections.Counter({(2, 0): 1, (3, 3): 1, (7, 5): 2, (None, 6): 1, (8, 9): 1, (9, 33): 2, **{(100 + i, 12): 1 for i in range(60)}})
    assert {r.score for r in got if r.doc_id in (2, 7, 8)} == {1.0}
    blocks = decontam.find_leaks(docs, bench, block_words=200)
    assert collections.Counter((r.doc_id, r.item_id) for r in blocks.collect()) == pairs
    stay = decontam.clean_documents(docs, decontam.find_leaks(docs, bench))
    assert sorted(r.doc_id for r in stay.collect()) == [1, 4, 5, 6] and stay.columns == docs.columns
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0


def plain_words(text):
    return [data[a:b].decode() for _, start, end, data in [decontam.words_of(text)] for a, b in zip(start, end)]


def test_words_of_scripts():
    assert plain_words("\u201cDon\u2019t\u201d\u00a0stop\u2014now\u2026 \u00abÉté\u00bb e\u0301t 12") == ["don", "t", "stop", "now", "été", "e\u0301t", "12"]
    assert plain_words("我们，在ab家。日本のカ") == ["我", "们", "在", "ab", "家", "日", "本", "の", "カ"]
    assert plain_words("ที่นี่ x") == ["ที่", "นี่", "x"] and plain_words("привет, мир") == ["привет", "мир"]
    assert plain_words("") == plain_words("…\u3002") == [] and plain_words("a-b c") == ["a", "b", "c"]


@pytest.mark.parametrize("size, vocabulary, every", [(20, 300, 4), (20, 300, 5), (25, 5000, 4), (40, 120, 4), (14, 300, 5)])
def test_leaks_recall_against_all_alignments(spark, size, vocabulary, every):
    """Edited copies of items of common words: what is found against every document aligned with every item."""
    rng = np.random.default_rng(size + every)
    weights = 1 / np.arange(1, vocabulary + 1)
    draw = lambda n: [f"w{i}" for i in rng.choice(vocabulary, n, p=weights / weights.sum())]
    items = [draw(size) for _ in range(60)]
    texts = [draw(rng.integers(20, 120)) for _ in range(150)]
    for item in items:
        copy = [f"new{rng.integers(999)}" if k % every == every - 1 else w for k, w in enumerate(item)]
        texts.append(draw(30) + copy + draw(30))
    frames = (spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(x)], f"{n} long, text string") for x, n in ((texts, "doc_id"), (items, "item_id")))
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(*frames).collect()}
    word_ids = collections.defaultdict(lambda: len(word_ids) + 2)
    want, wide = set(), max(map(len, texts))
    right = np.ones((len(texts), wide), np.uint64)
    for d, t in enumerate(texts):
        right[d, : len(t)] = [word_ids[w] for w in t]
    for i, item in enumerate(items):
        left = np.tile(np.array([word_ids[w] for w in item], np.uint64), (len(texts), 1))
        score = decontam.align(left, right)[0]
        want |= {(int(d), i) for d in np.flatnonzero(score / size >= 0.4)}
    assert {(150 + i, i) for i in range(60)} <= want and got <= want
    assert len({(150 + i, i) for i in range(60)} & got) >= 57 and len(got) / len(want) >= 0.9


def test_leaks_typography(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join(f"feld{rng.randrange(900)}" for _ in range(n))
    chinese = lambda n: "".join(chr(0x4E00 + rng.randrange(1500)) for _ in range(n))
    plain = [f"it's {w}" if i % 3 == 0 else w for i, w in enumerate(filler(20).split())]
    items = [(1, " ".join(plain)), (2, chinese(30)), (3, filler(20))]
    texts = [(1, filler(90) + " " + "\u00a0".join(f"\u201c{w}\u201d,".replace("'", "\u2019") for w in plain) + " " + filler(40)),
             (2, chinese(300) + items[1][1] + chinese(200)), (3, chinese(500)), (4, filler(300)),
             (5, filler(50) + " \u00ab" + "\u2014".join(items[2][1].split()) + "\u00bb")]
    got = decontam.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(1, 1, 1.0), (2, 2, 1.0), (5, 3, 1.0)]


def test_leaks_common_words(spark):
    """Verbatim copies of items of common words are found, beside many other items or few."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(12)]
    filler = lambda n: " ".join(rng.choice(common) for _ in range(n))
    items = [(1, "c0 c1 c2 c3"), (2, "c4 c4 c4"), (3, " ".join(["c5", "c6"] * 10))]
    texts = [(1, "c7 c8 c0 c1 c2 c3 c9"), (2, "c8 c4 c4 c4 c9"), (3, "c9 " + items[2][1] + " c10")]
    texts += [(10 + i, filler(400)) for i in range(40)]
    want = {(d, i) for d, t in texts for i, words in items if f" {words} " in f" {t} "}
    assert want >= {(1, 1), (2, 2), (3, 3)}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for more in (0, 3000):
        bench = items + [(100 + i, f"rare{i} word{i} of{i} its{i} own{i}") for i in range(more)]
        got = decontam.find_leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in got if r.score == 1} == want


# --- the pipeline -----------------------------------------------------------------------------------------------------

def test_pipeline_against_brute_force(spark):
    """Stages with exact answers are compared one by one on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    for frame in kept[:-1]:
        assert frame.columns == corpus_pipeline.COLUMNS
    rows = [sorted((r.doc_id, r.text) for r in frame.collect()) for frame in kept[:-1]]
    assert rows[1] == rows[0]  # every given text has a language
    assert rows[2] == [r for r, (_, c) in zip(rows[1], brute_components(rows[1], 5, 80)) if r[0] == c]
    cut = {d: (n, sha) for (d, _), (_, n, _, sha) in zip(rows[2], brute_repeats([t for _, t in rows[2]], 400))}
    for d, t in rows[3]:
        assert cut[d][0] == 0 or t
        if t.isascii():
            assert hashlib.sha256(t.encode()).hexdigest() == cut[d][1]
    assert {d for d, _ in rows[2]} - {d for d, _ in rows[3]} <= {d for d, (n, _) in cut.items() if n}
    flat = lambda t: " ".join(re.findall(r"[\w]+", t.lower()))
    items = [flat(t) for _, t in table("benchmark")]
    holds = {d for d, t in rows[3] if any(i in flat(t) for i in items)}
    assert {d for d, _ in rows[4]} == {d for d, _ in rows[3]} - holds
    check_packs(kept[-1].collect(), list(zip([d for d, _ in rows[4]], ids_of("byte_bpe_50k.json", [t for _, t in rows[4]]))), 2048)


def test_pipeline_near_copies(spark):
    """Copies with a similarity of 0.80 to 0.85 on five words, by added and by replaced words."""
    rng = random.Random(11)
    rows = []
    for i, share in enumerate((0.18, 0.2, 0.22, 0.24, 0.3)):
        text = numbered(rng, 400)
        rows += [(10 * i, text), (10 * i + 1, text + " " + numbered(rng, int(400 * share)))]
    words = numbered(rng, 1000).split()
    rows.append((90, " ".join(words)))
    for at in range(20, 1000, 46):
        words[at] = "other"
    rows += [(91, " ".join(words)), (92, numbered(rng, 300))]
    want = [d for (d, _), (_, c) in zip(rows, brute_components(rows, 5, 80)) if d == c]
    assert want == [0, 10, 20, 30, 40, 41, 90, 92]
    frame = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, frame, SF).collect()) == want


def test_pipeline_awkward_tables(spark, docs, tmp_path):
    (tmp_path / "in").mkdir()
    frame = docs.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for name, rows in (("full", frame), ("none", frame.limit(0))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").limit(5 if name == "full" else 0).write.parquet(f"{folder}/benchmark.parquet")
        assert (corpus_pipeline.run(spark, folder).count() > 0) == (name == "full")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_have_rows(spark, name):
    assert len(queries.QUERIES[name](spark, SF).take(1)) == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_spelled_once_and_frequent_ones_stay(name):
    chunks = ChunkTokenizer(public_tokenizers.path(name), limit=60)
    spelled = []
    add = chunks._add_words
    chunks._add_words = lambda keys: (spelled.extend(keys), add(keys))
    texts = ["a ofte ofte, ofte. ofte;\nofte"]
    texts += [f"a ofte {' '.join(''.join(chr(97 + (i * 7 + j) % 26) for j in range(5)) for i in range(k, k + 25))} ofte," for k in range(0, 250, 25)]
    for text in texts:
        assert list(chunks.encode([text])[0]) == chunks.tokenizer.encode(text, add_special_tokens=False).ids
    lead = chunks.lead
    assert spelled.count("ofte") == 1 and spelled.count(lead + "ofte") == 1  # whatever marks follow, and when the cache was full
    assert len(chunks.index) < 120


def test_groups_of_the_join_carry_small_bitmaps(spark):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 30, 700, 5000)]
    for x in sets:
        few, bits = jaccard_join.bitmap(x, 1), jaccard_join.bitmap(x)
        assert len(few) <= max(8, len(x) // 4 + 1) and len(few) < max(9, len(bits))
        assert jaccard_join.folded([bits], len(few)).tobytes() == few
    rows = pa.table({"key1": np.arange(4), "n": [len(x) for x in sets], "few_bits": [jaccard_join.bitmap(x, 1) for x in sets]})
    members = pa.table({"entry": [1, 1, 1, 1], "key1": np.arange(4), "probes": [True] * 4, "component": np.arange(4)})
    out = jaccard_join.sieved(spark.createDataFrame(members), spark.createDataFrame(rows), 85, 0, 64, 768)  # needs no other bitmap
    assert out.filter("NOT more").count() == 0  # sizes rule out all pairs


def test_automaton_needs_few_bytes_a_token():
    words = np.append(np.random.default_rng(4).integers(1, 60_000, 200_000).astype(np.uint64), backoff_lm.END)
    tokens = backoff_lm.Tokens(words, np.array([len(words)]))
    counts = [np.unique(key[whole], return_counts=True)[1] for key, whole in backoff_lm.ngrams(tokens, 3)]
    tracemalloc.start()
    model = backoff_lm.Automaton(tokens, counts, [200.0, 20.0], len(words), len(counts[0]))
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 200 * len(words) and held < 75 * len(words), (peak / len(words), held / len(words))
    assert np.isfinite(model.score(tokens)).all()


def test_tiles_give_no_more_pairs_than_members(spark):
    """Sets that all may link, each a component of its own: a tile gives a forest of them, not all pairs."""
    pool = np.unique(np.random.default_rng(6).integers(0, 1 << 63, 420).astype(np.uint64))
    sets = [np.delete(pool, np.arange(i, i + 4)) for i in range(400)]
    rows = pa.table({"key1": np.arange(400), "n": [len(x) for x in sets], "few_bits": [jaccard_join.bitmap(x, 1) for x in sets],
                     "bits": [jaccard_join.bitmap(x) for x in sets]})
    members = pa.table({"entry": [1] * 400, "key1": np.arange(400), "probes": [True] * 400, "component": np.arange(400)})
    frames = spark.createDataFrame(members), spark.createDataFrame(rows)
    for step, pairs in ((0, 0), (1, 400), (2, 800)):  # small bitmaps leave all pairs: the group is looked at again with larger ones
        out = jaccard_join.sieved(*frames, 85, step, max(1, step), 768).toPandas()
        assert out.more.sum() == 1 and len(out) == pairs + 1
        found = out[~out.more].drop_duplicates(["a", "b"])
        assert len(found) == pairs and (not pairs or set(found.a) | set(found.b) == set(range(400)))


def test_forest_joins_what_its_edges_join():
    rng = np.random.default_rng(8)
    for n, m in ((2, 1), (5, 9), (60, 400), (300, 290)):
        one, two = rng.integers(0, n, (2, m))
        one, two = one[one != two], two[one != two]
        parent, want = list(range(n)), []

        def root(x):
            return x if parent[x] == x else root(parent[x])

        for x, y in zip(one.tolist(), two.tolist()):  # Kruskal
            want.append(root(x) != root(y))
            parent[root(x)] = root(y)
        assert jaccard_join.forest(one, two).tolist() == want

def test_long_documents_are_scored_in_pieces():
    """A piece starts in the state its document has there, and the longest document makes no step of its own."""
    rng = np.random.default_rng(9)
    length = np.array([3000, 1, 2, 700, 40, 513, 1])
    words = rng.zipf(1.5, length.sum()).astype(np.uint64)
    words[np.cumsum(length) - 1] = backoff_lm.END
    tokens = backoff_lm.Tokens(words, length)
    for order, masses in ((1, []), (2, [200.0]), (3, [200.0, 20.0])):
        learned = np.repeat(np.arange(len(length)) % 3 > 0, length)  # the first document is held out
        counts = [np.bincount(np.unique(key[whole], return_inverse=True)[1], learned[whole]).astype(np.int64)
                  for key, whole in backoff_lm.ngrams(tokens, order)]
        model = backoff_lm.Automaton(tokens, counts, masses, int(learned.sum()), len(counts[0]))
        whole = model.score(tokens, piece=1 << 20)
        for piece in (1, 2, 7, 512):
            assert np.allclose(model.score(tokens, piece), whole, rtol=1e-12)
