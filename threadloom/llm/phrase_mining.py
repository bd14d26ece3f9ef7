"""Phrases of several words that occur more often than chance: exact counts in burst tries.

Words are named by 64-bit ids that also carry the language. A task keeps a shallow trie over word ids
whose leaves are hash containers; a container that grows too large bursts into a node by its next word.
A full trie spills whole subtrees as sorted runs, dealt out by the prefix that every phrase of
interest has, and a merge of the runs of a prefix partition has the exact count of each phrase in it.

A phrase is frequent only if its parts are, so three passes suffice: words, pairs of frequent words,
and windows of frequent pairs up to the full length. What is frequent travels as a bit filter of
bounded size; its false positives cost work and never change a count, and there are no false negatives.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.common import Rolling, kept, mix, partitions, slices
from threadloom.operators.ranking import with_group_position

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
CUT, BLANK = np.zeros(256, bool), np.zeros(256, bool)
CUT[[*b".,;:!?", *range(10, 14)]] = True
BLANK[[9, 32]] = True
WORD = 8  # bytes of a word id
ENTRIES = 600_000  # of a task's trie
BURST = 4096  # of a container
MOST_BITS = 1 << 28
WINDOWS = 2_000_000  # word positions of the corpus for one prefix partition
STEP = np.uint64(0x9E3779B97F4A7C15)


def name(ids: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row of word ids."""
    out = ids[:, 0]
    for column in ids.T[1:]:
        out = mix(out * STEP + column)
    return out


class Words:
    """The words of some texts: ids, piece of each word, and their bytes."""

    def __init__(self, texts: list[str | None], langs: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.data = b"\n".join(raw).translate(LOWER)
        data = np.frombuffer(self.data, np.uint8)
        cut = CUT[data]
        out = np.ones(len(data) + 2, bool)
        out[1:-1] = cut | BLANK[data]
        self.start = np.flatnonzero(out[:-1] & ~out[1:])
        self.end = np.flatnonzero(~out[:-1] & out[1:])
        self.piece = np.cumsum(cut, dtype=np.int64)[self.start] if len(data) else self.start
        self.langs = [x or "und" if x is None else x for x in langs]
        known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in set(self.langs)}
        salt = np.array([known[x] for x in self.langs], np.uint64)
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
        self.doc = np.searchsorted(begins, self.start, "right") - 1
        self.ids = mix(Rolling(self.data).span(self.start, self.end) ^ salt[self.doc]) if len(self.start) else np.zeros(0, np.uint64)
        self.ids[self.ids == 0] = 1  # 0 ends a shorter phrase


def windows(words: Words, link: np.ndarray, least: int, most: int) -> np.ndarray:
    """Rows of word ids from every word on, as far as links go, `most` words at most; zeros after the end."""
    n = len(words.ids)
    length = np.ones(n, np.int64)
    on = np.ones(n, bool)
    for k in range(1, min(most, n)):
        on[: n - k] &= link[k - 1: n - 1]
        on[n - k:] = False
        length += on
    at = np.flatnonzero(length >= least)
    rows = np.zeros((len(at), most), np.uint64)
    for k in range(most):
        has = length[at] > k
        rows[has, k] = words.ids[at[has] + k]
    return rows


class Container(dict):
    """Counts by the bytes of the remaining word ids."""


class Node(dict):
    """Children by word id."""


class HatTrie:
    """Counts of keys of word ids (big-endian, so runs sort by id)."""

    def __init__(self, burst: int = BURST):
        self.root, self.burst, self.size = Node(), burst, 0
        self.under: dict[bytes, int] = {}  # entries below each first word

    def add(self, keys: list[bytes], counts: list[int]) -> None:
        for key, n in zip(keys, counts):
            node, word, at = self.root, key[:WORD], WORD
            child = node.get(word)
            while type(child) is Node:
                node, word, at = child, key[at: at + WORD], at + WORD
                child = node.get(word)
            if child is None:
                child = node[word] = Container()
            rest = key[at:]
            if rest in child:
                child[rest] += n
                continue
            child[rest] = n
            self.size += 1
            self.under[key[:WORD]] = self.under.get(key[:WORD], 0) + 1
            if len(child) > self.burst and len(rest) > WORD:
                node[word] = self._burst(child)

    @staticmethod
    def _burst(full: Container) -> Node:
        node = Node()
        for rest, n in full.items():
            node.setdefault(rest[:WORD], Container())[rest[WORD:]] = n
        return node

    def _walk(self, prefix: bytes, child: dict) -> Iterator[tuple[bytes, int]]:
        for key in sorted(child):
            if type(child) is Node:
                yield from self._walk(prefix + key, child[key])
            else:
                yield prefix + key, child[key]

    def spill(self, leave: int) -> Iterator[tuple[bytes, int]]:
        """Take out whole subtrees, the largest first, until `leave` entries are left; one run, sorted by key."""
        gone = []
        for word in sorted(self.under, key=lambda w: (-self.under[w], w)):
            if self.size <= leave:
                break
            self.size -= self.under[word]
            gone.append(word)
        for word in sorted(gone):
            del self.under[word]
            yield from self._walk(word, self.root.pop(word))


def run_rows(run: Iterator[tuple[bytes, int]], width: int, prefix: int, parts: int) -> pa.RecordBatch:
    """A sorted run cut by prefix partition: (part, keys, counts)."""
    entries = list(run)
    keys = np.frombuffer(b"".join(k for k, _ in entries), ">u8").reshape(-1, width)
    counts = np.fromiter((n for _, n in entries), "<i8", len(entries))
    part = (name(keys[:, :prefix].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    found, starts = np.unique(part[order], return_index=True)
    split = np.split(order, starts[1:]) if len(found) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(found.astype(np.int32)), pa.array([keys[i].tobytes() for i in split], pa.binary()),
         pa.array([counts[i].tobytes() for i in split], pa.binary())], ["part", "keys", "counts"])


def merge_runs(keys: np.ndarray, counts: np.ndarray, shortest: int, least: int) -> pa.Table:
    """Phrases of at least `shortest` words with `least` occurrences: (size, key, f, name), from the runs of one partition."""
    order = np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    sums = np.concatenate([[0], np.cumsum(counts)])
    change = np.zeros(len(keys), bool)
    change[:1] = True
    out = []
    for k in range(keys.shape[1]):
        change[1:] |= keys[1:, k] != keys[:-1, k]
        if k + 1 < shortest:
            continue
        start = np.flatnonzero(change)
        f = sums[np.append(start[1:], len(keys))] - sums[start]
        good = (f >= least) & (keys[start, k] != 0)
        rows = keys[start[good], : k + 1]
        raw = np.ascontiguousarray(rows.astype(">u8")).view(f"V{WORD * (k + 1)}").ravel().tolist()
        out.append(pa.table({"size": pa.array(np.full(len(rows), k + 1, np.int32)), "key": pa.array(raw, pa.binary()),
                             "f": pa.array(f[good]), "name": pa.array(name(rows).view(np.int64) if len(rows) else np.zeros(0, np.int64))}))
    return pa.concat_tables(out)


class Filter:
    """Two bits per 64-bit name; no false negatives."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.mask = words, np.uint64(bits - 1)

    def holds(self, names: np.ndarray) -> np.ndarray:
        out = np.ones(len(names), bool)
        for shift in (0, 28):
            at = (names >> np.uint64(shift)) & self.mask
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def name_filter(names: DataFrame, most_bits: int = MOST_BITS):
    """A broadcast `Filter` of the `name` column: 16 bits a name, and never more than `most_bits` (32 MB).

    Bits are or-ed by 64-bit word before they meet, so a task of the last step reads 1 MB at most.
    """
    spark = names.sparkSession
    bits = 1 << 16
    rows = names.count()
    while bits < min(16 * rows, most_bits):
        bits *= 2
    spots = F.explode(F.array(*[F.shiftrightunsigned("name", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 28)]))
    filled = names.select(spots.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).withColumn("slice", F.shiftright("word", 17))

    def build(table: pa.Table) -> pa.Table:
        words = np.zeros(min(bits >> 6, 1 << 17), "<i8")
        words[table["word"].to_numpy() & ((1 << 17) - 1)] = table["bits"].to_numpy()
        return pa.table({"slice": table["slice"][:1], "raw": pa.array([words.tobytes()], pa.binary())})

    whole = np.zeros(bits >> 6, "<u8")
    for row in filled.groupBy("slice").applyInArrow(build, "slice long, raw binary").collect():  # 32 rows of 1 MB at most
        part = np.frombuffer(row["raw"], "<u8")
        whole[row["slice"] << 17: (row["slice"] << 17) + len(part)] = part
    return spark.sparkContext.broadcast((whole.tobytes(), bits))


def read_filter(held) -> Filter:
    raw, bits = held.value
    return Filter(np.frombuffer(raw, "<u8"), bits)


def count_words(texts: DataFrame) -> DataFrame:
    """(name, lang, word, f) of every word, and a row with a null word and each language's number of words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        spelled: dict[int, tuple[str, str]] = {}
        totals: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*spelled[i], i - (i >> 63 << 64), n) for i, n in held.items()]
            held.clear(), spelled.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))],
                ["lang", "word", "name", "f"])

        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(0).to_pylist(), part.column(1).to_pylist())
                ids, first, n = np.unique(w.ids, return_index=True, return_counts=True)
                for i, at, k in zip(ids.tolist(), first.tolist(), n.tolist()):
                    if i in held:
                        held[i] += k
                    else:
                        held[i] = k
                        spelled[i] = (w.langs[w.doc[at]], w.data[w.start[at]: w.end[at]].decode())
                for d, k in zip(*(x.tolist() for x in np.unique(w.doc, return_counts=True))):
                    totals[w.langs[d]] = totals.get(w.langs[d], 0) + k
                if len(held) > ENTRIES // 2:
                    yield flush()
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()),
                                          pa.array([0] * len(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())],
                                         ["lang", "word", "name", "f"])

    parts = texts.mapInArrow(count, "lang string, word string, name long, f long")
    return parts.groupBy("lang", "word", "name").agg(F.sum("f").alias("f"))


def count_phrases(texts: DataFrame, linked: Callable[[Words], np.ndarray], shortest: int, longest: int, least: int,
                  parts: int, entries: int = ENTRIES) -> DataFrame:
    """(size, key, f, name) of phrases with `least` occurrences; `linked` tells which words may go on to the next one."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie()
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(0).to_pylist(), part.column(1).to_pylist())
                if len(words.ids) < shortest:
                    continue
                rows = windows(words, linked(words), shortest, longest)
                if not len(rows):
                    continue
                _, first, n = np.unique(name(rows), return_index=True, return_counts=True)
                keys = np.ascontiguousarray(rows[first].astype(">u8")).view(f"V{WORD * longest}").ravel().tolist()
                trie.add(keys, n.tolist())
                if trie.size > entries:
                    yield run_rows(trie.spill(entries // 4), longest, shortest, parts)
        yield run_rows(trie.spill(0), longest, shortest, parts)

    def merge(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), ">u8").reshape(-1, longest).astype(np.uint64)
        return merge_runs(keys, np.frombuffer(b"".join(table["counts"].to_pylist()), "<i8"), shortest, least)

    runs = texts.mapInArrow(fill, "part int, keys binary, counts binary")
    return runs.groupBy("part").applyInArrow(merge, "size int, key binary, f long, name long")


def same_piece(words: Words) -> np.ndarray:
    return words.piece[1:] == words.piece[:-1]


def _words_between(key: Column, first: Column, count: Column) -> Column:
    return F.substring(key, first * WORD + 1, count * WORD)


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, text: str = "text", lang: str = "lang",
                     ) -> tuple[DataFrame, DataFrame]:
    """(key, lang, word, f, n) of the words and (size, key, f) of the phrases of 2 to `longest` words, with
    at least `least` occurrences; n is the number of all words of the language."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    seen = kept(count_words(texts).filter((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals = seen.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    key = F.unhex(F.lpad(F.hex("name"), 2 * WORD, "0"))
    words = kept(seen.filter("word IS NOT NULL").join(totals, "lang").select(key.alias("key"), "lang", "word", "f", "n", "name"), "frequent")
    every = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = int(max(2 * partitions(spark), every // WINDOWS))
    held = name_filter(words)

    def both_frequent(w: Words) -> np.ndarray:
        good = read_filter(held).holds(w.ids)
        return same_piece(w) & good[1:] & good[:-1]

    phrases = kept(count_phrases(texts, both_frequent, 2, 2, least, parts), "pairs")
    if longest > 2:
        pair_filter = name_filter(phrases)

        def frequent_pair(w: Words) -> np.ndarray:
            link = same_piece(w)
            at = np.flatnonzero(link)
            link[at] = read_filter(pair_filter).holds(name(np.column_stack([w.ids[at], w.ids[at + 1]])))
            return link

        phrases = phrases.unionByName(kept(count_phrases(texts, frequent_pair, 3, longest, least, parts), "longer"))
    return words, phrases.select("size", "key", "f")


def mine_phrases(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` best phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends and pieces into words at blanks and
    tabs. A phrase of 2 to `longest` words with a >= `least` occurrences scores floor(1000 a n / (l r)) at its worst
    cut, l and r being the counts of both parts and n all words of the language; of equal cuts the first
    counts. A phrase that only ever occurs inside one longer phrase is dropped. Order: score, a (both
    descending), phrase in UTF-8 byte order.

    A null or empty text has no words; a null language is `und`; repeated rows count as often as they are there; an
    empty table gives no rows; other columns are not read. Scores are exact while 1000 a n has at most 38 digits.
    """
    words, phrases = frequent_phrases(docs, longest, least, text, lang)
    phrases = kept(phrases.withColumnRenamed("f", "a"), "phrases")
    inner = F.explode(F.array(*[F.struct(_words_between(F.col("key"), F.lit(i), F.col("size") - 1).alias("key")) for i in (0, 1)]))
    longer = phrases.filter("size > 2").select(inner.alias("i"), "a").groupBy("i.key").agg(F.max("a").alias("within"))
    # a count equal to that of a phrase two words longer is also that of the one between, so one word more suffices
    free = kept(phrases.join(kept(longer, "longer"), "key", "left").filter("within IS NULL OR within < a").drop("within"), "free")

    at = free.select("key", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    spelled = at.withColumn("word_key", _words_between(F.col("key"), F.col("i"), F.lit(1))).join(
        words.select(F.col("key").alias("word_key"), "lang", "word", "n"), "word_key")
    named = spelled.groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.min("lang").alias("lang"), F.min("n").alias("n"))

    counts = kept(words.select("key", "f").unionByName(phrases.select("key", F.col("a").alias("f"))), "counts")
    cuts = free.select("key", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.withColumn("left", _words_between(F.col("key"), F.lit(0), F.col("k"))).withColumn(
        "right", _words_between(F.col("key"), F.col("k"), F.col("size") - F.col("k")))
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(
        counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    # a and n are the same for all cuts, so the lowest score has the largest product of l and r up to flooring
    each = kept(cuts.groupBy("key", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts")), "cuts")
    wide = lambda c: c.cast("decimal(19,0)")
    scored = named.join(each, "key").withColumn("best", F.array_min(F.transform("cuts", lambda c: F.struct(
        F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide(F.col("a")) * wide(F.col("n"))),
                        wide(c["l"]) * wide(c["r"])).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))))
    rows = scored.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    ranked = with_group_position(rows, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], "rank")
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrases_sql(longest: int = 5, least: int = 100, top: int = 2000) -> str:
    """The same in DuckDB's SQL, all phrases counted at once."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
o AS (SELECT lang, ws, i, unnest(range(1, least({longest}, len(ws) - i + 1) + 1)) AS k FROM s),
g AS (SELECT lang, k, ws[i:i + k - 1] AS g, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT lang, k AS size, g, f AS a FROM g WHERE k > 1),
inner_of AS (SELECT lang, g[1:size - 1] AS g, a FROM c UNION ALL SELECT lang, g[2:size], a FROM c),
free AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_of i WHERE i.lang = c.lang AND i.g = c.g AND i.a >= c.a)),
cuts AS (SELECT lang, g, a, size, unnest(range(1, size)) AS k FROM free),
scored AS (SELECT u.lang, u.g, u.a, u.k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * u.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts u JOIN totals t ON t.lang = u.lang JOIN g l ON l.lang = u.lang AND l.g = u.g[1:u.k]
  JOIN g r ON r.lang = u.lang AND r.g = u.g[u.k + 1:u.size]),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS nth FROM scored),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM worst WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {top}
"""
