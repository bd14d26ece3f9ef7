"""Benchmark decontamination: rare word n-grams seed alignments of training passages with test items.

Words are runs of Unicode letters, marks and digits, lower-cased, so case and punctuation do not hide a
copy; in scripts without spaces between words every character is a word, with the marks after it. At
every place of an item the seed is the shortest n-gram that is rare: by the corpus frequencies of
its words, all seeds of the item are expected to meet a document by chance at most `chance` times. An
item without a rare n-gram has its longest n-grams, or all of its words, as seeds.
Word frequencies, unlike those of the n-gram itself, stay low when a passage leaked many times.
Every place where a seed occurs in a document gives a window around it, and Smith-Waterman on
words scores it: 1 a match, -1 a replaced, missing or extra word, divided by the item's words.

Items are handled in blocks of a bounded number of words; a block goes to the tasks, documents are
not shuffled, and a document meets every block.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm.common import Rolling, mix, ragged, released, slices

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True
#: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, Balinese, Javanese, Myanmar's extensions, kana, bopomofo, Han
_UNSPACED = ((0x0E00, 0x0F00), (0x0F00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x1AB0), (0x1B00, 0x1B80), (0xA980, 0xAA00),
             (0xAA60, 0xAAE0), (0x3005, 0x3008), (0x3040, 0x3130), (0x31A0, 0x31C0), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000),
             (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x1B000, 0x1B170), (0x20000, 0x32000))
_LETTER, _SINGLE, _MARK, _SINGLE_MARK = 1, 2, 3, 4
_STEP = np.uint64(0xA24BAED4963EE407)
_BITS = 23
RESULT = "doc_id long, item_id long, score double, alignment long, item_words long, start_word long, end_word long, passage string"


@cache
def kinds() -> np.ndarray:
    """By code point: 0 outside words, a letter or digit, one of a script without spaces, or a mark of either."""
    table = np.zeros(0x110000, np.uint8)
    of = {"L": _LETTER, "N": _LETTER, "M": _MARK}
    for first, past in ((0, 0xD800), (0xF900, 0x32000), (0xE0100, 0xE01F0)):  # no letters, marks or digits elsewhere
        table[first:past] = [of.get(unicodedata.category(chr(c))[0], 0) for c in range(first, past)]
    for first, past in _UNSPACED:
        part = table[first:past]
        table[first:past] = np.where(part == _LETTER, _SINGLE, np.where(part == _MARK, _SINGLE_MARK, 0))
    return table


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes, byte starts and byte ends of the words of a lower-cased text, and its bytes."""
    data = (text or "").lower().encode("utf-8", "replace")
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), data
    if data.isascii():
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _WORD[np.frombuffer(data, np.uint8)]
        start, end = np.flatnonzero(~inside[:-2] & inside[1:-1]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    else:
        code = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
        kind = np.zeros(len(code) + 2, np.uint8)
        kind[1:-1] = kinds()[code]
        before, own = kind[:-2], kind[1:-1]
        begins = np.append((own == _SINGLE) | ((own > 0) & (before == 0))
                           | ((own == _LETTER) & ((before == _SINGLE) | (before == _SINGLE_MARK))), True)
        at = np.zeros(len(code) + 1, np.int64)  # of each character, in bytes
        np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), out=at[1:])
        start, end = at[:-1][begins[:-1]], at[1:][(own > 0) & (begins[1:] | (kind[2:] == 0))]
    return Rolling(data).span(start, end), start, end, data


def gram_hashes(words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the n-grams by their first word) for n = 1 .. longest."""
    key = np.zeros(len(words), np.uint64)
    for n in range(1, min(longest, len(words)) + 1):
        key = mix(key[: len(words) - n + 1] * _STEP + words[n - 1:] + np.uint64(n))
        yield n, key


class Members:
    """A sorted set of hashes with a bitmap in front of it."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in `hashes`, their index among the keys) of those that are members."""
        at = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        index = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[index] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[hit], index[hit]


@dataclass
class Items:
    """The items of one block: words one after another, and the seeds with the places they stand for."""

    ids: list[int]
    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    seeds: Members
    seed_lengths: list[int]
    first: np.ndarray  # of each seed, in the arrays below
    count: np.ndarray
    item: np.ndarray
    place: np.ndarray
    pairs: Members  # short n-grams that count when two of an item lie on one diagonal
    pair_first: np.ndarray
    pair_count: np.ndarray
    pair_item: np.ndarray
    pair_place: np.ndarray
    pair_words: int


def _grouped(keys: np.ndarray) -> tuple[Members, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, and of each the first place and number in the sorted order, which comes last."""
    members, order = Members(keys), np.argsort(keys, kind="stable")
    first = np.searchsorted(keys[order], members.keys)
    return members, first, np.diff(np.append(first, len(keys))), order


def corpus_counts(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int, int]:
    """How often each of the given words occurs in all documents, all words, and all documents."""
    members = Members(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total, rows = np.zeros(len(members.keys), np.int64), 0, 0
        for batch in released(batches):
            for text in batch.column("text").to_pylist():
                hashes = words_of(text)[0]
                _, index = members.find(hashes)
                found += np.bincount(index, minlength=len(found))
                total += len(hashes)
                rows += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([rows, total, *found[some].tolist()], pa.int64())], ["word", "n"])

    counts = {r.word: r.n for r in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    result = np.zeros(len(members.keys), np.int64)
    for w, n in counts.items():
        if w >= 0:
            result[w] = n
    return result[np.searchsorted(members.keys, words)], counts.get(-1, 0), counts.get(-2, 0)


def choose_seeds(rows: list[tuple[int, str]], docs: DataFrame, shortest: int, longest: int, chance: float) -> Items | None:
    """The shortest rare n-gram at every place of every item, whatever the other items; the longest ones of an item
    without any.

    An item of common words has rare n-grams that are longer than what an edited copy leaves intact. If less than half of
    its places have a seed of `shortest` words, all its n-grams of that length are seeds too, in pairs: two
    of them must lie on one diagonal.
    """
    parts = [words_of(text)[0] for _, text in rows]
    length = np.array([len(p) for p in parts], np.int64)
    if not length.sum():
        return None
    words = np.concatenate(parts)
    start = np.cumsum(length) - length
    seen, total, n_docs = corpus_counts(docs, words)
    # expected number of chance meetings per document of an n-gram: words per document * product of frequencies
    log_p = np.log((seen + 1.0) / (total + 1.0))
    item = np.repeat(np.arange(len(rows)), length)
    limit = np.log(chance / length[item])
    place = np.arange(len(words)) - start[item]
    left = length[item] - place
    grams = dict(gram_hashes(words, longest))
    mean = np.log(max(1.0, total / max(1, n_docs)))
    expected, done = np.full(len(words), mean), np.zeros(len(words), bool)
    found: list[tuple[int, np.ndarray]] = []
    for n, key in grams.items():
        usable = left >= n
        expected[usable] += log_p[np.flatnonzero(usable) + n - 1]
        fit = usable & ~done & (n >= np.minimum(shortest, length[item])) & (expected <= limit)
        done |= fit
        at = np.flatnonzero(fit)
        if len(at):
            found.append((n, at))
    common = np.bincount(item[done], minlength=len(rows))[item] == 0
    most = np.minimum(longest, length[item])
    for n in grams:
        at = np.flatnonzero(common & (most == n) & (left >= n))
        if len(at):
            found.append((n, at))
    short = np.zeros(len(words), bool)
    for n, at in found:
        short[at] |= n <= shortest
    few = 2 * np.bincount(item[short], minlength=len(rows)) < length
    paired = np.flatnonzero((few & (length >= 2 * shortest))[item] & (left >= shortest)) if shortest in grams else np.zeros(0, np.int64)
    pairs, pair_first, pair_count, pair_order = _grouped(grams[shortest][paired] if len(paired) else np.zeros(0, np.uint64))
    keys = np.concatenate([grams[n][at] for n, at in found])
    at = np.concatenate([at for _, at in found])
    seeds, first, count, order = _grouped(keys)
    return Items([i for i, _ in rows], words, start, length, seeds, [n for n, _ in found], first, count, item[at[order]], place[at[order]],
                 pairs, pair_first, pair_count, item[paired[pair_order]], place[paired[pair_order]], shortest)


def on_one_diagonal(item: np.ndarray, begin: np.ndarray, place: np.ndarray, words: int) -> np.ndarray:
    """Which hits have another of their item, at another place, whose begin differs by two words at most (insertions
    and deletions in between): both then share a cell of one of two grids of width four."""
    good = np.zeros(len(item), bool)
    for shift in (0, 2):
        cell, part = (begin + shift) // 4, place // words
        order = np.lexsort((part, cell, item))
        i, c, p = item[order], cell[order], part[order]
        new = np.append(True, (i[1:] != i[:-1]) | (c[1:] != c[:-1]))
        group = np.cumsum(new) - 1
        other = np.append(False, (p[1:] != p[:-1]) & ~new[1:])
        good[order[(np.bincount(group, other) > 0)[group]]] = True
    return good


def align(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score, first and one past the last column, for each row of `items` against the same row of `texts`.

    Rows are padded with two values that never match. A cell holds score * 2**20 + its first column, so
    the path's start travels with the score; the running maximum resolves gaps inside a row.
    """
    one, (n, width) = np.int64(1 << 20), texts.shape
    columns = np.arange(width)
    slope = columns * one
    above = np.zeros((n, width + 1), np.int64) + np.arange(width + 1)
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        step = np.where(items[:, i: i + 1] == texts, one, -one)
        cell = np.maximum(above[:, :-1] + step, above[:, 1:] - one)
        cell = np.maximum(cell, columns)  # start anew
        cell = np.maximum.accumulate(cell + slope, axis=1) - slope
        cell = np.maximum(cell, columns + 1)
        top = cell.argmax(axis=1)
        value = cell[np.arange(n), top]
        better = (value >> 20) > (best >> 20)
        best[better], end[better] = value[better], top[better] + 1
        above[:, 1:] = cell
        above[:, 0] = 0
    return best >> 20, best & (one - 1), end


def windows(items: Items, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first, last) of the passages around seeds; overlapping ones of an item are joined up to
    three times its length."""
    at, which = [], []
    short, pair = np.zeros(0, np.int64), np.zeros(0, np.int64)
    wanted = set(items.seed_lengths)
    for n, key in gram_hashes(words, max(items.pair_words, *wanted)):
        if n == items.pair_words and len(items.pairs.keys):
            short, pair = items.pairs.find(key)
        if n in wanted:
            place, index = items.seeds.find(key)
            at.append(place)
            which.append(index)
    at, which = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, which))
    rows = ragged(items.first[which], items.count[which])
    item = items.item[rows]
    begin = np.repeat(at, items.count[which]) - items.place[rows]
    if len(short):
        rows = ragged(items.pair_first[pair], items.pair_count[pair])
        begin_of = np.repeat(short, items.pair_count[pair]) - items.pair_place[rows]
        both = on_one_diagonal(items.pair_item[rows], begin_of, items.pair_place[rows], items.pair_words)
        item, begin = np.append(item, items.pair_item[rows][both]), np.append(begin, begin_of[both])
    size = items.length[item]
    slack = 3 + size // 4
    first, last = np.maximum(0, begin - slack), np.minimum(len(words), begin + size + slack)
    order = np.lexsort((first, item))
    result: list[list[int]] = []
    for i, a, b, n in zip(*(x[order].tolist() for x in (item, first, last, size))):
        if result and result[-1][0] == i and a <= result[-1][2] and b - result[-1][1] <= 3 * n + 20:
            result[-1][2] = max(b, result[-1][2])
        else:
            result.append([i, a, b])
    table = np.array(result, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        counts = [len(words_of(t)[0]) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["words"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, shortest: int = 3, longest: int = 12,
               chance: float = 0.005, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, score, alignment, words of the item, start and end word, passage), a row per
    document and item whose best alignment scores `threshold` or more.

    `docs` needs doc_id and text, `benchmark` item_id and text. Null texts have no words; null ids are
    kept; repeated rows are reported each; an item of few and common words is reported wherever they stand
    in a row. Whole texts are searched. Other columns are ignored; either table may be empty. `chance` holds
    for one item, so a larger benchmark does not change what is found of it; 0.005 is 1 for 200 items.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    sizes = usable.select("text").mapInArrow(_word_counts, "words long").agg(F.sum("words").alias("words")).first()
    blocks = int((sizes.words or 0) // block_words) + 1
    result = spark.createDataFrame([], RESULT)
    for b in range(blocks):
        own = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = choose_seeds([(r.item_id, r.text) for r in own.collect()], docs, shortest, longest, chance)
        if items is not None:
            result = result.unionByName(_search(docs, items, threshold))
    return result


def _search(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for piece in slices(batch, "text"):
                docs = [(i, *words_of(t)) for i, t in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist())]
                found = [(d, *w) for d, doc in enumerate(docs) for w in zip(*(x.tolist() for x in windows(items, doc[1])))]
                found.sort(key=lambda w: w[3] - w[2])
                best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
                a = 0
                while a < len(found):  # batches of windows of like width, at most 2**20 cells a row of the alignment
                    n = 1
                    while a + n < len(found) and (n + 1) * (found[a + n][3] - found[a + n][2]) <= 1 << 20 and n < 4096:
                        n += 1
                    part = found[a: a + n]
                    a += n
                    wide = max(w[3] - w[2] for w in part)
                    tall = max(int(items.length[w[1]]) for w in part)
                    left, right = np.zeros((n, tall), np.uint64), np.ones((n, wide), np.uint64)
                    for row, (d, item, first, last) in enumerate(part):
                        own = items.words[items.start[item]: items.start[item] + items.length[item]]
                        left[row, : len(own)], right[row, : last - first] = own, docs[d][1][first:last]
                    for (d, item, first, _), score, start, end in zip(part, *(x.tolist() for x in align(left, right))):
                        share = score / int(items.length[item])
                        if share >= threshold and best.get((d, item), (-1.0,))[0] < share:
                            best[d, item] = (share, score, first + start, first + end)
                rows = []
                for (d, item), (share, score, start, end) in sorted(best.items()):
                    doc_id, _, begin, stop, data = docs[d]
                    rows.append((doc_id, items.ids[item], share, score, int(items.length[item]), start, end,
                                 data[begin[start]: stop[end - 1]].decode("utf-8", "replace")))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4, pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                     [c.split()[0] for c in RESULT.split(", ")])

    return docs.mapInArrow(search, RESULT)


def clean_documents(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """`docs` without the documents that `leaks` names; rows with a null id stay unless a null id is named."""
    named = leaks.select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(named, docs.doc_id.cast("long").eqNullSafe(F.col("_leaked")), "left_anti")
