"""Scoring with a weighted backoff automaton learned from the corpus.

Words are hashed; a document ends with one end token. Every task cuts its documents into shards of
about `shard_bytes` of text and stores their words once, as codes, on shared storage. Counts are then
exchanged level by level: a shard sends distinct n-grams, sorted and cut by ranges of their hash,
with its training counts; the range's task adds the counts over all shards and answers each shard
with the totals of just the n-grams it asked for. The answer 0 says that the shard's own count is the total:
no other shard holds the n-gram, or nobody learned it. The same is then true of every longer n-gram around
it, so those are neither sent nor asked for, by any shard that has them. A hot n-gram is one entry per
shard, nothing is broadcast, and a shard's automaton is as large as its own text.

Smoothing is Dirichlet: p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m), with h' = h without its
first word and the add-one unigram below. That is the same as a backoff automaton: a state per
context, an arc per n-gram seen in training, and a failure arc to the state of h' that weighs
m / (c(h) + m). One left-to-right traversal carries the state and adds log10 weights; the
documents of a shard run side by side.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.common import commit_file, kept, make_folder, mix, partitions, slices, store, word_hashes

END = np.uint64(0xE0D0F0C0B0A09080)  # stands for the end of a document
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    """The words of some documents, one after another; `length` counts each document's end token."""

    words: np.ndarray
    length: np.ndarray

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length


def read_tokens(texts: list[str | None]) -> Tokens:
    parts = []
    for text in texts:
        parts += [word_hashes(ascii_lower(text)), np.array([END])]
    sizes = np.array([len(p) for p in parts], np.int64).reshape(-1, 2).sum(axis=1)
    return Tokens(np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes)


def ascii_lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()  # of bytes, only A-Z have lower forms


def ngrams(tokens: Tokens, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n up to `order`, one after another: the hash of the n-gram that ends at each token, and whether there is one."""
    place = np.arange(len(tokens.words), dtype=np.int32) - np.repeat(tokens.start.astype(np.int32), tokens.length)
    key = mix(tokens.words)
    for n in range(1, order + 1):
        if n > 1:  # the n-gram ending here is the shorter one ending a token before, and this word
            before = np.empty_like(key)
            before[1:], before[:1] = key[:-1], 0
            key = mix(before * _STEP + tokens.words + np.uint64(n))
        yield key, place >= n - 1


def planes(values: np.ndarray) -> bytes:
    """Byte planes of a sorted or small-valued array: Spark's block compression then does its work."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted 64-bit keys pass from one of `ranges` equal ranges to the next."""
    edges = [(i << 64) // ranges for i in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


def stored_shards(docs: DataFrame, shard_bytes: int, folder: str) -> DataFrame:
    """(shard): names of the files in `folder` that hold the words of some documents of (doc_id, held_out, text) each.

    A task that is run again writes files of its own; only those of the attempt that counts are named.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, tokens, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            words, codes = np.unique(np.concatenate([t.words for t in tokens]), return_inverse=True)
            row = pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([np.concatenate([t.length for t in tokens]).tobytes()], pa.binary()),
                 pa.array([words.tobytes()], pa.binary()), pa.array([planes(codes.astype("<u4"))], pa.binary())],
                ["doc_id", "held_out", "length", "words", "codes"])

            def put(out) -> None:
                with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(row)

            name = uuid.uuid4().hex
            commit_file(folder, name, put)
            return pa.RecordBatch.from_arrays([pa.array([name])], ["shard"])

        for batch in batches:
            for piece in slices(batch, "text", min(shard_bytes, 1 << 20)):
                texts = piece.column("text").to_pylist()
                ids += piece.column("doc_id").to_pylist()
                held += piece.column("held_out").to_pylist()
                tokens.append(read_tokens(texts))
                size += sum(len(t or "") for t in texts)
                if size >= shard_bytes:
                    yield flush()
                    ids, held, tokens, size = [], [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(write, "shard string")


def read_shard(folder: str, name: str) -> tuple[pa.Array, np.ndarray, Tokens]:
    """Ids, held-out marks and words of the documents of a stored shard."""
    fs, base = store(folder)
    with fs.open_input_stream(posixpath.join(base, name)) as f:
        row = pa.ipc.open_stream(f).read_all()
    ids, held = (row.column(c).combine_chunks().flatten() for c in ("doc_id", "held_out"))
    length, words = (np.frombuffer(row.column(c)[0].as_py(), kind) for c, kind in (("length", "<i8"), ("words", "<u8")))
    return ids, held.to_numpy(False).astype(bool), Tokens(words[from_planes(row.column("codes")[0].as_py(), "<u4")], length)


def levels(tokens: Tokens, learn: np.ndarray, order: int, answers: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, own counts, asked, totals) of each answered level and (keys, own counts, asked) of the next one.

    `asked` marks the n-grams both of whose shorter parts have an answer above 0; the total of any other is the own count.
    """
    weight = np.repeat(learn.astype(np.int64), tokens.length)
    alive = np.ones(len(tokens.words), bool)  # by the end of the n-gram
    for level, (key, whole) in enumerate(ngrams(tokens, order)):
        ends = np.flatnonzero(whole)
        keys, at = np.unique(key[ends], return_inverse=True)
        counts = np.bincount(at, weight[ends], len(keys)).astype(np.int64)
        asked = np.ones(len(keys), bool)
        if level:
            asked[at] = alive[ends] & alive[ends - 1]  # all places of an n-gram have the same parts
        if level == len(answers):
            yield keys, counts, asked
            return
        answer = np.zeros(len(keys), np.int64)
        answer[asked] = answers[level]
        yield keys, counts, asked, np.where(answer > 0, answer, counts)
        alive = np.zeros(len(key), bool)
        alive[ends] = answer[at] > 0


def by_level(table: pa.Table, n: int) -> list[np.ndarray]:
    """The answers of a shard for its first n levels, each in the order of its asked keys."""
    found: list[list[tuple[int, bytes]]] = [[] for _ in range(n)]
    for level, part, totals in zip(*(table.column(c).to_pylist() for c in ("level", "part", "totals"))):
        found[level].append((part, totals))
    return [np.concatenate([np.zeros(0, np.int64), *(from_planes(b, "<u8").astype(np.int64) for _, b in sorted(f))]) for f in found]


def answered(shards: DataFrame, answers: DataFrame, folder: str, level: int, ranges: int) -> DataFrame:
    """(shard, level, part, totals): for the n-grams that a shard asks for at `level`, in sorted order of their part, the
    training count of all shards, or 0 where only this shard holds it; at level 0 the shard '' carries (sum of
    counts, distinct keys learned) of each part."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        name = left.column("shard")[0].as_py()
        _, held, tokens = read_shard(folder, name)
        *_, (keys, counts, asked) = levels(tokens, ~held, level + 1, by_level(right, level))
        keys, counts = keys[asked], counts[asked].astype("<u4")
        edge = cuts(keys, ranges)
        parts = [i for i in range(ranges) if edge[i + 1] > edge[i]]
        return pa.table({"shard": pa.array([name] * len(parts), pa.string()), "part": pa.array(parts, pa.int32()),
                         "keys": pa.array([planes(keys[edge[i]: edge[i + 1]]) for i in parts], pa.binary()),
                         "counts": pa.array([planes(counts[edge[i]: edge[i + 1]]) for i in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        keys = [from_planes(k, "<u8") for k in table.column("keys").to_pylist()]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([from_planes(c, "<u4") for c in table.column("counts").to_pylist()])
        total = np.bincount(at, counts, len(every)).astype("<u8")
        answer = np.where(np.bincount(at) > 1, total, 0).astype("<u8")
        names = table.column("shard").to_pylist()
        rows = [planes(answer[own]) for own in np.split(at, np.cumsum([len(k) for k in keys])[:-1])]
        if level == 0:
            names, rows = [*names, ""], [*rows, planes(np.array([total.sum(), np.count_nonzero(total)], "<u8"))]
        n = len(names)
        return pa.table({"shard": pa.array(names, pa.string()), "level": pa.array([level] * n, pa.int32()),
                         "part": pa.array([table.column("part")[0].as_py()] * n, pa.int32()), "totals": pa.array(rows, pa.binary())})

    sent = with_answers(shards, answers).applyInArrow(send, "shard string, part int, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(add, _ANSWERS)


_ANSWERS = "shard string, level int, part int, totals binary"


def with_answers(shards: DataFrame, answers: DataFrame):
    """Shards and their answers, cogrouped; dealt over a fixed number of tasks, as a name says nothing of a shard's size."""
    n = partitions(shards.sparkSession)
    return shards.repartition(n, "shard").groupBy("shard").cogroup(
        answers.filter("shard <> ''").repartition(n, "shard").groupBy("shard"))


class Automaton:
    """States are the contexts seen in training; state 0 is the empty context."""

    def __init__(self, tokens: Tokens, counts: list[np.ndarray], masses: list[float], n_train: int, vocabulary: int):
        order = len(counts)
        rank, first = [], []  # of the n-gram that ends at each token (-1: none); a token where each distinct one ends
        for key, whole in ngrams(tokens, order):
            ends = np.flatnonzero(whole)
            distinct, at = np.unique(key[ends], return_inverse=True)  # places would take a stable sort, which is slower
            ranks = np.full(len(key), -1, np.int32)
            ranks[ends] = at
            rank.append(ranks)
            first.append(np.empty(len(distinct), np.int32))
            first[-1][at] = ends
            del key, whole, ends, distinct, at, ranks
        self.word, self.n_words, self.order = rank[0], len(first[0]), order
        is_end = tokens.words == END
        self.unigram = (counts[0] + 1.0) / (n_train + vocabulary + 1.0)
        self.count = counts[0]

        # states: n-grams below the top order that were seen and can go on
        states, used = [], 1
        for level in range(order - 1):
            number = np.zeros(len(counts[level]), np.int32)
            live = (counts[level] > 0) & ~is_end[first[level]]
            number[live] = used + np.arange(np.count_nonzero(live))
            used += np.count_nonzero(live)
            states.append(number)
        self.fail = np.zeros(used, np.int32)
        self.fail_weight = np.zeros(used)
        for level, number in enumerate(states):
            live = number > 0
            if level:
                self.fail[number[live]] = states[level - 1][rank[level - 1][first[level][live]]]
            mass = masses[level]
            self.fail_weight[number[live]] = np.log10(mass / (counts[level][live] + mass))

        # arcs: from the state of an n-gram's context, by its last word, to the longest state it leads to
        self.root_target = states[0] if states else np.zeros(self.n_words, np.int32)
        self.root_weight = np.log10(self.unigram)
        keys, weights, targets, shorter = [], [], [], self.unigram
        for level in range(1, order):
            at, mass = first[level], masses[level - 1]
            seen = counts[level] > 0
            context = rank[level - 1][np.maximum(at - 1, 0)]
            here = rank[level - 1][at]
            p = (counts[level] + mass * shorter[here]) / (counts[level - 1][context] + mass)
            target = states[level] if level < order - 1 else states[level - 1][here]
            keys.append(states[level - 1][context[seen]].astype(np.int64) * self.n_words + self.word[at[seen]])
            weights.append(np.log10(p[seen]))
            targets.append(target[seen])
            shorter = p
            del at, seen, context, here, p, target
        del rank, first, states, shorter
        order_of = np.argsort(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        self.keys, self.weights, self.targets = (  # one after another: each is copied once
            np.concatenate([np.zeros(0, kind), *x])[order_of] for x, kind in ((keys, np.int64), (weights, np.float64), (targets, np.int32)))

    def score(self, tokens: Tokens, piece: int = 512) -> np.ndarray:
        """log10 probability of each document, in one pass from left to right.

        Documents are read in pieces side by side. The state holds `order` - 1 words at most, so a piece is in the document's state
        once it has read that many words before its own.
        """
        pieces = -(-tokens.length // piece)
        doc = np.repeat(np.arange(len(pieces)), pieces)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * piece
        before = np.minimum(at, self.order - 1)
        length = np.minimum(tokens.length[doc] - at, piece) + before
        lanes = np.argsort(-length, kind="stable")
        start, length, before = (tokens.start[doc] + at - before)[lanes], length[lanes], before[lanes]
        state, total = np.zeros(len(lanes), np.int64), np.zeros(len(lanes))
        ending = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for t, n in enumerate(ending.tolist()):  # the first n lanes are longer than t
            word = self.word[start[:n] + t]
            now, gain = state[:n].astype(np.int64), np.zeros(n)
            todo = np.flatnonzero(now)
            while len(todo):
                key = now[todo] * self.n_words + word[todo]
                arc = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
                hit = self.keys[arc] == key if len(self.keys) else np.zeros(len(todo), bool)
                done, arc = todo[hit], arc[hit]
                gain[done] += self.weights[arc]
                now[done] = -1 - self.targets[arc]  # taken: below zero until the step ends
                todo = todo[~hit]
                gain[todo] += self.fail_weight[now[todo]]
                now[todo] = self.fail[now[todo]]
                todo = todo[now[todo] > 0]
            root = np.flatnonzero(now == 0)
            root = root[gain[root] <= 0]
            gain[root] += self.root_weight[word[root]]
            now[root] = -1 - self.root_target[word[root]]
            state[:n] = -1 - now
            total[:n] += gain if t >= self.order - 1 else np.where(before[:n] > t, 0, gain)
        return np.bincount(doc[lanes], total, len(pieces))


def score_texts(docs: DataFrame, held_out: Column, order: int = 2, masses: tuple[float, ...] = (200.0, 20.0),
                shard_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    All rows that are not held out are learned from, all rows are scored. A null text is empty: its
    one token is the end. A null doc_id is kept; repeated rows count and are scored each; other
    columns are ignored; without any training row every word is unseen. `masses` has the
    Dirichlet mass m for contexts of 1, 2, ... words; `shard_bytes` changes the work, not the result.
    """
    spark = docs.sparkSession
    ranges, folder = partitions(spark), make_folder(spark, "shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    shards = kept(stored_shards(rows, shard_bytes, folder), "shard-names")
    answers = spark.createDataFrame([], _ANSWERS)
    for level in range(order):
        answers = answers.unionByName(kept(answered(shards, answers, folder, level, ranges), f"counts{level}"))
    sums = [from_planes(r.totals, "<u8") for r in answers.filter("shard = ''").select("totals").collect()]  # a row per range
    n_train, vocabulary = (int(sum(s[i] for s in sums)) for i in (0, 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held, tokens = read_shard(folder, left.column("shard")[0].as_py())
        counts = [totals for *_, totals in levels(tokens, ~held, order, by_level(right, order))]
        del right  # answered: the automaton needs room
        model = Automaton(tokens, counts, list(masses), n_train, vocabulary)
        doc = np.repeat(np.arange(len(tokens.length)), tokens.length)
        n = len(tokens.length)
        base = np.bincount(doc, np.log10(model.unigram)[model.word], n)
        known = np.bincount(doc, model.count[model.word] > 0, n).astype(np.int64)
        return pa.table({"doc_id": ids, "held_out": pa.array(held), "n_tokens": tokens.length,
                         "n_known": known, "train_tokens": np.full(n, n_train), "base_score": base, "score": model.score(tokens)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_answers(shards, answers).applyInArrow(score, schema)
