"""Exact removal of long repeated byte strings by merging Burrows-Wheeler transforms of shards.

A string counts as repeated if its `length` bytes also start anywhere else. Sorting all suffixes of
the corpus byte by byte is out of reach, so suffixes are taken at anchors. An anchor is the smallest
hashed gram (half the length, plus one byte) of a window of `length` bytes; equal windows have equal
anchors, consecutive anchors lie closer than a gram is long, and so a text is a string of phrases
that overlap: (gram, distance to the next anchor).

1. Every shard sorts its own suffixes of phrases and keeps their transform: per row, the phrase
   before it and the row of that longer suffix.
2. The transforms are merged by refining the interleave round by round: in round d a row knows the
   interval of the merged order that its first d phrases lie in. The row before it then lies, by
   d + 1 phrases, in the interval (phrase before, interval). Shards exchange intervals with their
   sizes, never suffixes; an interval with one suffix is closed, and all rows whose continuation
   is closed are closed with it. The last round a row stays open is its common prefix with the rest
   of the corpus, in phrases.
3. The windows of one anchor are repeated if the phrases that span them are; not, if the gram is
   unique. What is left lies at the ends of repeated stretches. There, intervals are refined by
   bytes: windows are blocks by their distance to the anchor; a block whose common bytes are
   unique is dropped, one whose whole span is repeated is taken, any other is cut in parts, down to
   single windows. Blocks with the same common bytes stay together, so each still meets its like.

Intervals are named by 64-bit hashes. Every exchange carries a name once per shard, so a passage that
fills a third of all documents is one entry per shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.backoff_lm import cuts, from_planes, planes
from threadloom.llm.common import Rolling, kept, mix, partitions, released, slices, store
from threadloom.runtime import scratch_path

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
ROUNDS = 8  # of phrases; stretches that need more are settled by bytes
SPLIT = 6   # parts of a block
_NAMES = "shard int, part int, names binary, seconds binary, counts binary"


@dataclass
class Shape:
    """Sizes that follow from the length of a repeated string."""

    length: int

    @property
    def gram(self) -> int:
        return self.length // 2 + 1

    @property
    def grams(self) -> int:
        """Grams in a window; also the number of distances between a window and its anchor."""
        return self.length - self.gram + 1


def anchors_of(rolling: Rolling, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, gram hash) of every anchor; windows are numbered by their first byte."""
    hashes = rolling.grams(shape.gram)
    if rolling.n < shape.length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # the leftmost smallest gram of each window: its hash in the high half, its place in the low half
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= shape.grams:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = shape.grams - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], first, hashes[place[first]]


def name_rows(shard: int, ranges: int, names: np.ndarray, counts: np.ndarray, seconds: np.ndarray | None = None) -> pa.RecordBatch:
    """Distinct sorted names with their counts, one row per range of the hash space."""
    edge = cuts(names, ranges)
    at = [i for i in range(ranges) if edge[i + 1] > edge[i]]
    blob = lambda a: pa.array([planes(a[edge[i]: edge[i + 1]]) for i in at], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * len(at), pa.int32()), pa.array(at, pa.int32()), blob(names),
         blob(seconds) if seconds is not None else pa.nulls(len(at), pa.binary()), blob(counts.astype("<u4"))],
        ["shard", "part", "names", "seconds", "counts"])


def read_names(blobs: list, kind: str = "<u8") -> np.ndarray:
    parts = [from_planes(b, kind) for b in blobs if b is not None]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def shared_names(sent: DataFrame, least: int) -> DataFrame:
    """(shard, names): of the names a shard sent, those whose counts over all shards reach `least`."""

    def add(table: pa.Table) -> pa.Table:
        names = [from_planes(b, "<u8") for b in table.column("names").to_pylist()]
        every, at = np.unique(np.concatenate(names), return_inverse=True)
        good = np.bincount(at, read_names(table.column("counts").to_pylist(), "<u4"), len(every)) >= least
        own = [n[good[a]] for n, a in zip(names, np.split(at, np.cumsum([len(n) for n in names])[:-1]))]
        rows = [(s, planes(n)) for s, n in zip(table.column("shard").to_pylist(), own) if len(n)]
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "names": pa.array([r[1] for r in rows], pa.binary())})

    return sent.groupBy("part").applyInArrow(add, "shard int, names binary")


def member(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(names, values), len(names) - 1)
    return names[at] == values


# --- transforms of shards, merged by phrases -------------------------------------------------------------

STATE = "rows binary, before binary, longer binary, interval binary, depth binary"
ROUND = f"shard int, part int, names binary, seconds binary, counts binary, {STATE}"


def anchor_table(docs: DataFrame, shape: Shape, shards: int) -> DataFrame:
    """(shard, doc_id, text_key, n, place, first, grams) of every text that is long enough."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for piece in slices(batch, "text"):
                rows = []
                for doc, text in zip(piece.select(["shard", "doc_id", "text_key"]).to_pylist(), piece.column("text").to_pylist()):
                    data = (text or "").encode()
                    if len(data) >= shape.length:
                        place, first, grams = anchors_of(Rolling(data), shape)
                        rows.append({**doc, "n": len(data), "place": place.astype("<u4").tobytes(), "first": first.astype("<u4").tobytes(),
                                     "grams": grams.astype("<u8").tobytes()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(
                        [("shard", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()),
                         ("place", pa.binary()), ("first", pa.binary()), ("grams", pa.binary())]))

    return docs.mapInArrow(find, "shard int, doc_id long, text_key long, n long, place binary, first binary, grams binary")


def phrases(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all documents of a shard in a fixed order, distances to the next anchor (0: last), documents."""
    table = table.sort_by([("text_key", "ascending"), ("doc_id", "ascending")])
    grams = [np.frombuffer(b, "<u8") for b in table.column("grams").to_pylist()]
    places = [np.frombuffer(b, "<u4").astype(np.int64) for b in table.column("place").to_pylist()]
    gaps = [np.append(np.diff(p), 0) for p in places]
    return np.concatenate(grams), np.concatenate(gaps), np.repeat(np.arange(len(grams)), [len(g) for g in grams])


def transform(grams: np.ndarray, gaps: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix of each row, name of the phrase before it, row of the suffix one phrase longer or -1).

    Rows are in order of their first ROUNDS phrases: ranks of 1 phrase give those of 2, 3, 5 and 9.
    """
    n = len(grams)
    rank = np.unique(grams, return_inverse=True)[1].astype(np.int64) * (int(gaps.max(initial=0)) + 1) + gaps
    rank = np.unique(rank, return_inverse=True)[1]
    last = np.append(doc[1:] != doc[:-1], True)
    for shift in (1, 1, 2, 4):
        after = np.zeros(n, np.int64)
        after[:-shift or n] = (rank[shift:] + 1) * (doc[shift:] == doc[:-shift])
        rank = np.unique(rank * np.int64(n + 2) + after, return_inverse=True)[1]
    suffix = np.argsort(rank, kind="stable")
    row = np.empty(n, np.int64)
    row[suffix] = np.arange(n)
    phrase = mix(grams * _STEP + gaps.astype(np.uint64))
    first = np.append(True, last[:-1])
    before = phrase[suffix - 1]  # of the text's first anchor: not used
    longer = np.where(first[suffix], -1, row[suffix - 1])
    return suffix, before, longer


def interval_sizes(interval: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(interval, return_counts=True)


def gram_names(ranges: int) -> Callable[[pa.Table], pa.Table]:
    def name(table: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(b, "<u8") for b in table.column("grams").to_pylist()])
        return pa.Table.from_batches([name_rows(table.column("shard")[0].as_py(), ranges, *interval_sizes(grams))])

    return name


def first_round(ranges: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Build a shard's transform and keep the rows whose first phrase is repeated."""

    def start(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _no_rounds()
        grams, gaps, doc = phrases(table)
        suffix, before, longer = transform(grams, gaps, doc)
        return _refined(table.column("shard")[0].as_py(), ranges, suffix, before, longer, grams[suffix],
                        np.zeros(len(grams), np.uint8), answers, False)

    return start


def next_round(ranges: int, final: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def refine(state: pa.Table, answers: pa.Table) -> pa.Table:
        if not state.num_rows:
            return _no_rounds()
        r = state.to_pylist()[0]
        return _refined(r["shard"], ranges, *(np.frombuffer(r[c], k) for c, k in (
            ("rows", "<i4"), ("before", "<u8"), ("longer", "<i4"), ("interval", "<u8"))),
            np.frombuffer(r["depth"], np.uint8).copy(), answers, final)

    return refine


def _refined(shard, ranges, rows, before, longer, interval, depth, answers, final) -> pa.Table:
    """Drop closed rows, count the round for the others, and step to the rows before them."""
    open_ = member(interval, np.sort(read_names(answers.column("names").to_pylist())))
    depth[rows[open_]] += 1
    # rows that may be open in the next round: one phrase before an open row, and open themselves
    source = np.flatnonzero(open_ & (longer >= 0))
    target = longer[source]
    good = open_[target]
    source, target = source[good], target[good]
    renamed = np.zeros(len(rows), np.uint64)
    renamed[target] = mix(before[source] * _STEP + interval[source])
    alive = np.zeros(len(rows), bool)
    alive[target] = True
    number = np.full(len(rows), -1, np.int64)
    number[alive] = np.arange(np.count_nonzero(alive))
    onward = np.where(longer[alive] >= 0, number[longer[alive]], -1)
    return _round_table(shard, ranges, rows[alive], before[alive], onward, renamed[alive], depth, final)


def _no_rounds() -> pa.Table:
    return pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.binary()) for c in ROUND.split(", ")]).empty_table()


def _round_table(shard, ranges, rows, before, longer, interval, depth, final=False) -> pa.Table:
    blob = lambda a, kind: a.astype(kind).tobytes()
    names = [f.split()[0] for f in ROUND.split(", ")]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 8]
    state = pa.table([pa.array([x], t) for x, t in zip(
        [shard, -1, None, None, None, blob(rows, "<i4"), blob(before, "<u8"), blob(longer, "<i4"), blob(interval, "<u8"), depth.tobytes()], types)], names)
    if final or not len(interval):
        return state
    sent = pa.Table.from_batches([name_rows(shard, ranges, *interval_sizes(interval))])
    for name in names[5:]:
        sent = sent.append_column(name, pa.nulls(sent.num_rows, pa.binary()))
    return pa.concat_tables([state, sent])


# --- windows of one anchor ---------------------------------------------------------------------------------

CELLS = "shard int, doc_id long, text_key long, cells binary, part int, names binary, seconds binary, counts binary"
_CELL = np.dtype([("place", "<i4"), ("first", "<i4"), ("last", "<i4"), ("whole", "u1"), ("gram", "<u8")])


def settle(shape: Shape, ranges: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The anchors with repeated grams of each document, and whether all their windows are repeated; sends
    the grams, counting those with windows that are not settled."""

    def decide(table: pa.Table, state: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]])
                              for c in CELLS.split(", ")]).empty_table()
        table = table.sort_by([("text_key", "ascending"), ("doc_id", "ascending")])
        depth = np.frombuffer(state.column("depth")[0].as_py(), np.uint8).astype(np.int64)
        at, out, grams, unsettled = 0, [], [], []
        for r in table.to_pylist():
            place, first = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("place", "first"))
            own = depth[at: at + len(place)]
            at += len(place)
            repeated = np.flatnonzero(own)
            if not len(repeated):
                continue
            last = np.append(first[1:], r["n"] - shape.length + 1) - 1
            # phrases u .. v that cover every window of the anchor; all repeated together?
            u = np.searchsorted(place, first, "right") - 1
            v = np.searchsorted(place + shape.gram, last + shape.length, "left")
            covered = (u >= 0) & (v < len(place))
            whole = covered & (own[np.maximum(u, 0)] >= np.where(covered, v - u + 1, ROUNDS + 2))
            cells = np.zeros(len(repeated), _CELL)
            for name, values in (("place", place), ("first", first), ("last", last), ("whole", whole), ("gram", np.frombuffer(r["grams"], "<u8"))):
                cells[name] = values[repeated]
            out.append((r["shard"], r["doc_id"], r["text_key"], cells.tobytes()))
            grams.append(cells["gram"])
            unsettled.append(~cells["whole"].astype(bool))
        shard = table.column("shard")[0].as_py()
        names, sent = [c.split()[0] for c in CELLS.split(", ")], []
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*out)) or [[]] * 4
        rows = pa.table([pa.array(c, t) for c, t in zip([*columns, [-1] * len(out)], types)] + [pa.nulls(len(out), pa.binary())] * 3, names)
        if grams:
            every, place = np.unique(np.concatenate(grams), return_inverse=True)
            count = np.bincount(place, np.concatenate(unsettled), len(every))
            batch = pa.Table.from_batches([name_rows(shard, ranges, every, count)])
            nothing = lambda t: pa.nulls(batch.num_rows, t)
            sent = [pa.table([batch["shard"], nothing(pa.int64()), nothing(pa.int64()), nothing(pa.binary()), *(batch[c] for c in names[4:])], names)]
        return pa.concat_tables([rows, *sent])

    return decide


# --- blocks of windows, refined by bytes ---------------------------------------------------------------------

class Blocks:
    """The blocks of one document: windows whose distance to their anchor lies in low .. high."""

    def __init__(self, rolling: Rolling, shape: Shape, cells: np.ndarray, open_grams: np.ndarray):
        self.rolling, self.shape = rolling, shape
        self.covered = np.zeros(max(0, rolling.n - shape.length + 1), bool)
        whole = cells["whole"].astype(bool)
        for a, b in zip(cells["first"][whole].tolist(), cells["last"][whole].tolist()):
            self.covered[a: b + 1] = True
        cells = cells[member(cells["gram"], open_grams)]
        self.place, self.first, self.last = (cells[c].astype(np.int64) for c in ("place", "first", "last"))
        self.low = np.zeros(len(cells), np.int64)
        self.high = np.full(len(cells), shape.grams - 1)

    def split(self) -> None:
        size = -(-(self.high - self.low + 1) // SPLIT)
        part = np.arange(SPLIT)
        low = (self.low[:, None] + part * size[:, None]).ravel()
        high = np.minimum(np.repeat(self.high, SPLIT), low + np.repeat(size, SPLIT) - 1)
        place, first, last = (np.repeat(x, SPLIT) for x in (self.place, self.first, self.last))
        # keep blocks that hold a window of their anchor
        good = (low <= high) & (place - high <= last) & (place - low >= first)
        self.place, self.first, self.last, self.low, self.high = (x[good] for x in (place, first, last, low, high))

    def names(self, unique: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each block: the bytes all its windows share, and its whole span (`unique` seeds a name of its
        own where the span leaves the text)."""
        n, length = self.rolling.n, self.shape.length
        salt = mix((self.low * 65_536 + self.high).astype(np.uint64))
        core = mix(self.rolling.span(self.place - self.low, self.place - self.high + length) + salt)
        begin, end = self.place - self.high, self.place - self.low + length
        inside = (begin >= 0) & (end <= n)
        span = mix(self.rolling.span(np.where(inside, begin, 0), np.where(inside, end, 0)) + salt * _STEP)
        alone = mix(np.uint64(unique) + np.arange(len(span), dtype=np.uint64) * _STEP)
        return core, np.where(inside, span, alone)

    def refine(self, core: np.ndarray, span: np.ndarray, open_cores: np.ndarray, repeated_spans: np.ndarray) -> None:
        for i in np.flatnonzero(member(span, repeated_spans)).tolist():
            self.covered[max(self.first[i], self.place[i] - self.high[i]): min(self.last[i], self.place[i] - self.low[i]) + 1] = True
        on = member(core, open_cores) & (self.high > self.low)
        self.place, self.first, self.last, self.low, self.high = (
            x[on] for x in (self.place, self.first, self.last, self.low, self.high))

    def removed(self) -> np.ndarray:
        """Bytes that lie in a repeated window."""
        change = np.zeros(self.rolling.n + 1, np.int64)
        start = np.flatnonzero(self.covered)
        np.add.at(change, start, 1)
        np.add.at(change, start + self.shape.length, -1)
        return np.cumsum(change)[: self.rolling.n] > 0


def depth_of_blocks(shape: Shape) -> int:
    size, rounds = shape.grams, 0
    while size > 1:
        size, rounds = -(-size // SPLIT), rounds + 1
    return rounds


class Answers:
    """The answers of the rounds so far, by shard, read from shared storage by the task that needs them."""

    def __init__(self, folders: list[str]):
        self.folders = folders
        self.held: tuple[int, list[tuple[np.ndarray, np.ndarray]]] = (-1, [])

    def of(self, shard: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.held[0] != shard:
            self.held = (shard, [self._read(f, shard) for f in self.folders])
        return self.held[1]

    @staticmethod
    def _read(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
        fs, base = store(f"{folder}/shard={shard}")
        names, seconds = [], []
        for info in sorted(fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    table = pq.read_table(f, columns=["names", "seconds"])
                names += table.column("names").to_pylist()
                seconds += table.column("seconds").to_pylist()
        return np.sort(read_names(names)), np.sort(read_names(seconds))


def by_shard(answers: DataFrame, shards: int, name: str) -> str:
    path = scratch_path(answers.sparkSession, name)
    answers.repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    return path


def block_answers(sent: DataFrame) -> DataFrame:
    """(shard, names, seconds): the shared bytes whose blocks must be cut further, and the repeated spans."""

    def add(table: pa.Table) -> pa.Table:
        cores = [from_planes(b, "<u8") for b in table.column("names").to_pylist()]
        spans = [from_planes(b, "<u8") for b in table.column("seconds").to_pylist()]
        counts = read_names(table.column("counts").to_pylist(), "<u4").astype(np.int64)
        core, span = np.concatenate(cores), np.concatenate(spans)
        _, group = np.unique(core, return_inverse=True)
        _, pair = np.unique(span, return_inverse=True)  # a span has one core
        total = np.bincount(pair, counts)[pair]
        many = np.bincount(group, counts)[group] > 1
        split = many & (np.bincount(group, total == 1)[group] > 0)
        own = np.cumsum([len(c) for c in cores])[:-1]
        rows = [(s, planes(np.unique(c[g])), planes(np.unique(p[t > 1]))) for s, c, p, g, t in zip(
            table.column("shard").to_pylist(), cores, spans, np.split(split, own), np.split(total, own)) if g.any() or (t > 1).any()]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table({"shard": pa.array(columns[0], pa.int32()), "names": pa.array(columns[1], pa.binary()), "seconds": pa.array(columns[2], pa.binary())})

    return sent.groupBy("part").applyInArrow(add, "shard int, names binary, seconds binary")


def _replayed(row: dict, shape: Shape, answers: Answers) -> tuple[Blocks, int]:
    """The blocks of a document after all rounds answered so far."""
    rolling = Rolling(row["text"].encode())
    known = answers.of(row["shard"])
    blocks = Blocks(rolling, shape, np.frombuffer(row["cells"], _CELL), known[0][0])
    unique = (row["text_key"] ^ (row["doc_id"] or 0)) & (1 << 64) - 1
    for names, seconds in known[1:]:
        blocks.split()
        blocks.refine(*blocks.names(unique), names, seconds)
    return blocks, unique


def send_blocks(texts: DataFrame, shape: Shape, folders: list[str], ranges: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, held, size = Answers(folders), {}, 0

        def flush(shard):
            core, span = (np.concatenate(x) for x in zip(*held.pop(shard)))
            order = np.lexsort((span, core))
            core, span = core[order], span[order]
            new = np.flatnonzero(np.append(True, (core[1:] != core[:-1]) | (span[1:] != span[:-1])))
            return name_rows(shard, ranges, core[new], np.diff(np.append(new, len(core))), span[new])

        for batch in released(batches):
            for piece in slices(batch, "text"):
                for row in piece.to_pylist():
                    blocks, unique = _replayed(row, shape, answers)
                    blocks.split()
                    if len(blocks.place):
                        held.setdefault(row["shard"], []).append(blocks.names(unique))
                        size += len(blocks.place)
                if size > 2_000_000:
                    for shard in list(held):
                        yield flush(shard)
                    size = 0
        for shard in list(held):
            yield flush(shard)

    return texts.mapInArrow(send, _NAMES)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>, kept_text string"


def finished(texts: DataFrame, shape: Shape, folders: list[str], with_text: bool, carry: list[str]) -> DataFrame:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(folders)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                            ("kept_sha256", pa.string()), ("spans", spans_type), ("kept_text", pa.string())])
        for batch in released(batches):
            for piece in slices(batch, "text"):
                rows = []
                for row in piece.select(["shard", "doc_id", "text_key", "text", "cells"]).to_pylist():
                    blocks, data = _replayed(row, shape, answers)[0], row["text"].encode()
                    gone = blocks.removed()
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    start, length = edges[::2], edges[1::2] - edges[::2]
                    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    rows.append((row["doc_id"], len(data), int(gone.sum()), len(start), hashlib.sha256(left).hexdigest(),
                                 [{"start": a, "length": n} for a, n in zip(start.tolist(), length.tolist())],
                                 left.decode("utf-8", "ignore") if with_text else None))
                if rows:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                    yield pa.RecordBatch.from_arrays([*columns, *(piece.column(c) for c in carry)], [*schema.names, *carry])

    own = texts.select("shard", "doc_id", "text_key", "text", "cells", *carry)
    carried = "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in carry)
    return own.mapInArrow(finish, RESULT + carried)


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text) of every document, and its columns in `carry`.

    Texts are UTF-8 bytes; a null text is empty. Every byte covered by a string of `length` bytes that
    also starts anywhere else, in the same document or another, is removed; strings are judged on the
    input and overlaps count. `spans` are the maximal removed runs, `kept_text` the rest as text without
    characters that a cut left incomplete. Null ids are kept; repeated rows are copies and so repeat
    all their bytes if long enough; other columns are ignored.
    """
    if length < 4:
        raise ValueError("length must be at least 4")
    spark, shape = docs.sparkSession, Shape(length)
    shards = ranges = partitions(spark)
    taken = {c: f"_carried{i}" for i, c in enumerate(carry)}  # names that cannot clash with ours
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                        *[F.col(c).alias(n) for c, n in taken.items()]).withColumn(
        "text_key", F.xxhash64("text")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(shards)).cast("int"))

    anchors = kept(anchor_table(keyed, shape, shards), "anchors")
    sent = anchors.select("shard", "grams").groupBy("shard").applyInArrow(gram_names(ranges), _NAMES)
    own = anchors.select("shard", "doc_id", "text_key", "place", "grams")
    state = kept(own.groupBy("shard").cogroup(shared_names(sent, 2).groupBy("shard")).applyInArrow(first_round(ranges), ROUND), "round1")
    for step in range(2, ROUNDS + 1):
        sent = state.filter("part >= 0").select("shard", "part", "names", "counts")
        if sent.isEmpty():  # every interval is closed
            break
        state = kept(state.filter("part = -1").groupBy("shard").cogroup(shared_names(sent, 2).groupBy("shard")).applyInArrow(
            next_round(ranges, step == ROUNDS), ROUND), f"round{step}")

    cells = kept(anchors.groupBy("shard").cogroup(state.filter("part = -1").select("shard", "depth").groupBy("shard")).applyInArrow(
        settle(shape, ranges), CELLS), "cells")
    sent = cells.filter("part >= 0").select("shard", "part", "names", "counts")
    folders = [by_shard(shared_names(sent, 1).withColumn("seconds", F.lit(None).cast("binary")), shards, "answers0")]

    found = cells.filter("part = -1").select("shard", "doc_id", "text_key", "cells")

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        """Texts with their cells; a text without repeated grams is finished here."""
        own = {(d, k): c for d, k, c in zip(*(right.column(x).to_pylist() for x in ("doc_id", "text_key", "cells")))}
        shard, doc_id, key, text = (left.column(x).to_pylist() for x in ("shard", "doc_id", "text_key", "text"))
        got = [own.get(x) for x in zip(doc_id, key)]
        data = [None if c is not None else t.encode() for t, c in zip(text, got)]
        return pa.table({
            "shard": pa.array(shard, pa.int32()), "doc_id": pa.array(doc_id, pa.int64()), "text_key": pa.array(key, pa.int64()),
            "text": pa.array([t if c is not None or with_text else None for t, c in zip(text, got)], pa.string()),
            "cells": pa.array(got, pa.binary()),
            "n_bytes": pa.array([None if d is None else len(d) for d in data], pa.int64()),
            "kept_sha256": pa.array([None if d is None else hashlib.sha256(d).hexdigest() for d in data], pa.string()),
            **{n: left.column(n) for n in carried}})

    carried = list(taken.values())
    schema = "shard int, doc_id long, text_key long, text string, cells binary, n_bytes long, kept_sha256 string" + "".join(
        f", {n} {keyed.schema[n].dataType.simpleString()}" for n in carried)
    texts = kept(keyed.select("shard", "doc_id", "text_key", "text", *carried).groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(
        match, schema), "texts")
    open_texts = texts.filter("cells is not null").select("shard", "doc_id", "text_key", "text", "cells")
    for step in range(1, depth_of_blocks(shape) + 1):
        sent = send_blocks(open_texts, shape, folders, ranges)
        folders = [*folders, by_shard(block_answers(sent), shards, f"answers{step}")]
    clean = texts.filter("cells is null").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256",
        F.array().cast("array<struct<start:long,length:long>>").alias("spans"), F.col("text").alias("kept_text"), *carried)
    done = finished(texts.filter("cells is not null"), shape, folders, with_text, carried).unionByName(clean)
    own = [c.split()[0] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")]
    return done.select(*own, *[F.col(n).alias(c) for c, n in taken.items() if c not in own])
