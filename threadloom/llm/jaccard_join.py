"""Exact Jaccard self-join of word shingles by partitioning the universe of shingles.

Sets are put into size bands, so that linked sets lie in one band or in neighbours. For a band,
the hash space of shingles is cut into m segments. Two linked sets differ in at most H shingles
(H follows from the band's largest size), so by the pigeonhole principle they agree on a segment,
or differ by one shingle in a segment that also indexes its one-deletion neighbourhood:

  sum of allotments v_i >= H + 1, with v_i = 1 (segment must be equal), 2 (equal or one shingle
  more or less), 0 (not probed).

All sets index every segment. The first few segments are spare: they index one-deletion neighbours
too, which gives more allotment than needed, and each set spends the surplus by not probing where
that is dearest: its smallest segments, whose content many other sets share. A pair is a candidate if
one of both probes the entry. Candidates are verified on the whole sets.

A group of near copies shares nearly all entries. Each set is first compared with one centre, the set it
meets that meets the most others; groups that then lie in one component are done. In each of the others
the probing members meet all members where the group is, in tiles of two blocks at most: sizes and
bitmaps rule out nearly all pairs at once, as matrix products, and only pairs that may reach the threshold leave
the task. A tile gives no more pairs than `each` times its members. Where small bitmaps leave more, it gives none and
larger ones are sent to that group in the next round; where those leave more, it first gives the likeliest pairs
that would join its components to one another, a forest, and in every further round four times as many pairs of those still
apart. So the pairs grow with the members of a group, not with their square, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.backoff_lm import ascii_lower, cuts, from_planes, planes
from threadloom.llm.common import kept, mix, partitions, released, shingle_hashes, slices, word_hashes
from threadloom.llm.phrase_mining import name_filter, read_filter
from threadloom.operators.cluster import connected_components
from threadloom.runtime import ARROW_BYTES

_SALT = np.uint64(0xD6E8FEB86659FD93)
#: How sets are stored. They are hashes, which do not compress, and may take a megabyte each. Readers and codecs hold whole
#: pages and column chunks outside the heap, so these are small, measured at every row and not compressed.
_WIDE = {"compression": "uncompressed", "parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1",
         "parquet.block.size.row.check.max": "16", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16"}


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; fewer words are one shingle, no word is empty."""
    return np.unique(shingle_hashes(word_hashes(ascii_lower(text)), k))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit identities of a set, as signed longs."""
    a = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    b = mix(shingles ^ _SALT).sum(dtype=np.uint64) ^ np.uint64(len(shingles))
    return int(mix(a[None]).view(np.int64)[0]), int(mix(b[None]).view(np.int64)[0])


class Bands:
    """Sizes, segments and spare segments per band for 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.high = [1], []

    def of(self, size: int) -> int:
        while not self.high or self.high[-1] < size:
            self.high.append(self.low[-1] * 100 // self.percent)
            self.low.append(self.high[-1] + 1)
        return int(np.searchsorted(self.low, size, "right")) - 1

    def shape(self, band: int) -> tuple[int, int]:
        """(segments, spare ones): the smaller set of a pair lies in the band, so the larger has at most
        high * 100 / percent shingles, and |A - B| + |B - A| <= (100 - percent) / (100 + percent) * (|A| + |B|)."""
        self.of(self.low[band])
        high = self.high[band]
        differ = (100 - self.percent) * (high + high * 100 // self.percent) // (100 + self.percent)
        m = differ + 1
        return m, min(2 + m // 64, m - 1)


def entries(shingles: np.ndarray, band: int, m: int, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set for one band, and whether the set probes each."""
    segment = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with the sorted hashes
    size = np.bincount(segment.astype(np.int64), minlength=m)
    end = np.cumsum(size)
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles ^ _SALT), out=sums[1:])
    content = sums[end] - sums[end - size]
    salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
    whole = mix(content + salt)
    probe = np.ones(m, bool)
    deleted = end[spare - 1] if spare else 0  # shingles of spare segments come first
    part = segment[:deleted].astype(np.int64)
    fewer = mix(content[part] - mix(shingles[:deleted] ^ _SALT) + salt[part])
    probe_fewer = np.ones(deleted, bool)
    if spare:
        # the surplus equals `spare`: take back that many allotments where they cost most (small segments);
        # a spare segment first loses its neighbourhood, whose entries are one shingle smaller
        steps = np.concatenate([size[:spare] - 1, size])
        for step in np.argsort(steps, kind="stable")[:spare].tolist():
            if step < spare:
                probe_fewer[part == step] = False
            else:
                probe[step - spare] = False
    return np.concatenate([whole, fewer]), np.concatenate([probe, probe_fewer])


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, n, key1, key2): size and identity of every document's set."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, k)
                rows.append((len(shingles), *set_key(shingles)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns],
                                             ["doc_id", "text_key", "n", "key1", "key2"])

    return docs.mapInArrow(build, "doc_id long, text_key long, n long, key1 long, key2 long")


def index_entries(docs: DataFrame, k: int, percent: int, ranges: int, at_once: int = 1_000_000) -> DataFrame:
    """Sorted index entries by range of the hash space, each set of a task once; `sets` lists the sets of a
    row and `owners` numbers them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        signature, owner, probes, held = [], [], [], 0

        def flush():
            sig, probe = np.concatenate(signature), np.concatenate(probes)
            sets, sizes = map(np.array, zip(*owner))
            own = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(sig)
            sig, own, probe = sig[order], own[order], probe[order]
            edge = cuts(sig, ranges)
            rows = []
            for i in range(ranges):
                if edge[i + 1] > edge[i]:
                    used, number = np.unique(own[edge[i]: edge[i + 1]], return_inverse=True)
                    rows.append((i, planes(sig[edge[i]: edge[i + 1]]), planes((number * 2 + probe[edge[i]: edge[i + 1]]).astype("<u4")),
                                 sets[used].astype("<i8").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))],
                                              ["part", "entries", "owners", "sets"])

        for batch in released(batches):
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, k)
                key = set_key(shingles)
                if len(shingles) and key not in seen:
                    seen.add(key)
                    band = bands.of(len(shingles))
                    for b in {band, max(0, band - 1)}:
                        sig, probe = entries(shingles, b, *bands.shape(b))
                        signature.append(sig)
                        probes.append(probe)
                        owner.append((key[0], len(sig)))
                        held += len(sig)
                if held > at_once:
                    yield flush()
                    signature, owner, probes, held = [], [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(build, "part int, entries binary, owners binary, sets binary")


def entry_groups(index: DataFrame) -> DataFrame:
    """(entry, key1, probes) of every entry that several sets share and at least one of them probes.

    Entries with the same sets are one: a group is named by its members.
    """

    def group(table: pa.Table) -> pa.Table:
        sig = np.concatenate([from_planes(b, "<u8") for b in table.column("entries").to_pylist()])
        marks = [from_planes(b, "<u4") for b in table.column("owners").to_pylist()]
        own = np.concatenate([np.frombuffer(s, "<i8")[m >> 1] for s, m in zip(table.column("sets").to_pylist(), marks)])
        probe = np.concatenate(marks) % 2 == 1
        order = np.lexsort((~probe, own, sig))
        sig, own, probe = sig[order], own[order], probe[order]
        first = np.append(True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1]))  # a set counts once, as probing if it does anywhere
        sig, own, probe = sig[first], own[first], probe[first]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(start, len(sig)))
        name = mix(np.add.reduceat(mix(own.view(np.uint64) * np.uint64(2) + probe.astype(np.uint64)), start))
        good = (size > 1) & (np.add.reduceat(probe.astype(np.int64), start) > 0)
        once = np.zeros(len(start), bool)
        once[np.unique(name, return_index=True)[1]] = True
        good = np.repeat(good & once, size)
        return pa.table({"entry": np.repeat(name, size)[good].view(np.int64), "key1": own[good], "probes": probe[good]})

    groups = index.groupBy("part").applyInArrow(group, "entry long, key1 long, probes boolean")
    return groups.groupBy("entry", "key1").agg(F.max("probes").alias("probes"))


def bitmap(shingles: np.ndarray, room: int = 4) -> bytes:
    """One bit per shingle in `room` to twice as many bits per shingle, by the low bits of its hash."""
    size = 1 << max(6, (room * len(shingles)).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()  # folded in halves, it is that of less room


def most_shared(x: bytes, y: bytes, n_x: int) -> int:
    """No fewer than the shingles both sets share: each bit of x that y lacks is a shingle of x alone."""
    x, y = (np.frombuffer(b, np.uint8) for b in (x, y))
    while len(x) > len(y):  # folding halves keeps the low bits of the hash
        x = x[: len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2:]
    return n_x - int(_ONES[x & ~y].sum())


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of set keys whose sets reach the threshold. `sets`: (key1, n, bits, few_bits, shingles).

    Sizes and bitmaps rule out most of the others; whole sets are compared for the rest.
    """
    def reaches(both: int, n_a: int, n_b: int) -> bool:
        return 100 * both >= percent * (n_a + n_b - both)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            columns = (batch.column(c).to_pylist() for c in ("na", "nb", "ba", "bb"))
            keep = [reaches(min(most_shared(x, y, m), most_shared(y, x, n)), m, n) for m, n, x, y in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            linked = []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb"))):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                linked.append(reaches(len(x) + len(y) - len(np.union1d(x, y)), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    sizes = sets.select("key1", "n")
    fit = pairs.join(sizes.select(F.col("key1").alias("a"), F.col("n").alias("na")), "a").join(
        sizes.select(F.col("key1").alias("b"), F.col("n").alias("nb")), "b").filter(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    bits = sets.select("key1", "bits")
    likely = fit.join(bits.select(F.col("key1").alias("b"), F.col("bits").alias("bb")), "b").join(
        bits.select(F.col("key1").alias("a"), F.col("bits").alias("ba")), "a")
    likely = kept(likely.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(sieve, "a long, b long"), f"likely-{name}")
    used = few_files(likely.select(F.explode(F.array("a", "b")).alias("key1")).distinct(), f"used-{name}")
    whole = sets.select("key1", "shingles").join(used, "key1", "left_semi")
    with_b = likely.join(whole.select(F.col("key1").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(whole.select(F.col("key1").alias("a"), F.col("shingles").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")


def few_files(df: DataFrame, name: str) -> DataFrame:
    """Stored like `kept`, in at most four files per core of the cluster: the tables of the rounds are small."""
    return kept(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), name)


def centres(groups: DataFrame, name: str) -> DataFrame:
    """(entry, centre, weight): per group the set that meets the most others over all its groups."""
    size = few_files(groups.groupBy("entry").agg(F.count(F.lit(1)).alias("size")), f"sizes-{name}")
    weight = few_files(groups.join(size, "entry").groupBy("key1").agg(F.sum("size").alias("weight")), f"weights-{name}")
    best = groups.join(weight, "key1").groupBy("entry").agg(F.max(F.struct("weight", "key1")).alias("best"))
    return few_files(best.select("entry", F.col("best.key1").alias("centre"), F.col("best.weight").alias("weight")), f"centres-{name}")


def mixed_groups(groups: DataFrame, component: DataFrame, step: int) -> DataFrame:
    """(entry, key1, probes, component) of the groups whose sets are in different components; a group with one
    component has nothing to find."""
    label = groups.join(component.withColumnRenamed("id", "key1"), "key1", "left").withColumn("component", F.coalesce("component", "key1"))
    mixed = label.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return few_files(label.join(few_files(mixed.select("entry"), f"mixed{step}"), "entry", "left_semi"), f"open{step}")


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps folded to `size` bytes each, as rows."""
    rows = np.zeros((len(maps), size), np.uint8)
    for i, m in enumerate(maps):
        rows[i] = np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, size), axis=0)
    return rows


def most_shared_of_all(rows: list[bytes], columns: list[bytes], n_rows: np.ndarray, n_columns: np.ndarray) -> np.ndarray:
    """`most_shared` of every row with every column, the smaller of both directions."""
    out = np.zeros((len(rows), len(columns)), np.int64)
    size_r, size_c = np.array([len(b) for b in rows]), np.array([len(b) for b in columns])
    for x in np.unique(size_r):
        for y in np.unique(size_c):
            r, c, size = np.flatnonzero(size_r == x), np.flatnonzero(size_c == y), min(x, y)
            a, b = folded([rows[i] for i in r], size), folded([columns[i] for i in c], size)
            both = np.zeros((len(r), len(c)), np.float32)
            for at in range(0, size, 512):  # counts stay below 2**24, so they are exact
                both += np.unpackbits(a[:, at: at + 512], axis=1).astype(np.float32) @ np.unpackbits(b[:, at: at + 512], axis=1).astype(np.float32).T
            both = both.astype(np.int64)
            alone_r, alone_c = _ONES[a].sum(axis=1)[:, None] - both, _ONES[b].sum(axis=1)[None, :] - both
            out[np.ix_(r, c)] = np.minimum(n_rows[r][:, None] - alone_r, n_columns[c][None, :] - alone_c)
    return out


def forest(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of the edges (one, two) make a spanning forest; earlier edges go first."""
    nodes, at = np.unique(np.concatenate([one, two]), return_inverse=True)
    u, v = at[: len(one)], at[len(one):]
    edge, taken = np.arange(len(u)), np.zeros(len(u), bool)
    while len(u):
        best = np.full(len(nodes), len(taken))
        np.minimum.at(best, u, edge)
        np.minimum.at(best, v, edge)
        mine = (best[u] == edge) | (best[v] == edge)  # the first edge of either end
        taken[edge[mine]] = True
        label = np.arange(len(nodes))
        a, b = u[mine], v[mine]
        while True:  # trees of chosen edges get one label
            low = np.minimum(label[a], label[b])
            if (label[a] == label[b]).all():
                break
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label = label[label]
        u, v = label[u], label[v]
        apart = u != v
        u, v, edge = u[apart], v[apart], edge[apart]
    return taken


def likely_pairs(key: np.ndarray, probes: np.ndarray, component: np.ndarray, n: np.ndarray, bits: list[bytes], right: np.ndarray | None,
                 percent: int, most: int, some: bool = True) -> tuple[np.ndarray, np.ndarray, bool]:
    """(a, b, more): pairs of one tile that one side probes, that lie in different components and may reach the threshold.

    If there are more than `most`, these are chosen, none unless `some`: first a forest of the likeliest, then the likeliest between
    any two components; `more` tells of others. `right` marks the second block of a tile of two, whose pairs lie across.
    """
    rows, columns = (np.flatnonzero(~right), np.flatnonzero(right)) if right is not None else (np.flatnonzero(probes), np.arange(len(key)))
    ask = probes[rows][:, None] | probes[columns]
    if right is None:  # both members of a pair may probe: once is enough
        ask &= ~probes[columns] | (rows[:, None] < columns)
    small, large = np.minimum(n[rows][:, None], n[columns]), np.maximum(n[rows][:, None], n[columns])
    ask &= (component[rows][:, None] != component[columns]) & (100 * small >= percent * large)
    if not ask.any():
        return key[:0], key[:0], False
    r, c = np.nonzero(ask)
    if len(r) <= 24:
        both = np.array([min(most_shared(bits[rows[i]], bits[columns[j]], n[rows[i]]), most_shared(bits[columns[j]], bits[rows[i]], n[columns[j]]))
                         for i, j in zip(r, c)], np.int64)
    else:
        some_r, some_c = np.unique(r), np.unique(c)
        table = most_shared_of_all([bits[i] for i in rows[some_r]], [bits[j] for j in columns[some_c]], n[rows[some_r]], n[columns[some_c]])
        both = table[np.searchsorted(some_r, r), np.searchsorted(some_c, c)]
    x, y = rows[r], columns[c]
    union = n[x] + n[y] - both
    good = 100 * both >= percent * union
    x, y, share = x[good], y[good], (both / np.maximum(union, 1))[good]
    more = len(x) > most
    if more and not some:
        return key[:0], key[:0], True
    if more:
        order = np.lexsort((key[y], key[x], -share))
        x, y = x[order], y[order]
        one, two = np.minimum(component[x], component[y]), np.maximum(component[x], component[y])
        by_two = np.lexsort((two, one))  # stable: the likeliest pair of two components stays first
        start = np.append(True, (np.diff(one[by_two]) != 0) | (np.diff(two[by_two]) != 0))
        rank = np.empty(len(x), np.int64)
        rank[by_two] = np.arange(len(x)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        now = np.lexsort((rank, ~forest(one, two)))[:most]
        x, y = x[now], y[now]
    return np.minimum(key[x], key[y]), np.maximum(key[x], key[y]), more


def sieved(members: DataFrame, sets: DataFrame, percent: int, step: int, each: int, block: int) -> DataFrame:
    """(a, b, more): likely pairs of open groups, at most `each` per member of a tile; a row with `more` names a group (a)
    that has further ones.

    A set goes to all its open groups, so in the first round (`step` 0) it takes the small bitmap along, and later, to the groups
    that are left, the large one if that has at most 16 kB.
    """
    size = members.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    size = few_files(size.select("entry", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")), f"hot{step}")
    own = F.pmod(F.xxhash64("key1"), F.col("blocks")).cast("int")
    placed = members.join(size, "entry", "left").fillna(1, ["blocks"]).withColumn("own", own)
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), (F.col("own") > j).alias("right")))
    spread = placed.select("entry", "key1", "probes", "component", F.explode(tiles).alias("t")).join(
        sets.select("key1", "n", (F.when(F.col("n") < 1 << 14, F.col("bits")).otherwise(F.col("few_bits")) if step else F.col("few_bits")).alias("bits")),
        "key1").select(
        "entry", "t.i", "t.j", "t.right", "key1", "probes", "component", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            col = {c: table.column(c).to_numpy() for c in ("entry", "i", "j", "right", "key1", "probes", "component", "n")}
            bits = table.column("bits").to_pylist()
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(col["entry"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0), [True]]))
            a, b, again = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for s, e in zip(edge[:-1], edge[1:]):
                right = col["right"][s:e] if col["i"][s] != col["j"][s] else None
                x, y, more = likely_pairs(col["key1"][s:e], col["probes"][s:e], col["component"][s:e], col["n"][s:e], bits[s:e], right, percent,
                                          each * int(e - s), step > 0)
                a.append(x), b.append(y)
                if more:
                    again.append(col["entry"][s])
            a, b = np.concatenate([*a, np.array(again, np.int64)]), np.concatenate([*b, np.zeros(len(again), np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= len(a) - len(again))], ["a", "b", "more"])

        for batch in released(batches):
            if batch.num_rows:
                held.append(batch)
            if sum(h.nbytes for h in held) > 1 << 24:
                table = pa.Table.from_batches(held)
                e, i, j = (table.column(c).to_numpy() for c in ("entry", "i", "j"))
                open_tile = (e == e[-1]) & (i == i[-1]) & (j == j[-1])  # may go on in the next batch
                whole = int(len(e) - open_tile.sum())
                if whole:
                    yield solve(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    dealt = spread.repartition(partitions(members.sparkSession), "entry", "i", "j").sortWithinPartitions("entry", "i", "j")
    return dealt.mapInArrow(run, "a long, b long, more boolean")


def linked_documents(docs: DataFrame, k: int = 4, percent: int = 85, each: int = 1, block: int = 768) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key) of every document; text_key is xxhash64 of the text.

    The words of a text are runs without ASCII white space, A-Z lower-cased; a text with fewer than
    `k` words is one shingle; a text without words (or null) has size 0 and its own doc_id as
    component. Documents link when 100 * intersection >= percent * union of their sets;
    component_id is the smallest doc_id in reach. Null ids are kept and are no one's smallest;
    repeated rows link like other copies; other columns are ignored. `each` is the number of pairs per member
    that a tile gives at most in the first round, `block` the sets on one side of a tile; both
    change the work, not the result.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)  # texts and whole sets go to Python workers
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    rows = kept(set_rows(keyed, k), "rows")
    groups = kept(entry_groups(index_entries(keyed, k, percent, partitions(spark))), "groups")
    sets = kept(shared_sets(keyed, rows, groups, k), "sets", **_WIDE)

    # a first star per set: the centre, of those of its entries, that meets the most sets
    pairs = groups.join(centres(groups, "first"), "entry").filter("key1 <> centre").groupBy("key1").agg(
        F.max(F.struct("weight", "centre")).alias("best")).select(F.col("best.centre").alias("a"), F.col("key1").alias("b"))
    links = kept(verified(kept(pairs, "stars"), sets, percent, "first"), "links")
    component = few_files(connected_components(links), "components")
    tested, step = None, 0
    while True:
        members = mixed_groups(groups, component, step)
        found = few_files(sieved(members, sets, percent, step, each * 4 ** max(0, step - 1), block), f"sieved{step}")
        pairs = found.filter("NOT more").select("a", "b").distinct()
        pairs = few_files(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), f"likely{step}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not pairs.isEmpty():
            links = few_files(links.unionByName(verified(pairs, sets, percent, str(step))), f"links{step}")
            component = few_files(connected_components(links), f"components{step}")
        again = few_files(found.filter("more").select(F.col("a").alias("entry")).distinct(), f"again{step}")
        if again.isEmpty():
            break
        groups = few_files(groups.join(again, "entry", "left_semi"), f"groups{step}")
        step += 1

    # smallest doc_id per set, then per component; hot sets are one row before the last join
    own = kept(rows.filter("n > 0").groupBy("key1", "key2").agg(F.min("doc_id").alias("low")), "own")
    labelled = own.join(component.withColumnRenamed("id", "key1"), "key1", "left")
    lowest = labelled.filter("component is not null").groupBy("component").agg(F.min("low").alias("lowest"))
    found = kept(labelled.join(kept(lowest, "lowest"), "component", "left").select(
        "key1", "key2", F.coalesce("lowest", "low").alias("lowest")), "found")
    return rows.join(found, ["key1", "key2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_key")


def one_per_component(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """`docs` with one document of each component: that with the smallest doc_id, once if its row repeats.

    A row without an id stays if it is linked to no row with an id; texts without words all stay.
    """
    linked = kept(linked_documents(docs, k, percent), "linked")
    stay = linked.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("rows")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "rows")
    stay = kept(stay, "stay")

    def rows(which: DataFrame) -> DataFrame:
        same = docs.doc_id.cast("long").eqNullSafe(which["_id"]) & (F.xxhash64(docs.text) == which["_key"])
        return docs.join(which, same, "left_semi")

    repeated = stay.filter("rows > 1 and _id is not null")
    single = rows(stay.filter("rows = 1 or _id is null"))
    return single if repeated.isEmpty() else single.unionByName(rows(repeated).dropDuplicates(["doc_id", "text"]))


def shared_sets(keyed: DataFrame, rows: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(key1, n, bits, few_bits, shingles) of the sets that share an entry with another: one document of each is read again."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for piece in slices(batch, "text"):
                sets = [shingle_set(t, k) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([bitmap(s, 1) for s in sets], pa.binary()),
                     pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["key1", "n", "bits", "few_bits", "shingles"])

    wanted = groups.select("key1").distinct()
    one = rows.filter("n > 0").groupBy("key1").agg(F.min("text_key").alias("text_key")).join(wanted, "key1", "left_semi")
    # copies of one text share its key: the lowest doc_id stands for them
    copies = rows.join(kept(one, "wanted"), ["key1", "text_key"], "left_semi").groupBy("text_key", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    low = kept(copies.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows")).alias("low")).select(
        F.col("text_key").alias("_key"), F.col("low.doc_id").alias("_id"), F.col("low.rows").alias("rows")), "texts")
    held = name_filter(low.select(F.col("_key").alias("name")))

    def wanted_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):  # nearly all texts that are not wanted stay out of the join's exchange
            yield batch.filter(pa.array(read_filter(held).holds(np.asarray(batch.column("text_key")).astype(np.int64).view(np.uint64))))

    near = keyed.mapInArrow(wanted_texts, keyed.schema)
    same = (near.text_key == low["_key"]) & near.doc_id.eqNullSafe(low["_id"])
    found = near.join(low, same, "left_semi").select("text").mapInArrow(build, "key1 long, n long, bits binary, few_bits binary, shingles binary")
    # only a row that repeats with its id is read twice
    return found if low.filter("rows > 1").isEmpty() else found.dropDuplicates(["key1"])
