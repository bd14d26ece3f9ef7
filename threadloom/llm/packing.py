"""Packing of token pieces into training sequences, shortest pack first over the length histogram.

Documents are cut into full pieces of the sequence length and one rest. Only the histogram of
piece lengths (one count per length, so its size is that of the sequence length) reaches the
driver. There, lengths are placed longest first, always into the shortest pack, the one with the
most room; many equal packs at once, so a step updates the counts of packing patterns. Pieces then
find their place by rank: the r-th piece of a length belongs to the pattern whose interval of
ranks holds r.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.common import kept, released, slices, tokenizer
from threadloom.operators.ranking import with_group_position

PIECES = "doc_id long, text_key long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def token_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of at most `size` ids of every document, its `end_id` included.

    A null text is empty: one piece with `end_id` alone. A null doc_id is kept; repeated ids are
    separate documents, told apart by `text_key` where their texts differ. Other columns are
    ignored.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in released(batches):
            for part in slices(batch, "text", 4 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = []
                for doc_id, text, ids in zip(part.column("doc_id").to_pylist(), texts, encoder.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    key = zlib.crc32(ids.tobytes())
                    for start in range(0, len(ids), size):
                        own = ids[start: start + size].tobytes()
                        rows.append((doc_id, key, start, len(own) // 4, zlib.crc32(own), len(ids), own if with_ids else None))
                types = [pa.int64()] * 6 + [pa.binary()]
                names = [c.split()[0] for c in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)
    return pieces if with_ids else pieces.drop("ids")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences); the input counts are used up exactly.

    Packs are kept by the room they have left. Lengths come longest first; one goes to the shortest
    pack, the one with the most room, and to a new pack if it does not fit there. Equal packs take
    pieces at once, so the steps depend on the number of lengths, not of pieces.
    """
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        if room == 0:
            done.append((pattern, n))
        else:
            packs = by_room.setdefault(room, {})
            packs[pattern] = packs.get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(by_room, default=0)
            if room < length:
                put((length,), size - length, left)
                break
            packs = by_room[room]
            pattern = next(iter(packs))
            n = min(packs[pattern], left)
            packs[pattern] -= n
            if not packs[pattern]:
                del packs[pattern]
            if not packs:
                del by_room[room]
            put(pattern + (length,), room - length, n)
            left -= n
    done += [(p, n) for packs in by_room.values() for p, n in packs.items()]
    return done


def places(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence_id, offset): a run of equal places.

    Rank first + i of a length goes to sequence first_sequence + i, at `offset` there.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in sorted(shortest_pack_first(histogram, size), reverse=True):
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, first + n - 1, sequence, offset))
            used[length] = first + n
            offset += length
        sequence += n
    return rows


def pack(pieces: DataFrame, size: int = 2048, key: list[Column] | None = None) -> DataFrame:
    """`pieces` (with `length`) plus sequence_id and offset; offsets are gapless from 0 in a sequence.

    `pieces` is read three times: pass a stored table. Lengths must lie in 1..size. `key` orders the
    pieces of one length; ties are equal rows and may change places.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    if any(not 0 < n <= size for n in counts):
        raise ValueError(f"lengths must lie in 1..{size}")
    schema = "_length long, _first long, _last long, _sequence long, offset long, _page long"
    step = 4096  # ranks per page: a run is listed on each page it touches, so the join is an equality
    runs = places(counts, size)
    paged = spark.createDataFrame(
        runs, "_length long, _first long, _last long, _sequence long, offset long"
    ).withColumn("_page", F.explode(F.sequence(F.floor(F.col("_first") / step), F.floor(F.col("_last") / step))))
    order = key or [F.col(c) for c in ("doc_id", "start")]
    ranked = with_group_position(pieces, ["length"], order, "_rank").withColumn("_rank", F.col("_rank") - 1)
    same = (F.col("length") == F.col("_length")) & (F.floor(F.col("_rank") / step) == F.col("_page"))
    inside = F.col("_rank").between(F.col("_first"), F.col("_last"))
    return ranked.join(paged.select(*[c.split()[0] for c in schema.split(", ")]), same & inside).select(
        *pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Cut, store, pack: one row per piece with its sequence and place."""
    pieces = kept(token_pieces(docs, path, size, end_id, with_ids), "pieces")
    return pack(pieces, size, [F.col(c) for c in ("doc_id", "text_key", "start")])


def sequences(packed: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids binary, n_tokens): pieces joined in order of offset, padded to `size`
    unless their length is a power of two. A group is one sequence, so its size is bound."""
    joined = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    padding = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(size) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", F.when(power, ids).otherwise(F.concat(ids, padding)).alias("ids"), "n_tokens")
