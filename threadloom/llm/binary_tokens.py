"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A data file is a row of frames: length (u64), masked crc32 of the length, payload, masked crc32
of the payload. A payload is: has-id flag (u8), id width in bytes (u8), doc_id (i64), then the
token ids. Beside it an index file holds the u64 offset of every frame and the file's end.
The mask (rotate right by 15, add a constant) keeps a checksum of data that itself holds
checksums from being trivial. Files are written under temporary names, renamed, and listed in a
manifest, so a retried task replaces its own files and a reader sees whole files only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm.common import commit_file, make_folder, partitions, slices, store, tokenizer

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<BBq")
_LENGTH = struct.Struct("<QI")
_CRC = struct.Struct("<I")


def masked_crc(data) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _CRC.pack(masked_crc(length)), payload, _CRC.pack(masked_crc(payload))))


def read_frame(read) -> bytes:
    """The payload at the reader's place; ValueError if a checksum or a length does not hold."""
    head = read(_LENGTH.size)
    if len(head) != _LENGTH.size:
        raise ValueError("truncated frame")
    n, crc = _LENGTH.unpack(head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("length checksum")
    body = read(n + 4)
    if len(body) != n + 4 or masked_crc(body[:n]) != _CRC.unpack(body[n:])[0]:
        raise ValueError("payload checksum")
    return body[:n]


def serialize(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id is not None, width, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    has, width, doc_id = _HEAD.unpack_from(payload)
    return (doc_id if has else None), np.frombuffer(payload, f"<u{width}", offset=_HEAD.size).astype("<u4")


def write_records(docs: DataFrame, path: str, end_id: int = 1, files: int | None = None) -> tuple[str, DataFrame]:
    """Tokenize `docs` (doc_id, text) and write the files in ascending doc_id order.

    Returns the folder and its manifest (file number, rows, tokens, bytes). A null text is empty
    (only `end_id` is written); a null doc_id sorts first; repeated ids are ordered by text;
    other columns are ignored; an empty table gives no rows in the manifest.
    """
    spark = docs.sparkSession
    folder = make_folder(spark, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, encoder = f"part-{part:06d}", tokenizer(path)
        offsets, tokens, at = [0], 0, 0

        def body(out):
            nonlocal tokens, at
            for batch in batches:
                for piece in slices(batch, "text", 4 << 20):
                    texts = [t or "" for t in piece.column("text").to_pylist()]
                    frames = []
                    for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(texts)):
                        ids = np.append(ids, np.uint32(end_id))
                        frames.append(frame(serialize(doc_id, ids, max(encoder.width, 2 if end_id < 1 << 16 else 4))))
                        at += len(frames[-1])
                        offsets.append(at)
                        tokens += len(ids)
                    out.write(b"".join(frames))

        size = commit_file(folder, f"{name}.bin", body)
        if len(offsets) > 1:
            commit_file(folder, f"{name}.idx", lambda out: out.write(np.asarray(offsets, "<u8").tobytes()))
            yield pa.RecordBatch.from_pylist([{"part": part, "n_rows": len(offsets) - 1, "n_tokens": tokens, "n_bytes": size}])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(
        files or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(write, "part long, n_rows long, n_tokens long, n_bytes long")
    manifest.write.parquet(f"{folder}/manifest.parquet")
    return folder, read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part long, n_rows long, n_tokens long, n_bytes long").parquet(f"{folder}/manifest.parquet")


def read_records(spark: SparkSession, folder: str, rows_per_task: int = 20_000) -> DataFrame:
    """(doc_id, part, row, ids) of every record; the ids are little-endian unsigned 32-bit integers.

    The offset index lets a task open its own range of rows, so ranges can be read in any order.
    """
    listed = sorted(read_manifest(spark, folder).collect())  # a row per file
    ranges, start = [], 0
    for r in listed:
        ranges += [(r.part, a, min(a + rows_per_task, r.n_rows)) for a in range(0, r.n_rows, rows_per_task)]
    schema = "part long, first long, last long"
    tasks = spark.createDataFrame(ranges, schema).repartition(max(1, min(len(ranges), partitions(spark))), "part", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("row", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                rows, size = [], 0
                for row, doc_id, ids in records_between(folder, r["part"], r["first"], r["last"]):
                    rows.append({"doc_id": doc_id, "part": r["part"], "row": row, "ids": ids.tobytes()})
                    size += ids.nbytes
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, out_schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, out_schema)

    return tasks.mapInArrow(read, "doc_id long, part long, row long, ids binary")


def records_between(folder: str, part: int, first: int, last: int) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(row, doc_id, ids) of the rows first..last-1 of one file, found through its index."""
    fs, base = store(folder)
    with fs.open_input_file(f"{base}/part-{part:06d}.idx") as f:
        f.seek(8 * first)
        offsets = np.frombuffer(f.read(8 * (last - first + 1)), "<u8")
    with fs.open_input_file(f"{base}/part-{part:06d}.bin") as f:
        f.seek(int(offsets[0]))
        for row in range(first, last):
            yield row, *deserialize(read_frame(f.read))


def record_summary(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, row) of every record, read back from the files.

    `start` needs the ids before a record: files are summed first (a row each in the manifest),
    rows inside a file by the task that reads it, so a file must be one range.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(doc_id, row, len(ids), zlib.crc32(ids.tobytes()))
                        for row, doc_id, ids in records_between(folder, r["part"], r["first"], r["last"])]
                doc_id, row, n, crc = zip(*rows)
                n = np.asarray(n, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id, pa.int64()), pa.array(r["base"] + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64()),
                     pa.array([r["part"]] * len(rows), pa.int64()), pa.array(row, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "part", "row"])

    listed = sorted(read_manifest(spark, folder).collect())  # a row per file
    ranges = [(r.part, 0, r.n_rows) for r in listed]
    starts = np.cumsum([0] + [r.n_tokens for r in listed])
    base = {r.part: int(s) for r, s in zip(listed, starts)}
    tasks = spark.createDataFrame([(*x, base[x[0]]) for x in ranges], "part long, first long, last long, base long")
    tasks = tasks.repartition(max(1, min(len(ranges), partitions(spark))), "part")
    return tasks.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long, part long, row long")
