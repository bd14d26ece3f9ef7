"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id, then digest of the payload, url and reference. Shards are cut at exact
ranks in this order, not at sampled bounds, so the same table and number of shards always give the same
files, byte for byte, however the table is partitioned. A shard rolls to the next file when the compressed size is reached, every
record is a gzip member of its own, and headers and digests are made anew from the payload. Files
are written under temporary names and renamed; the manifest, written last, lists the whole ones.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm.common import kept, make_folder, partitions, slices, store
from threadloom.operators.ranking import with_row_index

MANIFEST = "file string, n_records long, n_bytes long, first_id long, last_id long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
_SPACE_ID = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page-record")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """`pages` (page_id, url, html) plus `refers_to`: the largest page_id with the same payload of at
    least `least` bytes, null for that row itself and for short payloads.

    Digests that occur once are dropped before the join, the rest is stored first: a hot digest is
    one row there, and the planner may split its pages. Rows that repeat the largest id are all
    responses; a null id is smaller than any, and stays a response if its group has no other.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary")))
    shared = kept(
        pages.select("page_id", digest.alias("_digest")).filter("_digest is not null").groupBy("_digest").agg(
            F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "digests")
    marked = pages.withColumn("_d", digest).join(shared, F.col("_d") == F.col("_digest"), "left")
    revisits = F.col("_response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_response"))
    return marked.select("page_id", "url", "html", F.when(revisits, F.col("_response")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, str(page_id))}>"


def _header_value(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC 1.1 record: a response with its payload, or a revisit with the HTTP head alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    encode = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
            f"WARC-Block-Digest: {encode(block)}", f"WARC-Payload-Digest: {encode(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name: equal data, equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


KEY = ["page_id", "digest", "url", "refers_to"]


def shard_bounds(keys: DataFrame, shards: int) -> list[tuple]:
    """The first key of every shard but the first: exact ranks, at most `shards` rows. Equal keys stay together."""
    ranked = kept(with_row_index(keys.select(KEY), [F.col(c) for c in KEY], "rank", start=0), "ranks")
    step = max(1, -(-ranked.count() // shards))
    return [_order(*r) for r in ranked.filter((F.col("rank") % step == 0) & (F.col("rank") > 0)).orderBy("rank").select(KEY).collect()]


def _order(page_id: int | None, digest: str, url: str | None, refers_to: int | None) -> tuple:
    """A key that Python orders as Spark does: nulls first."""
    return tuple((v is not None, v if v is not None else 0) for v in (page_id, digest, url, refers_to))


def write_warc(pages: DataFrame, roll: int = 64 << 20, shards: int | None = None,
               date: str = "2024-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Write marked pages (page_id, url, html, refers_to); returns the folder and its manifest.

    A null html is an empty payload, a null url leaves its header out, nulls sort first; rows that repeat an id are
    ordered by payload digest, url and reference, so one id may fill several shards; rows equal in all of these
    lie in one shard; other columns are ignored; an empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    folder = make_folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        out = name = temporary = None
        shard, number, rows = None, 0, []

        def close():
            nonlocal out
            out.close()
            fs.move(temporary, posixpath.join(base, name))
            out = None

        for batch in batches:
            for piece in slices(batch, "html"):
                for r in piece.to_pylist():
                    data = member(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"], date))
                    if out is not None and (r["shard"] != shard or rows[-1]["n_bytes"] + len(data) > roll):
                        close()
                    if out is None:
                        number = number if r["shard"] == shard else 0
                        shard = r["shard"]
                        name = f"shard-{shard:06d}-{number:05d}.warc.gz"
                        temporary = posixpath.join(base, f"_temporary-{name}-{uuid.uuid4().hex}")
                        out = fs.open_output_stream(temporary, compression=None)
                        rows.append({"file": name, "n_records": 0, "n_bytes": 0, "first_id": r["page_id"], "last_id": None})
                        number += 1
                    out.write(data)
                    row = rows[-1]
                    row["n_records"] += 1
                    row["n_bytes"] += len(data)
                    row["last_id"] = r["page_id"]
        if out is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]))

    shards = shards or partitions(spark)
    keyed = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), "url", "refers_to", "html")
    bounds = shard_bounds(keyed, shards)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in KEY))
            shard = pa.array([bisect.bisect_right(bounds, _order(*k)) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], [*batch.schema.names, "shard"])

    placed = keyed.mapInArrow(place, "page_id long, digest string, url string, refers_to long, html string, shard int")
    ordered = placed.repartition(shards, "shard").sortWithinPartitions("shard", *KEY)
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest.parquet")
    return folder, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest.parquet")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    data = b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data:
                data = stream.read(chunk)
                if not data:
                    raise ValueError("truncated member")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Type, ids and payload facts of one record; ValueError if a length or a digest does not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record length")
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != declared:
        raise ValueError("payload digest")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["WARC-Type"] == "response" and size != len(payload):
        raise ValueError("payload length")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": declared, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"),
            "payload": payload if fields["WARC-Type"] == "response" else None}


def read_warc(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Every record of the files that the manifest lists; `payload` adds the bytes of responses."""
    schema = READ + (", payload binary" if payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest.parquet").select("file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        arrow = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])
        fs, base = store(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(posixpath.join(base, file), compression=None) as stream:
                    for data in members(stream):
                        rows.append({**parse(data), "file": file})
                        held += len(data) if payload else 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], arrow)

    return files.repartition(partitions(spark), "file").mapInArrow(read, schema)
