"""Incremental pulls and continuous feeding, in batch and in Structured Streaming."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.sources.buckets import BucketTable

log = logging.getLogger("threadloom")


def pull_windows(stored: DataFrame, communities: DataFrame, community: str, ts: str, now: Column, years: int) -> DataFrame:
    """(community, forward_start, forward_end, back_start, back_end) per community.

    Forward: from one second after the last stored row, at most `years` back, until now.
    Backfill: from `years` back until one second before the first stored row.
    """
    horizon = now - F.make_interval(days=F.lit(365 * years))
    sec = F.make_interval(secs=F.lit(1))
    have = stored.groupBy(community).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    return communities.join(have, community, "left").select(
        community,
        F.greatest(F.col("_last") + sec, horizon).alias("forward_start"), now.alias("forward_end"),
        F.least(F.col("_first"), horizon).alias("back_start"), F.coalesce(F.col("_first") - sec, now).alias("back_end"),
    )


def _between(source: DataFrame, windows: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows inside the widest window of all communities: literals, so the bound reaches the scan."""
    widest = windows.agg(F.min(start).alias("a"), F.max(end).alias("b")).first()
    if widest.a is None or widest.b is None:
        return source
    kind = source.schema[ts].dataType
    return source.filter(F.col(ts).between(F.lit(widest.a).cast(kind), F.lit(widest.b).cast(kind)))


def pull_forward(source: DataFrame, windows: DataFrame, community: str, ts: str) -> DataFrame:
    """Rows newer than what is stored. The window table has one row per community."""
    w = windows.select(community, "forward_start", "forward_end")
    return _between(source, windows, ts, "forward_start", "forward_end").join(w, community).filter(F.col(ts).between(F.col("forward_start"), F.col("forward_end"))).drop("forward_start", "forward_end")


def pull_backfill(source: DataFrame, windows: DataFrame, community: str, ts: str) -> DataFrame:
    """Rows older than what is stored."""
    w = windows.select(community, "back_start", "back_end")
    return _between(source, windows, ts, "back_start", "back_end").join(w, community).filter(F.col(ts).between(F.col("back_start"), F.col("back_end"))).drop("back_start", "back_end")


def resume_append(source: DataFrame, path: str, ts: str, key: str) -> int:
    """Append to `path` the rows after its last (time, key); nothing that is there is rewritten."""
    spark = source.sparkSession
    last = spark.read.parquet(path).agg(F.max(F.struct(ts, key)).alias("m")).first()["m"]
    if last is not None:
        t, k = F.lit(last[0]), F.lit(last[1])
        source = source.filter((F.col(ts) >= t) & ((F.col(ts) > t) | (F.col(key) > k)))
    source.write.mode("append").parquet(path)
    return 0 if last is None else 1


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is there now, batch by batch; the checkpoint remembers what was done."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_log(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps every batch in its own folder.

    Replaying a batch overwrites its folder with the same rows, and no batch rewrites the
    table, so the cost of a batch does not grow with what is stored.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:010d}")

    return write


def upsert_newest(table: BucketTable, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the newest row of every key in a bucketed table: only the buckets that really
    change are rewritten, so no read merges batches and a replayed batch writes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.keep_newest(batch, order)

    return write


def current_rows(spark: SparkSession, path: str, key: str, order: list[str]) -> DataFrame:
    """The last version of every key: by `order`, then by batch. One partial aggregate."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    others = [c for c in rows.columns if c not in (key, "batch", *order)]
    last = rows.groupBy(key).agg(F.max(F.struct(*order, "batch", *others)).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *others]])


def compact_log(spark: SparkSession, path: str, target: str, key: str, order: list[str]) -> None:
    """Write the current rows as the first batch of a new log, so reads stay cheap over time."""
    current_rows(spark, path, key, order).write.parquet(f"{target}/batch={0:010d}")


def distinct_within(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Drop repeated keys with bounded state; later repeats are settled by `current_rows`."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def feed(prepare: Callable[[DataFrame], DataFrame], path: str, failed: list[int] | None = None, tries: int = 3,
         dead_letters: str | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer that prepares lines and writes them.

    A batch that fails `tries` times is not lost: its input rows go to `<dead_letters>/batch=<id>`
    (default `<path>-dead`), from where they can be fed again. If they cannot be written either, the
    stream stops before its checkpoint moves on.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(tries):
            try:
                prepare(batch).write.mode("overwrite").text(f"{path}/batch={batch_id:010d}")
                return
            except Exception:
                log.exception("batch %s failed, attempt %s", batch_id, attempt + 1)
        batch.write.mode("overwrite").parquet(f"{dead_letters or path + '-dead'}/batch={batch_id:010d}")
        if failed is not None:
            failed.append(batch_id)

    return write
