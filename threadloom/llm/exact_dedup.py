"""Exact duplicates by a heavy-hitter split.

A table of digests is written first, so texts are read once and never shuffled. Each task sums up its
digests in a Misra-Gries summary; the merged summaries name every digest that may hold a large share
of all rows. Those few are counted exactly and their winners go to all tasks, which settle the copies
where they are (map-side). All other digests are too rare to be hot and take the ordinary shuffle.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.common import kept, partitions

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    """A-Z to lower case, nothing else; null is the empty text. Plain `lower` does the same for ASCII texts, faster."""
    text = F.coalesce(text, F.lit(""))
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(exact)


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class MisraGries:
    """At most `counters` keys with counts that fall short of the true ones by at most rows / (counters + 1)."""

    def __init__(self, counters: int):
        self.counters = counters
        self.held = pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})

    def add(self, column: pa.Array) -> None:
        seen = pc.value_counts(column)
        new = pa.table({"digest": seen.field("values").cast(pa.binary()), "n": seen.field("counts")})
        both = pa.concat_tables([self.held, new]).group_by("digest").aggregate([("n", "sum")])
        both = both.rename_columns(["digest", "n"])
        if both.num_rows > self.counters:  # the largest count without a counter goes off every count
            order = pc.sort_indices(both, [("n", "descending")])
            less = both["n"][order[self.counters].as_py()]
            both = both.set_column(1, "n", pc.subtract(both["n"], less))
            both = both.filter(pc.greater(both["n"], 0))
        self.held = both.combine_chunks()


def frequent_digests(rows: DataFrame, counters: int) -> DataFrame:
    """(digest): all that more than 2 / counters of all rows hold, and at most `counters` digests.

    A merged count falls short by at most rows / (counters + 1), so a digest with that many rows keeps a
    merged count above rows / counters; the merged counts sum to at most the number of rows, so
    fewer than `counters` digests can have as much.
    """
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, n = MisraGries(counters), 0
        for batch in batches:
            if batch.num_rows:
                summary.add(batch.column(0))
                n += batch.num_rows
        yield from summary.held.to_batches()
        yield pa.RecordBatch.from_pydict({"digest": pa.array([None], pa.binary()), "n": pa.array([n], pa.int64())})

    found = kept(rows.select("digest").mapInArrow(summarise, "digest binary, n long"), "summaries")
    total = found.filter("digest IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    merged = found.filter("digest IS NOT NULL").groupBy("digest").agg(F.sum("n").alias("n"))
    return merged.filter(F.col("n") * counters > F.lit(total)).select("digest")


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`, dropped ones too.

    Texts are equal when their normalised forms have one SHA-256. Of equal texts the row with the largest
    id stays; a null id is below all others, and of rows with the same id and text exactly one stays. A
    null text equals the empty one. An empty table gives no rows; other columns are not read, whatever
    their names. `counters` (default: four per shuffle partition) is the size of a summary: a digest that
    is not frequent holds at most half a partition's fair share of the rows (2 / counters of all), and at most
    `counters` winners of 60 bytes travel to the tasks.
    """
    spark = docs.sparkSession
    counters = counters or max(64, 4 * partitions(spark))
    rows = kept(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"),
                            F.monotonically_increasing_id().alias("row")), "digests")
    frequent = kept(frequent_digests(rows, counters), "frequent")
    winner = F.max(F.struct("doc_id", (-F.col("row")).alias("row")))  # null ids first, then the first of equal rows
    heavy = rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(winner.alias("w"), F.count(F.lit(1)).alias("group_size"))
    heavy = kept(heavy, "winners")
    here = rows.join(F.broadcast(heavy), "digest")  # no shuffle: a hot group stays where it is
    one = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "digest", "doc_id", "row", winner.over(one).alias("w"), F.count(F.lit(1)).over(one).alias("group_size"))
    return here.select("digest", "doc_id", "row", "w", "group_size").unionByName(rest).select(
        "doc_id", F.col("w.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("w.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns as they are.

    Digests meet the table of what stays; texts are not shuffled unless several rows share both id and text:
    of those, any one stays (they are equal but for other columns).
    """
    marked = kept(mark_copies(docs, text, doc_id, counters), "marked")
    own = marked.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("text_sha256", "keep_id").agg(
        (F.count(F.lit(1)) > 1).alias("_tied"))
    own = kept(own.select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep"), "_tied"), "stay")
    named = docs.withColumn("_text_digest", F.sha2(normalised(F.col(text)).cast("binary"), 256))
    met = named.join(own, (F.col("_text_digest") == F.col("_sha")) & F.col(doc_id).eqNullSafe(F.col("_keep")))
    alone = met.filter(~F.col("_tied"))
    tied = met.filter("_tied").dropDuplicates(["_text_digest"])
    return alone.unionByName(tied).select(*[F.col(f"`{c}`") for c in docs.columns])
