"""A stored table whose changes rewrite only the hash partitions they touch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.operators.clean import upsert_by_key
from threadloom.runtime import exists, stored

BUCKET = "bucket"


class BucketTable:
    """Rows with unique keys in `buckets` hash partitions under one path.

    A change is merged in three steps: rows that would change nothing are dropped, the buckets of the others are read
    (the scan is pruned to them), and the merged buckets replace the old ones by a dynamic partition
    overwrite. So a small batch costs its buckets, a replayed batch writes nothing, and every rewrite leaves a
    bucket in one file. A run that dies half way can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, parts: int) -> None:
        self._placed(df).repartition(parts, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            BUCKET).parquet(self.path)

    def create(self, df: DataFrame) -> BucketTable:
        self._write(df, self.buckets)
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def _merge(self, changed: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """The buckets that were rewritten."""
        changed = stored(self._placed(changed), "changed")
        touched = sorted(r[0] for r in changed.select(BUCKET).distinct().collect())  # `buckets` numbers at most
        if touched:
            old = self.spark.read.parquet(self.path).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
            self._write(stored(merge(old, changed.drop(BUCKET)), "merged"), len(touched))
        return touched

    def upsert(self, new: DataFrame, columns: list[str]) -> list[int]:
        """Insert new keys and overwrite the named columns of known ones (see `upsert_by_key`)."""
        picked = new.groupBy(self.key).agg(F.max(F.struct(*columns)).alias("_v")).select(self.key, *[F.col(f"_v.{c}").alias(c) for c in columns])
        old = self.rows().select(F.col(self.key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
        changed = picked.join(old, (F.col(self.key) == F.col("_k")) & same, "left_anti")
        return self._merge(changed, lambda old, new: upsert_by_key(old, new, self.key, columns))

    def keep_newest(self, new: DataFrame, order: list[str]) -> list[int]:
        """Of every key the row with the greatest `order` stays, whichever came first."""
        others = [c for c in new.columns if c not in (self.key, *order)]

        def last(df: DataFrame) -> DataFrame:
            best = df.groupBy(self.key).agg(F.max(F.struct(*order, *others)).alias("_r"))
            return best.select(self.key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *others]])

        new = last(new)
        if not exists(self.spark, self.path):
            self.create(new)
            return list(range(self.buckets))
        old = self.rows().select(F.col(self.key).alias("_k"), F.struct(*[F.col(c) for c in [*order, *others]]).alias("_o"))
        changed = new.join(old, (F.col(self.key) == F.col("_k")) & (F.col("_o") >= F.struct(*order, *others)), "left_anti")
        return self._merge(changed, lambda old, new: last(old.select(new.columns).unionByName(new)))
