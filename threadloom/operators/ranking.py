"""Row numbers, positions inside groups, top-k and sampling that hold up under skew.

A plain `row_number` over a whole table, or over a group that holds a third of it,
runs in one task. The helpers here range-partition on the full order instead, so a hot
group is spread over many tasks, and add small per-partition offsets. Windows are kept
for top-k, where Spark prunes each task's input first (WindowGroupLimit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions.text import md5_number
from threadloom.runtime import durable


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted, range-partitioned rows with their partition number, fixed by a checkpoint.

    The checkpoint matters for correctness too: the partition numbers are read twice and
    must not change when a task is run again.
    """
    return durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )


def with_row_index(df: DataFrame, order: list[Column], name: str = "rn", start: int = 1) -> DataFrame:
    """Consecutive numbers in `order` (which must be total) without a one-task window."""
    ranged = _ranged(df, order)
    # one row per partition: this window sorts a few thousand numbers at most
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + F.col("_pos") + F.lit(start)).cast("bigint"))
        .drop("_pid", "_pos", "_off")
    )


def with_group_position(
    df: DataFrame, group: list[str], order: list[Column], name: str = "pos", size: str | None = None
) -> DataFrame:
    """1-based position of each row in its group's `order`; `size` adds the group's row count.

    Rows are numbered within (group, partition) and shifted by the group's rows in earlier
    partitions, so a hot group is handled by many tasks.
    """
    ranged = _ranged(df, [F.col(g) for g in group] + list(order))
    keys = group + ["_pid"]
    spans = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_pid")
    spans = spans.withColumn(
        "_off", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    if size:
        everything = Window.partitionBy(*group)
        spans = spans.withColumn(size, F.sum("_n").over(everything))
    spans = spans.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_pid").alias("_p"), "_first", "_off", *([size] if size else [])
    )
    # null-safe so that a null group keeps its rows
    cond = F.col("_pid") == F.col("_p")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return ranged.join(spans, cond).select(
        *df.columns, (F.col("_pos") - F.col("_first") + F.col("_off") + 1).cast("bigint").alias(name),
        *([size] if size else []),
    )


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Best k rows of the whole table (each task keeps k, then one merge of k per task)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rn"
) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def merged_top_k(found: DataFrame, tasks: int, group: list[str], order: list[Column], k: int, fan_in: int = 64) -> DataFrame:
    """The k best per group from rows of which each of about `tasks` tasks has at most k per group.

    Merged in levels: no task of a level gets more than about `fan_in * k` rows of a group.
    """
    while tasks > fan_in:
        tasks = -(-tasks // fan_in)
        way = F.pmod(F.spark_partition_id(), F.lit(tasks))
        found = top_k_per_group(found.withColumn("_way", way), [*group, "_way"], order, k).drop("rn", "_way")
    return top_k_per_group(found, group, order, k)


def best_per_key(df: DataFrame, key: list[str], score: str, tie: str, keep: list[str]) -> DataFrame:
    """The row with the highest score per key, lowest `tie` first: one partial aggregate.

    `(score, -rank of tie)` is ordered by taking the maximum score and the minimum tie among
    equal scores through a struct, so hot keys are reduced before the shuffle.
    """
    others = [c for c in keep if c not in (score, tie)]
    best = F.min(F.struct((-F.col(score)).alias("_neg"), F.col(tie), *[F.col(c) for c in others]))
    return df.groupBy(*key).agg(best.alias("_b")).select(
        *key, (-F.col("_b._neg")).alias(score), F.col(f"_b.{tie}").alias(tie),
        *[F.col(f"_b.{c}").alias(c) for c in others],
    )


def batch_rows(df: DataFrame, order: list[Column], text: str, size: int, sep: str = "") -> DataFrame:
    """Consecutive batches of `size` rows with their texts joined in order."""
    if not 1 <= size <= 200:
        raise ValueError("batch size must be between 1 and 200")
    numbered = with_row_index(df, order, "_rn", start=0)
    return (
        numbered.withColumn("batch", F.floor(F.col("_rn") / size).cast("bigint"))
        .groupBy("batch")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.array_sort(F.collect_list(F.struct("_rn", F.col(text).alias("_t")))).alias("_items"),
        )
        .select("batch", "n_rows", F.array_join(F.transform("_items", lambda x: x["_t"]), sep).alias("text"))
    )


def edge_reorder(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Best rows at both ends, weakest in the middle."""
    ranked = with_row_index(df, order, "_k", start=0)
    n = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = ranked.withColumn("_n", n).withColumn("_i", F.col("_n") - 1 - F.col("_k"))
    half = F.ceil(F.col("_n") / 2)
    pos = F.when(F.col("_i") % 2 == 0, half - 1 - (F.col("_i") / 2).cast("bigint")).otherwise(
        half + ((F.col("_i") - 1) / 2).cast("bigint")
    )
    return ranked.withColumn(name, pos.cast("bigint")).drop("_k", "_n", "_i")


def keyset_pages(df: DataFrame, ts: str, key: str, size: int = 100) -> DataFrame:
    """Page number of each row in (time, key) order; no row on a boundary second is lost."""
    return with_row_index(df, [F.col(ts), F.col(key)], "_rn", start=0).withColumn(
        "page", F.floor(F.col("_rn") / size).cast("bigint")
    ).drop("_rn")


def keyset_page(df: DataFrame, ts: str, key: str, after: tuple | None, size: int = 100) -> DataFrame:
    """One page after the cursor `(time, key)`; the filter reaches the scan."""
    if after is not None:
        t, k = F.lit(after[0]), F.lit(after[1])
        df = df.filter((F.col(ts) >= t) & ((F.col(ts) > t) | (F.col(key) > k)))
    return df.orderBy(ts, key).limit(size)


def sample_fixed(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """Exactly n rows (or all), the same ones on every run."""
    return df.orderBy(md5_number(F.lit(seed), F.col(key), digits=12), key).limit(n)


def sample_bernoulli(df: DataFrame, key: str, p: float, seed: int = 1) -> DataFrame:
    """Each row with probability p, the same ones on every run."""
    return df.filter(md5_number(F.lit(seed), F.col(key), digits=8) < F.lit(int(p * (1 << 32))))


def dense_index(df: DataFrame, key: str, seen_at: list[str], name: str) -> DataFrame:
    """0..n-1 per distinct key in order of first sight."""
    first = df.groupBy(key).agg(F.min(F.struct(*seen_at)).alias("_first"))
    return with_row_index(first, [F.col("_first"), F.col(key)], name, start=0).drop("_first")
