"""Cleaning of posts and comments and joining comments to their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.functions.text import strip_type_prefix
from threadloom.runtime import stored


def drop_removed_posts(posts: DataFrame, text: str = "selftext") -> DataFrame:
    return posts.filter((F.col(text) != "[removed]") & F.col(text).isNotNull())


def drop_empty_comments(comments: DataFrame, text: str = "body") -> DataFrame:
    """Only nulls go; a comment saying [removed] stays."""
    return comments.filter(F.col(text).isNotNull())


def tag_posts(posts: DataFrame) -> DataFrame:
    return (
        posts.withColumnRenamed("selftext", "body")
        .withColumn("is_post", F.lit(True)).withColumn("parent_post", F.lit(""))
    )


def tag_comments(comments: DataFrame) -> DataFrame:
    return comments.withColumn("is_post", F.lit(False))


def join_parent_post(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Add the parent's title and body; '' when the parent is missing or was removed.

    Ids are unique after the reduction, so each comment keeps one row. The reduced posts are
    stored before the join: a post with a third of all comments is then a hot key on the
    comment side only, which the adaptive skew join splits, and posts are broadcast only
    when their size is known to be small.
    """
    parents = stored(posts.groupBy("id").agg(F.min(F.struct("title", "body")).alias("_p")).select(
        F.col("id").alias("_pid"), F.col("_p.title").alias("_title"), F.col("_p.body").alias("_body")
    ), "parents")
    return (
        comments.withColumn("_key", strip_type_prefix(F.col("link_id")))
        .join(parents, F.col("_key") == F.col("_pid"), "left")
        .withColumn("title", F.coalesce("_title", F.lit("")))
        .withColumn("parent_post", F.coalesce("_body", F.lit("")))
        .drop("_key", "_pid", "_title", "_body")
    )


def union_posts_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    return comments.unionByName(posts, allowMissingColumns=True)


def _digest(body: str):
    return F.unhex(F.sha2(F.col(body), 256))


def repeated_bodies(bodies: DataFrame, body: str = "body", num: int = 25) -> DataFrame:
    """SHA-256 digests of the texts seen more than `num` times; null texts are never repeated.

    The shuffle moves digests that are already added up per task, not texts.
    """
    seen = bodies.select(_digest(body).alias("_h")).groupBy("_h").agg(F.count("_h").alias("_n"))
    return seen.filter(F.col("_n") > num).select("_h")


def drop_repeated_bodies(df: DataFrame, body: str = "body", num: int = 25, repeated: DataFrame | None = None) -> DataFrame:
    """Remove every row of a body seen more than `num` times.

    Only repeated digests come back. They are stored first: few ones are broadcast, and with many
    the adaptive skew join can split the rows of a hot body. `repeated` passes stored digests that
    were counted elsewhere.
    """
    found = stored(repeated_bodies(df, body, num), "repeated") if repeated is None else repeated
    return df.withColumn("_h", _digest(body)).join(found, "_h", "left_anti").drop("_h")


def fill_defaults(df: DataFrame, archived_compat: bool = True) -> DataFrame:
    """num_comments -1; a missing archived flag is true in the compatible form, else false."""
    return df.withColumn("num_comments", F.coalesce("num_comments", F.lit(-1))).withColumn(
        "archived", F.coalesce("archived", F.lit(archived_compat))
    )


def clean_threads(
    posts: DataFrame, comments: DataFrame, num: int = 25, archived_compat: bool = True
) -> DataFrame:
    """The whole cleaning job.

    Repeats are counted on the bare bodies and dropped before the parents are joined: the join
    does not change a body, so it runs once and on fewer rows. A repeated post is still the
    parent of its comments.
    """
    all_posts = tag_posts(drop_removed_posts(posts))
    all_comments = tag_comments(drop_empty_comments(comments))
    repeated = stored(repeated_bodies(all_comments.select("body").unionByName(all_posts.select("body")), num=num), "repeated")
    kept_posts, kept_comments = (drop_repeated_bodies(df, repeated=repeated) for df in (all_posts, all_comments))
    both = union_posts_comments(kept_posts, join_parent_post(kept_comments, all_posts))
    return fill_defaults(both, archived_compat)


def count_by_community(df: DataFrame, community: str = "subreddit") -> DataFrame:
    return df.groupBy(F.col(community).alias("community")).agg(F.count(F.lit(1)).alias("n_rows"))


def time_bounds(df: DataFrame, community: str, ts: str) -> DataFrame:
    """First and last time per community; communities without rows have no row."""
    return df.groupBy(F.col(community).alias("community")).agg(
        F.min(ts).alias("earliest"), F.max(ts).alias("latest")
    )


def first_by_priority(parts: list[DataFrame], key: str, last_wins: bool = False) -> DataFrame:
    """Union of files where one row per key is kept: from the first file, or from the last.

    One partial aggregate over `(priority, row)`; equal keys inside a file keep the smallest row.
    """
    tagged = None
    for i, part in enumerate(parts):
        p = part.withColumn("_prio", F.lit(-i if last_wins else i))
        tagged = p if tagged is None else tagged.unionByName(p)
    others = [c for c in parts[0].columns if c != key]
    best = tagged.groupBy(key).agg(F.min(F.struct("_prio", *others)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in others])


def upsert_by_key(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Insert new keys and overwrite the named columns of known ones. Equal new keys are reduced first."""
    picked = new.groupBy(key).agg(F.max(F.struct(*columns)).alias("_v")).select(
        F.col(key).alias("_k"), "_v"
    )
    joined = old.join(picked, old[key] == F.col("_k"), "full_outer")
    keep = []
    for c in old.columns:
        if c == key:
            keep.append(F.coalesce(old[key], F.col("_k")).alias(key))
        elif c in columns:
            keep.append(F.when(F.col("_k").isNotNull(), F.col(f"_v.{c}")).otherwise(old[c]).alias(c))
        else:
            keep.append(old[c])
    return joined.select(*keep)


def entity_users(df: DataFrame, author: str) -> DataFrame:
    """User dimension: one row per author with empty attributes."""
    return df.select(F.col(author).alias("username")).filter(F.col("username").isNotNull()).distinct().select(
        "username", F.lit("{}").alias("flairs"), F.lit("{}").alias("interactions"), F.lit("{}").alias("info")
    )


def entity_communities(df: DataFrame, name: str) -> DataFrame:
    """Community dimension: one row per name; attributes are filled by a later upsert."""
    return df.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct().select(
        "name", F.lit(None).cast("string").alias("description"), F.lit(None).cast("bigint").alias("subscribers")
    )


def bridge_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.select(left, right).distinct()


def distinct_ordered(a, b, size: int = 2, pad: str = ""):
    """Ids of both lists in order, without repeats, cut or padded to `size`."""
    joined = F.array_distinct(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))
    return F.slice(F.concat(joined, F.array_repeat(F.lit(pad), size)), 1, size)
