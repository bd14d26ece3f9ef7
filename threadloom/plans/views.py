"""Derived tables that the registered queries share, in Spark and in SQL.

All of them are built from whole given tables: posts and comments from conversations,
search documents from documents, query texts from every benchmark item, impressions from
every event.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.functions import text as X
from threadloom.functions.vectors import as_double
from threadloom.runtime import ARROW_BYTES, stored

EPOCH = 1704067200  # start of the made-up timeline of conversations and documents
DIMS = 64           # width of the given vectors


def _slug(title):
    return F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_")


def rotate(v, n: int):
    """Components n+1.. first: a second vector with the same values."""
    return F.concat(F.slice(v, n + 1, DIMS - n), F.slice(v, 1, n))


class Tables:
    """Lazy access to the given tables of one directory and to the shared views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)  # whole texts go to Python workers

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def posts(self) -> DataFrame:
        c, title, n = F.col, F.split_part("text", F.lit("."), F.lit(1)), F.length("text")
        return self.conversations.filter("turn = 0").select(
            c("role").alias("author"), F.when(n > 250, True).alias("archived"), title.alias("title"),
            n.cast("bigint").alias("score"),
            F.when(c("role") == "system", "[removed]").when(n < 60, None).otherwise(c("text")).alias("selftext"),
            F.concat(F.lit("/r/"), "role", F.lit("/comments/"), c("conv_id").cast("string"), F.lit("/"),
                     _slug(title), F.lit("/")).alias("permalink"),
            c("role").alias("subreddit"), (F.lit(EPOCH) + c("conv_id") * 3600).cast("bigint").alias("created_utc"),
            F.lit(0).cast("bigint").alias("gilded"), c("conv_id").cast("string").alias("id"),
            F.when(n > 100, F.length(title)).cast("bigint").alias("num_comments"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        c, n = F.col, F.length("text")
        post = c("conv_id").cast("string")
        link = F.concat(F.lit("t3_"), post)
        return self.conversations.filter("turn > 0").select(
            c("role").alias("author"), n.cast("bigint").alias("score"),
            (F.lit(EPOCH) + c("conv_id") * 3600 + c("turn") * 60).cast("bigint").alias("created_utc"),
            F.concat(F.lit("/r/"), "role", F.lit("/comments/"), post, F.lit("/reply/")).alias("permalink"),
            F.when(n < 130, None).when(n > 600, "[removed]").otherwise(c("text")).alias("body"),
            c("role").alias("subreddit"),
            F.concat(post, F.lit("_"), c("turn").cast("string")).alias("id"),
            link.alias("parent_id"), link.alias("link_id"),
        )

    @cached_property
    def docs(self) -> DataFrame:
        title = F.split_part("text", F.lit("."), F.lit(1))
        return self.documents.select(
            F.col("doc_id").alias("id"), F.col("text").alias("body"), title.alias("title"),
            F.col("source").alias("community"), "lang", F.col("n_chars").alias("score"),
            F.concat_ws("_", "lang", "source").alias("author"),
            (F.lit(EPOCH) + F.col("doc_id") * 60).alias("created_utc"),
            F.concat(F.lit("/r/"), "source", F.lit("/comments/"), F.col("doc_id").cast("string"), F.lit("/"),
                     _slug(title), F.lit("/")).alias("permalink"),
            F.array_distinct(F.filter(X.tokens(title), lambda t: F.length(t) > 6)).alias("keywords"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), as_double(F.col("embedding")).alias("v"), "label")

    @cached_property
    def query_terms(self) -> DataFrame:
        return self.benchmark.select(
            F.col("item_id").alias("qid"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")
        )

    @cached_property
    def query_vectors(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("qid")).join(
            self.vectors.select(F.col("id").alias("qid"), "v"), "qid")

    @cached_property
    def doc_vectors(self) -> DataFrame:
        """All documents with body, title and keyword vectors, null for those without one; written once,
        as every leg of a hybrid search reads them."""
        kv = F.when(F.col("v").isNotNull(), F.array(rotate(F.col("v"), 16), rotate(F.col("v"), 32)))
        return stored(self.docs.join(self.vectors, "id", "left").withColumn("tv", F.reverse("v")).withColumn("kv", kv), "docs")

    @cached_property
    def impressions(self) -> DataFrame:
        """One row per (user, day, item): clicked or not, and where it stood."""
        e = self.events
        return e.select(
            F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("imp_id"),
            "user_id", F.to_date("ts").alias("day"),
            F.get_json_object("props", "$.k").cast("bigint").alias("item"),
            F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("label"), "event_id",
        ).groupBy("imp_id", "user_id", "day", "item").agg(
            F.max("label").cast("bigint").alias("label"), F.min("event_id").alias("seen"))

    @cached_property
    def news(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("item"), F.col("p_brand").alias("category"), F.col("p_type").alias("subcategory"),
            F.col("p_name").alias("title"))

    @cached_property
    def persona_items(self) -> DataFrame:
        """Extracted statements: persona = order priority, cluster = brand, score = price."""
        return (
            self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
            .join(self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("persona")), "l_orderkey")
            .join(self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("cluster")), "l_partkey")
            .select("persona", "cluster", F.col("l_extendedprice").alias("score"),
                    F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                                F.col("l_partkey").cast("string")).alias("item"))
        )


def tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


SQL_VIEWS = {
    "P": f"""P AS (SELECT role AS author, CASE WHEN length(text) > 250 THEN true END AS archived,
        split_part(text, '.', 1) AS title, CAST(length(text) AS BIGINT) AS score,
        CASE WHEN role = 'system' THEN '[removed]' WHEN length(text) < 60 THEN NULL ELSE text END AS selftext,
        '/r/' || role || '/comments/' || conv_id || '/'
          || regexp_replace(lower(split_part(text, '.', 1)), '[^a-z0-9]+', '_', 'g') || '/' AS permalink,
        role AS subreddit, CAST({EPOCH} + conv_id * 3600 AS BIGINT) AS created_utc, CAST(0 AS BIGINT) AS gilded,
        CAST(conv_id AS VARCHAR) AS id,
        CASE WHEN length(text) > 100 THEN CAST(length(split_part(text, '.', 1)) AS BIGINT) END AS num_comments
        FROM conversations WHERE turn = 0)""",
    "C": f"""C AS (SELECT role AS author, CAST(length(text) AS BIGINT) AS score,
        CAST({EPOCH} + conv_id * 3600 + turn * 60 AS BIGINT) AS created_utc,
        '/r/' || role || '/comments/' || conv_id || '/reply/' AS permalink,
        CASE WHEN length(text) < 130 THEN NULL WHEN length(text) > 600 THEN '[removed]' ELSE text END AS body,
        role AS subreddit, conv_id || '_' || turn AS id, 't3_' || conv_id AS parent_id, 't3_' || conv_id AS link_id
        FROM conversations WHERE turn > 0)""",
    "D": f"""D AS (SELECT doc_id AS id, text AS body, split_part(text, '.', 1) AS title, source AS community, lang,
        n_chars AS score, lang || '_' || source AS author, {EPOCH} + doc_id * 60 AS created_utc,
        '/r/' || source || '/comments/' || doc_id || '/'
          || regexp_replace(lower(split_part(text, '.', 1)), '[^a-z0-9]+', '_', 'g') || '/' AS permalink,
        list_distinct(list_filter({tok("split_part(text, '.', 1)")}, lambda t: length(t) > 6)) AS keywords
        FROM documents)""",
    "V": "V AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)",
    "QT": f"QT AS (SELECT item_id AS qid, unnest(list_distinct({tok('text')})) AS term FROM benchmark)",
    "QV": "QV AS (SELECT item_id AS qid, v FROM benchmark JOIN V ON item_id = id)",
    "DV": """DV AS (SELECT D.*, V.v, V.label, list_reverse(V.v) AS tv,
        [list_concat(V.v[17:64], V.v[1:16]), list_concat(V.v[33:64], V.v[1:32])] AS kv FROM D JOIN V USING (id))""",
    "I": """I AS (SELECT user_id || '_' || strftime(ts, '%Y%m%d') AS imp_id, user_id, CAST(ts AS DATE) AS day,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS item,
        CAST(max(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS BIGINT) AS label,
        min(event_id) AS seen FROM events GROUP BY ALL)""",
    "N": "N AS (SELECT p_partkey AS item, p_brand AS category, p_type AS subcategory, p_name AS title FROM part)",
    "PI": """PI AS (SELECT o_orderpriority AS persona, p_brand AS cluster, l_extendedprice AS score,
        l_orderkey || '-' || l_linenumber || '-' || l_partkey AS item
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    # BM25 in long form over the four fields of D; BM has one row per query, document and field
    "BM": f"""DF0 AS (SELECT id, 'title' AS field, {tok('title')} AS toks FROM D
          UNION ALL SELECT id, 'body', {tok('body')} FROM D
          UNION ALL SELECT id, 'keywords', keywords FROM D
          UNION ALL SELECT id, 'community', {tok('community')} FROM D),
        FL AS (SELECT field, count(*) AS n, avg(len(toks)) AS avgdl FROM DF0 GROUP BY field),
        TF AS (SELECT id, field, dl, term, count(*) AS tf
          FROM (SELECT id, field, len(toks) AS dl, unnest(toks) AS term FROM DF0)
          WHERE term IN (SELECT term FROM QT) GROUP BY ALL),
        DFQ AS (SELECT field, term, count(*) AS df FROM TF GROUP BY ALL),
        BM AS (SELECT q.qid, t.id, t.field, sum(ln(1 + (n - df + 0.5) / (df + 0.5))
            * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
          FROM TF t JOIN DFQ USING (field, term) JOIN FL USING (field) JOIN QT q ON q.term = t.term
          GROUP BY q.qid, t.id, t.field),
        BW AS (SELECT qid, id, round(coalesce(sum(s) FILTER (field = 'title'), 0), 12) AS title,
            round(coalesce(sum(s) FILTER (field = 'body'), 0), 12) AS body,
            round(coalesce(sum(s) FILTER (field = 'keywords'), 0), 12) AS keywords,
            round(coalesce(sum(s) FILTER (field = 'community'), 0), 12) AS community
          FROM BM GROUP BY qid, id)""",
    # sign codes and all query x document scores the hybrid twins need
    "SC": """SC AS (SELECT qid, id, 1 / (1 + CAST(list_sum(list_transform(list_zip(DV.v, QV.v),
            lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS DOUBLE)) AS ham,
          list_sum(list_transform(list_zip(DV.v, QV.v), lambda p: CASE WHEN p[1] > 0 THEN p[2] ELSE -p[2] END)) AS inv,
          list_sum(list_transform(list_zip(DV.tv, QV.v), lambda p: CASE WHEN p[1] > 0 THEN p[2] ELSE -p[2] END)) AS tinv,
          list_cosine_similarity(DV.v, QV.v) AS bcos, list_cosine_similarity(DV.tv, QV.v) AS tcos,
          greatest(list_cosine_similarity(DV.kv[1], QV.v), list_cosine_similarity(DV.kv[2], QV.v)) AS kcos
          FROM DV, QV)""",
}
