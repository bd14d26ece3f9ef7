"""Registered queries: scans, sinks, cleaning, filters, sets and scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

from threadloom import schemas
from threadloom.functions import text as X
from threadloom.operators import clean, ranking, recs
from threadloom.plans.registry import query
from threadloom.plans.views import tok
from threadloom.runtime import scratch_path, spread
from threadloom.sources import files
from threadloom.sources.buckets import BucketTable

KEPT = """KP AS (SELECT * REPLACE (selftext AS selftext) FROM P WHERE selftext <> '[removed]' AND selftext IS NOT NULL),
  KC AS (SELECT C.*, coalesce(KP.title, '') AS title, coalesce(KP.selftext, '') AS parent_post
    FROM (SELECT * FROM C WHERE body IS NOT NULL) C LEFT JOIN KP ON split_part(C.link_id, '_', 2) = KP.id),
  U AS (SELECT id, author, subreddit, title, body, parent_post, false AS is_post, score, CAST(NULL AS BIGINT) AS num_comments,
      CAST(NULL AS BOOLEAN) AS archived FROM KC
    UNION ALL SELECT id, author, subreddit, title, selftext, '', true, score, num_comments, archived FROM KP)"""
UNION_COLUMNS = ["id", "author", "subreddit", "title", "body", "parent_post", "is_post", "score", "num_comments", "archived"]


def _landing(t):
    """Posts and comments written to shared scratch as a download would leave them."""
    path = scratch_path(t.spark, "landing")
    t.posts.write.parquet(f"{path}/all-posts.parquet")
    t.comments.write.parquet(f"{path}/all-comments.parquet")
    return path


@query("scan_union_by_suffix", views="P C", sql="""SELECT id, author, subreddit, body, kind FROM
  (SELECT id, author, subreddit, selftext AS body, 'post' AS kind FROM P
   UNION ALL SELECT id, author, subreddit, body, 'comment' FROM C)""")
def _(t):
    posts, comments = files.scan_threads(t.spark, _landing(t))
    posts = posts.select("id", "author", "subreddit", F.col("selftext").alias("body"), F.lit("post").alias("kind"))
    comments = comments.select("id", "author", "subreddit", "body", F.lit("comment").alias("kind"))
    return posts.unionByName(comments)


@query("audit_files", sql="""SELECT 'documents' AS folder, true AS readable, CAST(1 AS BIGINT) AS any_file
  FROM documents HAVING count(*) > 0
  UNION ALL SELECT 'broken', false, CAST(1 AS BIGINT) FROM documents HAVING count(*) > 0""")
def _(t):
    path = scratch_path(t.spark, "audit")
    t.documents.write.parquet(f"{path}/documents")
    # the same rows as plain text are not parquet
    t.documents.select("text").write.text(f"{path}/broken")
    found = files.audit_files(t.spark, [f"{path}/documents/part-*", f"{path}/broken/part-*"])
    folder = F.regexp_extract("path", "/(documents|broken)/", 1)
    return found.groupBy(folder.alias("folder"), "readable").agg(F.lit(1).cast("bigint").alias("any_file"))


@query("keyset_pages", sql="""SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 100) AS BIGINT) AS page
  FROM events""")
def _(t):
    return ranking.keyset_pages(t.events.select("ts", "event_id"), "ts", "event_id").select("event_id", "page")


@query("project_fields", views="P C", sql="""SELECT 'post' AS kind, author, score, created_utc, permalink, subreddit, id,
    title || coalesce(selftext, '') AS words, gilded, num_comments, CAST(NULL AS VARCHAR) AS link_id FROM P
  UNION ALL SELECT 'comment', author, score, created_utc, permalink, subreddit, id, coalesce(body, ''), NULL, NULL, link_id FROM C""")
def _(t):
    p = files.project_fields(t.posts, schemas.POSTS)
    c = files.project_fields(t.comments, schemas.COMMENTS)
    common = ["author", "score", "created_utc", "permalink", "subreddit", "id"]
    p = p.select(F.lit("post").alias("kind"), *common, F.concat("title", F.coalesce("selftext", F.lit(""))).alias("words"), "gilded", "num_comments")
    c = c.select(F.lit("comment").alias("kind"), *common, F.coalesce("body", F.lit("")).alias("words"), "link_id")
    return p.unionByName(c, allowMissingColumns=True)


@query("sink_parquet", sql="""SELECT doc_id, text, lang, source, n_chars,
  CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_index FROM documents""")
def _(t):
    path = scratch_path(t.spark, "docs")
    files.write_parquet(t.documents, path, codec="gzip", index_by=[F.col("doc_id")])
    return t.spark.read.parquet(path)


@query("scan_in_batches", sql="SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS error FROM documents")
def _(t):
    def lengths(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n": pdf["text"].str.len()})

    return files.map_batches(t.documents.select("doc_id", "text"), lengths, "doc_id bigint, n bigint")


@query("sink_put_jsonl", views="D", sql="""SELECT 'id:feed:post::' || id AS put, title, body, community AS subreddit_name,
  author, created_utc, permalink AS url FROM D""")
def _(t):
    d = t.docs
    docs = files.search_document(d.select(
        F.col("id").alias("reddit_id"), F.concat(F.lit("t3_"), F.col("id").cast("string")).alias("link_id"),
        F.col("community").alias("subreddit_name"), "title", "author", "created_utc", F.col("permalink").alias("url"), "body",
        "score", F.lit(-1).alias("num_comments"), F.lit(True).alias("is_post"), F.lit("").alias("parent_post"),
        F.lit(False).alias("archived"), "keywords"))
    path = scratch_path(t.spark, "put")
    files.put_lines(docs, "feed", "post", "reddit_id").write.text(path)
    back = F.from_json("value", T.StructType([T.StructField("put", T.StringType()), T.StructField("fields", schemas.SEARCH_DOCUMENT)])).alias("j")
    return t.spark.read.text(path).select(back).select(
        "j.put", "j.fields.title", "j.fields.body", "j.fields.subreddit_name", "j.fields.author", "j.fields.created_utc", "j.fields.url")


@query("sink_update_jsonl", views="V N", sql="""SELECT '{"update": "id:news:news::' || id || '", "fields": {"embedding": {"assign": { "values": ['
    || array_to_string(list_transform(v, lambda x: printf('%.6f', x)), ',') || ']} }}}' AS value FROM V
  UNION ALL SELECT '{"update":"id:news:news::' || item || '","fields":{"category_ctr_ref":{"assign":"id:category_ctr:category_ctr::global"},'
    || '"category_tensor":{"assign":{"cells":[{"address":{"category":"' || category || '"},"value":1.0}]}}}}' FROM N""")
def _(t):
    path = scratch_path(t.spark, "update")
    files.update_vector_lines(t.vectors, "id", "v", "news", "news").write.text(f"{path}/vectors")
    files.update_category_lines(t.news, "item", "category", "id:category_ctr:category_ctr::global").write.text(f"{path}/categories")
    return t.spark.read.text([f"{path}/vectors", f"{path}/categories"])


@query("scan_tsv", sql="""SELECT CAST(p_partkey AS VARCHAR) AS news_id, p_brand AS category, p_type AS subcategory, p_name AS title,
  '[{"WikidataId": "Q' || p_size || '"}]' AS title_entities FROM part""")
def _(t):
    path = scratch_path(t.spark, "news")
    entity = F.format_string('[{"WikidataId": "Q%d"}]', "p_size")
    files.write_tsv(t.part.select(
        F.col("p_partkey").cast("string"), "p_brand", "p_type", "p_name", F.lit("none"), F.lit("none"), entity, F.lit("[]")), path)
    return files.scan_tsv(t.spark, path, schemas.NEWS_TSV).select("news_id", "category", "subcategory", "title", "title_entities")


@query("scan_behaviors", views="I", sql="""SELECT imp_id AS impression_id, CAST(user_id AS VARCHAR) AS user_id, CAST(item AS VARCHAR) AS item, CAST(label AS INTEGER) AS label,
  CAST(row_number() OVER (PARTITION BY imp_id ORDER BY item) - 1 AS INTEGER) AS pos FROM I""")
def _(t):
    """Click lists written as packed lines, read back with the 5-column schema and unpacked."""
    path = scratch_path(t.spark, "behaviors")
    cell = F.concat_ws("-", F.col("item").cast("string"), F.col("label").cast("string"))
    lists = t.impressions.groupBy("imp_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("item", cell.alias("cell")))).alias("cells"))
    files.write_tsv(lists.select("imp_id", F.col("user_id").cast("string"), F.lit("11/15/2019 9:55:12 AM"), F.lit(""),
                                 F.array_join("cells.cell", " ")), path)
    lines = files.scan_tsv(t.spark, path, schemas.BEHAVIORS_TSV)
    return recs.parse_behaviors(lines).select("impression_id", "user_id", "item", "label", "pos")


@query("sink_user_vectors", views="V", sql="""SELECT '{"put": "id:user:user::' || id || '", "fields": {"user_id":"' || id || '", "embedding": {"values": ['
    || array_to_string(list_transform(v, lambda x: printf('%.6f', x)), ',') || ']} }}' AS value FROM V""")
def _(t):
    path = scratch_path(t.spark, "users")
    files.put_user_vector_lines(t.vectors, "id", "v").write.text(path)
    return t.spark.read.text(path)


@query("sink_category_ctr", views="I N", sql="""SELECT category, round(round(sum(label) / count(*), 12), 6) + 0.0 AS ctr FROM I JOIN N USING (item) GROUP BY category""")
def _(t):
    """The parent document with all categories' rates, written and read back cell by cell."""
    path = scratch_path(t.spark, "ctr")
    files.ctr_document(recs.ctr_by_category(t.impressions, t.news)).write.text(path)
    cells = "array<struct<address:struct<category:string>,value:double>>"
    body = F.from_json(F.get_json_object("value", "$.fields.ctrs.cells"), cells)
    return t.spark.read.text(path).select(F.explode(body).alias("c")).select(
        F.col("c.address.category").alias("category"), (F.round(F.round("c.value", 12), 6) + F.lit(0.0)).alias("ctr"))


@query("tsv_vectors_roundtrip", views="V", sql="""SELECT CAST(id AS VARCHAR) AS id, CAST(len(v) AS BIGINT) AS dims,
  round(list_sum(list_transform(v, lambda x: round(x, 4))), 4) + 0.0 AS total FROM V""")
def _(t):
    path = scratch_path(t.spark, "vec")
    files.write_vector_tsv(t.vectors, "id", "v", path, digits=4)
    total = F.aggregate(F.transform("vector", lambda x: F.round(x.cast("double"), 4)), F.lit(0.0), lambda s, x: s + x)
    return files.read_vector_tsv(t.spark, path).select(
        "id", F.size("vector").cast("bigint").alias("dims"), (F.round(total, 4) + F.lit(0.0)).alias("total"))


@query("upsert_by_key", sql="""SELECT coalesce(c.c_custkey, n.k) AS c_custkey,
    CASE WHEN n.k IS NOT NULL THEN n.c_acctbal ELSE c.c_acctbal END AS c_acctbal,
    CASE WHEN n.k IS NOT NULL THEN n.seg ELSE c.c_mktsegment END AS c_mktsegment, c.c_name
  FROM customer c FULL OUTER JOIN (SELECT o_custkey + 100 AS k, max(o_totalprice) AS c_acctbal,
    max_by(o_orderpriority, (o_totalprice, o_orderpriority)) AS seg FROM orders GROUP BY 1) n ON c.c_custkey = n.k""")
def _(t):
    new = t.orders.select((F.col("o_custkey") + 100).alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"),
                          F.col("o_orderpriority").alias("c_mktsegment"))
    old = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment", "c_name")
    table = BucketTable(t.spark, scratch_path(t.spark, "customers"), "c_custkey", buckets=16).create(old)
    table.upsert(new, ["c_acctbal", "c_mktsegment"])
    return table.rows().select(old.columns)


@query("deterministic_uuid", sql="""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS BIGINT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
  FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents)""")
def _(t):
    return t.documents.select("doc_id", X.uuid5(F.col("doc_id").cast("string")).alias("uuid"))


@query("entity_dimension", views="D", sql="""SELECT DISTINCT 'user' AS kind, author AS name, '{}' AS attributes FROM D
  UNION ALL SELECT DISTINCT 'community', community, NULL FROM D""")
def _(t):
    users = clean.entity_users(t.docs, "author").select(F.lit("user").alias("kind"), F.col("username").alias("name"), F.col("info").alias("attributes"))
    places = clean.entity_communities(t.docs, "community").select(F.lit("community").alias("kind"), "name", F.col("description").alias("attributes"))
    return users.unionByName(places)


# ---- projections and filters -------------------------------------------------

@query("drop_removed", views="P C", sql="""SELECT id, 'post' AS kind FROM P WHERE selftext <> '[removed]' AND selftext IS NOT NULL
  UNION ALL SELECT id, 'comment' FROM C WHERE body IS NOT NULL""")
def _(t):
    p = clean.drop_removed_posts(t.posts).select("id", F.lit("post").alias("kind"))
    return p.unionByName(clean.drop_empty_comments(t.comments).select("id", F.lit("comment").alias("kind")))


@query("rename_and_tag", views="P C", sql="""SELECT id, selftext AS body, true AS is_post, '' AS parent_post FROM P
  UNION ALL SELECT id, body, false, NULL FROM C""")
def _(t):
    p = clean.tag_posts(t.posts).select("id", "body", "is_post", "parent_post")
    return p.unionByName(clean.tag_comments(t.comments).select("id", "body", "is_post"), allowMissingColumns=True)


@query("fill_defaults", views="P C", sql="""SELECT id, coalesce(num_comments, -1) AS num_comments FROM P
  UNION ALL SELECT id, -1 FROM C""")
def _(t):
    return clean.fill_defaults(clean.union_posts_comments(t.posts, t.comments)).select("id", "num_comments")


@query("fill_archived", views="P C", sql="""SELECT id, coalesce(archived, true) AS compat, coalesce(archived, false) AS plain FROM P
  UNION ALL SELECT id, true, false FROM C""")
def _(t):
    u = clean.union_posts_comments(t.posts, t.comments).withColumn("raw", F.col("archived"))
    compat = clean.fill_defaults(u, True).withColumnRenamed("archived", "compat").withColumnRenamed("raw", "archived")
    return clean.fill_defaults(compat, False).select("id", "compat", F.col("archived").alias("plain"))


@query("judgement_filter", views="D", sql="""SELECT id, community FROM D JOIN labels ON id = doc_id WHERE quality = 1 AND toxic = 0""")
def _(t):
    from threadloom.operators.extract import judgement_filter
    verdicts = t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("space_match"), (F.col("toxic") == 0).alias("perspective_match"))
    return judgement_filter(t.docs.select("id", "community"), verdicts, "id")


# Model answers in the shape of an extraction, made from every event: one JSON text per event
ANSWER = """A AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Anger' WHEN 'view' THEN 'Frustration' WHEN 'signup' THEN 'Joy'
      WHEN 'purchase' THEN 'Worry' ELSE 'Amazement' END AS emotion,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)"""


def answers(t):
    """Pain point and persona answers as JSON text, with some broken ones, from every event."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    emotion = (F.when(F.col("event_type") == "error", "Anger").when(F.col("event_type") == "view", "Frustration")
               .when(F.col("event_type") == "signup", "Joy").when(F.col("event_type") == "purchase", "Worry").otherwise("Amazement"))
    topic = F.when(k < 10, F.lit('"a topic"')).when(k < 30, F.lit('{"name": "x", "match_space_topic": true, "match_quote_pain": false}')) \
        .when(k < 40, F.lit('{"name": "x"}')).otherwise(F.lit('{"name": "x", "match_space_topic": true}'))
    relevant = F.when(k >= 90, F.lit("")).when(F.col("value") > 20, F.lit(', "is_quote_relevant": false')).otherwise(F.lit(', "is_quote_relevant": true'))
    pain = F.concat(F.lit('{"pain_points": [{"post_id": "'), k.cast("string"), F.lit('", "title": "t'), F.col("event_id").cast("string"),
                    F.lit('", "issue_emotion": "'), emotion, F.lit('", "issue_topic": '), topic, relevant, F.lit("}]}"))
    persona = F.concat(F.lit('{"personas": [{"post_id": "'), k.cast("string"), F.lit('", "title": "p'), F.col("event_id").cast("string"), F.lit('"'), relevant, F.lit("}]}"))
    broken = F.col("value") < 1
    cut = lambda c: F.when(broken, F.concat(F.lit("sorry "), c)).otherwise(c)
    return t.events.select("event_id", cut(pain).alias("pain"), cut(persona).alias("persona"))


@query("pain_point_filter", views="", sql=f"""WITH {ANSWER} SELECT event_id, CAST(k AS VARCHAR) AS post_id, 't' || event_id AS title FROM A
  WHERE value >= 1 AND emotion IN ('Anger', 'Frustration') AND k >= 40 AND k < 90 AND value <= 20 AND k IN (SELECT doc_id FROM documents)""")
def _(t):
    from threadloom.operators.extract import pain_point_filter, pain_points_of
    points = pain_points_of(answers(t), "pain", ["event_id"])
    known = t.documents.select(F.col("doc_id").cast("string").alias("post_id"))
    return pain_point_filter(points, known).select("event_id", "post_id", "title")


@query("persona_filter", sql=f"""WITH {ANSWER} SELECT event_id, CAST(k AS VARCHAR) AS post_id, 'p' || event_id AS title FROM A
  WHERE value >= 1 AND k < 90 AND value <= 20 AND k IN (SELECT doc_id FROM documents)""")
def _(t):
    from threadloom.operators.extract import persona_filter, personas_of
    known = t.documents.select(F.col("doc_id").cast("string").alias("post_id"))
    return persona_filter(personas_of(answers(t), "persona", ["event_id"]), known).select("event_id", "post_id", "title")


@query("community_filter", views="D", sql="SELECT id, title, score FROM D WHERE community = 'src7'")
def _(t):
    return t.docs.filter(F.col("community") == "src7").select("id", "title", "score")


# ---- joins, counts, sets -----------------------------------------------------

@query("join_parent_post", views="P C", sql=f"WITH {KEPT} SELECT id, title, body, parent_post FROM KC")
def _(t):
    posts = clean.tag_posts(clean.drop_removed_posts(t.posts))
    return clean.join_parent_post(clean.drop_empty_comments(t.comments), posts).select("id", "title", "body", "parent_post")


@query("enrich_from_source", views="D", sql="""SELECT event_id, item, 'https://www.reddit.com' || permalink AS link, score,
    strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%d') AS day
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item FROM events) JOIN D ON item = id""")
def _(t):
    from threadloom.operators.report import enrich_from_source
    items = t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("item"))
    return enrich_from_source(items, t.docs, "item").select("event_id", "item", "link", "score", "day")


@query("semi_join_ids", views="D", sql="SELECT id, author, score FROM D WHERE id IN (SELECT doc_id FROM labels)")
def _(t):
    return t.docs.select("id", "author", "score").join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_semi")


NEWS_FILES = "(SELECT p_partkey, p_brand, p_name, {a} AS prio FROM part WHERE p_size < 30 UNION ALL SELECT p_partkey, p_type, p_name, {b} FROM part WHERE p_size > 20)"


def _news_files(t):
    first = t.part.filter("p_size < 30").select("p_partkey", "p_brand", "p_name")
    later = t.part.filter("p_size > 20").select("p_partkey", F.col("p_type").alias("p_brand"), "p_name")
    return [first, later]


@query("anti_join_seen", sql=f"SELECT p_partkey, min_by(p_brand, prio) AS p_brand, min_by(p_name, prio) AS p_name FROM {NEWS_FILES.format(a=0, b=1)} GROUP BY 1")
def _(t):
    return clean.first_by_priority(_news_files(t), "p_partkey")


@query("train_dev_merge", sql=f"SELECT p_partkey, max_by(p_brand, prio) AS p_brand, max_by(p_name, prio) AS p_name FROM {NEWS_FILES.format(a=0, b=1)} GROUP BY 1")
def _(t):
    return clean.first_by_priority(_news_files(t), "p_partkey", last_wins=True)


@query("bridge_user_community", sql="SELECT DISTINCT o_custkey AS user_id, l_suppkey AS community_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(t):
    pairs = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id")).join(
        t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("community_id")), "o_orderkey")
    return clean.bridge_pairs(pairs, "user_id", "community_id")


@query("drop_repeated_bodies", sql="""SELECT doc_id, source FROM documents
  WHERE text NOT IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def _(t):
    return clean.drop_repeated_bodies(t.documents, "text", num=1).select("doc_id", "source")


@query("count_by_community", sql="SELECT source AS community, count(*) AS n_rows FROM documents GROUP BY 1")
def _(t):
    return clean.count_by_community(t.documents, "source")


@query("latest_time", sql="SELECT event_type AS community, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY 1")
def _(t):
    return clean.time_bounds(t.events, "event_type", "ts").select("community", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("earliest_time", sql="SELECT event_type AS community, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest FROM events GROUP BY 1")
def _(t):
    return clean.time_bounds(t.events, "event_type", "ts").select("community", F.date_format("earliest", "yyyy-MM-dd HH:mm:ss").alias("earliest"))


@query("count_parsed_values", sql=r"""SELECT value, count(*) AS n FROM (
    SELECT unnest(CASE WHEN s LIKE '[%' AND s LIKE '%]' THEN list_transform(string_split(s[2:-2], ','),
        lambda x: CASE WHEN trim(x) = '' THEN 'None' ELSE trim(x) END) ELSE [CASE WHEN s = '' THEN 'None' ELSE s END] END) AS value
    FROM (SELECT trim(replace(CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN event_type ELSE '[' || event_type || ', ' || json_extract_string(props, '$.k') || ',]' END
      || ' <Finish>', '<Finish>', '')) AS s FROM events)) GROUP BY 1""")
def _(t):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", F.col("event_type")).otherwise(
        F.concat(F.lit("["), F.col("event_type"), F.lit(", "), k, F.lit(",]")))
    return t.events.select(F.explode(X.parse_bracket_list(F.concat(raw, F.lit(" <Finish>")))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_docs", sql="""SELECT lang, count(*) AS n_rows, count(DISTINCT text) AS n_texts, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1""")
def _(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.sha2("text", 256)).alias("n_texts"), F.countDistinct("source").alias("n_sources"))


@query("union_posts_comments", views="P C", sql=f"WITH {KEPT} SELECT id, title, body, is_post, num_comments, archived FROM U")
def _(t):
    posts = clean.tag_posts(clean.drop_removed_posts(t.posts))
    comments = clean.join_parent_post(clean.tag_comments(clean.drop_empty_comments(t.comments)), posts)
    return clean.union_posts_comments(posts, comments).select("id", "title", "body", "is_post", "num_comments", "archived")


CLEAN_SQL = f"""WITH {KEPT} SELECT subreddit AS community, is_post, count(*) AS n_rows, sum(CASE WHEN parent_post <> '' THEN 1 ELSE 0 END)::BIGINT AS with_parent,
    sum(coalesce(num_comments, -1))::BIGINT AS sum_comments, sum(CASE WHEN coalesce(archived, true) THEN 1 ELSE 0 END)::BIGINT AS n_archived
  FROM U WHERE body NOT IN (SELECT body FROM U GROUP BY body HAVING count(*) > 25) GROUP BY 1, 2"""


@query("clean_threads", views="P C", sql=CLEAN_SQL)
def clean_report(t):
    """Rows per community after the whole cleaning job."""
    return clean.clean_threads(t.posts, t.comments).groupBy(F.col("subreddit").alias("community"), "is_post").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("parent_post") != "", 1).otherwise(0)).alias("with_parent"),
        F.sum("num_comments").alias("sum_comments"), F.sum(F.col("archived").cast("int")).alias("n_archived"))


@query("distinct_ordered_ids", sql=f"""SELECT conv_id, turn, list_concat(l, ['', ''])[1] AS first_id, list_concat(l, ['', ''])[2] AS second_id FROM (
    SELECT conv_id, turn, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS l FROM (
      SELECT conv_id, turn, list_concat({tok('text')}, {tok('role')}) AS ids FROM conversations))""")
def _(t):
    ids = clean.distinct_ordered(X.tokens(F.col("text")), X.tokens(F.col("role")))
    return t.conversations.select("conv_id", "turn", ids.alias("ids")).select("conv_id", "turn", F.col("ids")[0].alias("first_id"), F.col("ids")[1].alias("second_id"))


@query("latest_n", sql="""SELECT event_type, event_id, rn FROM (SELECT event_type, event_id,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 10""")
def _(t):
    return ranking.top_k_per_group(t.events.select("event_type", "event_id", "ts"), ["event_type"], [F.desc("ts"), F.col("event_id")], 10) \
        .select("event_type", "event_id", F.col("rn").cast("bigint").alias("rn"))


# ---- order, batches, samples -------------------------------------------------

@query("edge_reorder", sql="""SELECT doc_id, CAST(CASE WHEN i % 2 = 0 THEN ceil(n / 2) - 1 - i / 2 ELSE ceil(n / 2) + (i - 1) / 2 END AS BIGINT) AS position
  FROM (SELECT doc_id, count(*) OVER () AS n, count(*) OVER () - row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i FROM documents)""")
def _(t):
    return ranking.edge_reorder(t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "position")


@query("batch_ids", sql="""SELECT CAST(floor((rn - 1) / 50) AS BIGINT) AS batch, count(*) AS n_rows, md5(string_agg(text, chr(10) ORDER BY rn)) AS digest
  FROM (SELECT text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1""")
def _(t):
    out = ranking.batch_rows(t.documents.select("doc_id", "text"), [F.col("doc_id")], "text", 50, sep="\n")
    return out.select("batch", "n_rows", F.md5("text").alias("digest"))


@query("sample_rows", sql="""SELECT event_id, kind FROM (
    SELECT event_id, 'bernoulli' AS kind FROM events WHERE CAST('0x' || substr(md5('1|' || event_id), 1, 8) AS BIGINT) < CAST(0.1 * 4294967296 AS BIGINT)
    UNION ALL (SELECT event_id, 'fixed' FROM events ORDER BY CAST('0x' || substr(md5('1|' || event_id), 1, 12) AS BIGINT), event_id LIMIT 100))""")
def _(t):
    ids = t.events.select("event_id")
    b = ranking.sample_bernoulli(ids, "event_id", 0.1).withColumn("kind", F.lit("bernoulli"))
    return b.unionByName(ranking.sample_fixed(ids, "event_id", 100).withColumn("kind", F.lit("fixed")))


# ---- scalar functions --------------------------------------------------------

def scalar(key, table, columns, sql, views=""):
    """Register a projection: Spark columns of a table against a SELECT."""
    @query(key, sql=sql, views=views)
    def _(t):
        return getattr(t, table).select(*columns())


c = F.col
scalar("strip_type_prefix", "comments", lambda: ["id", X.strip_type_prefix(c("link_id")).alias("parent")],
       "SELECT id, split_part(link_id, '_', 2) AS parent FROM C", "C")

TITLE = r"""array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|\P{{L}}+'), lambda r: upper(r[1]) || lower(r[2:])), '')"""
scalar("post_slug_title", "posts", lambda: ["id", X.post_slug_title(c("permalink")).alias("title_text"),
       X.post_slug_title(F.concat(F.lit("/r/x/comments/y/it's_a-2nd_"), c("id"), F.lit(".html/"))).alias("odd_title")],
       "SELECT id, CASE WHEN slug <> '' THEN " + TITLE.format(x=r"regexp_replace(regexp_replace(slug, '[_-]', ' ', 'g'), '\.\w+$', '')")
       + " END AS title_text, 'It''S A 2Nd ' || id AS odd_title FROM (SELECT id, regexp_extract(permalink, '/r/[^/]+/comments/[^/]+/([^/]+)/', 1) AS slug FROM P)", "P")
scalar("permalink_title", "posts", lambda: ["id", X.permalink_title(c("permalink")).alias("title_text")],
       "SELECT id, nullif(replace(regexp_extract(permalink, '/comments/[^/]+/([^/]+)/', 1), '_', ' '), '') AS title_text FROM P", "P")
scalar("full_link", "docs", lambda: ["id", X.full_link(c("permalink")).alias("link")],
       "SELECT id, 'https://www.reddit.com' || permalink AS link FROM D", "D")
scalar("ascii_only", "documents", lambda: ["doc_id", X.ascii_only(c("text")).alias("ascii")],
       r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS ascii FROM documents")
scalar("rerank_text", "docs", lambda: ["id", X.rerank_text(c("community"), c("title"), c("body")).alias("scored"),
       X.rerank_value(c("community"), c("title"), c("body")).alias("stored")],
       "SELECT id, 'Subreddit:' || community || ' Title:' || title || ' Post: ' || body AS scored, 'Subreddit:' || community || ' Title:' || title || ' Post: ' || substr(body, 1, 2000) AS stored FROM D", "D")
scalar("post_block_text", "docs", lambda: ["id", X.post_block([("Text", X.ascii_only(c("body"))), ("Link", X.full_link(c("permalink"))),
       ("Created At", X.iso_utc(c("created_utc"))), ("Author", c("author")), ("Score", c("score")), ("post_id", c("id"))]).alias("block")],
       r"""SELECT id, '- POST:' || chr(10) || '- Text: ' || regexp_replace(body, '[^\x00-\x7F]', '', 'g') || chr(10) || '- Link: https://www.reddit.com' || permalink
       || chr(10) || '- Created At: ' || strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%dT%H:%M:%S') || chr(10) || '- Author: ' || author
       || chr(10) || '- Score: ' || score || chr(10) || '- post_id: ' || id AS block FROM D""", "D")
scalar("template_fill", "benchmark", lambda: ["item_id", X.template_fill(X.choose_template(
       F.when(c("item_id") < 20, "ask").otherwise("other"), {"ask": "Find {space} about {topic} for {who}"}),
       {"space": c("text"), "topic": c("item_id").cast("string"), "who": F.lit(None).cast("string")}).alias("prompt")],
       "SELECT item_id, CASE WHEN item_id < 20 THEN 'Find ' || text || ' about ' || item_id || ' for {who}' ELSE 'Unknown template' END AS prompt FROM benchmark")
scalar("parse_bracket_list", "events", lambda: ["event_id", F.array_join(X.parse_bracket_list(F.concat(F.lit(" ["), c("event_type"),
       F.lit(" , ,"), F.get_json_object("props", "$.k"), F.lit("]<Finish>"))), "/").alias("items"),
       F.array_join(X.parse_bracket_list(F.when(c("value") > 10, c("event_type")).otherwise("<Finish>")), "/").alias("single")],
       "SELECT event_id, event_type || '/None/' || json_extract_string(props, '$.k') AS items, CASE WHEN value > 10 THEN event_type ELSE 'None' END AS single FROM events")


@query("tagged_json_extract", sql="""SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END::BIGINT AS n,
  CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(t):
    el = T.StructType([T.StructField("k", T.LongType())])
    key = F.when(c("event_type") == "error", "Other").otherwise("PainPoints")
    raw = F.concat(F.lit('Here:\n<json>\n{"'), key, F.lit('": ['), c("props"), F.lit("]}\n</json> and <json>{}</json>"))
    found = X.tagged_json_list(raw, "PainPoints", el)
    return t.events.select("event_id", F.size(found).cast("bigint").alias("n"), F.get(found, F.lit(0))["k"].alias("k"))


scalar("escape_quotes", "events", lambda: ["event_id", X.escape_quotes(F.concat(c("props"), F.lit(r' \"kept\"'))).alias("escaped")],
       r"""SELECT event_id, replace(props, '"', '\"') || ' \"kept\"' AS escaped FROM events""")


@query("json_or_empty", sql="""SELECT event_id, value >= 5 AS json_ok, CASE WHEN value >= 5 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(t):
    raw = F.when(c("value") < 5, F.replace(c("props"), F.lit("}"), F.lit(""))).otherwise(c("props"))
    j = X.json_or_empty(raw, T.StructType([T.StructField("k", T.LongType())]))
    return t.events.select("event_id", j.alias("j")).select("event_id", "j.json_ok", "j.k")


scalar("epoch_to_utc", "docs", lambda: ["id", X.iso_utc(c("created_utc")).alias("iso")],
       "SELECT id, strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso FROM D", "D")
scalar("format_day", "events", lambda: ["event_id", X.day_text(c("ts")).alias("day"), X.day_number(c("ts")).alias("day_number")],
       "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day_number FROM events")
scalar("parse_us_time", "events", lambda: ["event_id", F.date_format(X.parse_us_time(F.date_format("ts", "M/d/yyyy h:mm:ss a")), "yyyy-MM-dd HH:mm:ss").alias("time")],
       "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time FROM events")
scalar("emotion_polarity", "events", lambda: ["event_id", X.emotion_polarity(F.when(c("event_type") == "error", F.lit('{"enum": ["Fear", "Joy"]}'))
       .when(c("event_type") == "view", "Curiosity").when(c("event_type") == "click", "0.25").otherwise("Nonsense")).alias("polarity")],
       "SELECT event_id, CAST(CASE event_type WHEN 'error' THEN -0.8 WHEN 'view' THEN 0.5 WHEN 'click' THEN 0.25 ELSE 0.0 END AS DOUBLE) AS polarity FROM events")
scalar("join_keywords", "conversations", lambda: ["conv_id", "turn", X.join_keywords(X.tokens(c("text"))).alias("keywords")],
       f"SELECT conv_id, turn, array_to_string({tok('text')}, ', ') AS keywords FROM conversations")


@query("text_stats")
def _(t):
    """Counts over whole texts; word boundaries of SQL engines differ outside ASCII, so a test compares with written-out code."""
    return spread(t.documents).select("doc_id", X.text_stats(c("text")).alias("s")).filter("s IS NOT NULL").select("doc_id", *[
        c(f"s.{a}").cast("bigint").alias(b) for a, b in (("word_count", "words"), ("sentence_count", "sentences"), ("paragraph_count", "paragraphs"))])


@query("list_flatten_split", sql=f"""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
  array_to_string(list_transform(string_split(text, chr(10)), lambda p: CAST(len({tok('p')}) AS VARCHAR)), ',') AS line_words FROM documents""")
def _(t):
    from threadloom.operators.infer import flatten_lists, regroup_lists
    lines = t.documents.select("doc_id", F.split("text", "\n").alias("lines"))
    done = flatten_lists(lines, "doc_id", "lines").withColumn("value", F.size(X.tokens(c("value"))).cast("string"))
    return regroup_lists(done, "doc_id").select("doc_id", F.size("values").cast("bigint").alias("n_lines"), F.array_join("values", ",").alias("line_words"))


@query("bold_matches", views="D QT", sql=r"""SELECT id, array_to_string(list_transform(regexp_extract_all(title, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'),
  lambda r: CASE WHEN list_contains(ts, lower(r)) THEN '<hi>' || r || '</hi>' ELSE r END), '') AS marked FROM D, (SELECT list(DISTINCT term) AS ts FROM QT)""")
def _(t):
    from threadloom.operators.lexical import bold_field
    return bold_field(t.docs.select("id", "title"), "id", "title", t.query_terms.select("term").distinct()).select("id", "marked")
