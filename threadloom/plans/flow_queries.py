"""Registered queries: key phrases, pluggable functions, incremental pulls and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.functions import text as X
from threadloom.operators import infer, keywords
from threadloom.plans.registry import query
from threadloom.plans.search_queries import R, r6
from threadloom.plans.views import tok
from threadloom.runtime import scratch_path, stored as keep
from threadloom.sources import files
from threadloom.sources.buckets import BucketTable
from threadloom.streaming import incremental as inc

c = F.col


@query("keyphrases_mmr")
def _(t):
    return keywords.keyphrases(t.docs.select("id", "body"), "id", "body").select("id", F.posexplode("keywords").alias("place", "phrase"))


@query("attach_keywords")
def _(t):
    """Every document with its phrases in order; a test compares them with the written-out definition."""
    docs = t.docs.select("id", "title", "body")
    out = keywords.attach_keywords(docs, keywords.keyphrases(docs.select("id", "body"), "id", "body"), "id")
    return out.select("id", "title", F.array_join("keywords", "; ").alias("keywords"))


@query("embed_column", sql=f"""WITH T AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, count(*) AS n FROM (SELECT doc_id, unnest({tok('text')}) AS w FROM documents) GROUP BY 1, 2),
  A AS (SELECT doc_id, count(*) AS nnz, max(n) / sqrt(sum(n * n)) AS top, sum(n) / sqrt(sum(n * n)) AS total FROM T GROUP BY 1)
  SELECT doc_id, coalesce(nnz, 0) AS nnz, {R('coalesce(top, 0)')} AS top, {R('coalesce(total, 0)')} AS total FROM documents LEFT JOIN A USING (doc_id)""")
def _(t):
    v = infer.embed_column(t.documents.select("doc_id", "text"), "text", dims=64)
    return v.select("doc_id", F.size(F.filter("v", lambda x: x > 0)).cast("bigint").alias("nnz"), r6(F.array_max("v")).alias("top"),
                    r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("batch_infer", sql="""SELECT doc_id, NOT contains(text, 'License') AS ok, CASE WHEN contains(text, 'License') THEN '' ELSE CAST(length(text) AS VARCHAR) END AS result,
  CASE WHEN contains(text, 'License') THEN 'ValueError: refused' END AS error FROM documents""")
def _(t):
    def measure(texts):
        if any("License" in x for x in texts):
            raise ValueError("refused")
        return [str(len(x)) for x in texts]

    return infer.infer_with_ledger(t.documents, "doc_id", "text", measure, scratch_path(t.spark, "ledger"))


@query("structured_extract", sql="""SELECT doc_id, CAST(length(text) AS VARCHAR) AS post_id, 'pain' AS kind FROM documents WHERE length(text) > 500 AND length(text) IN (SELECT doc_id FROM documents)
  UNION ALL SELECT doc_id, CAST(length(text) AS VARCHAR), 'persona' FROM documents WHERE length(text) <= 500 AND length(text) IN (SELECT doc_id FROM documents)""")
def _(t):
    def answer(texts):
        import json
        return [json.dumps({
            "pain_points": [{"post_id": str(len(x)), "issue_emotion": "Fear" if len(x) > 500 else "Joy", "is_quote_relevant": True, "issue_topic": {"name": "n", "match_space_topic": True}}],
            "personas": [{"post_id": str(len(x)), "title": "p", "is_quote_relevant": len(x) <= 500}],
        }) for x in texts]

    known = t.documents.select(c("doc_id").cast("string").alias("post_id"))
    get = lambda kind, label: infer.structured_extract(t.documents, "doc_id", "text", answer, known, kind).select("doc_id", "post_id", F.lit(label).alias("kind"))
    return get("pain_points", "pain").unionByName(get("personas", "persona"))


TEMPLATES = ", ".join("'" + q.replace("{q}", "' || text || '") + "'" for q in infer.QUERY_TEMPLATES)


@query("expand_queries", sql=f"""SELECT item_id, query_no, q AS query, 'A post about ' || q || '.' AS hypothetical FROM (
  SELECT item_id, unnest([{TEMPLATES}]) AS q, unnest([{', '.join(f'CAST({i} AS BIGINT)' for i in range(len(infer.QUERY_TEMPLATES)))}]) AS query_no FROM benchmark)""")
def _(t):
    return infer.expand_queries(t.benchmark, "item_id", "text")


# ---- incremental -------------------------------------------------------------

MID = "2024-01-15 00:00:00"
WIN = f"""NOWT AS (SELECT max(ts) AS t FROM events), W AS (SELECT event_type, greatest(max(ts) + INTERVAL 1 SECOND, (SELECT t FROM NOWT) - INTERVAL 365 DAY) AS fs, (SELECT t FROM NOWT) AS fe,
  least(min(ts), (SELECT t FROM NOWT) - INTERVAL 365 DAY) AS bs, min(ts) - INTERVAL 1 SECOND AS be FROM events WHERE {{cond}} GROUP BY 1)"""


def stored(t, newest: bool):
    """What an earlier run would have left: the older or the newer half by time."""
    mid = F.lit(MID).cast("timestamp_ntz")
    return t.events.filter(c("ts") >= mid if newest else c("ts") < mid)


def windows(t, newest):
    now = t.events.agg(F.max("ts")).scalar()
    kinds = t.events.select("event_type").distinct()
    return inc.pull_windows(stored(t, newest), kinds, "event_type", "ts", now, years=1)


FMT, SFMT = "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"


@query("window_bounds", sql=f"WITH {WIN.format(cond=f'''ts < TIMESTAMP '{MID}' ''')} SELECT event_type, strftime(fs, '{SFMT}') AS forward_start, strftime(fe, '{SFMT}') AS forward_end, strftime(bs, '{SFMT}') AS back_start, strftime(be, '{SFMT}') AS back_end FROM W")
def _(t):
    return windows(t, False).select("event_type", *[F.date_format(n, FMT).alias(n) for n in ("forward_start", "forward_end", "back_start", "back_end")])


@query("incremental_forward", sql=f"WITH {WIN.format(cond=f'''ts < TIMESTAMP '{MID}' ''')} SELECT event_id, event_type FROM events JOIN W USING (event_type) WHERE ts BETWEEN fs AND fe")
def _(t):
    return inc.pull_forward(t.events, windows(t, False), "event_type", "ts").select("event_id", "event_type")


@query("backfill", sql=f"WITH {WIN.format(cond=f'''ts >= TIMESTAMP '{MID}' ''')} SELECT event_id, event_type FROM events JOIN W USING (event_type) WHERE ts BETWEEN bs AND be")
def _(t):
    return inc.pull_backfill(t.events, windows(t, True), "event_type", "ts").select("event_id", "event_type")


@query("resume_from_file", sql="SELECT event_id, user_id, event_type, value FROM events")
def _(t):
    path = scratch_path(t.spark, "resume")
    stored(t, False).write.parquet(path)
    inc.resume_append(t.events, path, "ts", "event_id")
    return t.spark.read.parquet(path).select("event_id", "user_id", "event_type", "value")


@query("idempotent_stream_upsert", sql="""SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    path = scratch_path(t.spark, "upsert")
    t.events.repartition(3, "event_id").write.parquet(f"{path}/in")
    stream = inc.read_files(t.spark, f"{path}/in", t.events.schema)
    table = BucketTable(t.spark, f"{path}/table", "user_id")
    inc.run_to_end(stream, inc.upsert_newest(table, ["ts", "event_id"]), f"{path}/checkpoint")
    return table.rows().select("user_id", "event_id", "event_type", "value")


@query("micro_batch_feed", views="D", sql="SELECT 'id:feed:post::' || id AS put, title, body, author FROM D WHERE body IS NOT NULL AND body <> '[removed]'")
def _(t):
    path = scratch_path(t.spark, "feed")
    t.docs.drop("keywords").repartition(3, "id").write.parquet(f"{path}/in")

    usable = "body IS NOT NULL AND body <> '[removed]'"
    idf = keep(keywords.word_weights(t.docs.filter(usable), "id", "body"), "idf")  # one table for every batch

    def prepare(batch):
        kept = batch.filter(usable)
        phrases = keywords.keyphrases(kept.select("id", "body"), "id", "body", idf=idf)
        return files.put_lines(keywords.attach_keywords(kept, phrases, "id"), "feed", "post", "id")

    stream = inc.read_files(t.spark, f"{path}/in", t.spark.read.parquet(f"{path}/in").schema, files_per_batch=2)
    inc.run_to_end(stream, inc.feed(prepare, f"{path}/out"), f"{path}/checkpoint")
    lines = t.spark.read.text(f"{path}/out")
    return lines.select(F.get_json_object("value", "$.put").alias("put"), *[F.get_json_object("value", f"$.fields.{n}").alias(n) for n in ("title", "body", "author")])
