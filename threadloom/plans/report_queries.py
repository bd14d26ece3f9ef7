"""Registered queries: clusters, shares, personas and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as X, vectors as V
from threadloom.operators import cluster as CL, flow, nearest as NN, report
from threadloom.plans.registry import query
from threadloom.plans.search_queries import CENTROID, R, WC, r6, rounded, with_centroid
from threadloom.plans.views import tok
from threadloom.runtime import scratch_path, stored

c = F.col


def label_members(t):
    """Embeddings as members of the cluster named by their label."""
    return t.vectors.select(F.concat(F.lit("cluster "), c("label").cast("string")).alias("cluster"), "id", "v")


VERDICT = "CASE WHEN label = 3 THEN NULL ELSE 'cluster ' || label END"


@query("cluster_share", views="V", sql=f"""SELECT 'cluster ' || label AS cluster, count(*) AS n_items, {R('100.0 * count(*) / (SELECT count(*) FROM V)')} AS percentage FROM V WHERE label <> 3 GROUP BY label""")
def _(t):
    m = label_members(t)
    rejected = m.select("cluster").distinct().filter("cluster = 'cluster 3'")  # a judgement without a valid part
    return rounded(report.cluster_share(m, rejected), "percentage")


SHARE = "SH AS (SELECT cluster, count(*) AS n_items, 100.0 * count(*) / (SELECT count(*) FROM PI) AS percentage FROM PI WHERE cluster <> 'Brand#1' GROUP BY 1)"


def brand_share(t):
    m = t.persona_items.select("cluster", "item", "score")
    return report.cluster_share(m, m.select("cluster").distinct().filter("cluster = 'Brand#1'")), m


@query("renormalise_share", views="PI", sql=f"WITH {SHARE} SELECT cluster, n_items, {R('100.0 * percentage / (SELECT sum(percentage) FROM SH)')} AS percentage FROM SH")
def _(t):
    return rounded(report.renormalise_share(brand_share(t)[0]), "percentage")


@query("merge_groups", views="PI", sql=f"""WITH {SHARE}, G AS (SELECT *, right(cluster, 1) AS grp FROM SH)
  SELECT grp, arg_min(cluster, (-percentage, cluster)) AS cluster, arg_min(n_items, (-percentage, cluster)) AS n_items, {R('sum(percentage)')} AS percentage, any_value(moved) AS n_moved
  FROM G JOIN (SELECT right(cluster, 1) AS grp, count(*) AS moved FROM PI WHERE cluster <> 'Brand#1' GROUP BY 1) USING (grp) GROUP BY grp""")
def _(t):
    shares, members = brand_share(t)
    merged, moved = report.merge_groups(shares.withColumn("grp", F.right("cluster", F.lit(1))), members, "grp")
    sizes = report.cluster_sizes(moved).select("cluster", c("n_items").alias("n_moved"))
    return rounded(merged.join(sizes, "cluster").select("grp", "cluster", "n_items", "percentage", "n_moved"), "percentage")


@query("collect_items", views="V", sql="""SELECT 'cluster ' || label AS cluster, CAST(floor((rn - 1) / 20) AS BIGINT) AS page, n AS n_items, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS items
  FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM V) GROUP BY 1, 2, 3""")
def _(t):
    m = label_members(t).select("cluster", c("id").alias("no"), c("id").cast("string").alias("id"))
    pages = report.collect_items(m, "cluster", [c("no")], ["id"], page_size=20)
    return pages.select("cluster", "page", "n_items", F.array_join("items.id", ",").alias("items"))


COUNT = "PC AS (SELECT persona, cluster, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY persona) AS BIGINT) AS persona_total FROM PI WHERE persona <> '5-LOW' GROUP BY 1, 2)"


def known_personas(t):
    return t.orders.select(c("o_orderpriority").alias("persona")).distinct().filter("persona <> '5-LOW'")


@query("persona_pain_counts", views="PI", sql=f"WITH {COUNT} SELECT * FROM PC")
def _(t):
    return report.persona_counts(t.persona_items, known_personas(t))


TOP3 = "T3 AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY n DESC, cluster) AS place FROM PC QUALIFY place <= 3)"


@query("top3_clusters_per_persona", views="PI", sql=f"WITH {COUNT}, {TOP3} SELECT persona, cluster, n, {R('100.0 * n / persona_total')} AS percentage, CAST(place AS INTEGER) AS place FROM T3")
def _(t):
    top = report.top_clusters_per_persona(report.persona_counts(t.persona_items, known_personas(t)))
    return rounded(top.select("persona", "cluster", "n", "percentage", "place"), "percentage")


@query("top5_items_by_score", views="PI", sql="""SELECT persona, cluster, item, score, CAST(row_number() OVER w AS INTEGER) AS item_place FROM PI
  WINDOW w AS (PARTITION BY persona, cluster ORDER BY score DESC, item) QUALIFY row_number() OVER w <= 5""")
def _(t):
    return report.top_items(t.persona_items)


@query("persona_report", views="PI", sql=f"""WITH {COUNT}, {TOP3}, B AS (SELECT persona, cluster, string_agg(item, ',' ORDER BY p) AS items FROM
    (SELECT persona, cluster, item, row_number() OVER (PARTITION BY persona, cluster ORDER BY score DESC, item) AS p FROM PI QUALIFY p <= 5) GROUP BY 1, 2)
  SELECT persona, CAST(place AS INTEGER) AS place, cluster, n, {R('100.0 * n / persona_total')} AS percentage,
    'Common issue found in ' || n || ' out of ' || persona_total || ' pain points for ' || persona AS description, items FROM T3 JOIN B USING (persona, cluster)""")
def _(t):
    rows = report.persona_report(t.persona_items, known_personas(t))
    flat = rows.select("persona", F.explode("top_pain_points").alias("p")).select("persona", "p.*")
    return rounded(flat.select("persona", "place", "cluster", "n", "percentage", "description", F.array_join("items.item", ",").alias("items")), "percentage")


@query("cluster_title_join", views="PI", sql="""WITH FT AS (SELECT p_name AS title, min(p_partkey) AS first_key, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1),
  PT AS (SELECT o_orderpriority AS persona, p_name AS title, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
  SELECT persona, title, n, first_key, brand FROM PT JOIN FT USING (title)""")
def _(t):
    titles = report.titles_first(t.part.select(c("p_name").alias("title"), c("p_partkey").alias("first_key"), c("p_brand").alias("brand")), "title", "first_key")
    counts = (t.lineitem.select(c("l_orderkey").alias("o_orderkey"), c("l_partkey").alias("p_partkey"))
              .join(t.orders.select("o_orderkey", c("o_orderpriority").alias("persona")), "o_orderkey")
              .join(t.part.select("p_partkey", c("p_name").alias("title")), "p_partkey").groupBy("persona", "title").agg(F.count(F.lit(1)).alias("n")))
    return counts.join(titles, "title").select("persona", "title", "n", "first_key", "brand")


@query("cluster_sample_10", views="V", sql=f"""WITH {CENTROID}, X AS (SELECT label, id, round(list_distance(v, q), 9) AS d FROM W)
  SELECT 'first' AS kind, label, id, CAST(row_number() OVER (PARTITION BY label ORDER BY d, id) AS INTEGER) AS place FROM (SELECT * FROM X QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 10)
  UNION ALL SELECT 'nearest', label, id, CAST(row_number() OVER (PARTITION BY label ORDER BY d, id) AS INTEGER) FROM X QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, id) <= 10""")
def _(t):
    m = with_centroid(t).select("label", "id", c("id").alias("arrival"), F.round(V.euclidean(c("v"), c("centroid")), 9).alias("d"))
    pick = lambda kind, nearest: report.cluster_sample(m, "arrival", "d", "id", nearest=nearest, cluster="label").select(F.lit(kind).alias("kind"), "label", "id", "place")
    return pick("first", False).unionByName(pick("nearest", True))


# ---- clustering --------------------------------------------------------------

def cc(edges, start="a"):
    """SQL components of an edge list with both directions."""
    return f"RC(id, r) AS (SELECT DISTINCT a, a FROM {edges} UNION SELECT {edges}.b, RC.r FROM RC JOIN {edges} ON RC.id = {edges}.a), CC AS (SELECT id, min(r) AS component FROM RC GROUP BY id)"


@query("exemplar_clusters")
def _(t):
    """Affinity propagation; compared with the dense algorithm in the tests."""
    return rounded(CL.exemplar_clusters(t.vectors, threshold=0.4), "distance")


@query("component_clusters", views="V", sql=f"""WITH RECURSIVE PR AS (SELECT a.id AS a, b.id AS b FROM V a JOIN V b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.4), {cc('PR')},
  SIM AS (SELECT x.component, x.id, round(-avg(list_cosine_similarity(vx.v, vy.v)), 9) AS far FROM CC x JOIN CC y USING (component) JOIN V vx ON vx.id = x.id JOIN V vy ON vy.id = y.id GROUP BY 1, 2),
  EX AS (SELECT component, id AS exemplar FROM SIM QUALIFY row_number() OVER (PARTITION BY component ORDER BY far, id) = 1),
  DS AS (SELECT CC.id, exemplar, CASE WHEN CC.id = exemplar THEN 0 ELSE 1 - list_cosine_similarity(m.v, e.v) END AS d FROM CC JOIN EX USING (component) JOIN V m ON m.id = CC.id JOIN V e ON e.id = exemplar),
  NR AS (SELECT *, count(*) OVER (PARTITION BY exemplar) AS n FROM DS WHERE d <= 0.6 + 1e-9)
  SELECT V.id, CASE WHEN n > 1 THEN exemplar ELSE -1 END AS cluster, CASE WHEN n > 1 THEN {R('d')} END AS distance FROM V LEFT JOIN NR USING (id)""")
def _(t):
    return rounded(CL.component_clusters(t.vectors, threshold=0.4), "distance")


EPS = 9.3


@query("density_clusters")
def _(t):
    """The most stable groups of a density hierarchy; compared with a written-out hierarchy in the tests."""
    return rounded(CL.density_clusters(t.vectors), "distance")


@query("dense_components", views="V", sql=f"""WITH RECURSIVE E AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM V), S AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM E GROUP BY i),
  Z AS (SELECT id, list((x - m) / s ORDER BY i) AS z FROM E JOIN S USING (i) GROUP BY id),
  NB AS (SELECT a.id AS a, b.id AS b FROM Z a JOIN Z b ON a.id <> b.id AND list_distance(a.z, b.z) <= {EPS}),
  CO AS (SELECT a AS id FROM NB GROUP BY a HAVING count(*) >= 3),
  PR AS (SELECT a, b FROM NB WHERE a IN (FROM CO) AND b IN (FROM CO)), {cc('PR')},
  MB AS (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM CC), BIG AS (SELECT id, component, n, z FROM MB JOIN Z USING (id) WHERE n >= 5),
  CE AS (SELECT component, list(m ORDER BY i) AS q FROM (SELECT component, i, avg(x) AS m FROM (SELECT component, unnest(z) AS x, generate_subscripts(z, 1) AS i FROM BIG) GROUP BY 1, 2) GROUP BY 1),
  EX AS (SELECT component, id AS exemplar, z AS ez FROM BIG JOIN CE USING (component) QUALIFY row_number() OVER (PARTITION BY component ORDER BY round(list_distance(z, q), 9), id) = 1)
  SELECT V.id, coalesce(component, -1) AS cluster, {R('CASE WHEN V.id = exemplar THEN 0 ELSE list_distance(z, ez) END')} AS distance FROM V LEFT JOIN (SELECT id, component, z, exemplar, ez FROM BIG JOIN EX USING (component)) b ON b.id = V.id""")
def _(t):
    return rounded(CL.dense_components(t.vectors, EPS), "distance")


@query("merge_near_clusters")
def _(t):
    """Average linkage by 1 - cosine; compared with pairwise merging in the tests."""
    reps = NN.label_centroids(t.vectors, "label").select(c("label").cast("bigint").alias("cluster"), c("centroid").alias("v"))
    return CL.merge_average_linkage(reps, 0.85).select("cluster", c("group").alias("grp"))


@query("merge_near_components", views="V", sql=f"""WITH RECURSIVE {CENTROID}, PR AS (SELECT a.label AS a, b.label AS b FROM M a JOIN M b ON a.label <> b.label AND 1 - list_cosine_similarity(a.q, b.q) <= 0.85), {cc('PR')}
  SELECT CAST(label AS BIGINT) AS cluster, CAST(coalesce(component, label) AS BIGINT) AS grp FROM M LEFT JOIN CC ON id = label""")
def _(t):
    reps = NN.label_centroids(t.vectors, "label").select(c("label").cast("bigint").alias("cluster"), c("centroid").alias("v"))
    return CL.merge_near_components(reps, 0.85).select("cluster", c("group").alias("grp"))


@query("merge_average_linkage")
def _(t):
    """Average-linkage groups of the label centroids; compared with pairwise merging in the tests."""
    reps = NN.label_centroids(t.vectors, "label").select(c("label").cast("bigint").alias("cluster"), c("centroid").alias("v"))
    return CL.merge_average_linkage(reps, 0.95).select("cluster", c("group").alias("grp"))


EXEMPLAR = f"""{CENTROID}, EX AS (SELECT label, id AS exemplar, v AS ev FROM W QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(-list_inner_product(v, q), 9), id) = 1)"""


@query("assign_exemplar_distance", views="V", sql=f"""WITH {EXEMPLAR} SELECT id, exemplar, {R('CASE WHEN id = exemplar THEN 0 ELSE 1 - list_cosine_similarity(v, ev) END')} AS distance FROM V JOIN EX USING (label)""")
def _(t):
    placed = CL.assign_exemplar_distance(t.vectors, "label")
    return rounded(placed.select("id", "exemplar", "distance"), "distance")


@query("cluster_report", views="V D", sql=f"""WITH {EXEMPLAR} SELECT 'cluster ' || label AS cluster, 'Theme ' || label AS title, exemplar AS quote_id, 'https://www.reddit.com' || permalink AS link, score,
    strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%d') AS day, n AS n_items, {R('100.0 * n / (SELECT count(*) FROM V)')} AS percentage
  FROM EX JOIN D ON exemplar = id JOIN (SELECT label, count(*) AS n FROM V GROUP BY 1) USING (label) WHERE label <> 3""")
def _(t):
    ex = CL.exemplars(t.vectors, "label")
    verdicts = ex.select(F.concat(F.lit("cluster "), c("label").cast("string")).alias("cluster"),
                         F.when(c("label") != 3, F.concat(F.lit("Theme "), c("label").cast("string"))).alias("title"), c("exemplar").alias("quote_id"))
    out = report.cluster_report(label_members(t), verdicts, t.docs)
    return rounded(out.select("cluster", "title", "quote_id", "link", "score", "day", "n_items", "percentage"), "percentage")


INS = """INS AS (SELECT id AS insight_id, CASE WHEN quality = 1 THEN 'attitudinal' ELSE 'behavioral' END AS kind, title AS insight, lang || '/' || community || '/' || length(author) AS source, split_part(lower(title), ' ', 1) AS quote FROM D JOIN labels ON id = doc_id),
  I1 AS (SELECT * FROM INS QUALIFY row_number() OVER (PARTITION BY source ORDER BY insight_id) = 1), I2 AS (SELECT * FROM I1 QUALIFY row_number() OVER (PARTITION BY quote ORDER BY insight_id) = 1)"""


def insights(t):
    d = t.docs.join(t.labels.select(c("doc_id").alias("id"), "quality"), "id")
    return d.select(c("id").alias("insight_id"), F.when(c("quality") == 1, "attitudinal").otherwise("behavioral").alias("kind"), c("title").alias("insight"),
                    F.concat_ws("/", "lang", "community", F.length("author").cast("string")).alias("source"), F.split_part(F.lower("title"), F.lit(" "), F.lit(1)).alias("quote"))


@query("insight_report", views="D", sql=f"WITH {INS} SELECT insight_id, kind, insight, source, quote FROM I2")
def _(t):
    return report.insight_report(insights(t)).select("insight_id", "kind", "insight", "source", "quote")


@query("report_to_tables", views="D PI", sql=f"""WITH {INS}, {COUNT}, {TOP3}
  SELECT 'reports' AS tab, CAST(1 AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS n_ids, CAST(0 AS BIGINT) AS orphans
  UNION ALL SELECT 'personas', count(DISTINCT persona), count(DISTINCT persona), 0 FROM T3
  UNION ALL SELECT 'pain_points', count(*), count(DISTINCT (persona, item)), 0 FROM PI WHERE persona <> '5-LOW'
  UNION ALL SELECT 'insights', 1, 1, 0
  UNION ALL SELECT kind || '_insights', count(*), count(*), 0 FROM I2 GROUP BY kind
  UNION ALL SELECT 'user_segments', count(*), count(*), 0 FROM T3""")
def _(t):
    # stored, as few personas own all items: they are broadcast by their known size, and no hot key is shuffled
    items, known = t.persona_items, stored(known_personas(t), "known")
    tops = report.top_clusters_per_persona(report.persona_counts(items, known)).select("persona", c("cluster").alias("description"))
    members = items.join(known, "persona", "left_semi").select("persona", c("item").alias("description"))
    rows = report.insight_report(insights(t)).withColumn("day", F.lit("2024-01-01"))
    tabs = report.report_tables("space", tops, members, rows)
    parent = {"personas": ("report_id", "reports"), "pain_points": ("persona_id", "personas"), "insights": ("report_id", "reports"),
              "attitudinal_insights": ("insight_id", "insights"), "behavioral_insights": ("insight_id", "insights"), "user_segments": ("insight_id", "insights")}
    ups = {up: stored(tabs[up].select(c("id").alias("_up")), up) for up in {up for _, up in parent.values()}}
    out = None
    for name, df in tabs.items():
        if name in parent:
            fk, up = parent[name]
            df = df.join(ups[up], df[fk] == c("_up"), "left").withColumn("_lost", c("_up").isNull().cast("bigint"))
        else:
            df = df.withColumn("_lost", F.lit(0).cast("bigint"))
        df = df.select("id", "_lost").repartition("id")  # a task counts a bounded share of the ids, not those of a whole join task
        row = df.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.coalesce(F.sum("_lost"), F.lit(0)).alias("orphans"))
        out = row if out is None else out.unionByName(row)
    return out


@query("sink_report_json", views="PI", sql=f"""WITH {SHARE}, T13 AS (SELECT cluster, {R('100.0 * percentage / (SELECT sum(percentage) FROM SH)')} AS p FROM SH)
  SELECT 'Pain Points' AS part, row_number() OVER (ORDER BY p DESC, cluster) AS no, cluster AS name, p AS percentage, CAST(NULL AS BIGINT) AS n_ids FROM T13
  UNION ALL SELECT 'Personas', row_number() OVER (ORDER BY persona), persona, NULL, NULL FROM (SELECT DISTINCT persona FROM PI)
  UNION ALL SELECT 'Ids', page + 1, NULL, NULL, count(*) FROM (SELECT CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 300) AS BIGINT) AS page FROM documents) GROUP BY page""")
def _(t):
    pains = report.renormalise_share(brand_share(t)[0]).select("cluster", r6(c("percentage")).alias("percentage"))
    personas = t.orders.select(c("o_orderpriority").alias("persona")).distinct()
    lines = report.report_lines(pains, personas, t.documents.select(c("doc_id").alias("id")), page_size=300)
    path = scratch_path(t.spark, "report")
    lines.write.json(path)
    back = t.spark.read.schema("part string, no bigint, value string").json(path)
    name = F.coalesce(F.get_json_object("value", "$.cluster"), F.get_json_object("value", "$.persona"))
    ids = F.when(c("part") == "Ids", F.json_array_length("value").cast("bigint"))
    return back.select("part", "no", name.alias("name"), F.get_json_object("value", "$.percentage").cast("double").alias("percentage"), ids.alias("n_ids"))


def overlap_scores(queries, texts):
    """Share of a query's distinct words that the text holds."""
    wanted, held = [set(q.split()) for q in queries], [set(x.split()) for x in texts]
    return [[len(w & h) / len(w) if w else 0.0 for w in wanted] for h in held]


def plain_answers(texts):
    """The offline extractor: the first words of a text are its pain point, its longest one names the persona."""
    import json

    out = []
    for x in texts:
        words = x.lower().split()
        head, name = " ".join(words[:4]), max(words, key=lambda w: (len(w), w), default="")
        out.append(json.dumps({
            "pain_points": [{"post_id": words[0] if words else "", "title": head, "description": " ".join(words[4:8]), "quote": head, "persona": name[:1],
                             "issue_emotion": "Anger", "is_quote_relevant": True, "issue_topic": {"name": name, "match_space_topic": len(words) > 20}}],
            "personas": [{"post_id": words[0] if words else "", "title": name, "description": head, "quote": head, "is_quote_relevant": len(words) % 2 == 0}]}))
    return out


@query("report_request", views="D V QV DV QT SC BM", sql=f"""WITH {WC}, CAND AS (SELECT DISTINCT id FROM WC),
  T AS (SELECT id, {tok("id || ' ' || title || ' ' || body")} AS w FROM D WHERE id IN (FROM CAND)), Q AS (SELECT item_id AS qid, list_distinct({tok('text')}) AS q FROM benchmark),
  RR AS (SELECT id, any_value(w) AS w FROM T, Q WHERE len(list_intersect(w, q)) / len(q) > 0.25 GROUP BY id)
  SELECT 'candidates' AS stage, count(*) AS n_rows FROM CAND UNION ALL SELECT 'reranked', count(*) FROM RR UNION ALL SELECT 'answers', count(*) FROM RR
  UNION ALL SELECT 'pain_points', count(*) FILTER (len(w) > 20) FROM RR UNION ALL SELECT 'personas', count(*) FILTER (len(w) % 2 = 0) FROM RR
  UNION ALL SELECT 'ids_in_result', count(*) FROM RR""")
def _(t):
    """The whole flow from queries to the result document; the rows of its stages, and the ids its document lists."""
    words = lambda text: F.array_join(X.tokens(text), " ")
    # texts as words, the first of which is the id, so that the offline extractor can name its source
    docs = t.doc_vectors.withColumn("title", F.concat_ws(" ", c("id").cast("string"), words(c("title")))).withColumn("body", words(c("body")))
    queries = t.benchmark.select(c("item_id").alias("qid"), words(c("text")).alias("query"))
    run = flow.StagedRun(t.spark, scratch_path(t.spark, "report"))
    lines = flow.report_request(run, docs, queries, t.query_vectors, t.query_terms, overlap_scores, plain_answers, threshold=0.6, embed={"dims": 64})
    done = lambda name: t.spark.read.parquet(f"{run.path}/{name}").agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n_rows"))
    out = lines.filter("part = 'Ids'").agg(F.lit("ids_in_result").alias("stage"), F.coalesce(F.sum(F.json_array_length("value")), F.lit(0)).cast("bigint").alias("n_rows"))
    for name in ("candidates", "reranked", "answers", "pain_points", "personas"):
        out = out.unionByName(done(name))
    return out
