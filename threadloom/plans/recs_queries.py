"""Registered queries: click logs, recommendation and ranking quality."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from threadloom.functions import text as X
from threadloom.operators import clean, lexical, ranking, recs
from threadloom.operators.ranking import dense_index
from threadloom.operators.report import collect_items
from threadloom.plans.registry import query
from threadloom.plans.search_queries import R, r6, rounded
from threadloom.plans.views import DIMS

c = F.col

# user and item vectors are the embeddings of the same ids
SI = """SI AS (SELECT I.*, list_inner_product(uv.v, iv.v) AS score FROM I LEFT JOIN V uv ON uv.id = user_id LEFT JOIN V iv ON iv.id = item)"""
NH = """NH AS (SELECT * FROM I x WHERE NOT EXISTS (SELECT 1 FROM I h WHERE h.user_id = x.user_id AND h.item = x.item AND h.label > 0 AND h.day < x.day))"""
MIX = "MIX AS (SELECT * FROM SI WHERE imp_id IN (SELECT imp_id FROM I GROUP BY imp_id HAVING min(label) = 0 AND max(label) > 0))"
RK = f"{SI}, {MIX}, RK AS (SELECT *, row_number() OVER (PARTITION BY imp_id ORDER BY round(score, 9) DESC, item) AS pos, row_number() OVER (PARTITION BY imp_id ORDER BY label DESC, item) AS ipos FROM MIX)"


def scored(t):
    v = t.vectors.select("id", "v")
    return recs.score_impressions(t.impressions, v, v)


def ranked(t):
    return recs.ranked_impressions(recs.mixed_label_groups(scored(t)))


@query("not_in_history", views="I", sql=f"WITH {NH} SELECT imp_id, item, label FROM NH")
def _(t):
    return recs.not_in_history(t.impressions).select("imp_id", "item", "label")


@query("mixed_label_groups", views="I", sql="SELECT imp_id, item, label FROM I WHERE imp_id IN (SELECT imp_id FROM I GROUP BY imp_id HAVING min(label) = 0 AND max(label) > 0)")
def _(t):
    return recs.mixed_label_groups(t.impressions).select("imp_id", "item", "label")


COUNTS = "CN AS (SELECT N.item, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks FROM N LEFT JOIN (SELECT item, count(*) AS impressions, CAST(sum(label) AS BIGINT) AS clicks FROM I GROUP BY item) USING (item))"


@query("click_counts", views="I N", sql=f"WITH {COUNTS} SELECT * FROM CN")
def _(t):
    return recs.click_counts(t.news, t.impressions)


@query("popularity", views="I N", sql=f"WITH {COUNTS} SELECT item, {R('CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0 END')} AS popularity FROM CN")
def _(t):
    return recs.popularity(recs.click_counts(t.news, t.impressions)).select("item", r6(c("popularity")).alias("popularity"))


CTR = "CTR AS (SELECT category, count(*) AS impressions, CAST(sum(label) AS BIGINT) AS clicks, sum(label) / count(*) AS ctr FROM I JOIN N USING (item) GROUP BY category)"


@query("ctr_by_category", views="I N", sql=f"WITH {CTR} SELECT category, impressions, clicks, {R('ctr')} AS ctr FROM CTR")
def _(t):
    return rounded(recs.ctr_by_category(t.impressions, t.news), "ctr")


@query("impressions_category_join", views="I N", sql="SELECT imp_id, item, label, category FROM I JOIN N USING (item)")
def _(t):
    return recs.impressions_by_category(t.impressions, t.news).select("imp_id", "item", "label", "category")


@query("parent_child_import", views="I N", sql=f"WITH {CTR} SELECT item, category, {R('coalesce(ctr, 0)')} AS ctr FROM N LEFT JOIN CTR USING (category)")
def _(t):
    return recs.import_parent_ctr(t.news, recs.ctr_by_category(t.impressions, t.news)).select("item", "category", r6(c("ctr")).alias("ctr"))


@query("user_item_score_join", views="I V", sql=f"""WITH {SI} SELECT imp_id, item, row_number() OVER (PARTITION BY imp_id ORDER BY seen) AS place, {R('score')} AS score FROM SI""")
def _(t):
    placed = ranking.with_group_position(scored(t).select("imp_id", "item", "seen", "score"), ["imp_id"], [c("seen")], "place")
    return placed.select("imp_id", "item", "place", r6(c("score")).alias("score"))


@query("split_click_skip", views="I", sql="""SELECT imp_id, kind, CAST(floor((rn - 1) / 1000) AS BIGINT) AS page, string_agg(CAST(item AS VARCHAR), ',' ORDER BY rn) AS items
  FROM (SELECT imp_id, item, CASE WHEN label > 0 THEN 'clicked' ELSE 'skipped' END AS kind, row_number() OVER (PARTITION BY imp_id, label ORDER BY seen) AS rn FROM I) GROUP BY 1, 2, 3""")
def _(t):
    kind = F.when(c("label") > 0, "clicked").otherwise("skipped")
    rows = t.impressions.select(F.struct("imp_id", kind.alias("kind")).alias("cluster"), "seen", c("item").cast("string").alias("item"))
    pages = collect_items(rows, "cluster", [c("seen")], ["item"])
    return pages.select("cluster.imp_id", "cluster.kind", "page", F.array_join("items.item", ",").alias("items"))


@query("dense_index", views="I", sql="""SELECT 'user' AS kind, user_id AS id, row_number() OVER (ORDER BY min(seen)) - 1 AS idx FROM I GROUP BY user_id
  UNION ALL SELECT 'item', item, row_number() OVER (ORDER BY min(seen)) - 1 FROM I GROUP BY item""")
def _(t):
    users = dense_index(t.impressions, "user_id", ["seen"], "idx").select(F.lit("user").alias("kind"), c("user_id").alias("id"), "idx")
    return users.unionByName(dense_index(t.impressions, "item", ["seen"], "idx").select(F.lit("item").alias("kind"), c("item").alias("id"), "idx"))


@query("index_impressions", views="I", sql=f"""WITH {NH}, UX AS (SELECT user_id, row_number() OVER (ORDER BY min(seen)) - 1 AS user_index FROM I GROUP BY 1),
  IX AS (SELECT item, row_number() OVER (ORDER BY min(seen)) - 1 AS item_index FROM I GROUP BY 1)
  SELECT imp_id, user_index, item_index, label, strftime(day, '%Y-%m-%d') AS day FROM NH JOIN UX USING (user_id) JOIN IX USING (item)""")
def _(t):
    return recs.index_impressions(t.impressions).select("imp_id", "user_index", "item_index", "label", X.day_text(c("day")).alias("day"))


@query("news_features", views="N", sql=r"""WITH E AS (SELECT item, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') AS e FROM N),
  L AS (SELECT item, unnest([e[1], CASE WHEN e[2] = e[1] THEN '' ELSE coalesce(e[2], '') END]) AS entity, unnest([0, 1]) AS pos FROM E),
  EI AS (SELECT entity, row_number() OVER (ORDER BY min(item * 2 + pos)) - 1 AS ei FROM L GROUP BY 1),
  CI AS (SELECT category, row_number() OVER (ORDER BY min(item)) - 1 AS category_index FROM N GROUP BY 1),
  SX AS (SELECT subcategory, row_number() OVER (ORDER BY min(item)) - 1 AS subcategory_index FROM N GROUP BY 1)
  SELECT N.item, category_index, subcategory_index, max(ei) FILTER (pos = 0) AS entity_1, max(ei) FILTER (pos = 1) AS entity_2
  FROM N JOIN CI USING (category) JOIN SX USING (subcategory) JOIN L USING (item) JOIN EI USING (entity) GROUP BY 1, 2, 3""")
def _(t):
    words = X.tokens(c("title"))
    return recs.news_features(t.news, clean.distinct_ordered(words, F.array().cast("array<string>")))


MD = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
NEG = f"""NG AS (SELECT imp_id, item, row_number() OVER (PARTITION BY imp_id ORDER BY {MD.format("'1|' || imp_id || '|' || item")}, item) - 1 AS no, count(*) OVER (PARTITION BY imp_id) AS n FROM I WHERE label = 0),
  PS AS (SELECT imp_id, item AS positive, {MD.format("'1|start|' || imp_id || '|' || item")} AS s FROM I WHERE label > 0),
  SM AS (SELECT imp_id, positive, positive AS item, 1 AS label FROM PS UNION ALL
    SELECT NG.imp_id, positive, item, 0 FROM PS JOIN NG ON PS.imp_id = NG.imp_id AND (no - s % n + n) % n < 4)"""


@query("negative_sampling", views="I", sql=f"WITH {NEG} SELECT * FROM SM")
def _(t):
    return recs.negative_sampling(t.impressions)


@query("training_pairs", views="I N", sql=f"""WITH {NEG} SELECT imp_id, positive, item, label, CAST(split_part(imp_id, '_', 1) AS BIGINT) AS user_id, category
  FROM SM JOIN N USING (item) WHERE imp_id IN (SELECT imp_id FROM I GROUP BY 1 HAVING min(label) = 0 AND max(label) > 0)""")
def _(t):
    return recs.training_pairs(t.impressions, t.news.select("item", "category")).select("imp_id", "positive", "item", "label", "user_id", "category")


@query("position_discount", views="I V", sql=f"WITH {RK} SELECT imp_id, item, pos, {R('1 / pos')} AS reciprocal, {R('1 / log2(pos + 1)')} AS log_discount FROM RK")
def _(t):
    return rounded(recs.discounts(ranked(t)).select("imp_id", "item", "pos", "reciprocal", "log_discount"), "reciprocal", "log_discount")


AUC = """AU AS (SELECT a.imp_id, avg(CASE WHEN round(a.score, 9) > round(b.score, 9) THEN 1.0 WHEN round(a.score, 9) = round(b.score, 9) THEN 0.5 ELSE 0 END) AS auc
    FROM MIX a JOIN MIX b ON a.imp_id = b.imp_id AND a.label = 1 AND b.label = 0 GROUP BY 1)"""
MRR = "MR AS (SELECT imp_id, sum(label / pos) / sum(label) AS mrr FROM RK GROUP BY 1)"
NDCG = "ND AS (SELECT imp_id, " + ", ".join(f"coalesce(sum((2 ** label - 1) / log2(pos + 1)) FILTER (pos <= {k}), 0) / sum((2 ** label - 1) / log2(ipos + 1)) FILTER (ipos <= {k}) AS ndcg{k}" for k in (5, 10)) + " FROM RK GROUP BY 1)"


@query("auc_by_group", views="I V", sql=f"WITH {RK}, {AUC} SELECT imp_id, {R('auc')} AS auc FROM AU")
def _(t):
    return rounded(recs.auc_by_group(ranked(t)), "auc")


@query("mrr", views="I V", sql=f"WITH {RK}, {MRR} SELECT imp_id, {R('mrr')} AS mrr FROM MR")
def _(t):
    return rounded(recs.mrr_by_group(ranked(t)), "mrr")


@query("ndcg_at_k", views="I V", sql=f"WITH {RK}, {NDCG} SELECT imp_id, {R('ndcg5')} AS ndcg5, {R('ndcg10')} AS ndcg10 FROM ND")
def _(t):
    return rounded(recs.ndcg_by_group(ranked(t)), "ndcg5", "ndcg10")


@query("evaluate_split", views="I V", sql=f"""WITH {RK}, {AUC}, {MRR}, {NDCG}, SP AS (SELECT DISTINCT imp_id, CASE WHEN day < DATE '2024-01-21' THEN 'train' ELSE 'validation' END AS split FROM MIX)
  SELECT split, count(*) AS n_impressions, round(avg(auc), 4) AS auc, round(avg(mrr), 4) AS mrr, round(avg(ndcg5), 4) AS ndcg5, round(avg(ndcg10), 4) AS ndcg10
  FROM SP JOIN AU USING (imp_id) JOIN MR USING (imp_id) JOIN ND USING (imp_id) GROUP BY split""")
def _(t):
    split = F.when(c("day") < F.lit("2024-01-21").cast("date"), "train").otherwise("validation")
    return recs.evaluate(scored(t).withColumn("split", split), split="split")


@query("top_n_for_user", views="I V", sql=f"""WITH US AS (SELECT DISTINCT user_id FROM I) SELECT user_id AS qid, i.id, {R('list_inner_product(u.v, i.v)')} AS score
  FROM US JOIN V u ON u.id = user_id, V i WHERE (user_id, i.id) NOT IN (SELECT (user_id, item) FROM I WHERE label > 0)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY list_inner_product(u.v, i.v) DESC, i.id) <= 10""")
def _(t):
    users = t.impressions.select(c("user_id").alias("qid")).distinct().join(t.vectors.select(c("id").alias("qid"), "v"), "qid")
    read = recs.first_clicks(t.impressions).select(c("user_id").alias("qid"), c("item").alias("id"))
    return rounded(recs.top_n_for_user(users, t.vectors, 10, read), "score")


@query("recommend_with_ctr", views="I V N", sql=f"""WITH {CTR}, IT AS (SELECT V.id, v, coalesce(ctr, 0) AS ctr FROM V JOIN N ON id = item LEFT JOIN CTR USING (category)), US AS (SELECT DISTINCT user_id FROM I)
  SELECT user_id AS qid, i.id, {R('list_inner_product(u.v, i.v)')} AS closeness, {R('ctr')} AS ctr, {R('list_inner_product(u.v, i.v) * ctr')} AS score FROM US JOIN V u ON u.id = user_id, IT i
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY list_inner_product(u.v, i.v) * ctr DESC, i.id) <= 10""")
def _(t):
    users = t.impressions.select(c("user_id").alias("qid")).distinct().join(t.vectors.select(c("id").alias("qid"), "v"), "qid")
    rates = recs.import_parent_ctr(t.news, recs.ctr_by_category(t.impressions, t.news))
    items = t.vectors.select("id", "v").join(rates.select(c("item").alias("id"), "ctr"), "id")
    return rounded(recs.recommend_with_ctr(users, items), "closeness", "ctr", "score")


@query("popularity_rank", views="D QT BM I", sql=f"""WITH PO AS (SELECT item AS id, sum(label) / count(*) AS p FROM I GROUP BY 1),
  S AS (SELECT qid, id, round(BW.body + BW.title, 12) + 100 * coalesce(p, 0) AS s FROM BW LEFT JOIN PO USING (id) WHERE BW.body + BW.title > 0)
  SELECT qid, id, {R('s')} AS score FROM S QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 700""")
def _(t):
    f = lexical.document_fields()
    pop = recs.popularity(recs.click_counts(t.docs.select(c("id").alias("item")), t.impressions))
    docs = t.docs.join(pop.select(c("item").alias("id"), (100 * c("popularity")).alias("bonus")), "id")
    hits = lexical.bm25_hits(docs, "id", {k: f[k] for k in ("title", "body")}, t.query_terms, bonus="bonus")
    return rounded(hits, "score")


@query("train_mf")
def _(t):
    """Five recommendations per user from implicit-feedback factors."""
    users, items = recs.train_factors(t.impressions)
    best = recs.top_n_for_user(users.withColumnRenamed("id", "qid"), items, 5)
    return best.select(c("qid").alias("user_id"), c("id").alias("item"), "score")


@query("evaluate_factors")
def _(t):
    """Train on clicks before the last day, score the last day's impressions, evaluate per day."""
    last = t.impressions.agg(F.max("day").alias("d"))
    seen = t.impressions.join(last, c("day") < c("d"), "left_semi")
    users, items = recs.train_factors(seen)
    scored = recs.score_impressions(t.impressions, users, items).fillna(0.0, ["score"])  # cold users and items score 0
    return recs.evaluate(scored, split="day")


@query("train_content_model")
def _(t):
    """Click probabilities of impressions from a content model trained on sampled pairs."""
    from pyspark.ml.functions import vector_to_array

    news = t.news.withColumn("entity", F.get(X.tokens(c("title")), F.lit(0)))
    items = recs.content_vectors(news, t.vectors, DIMS)
    users = recs.user_profiles(t.impressions, items)
    pairs = recs.training_pairs(t.impressions, news.select("item"))
    model, featurise = recs.train_content_model(pairs.select("user_id", "item", "label"), users, items)
    out = model.transform(featurise(t.impressions.select("imp_id", "user_id", "item", "label")))
    return out.select("imp_id", "item", "label", vector_to_array("probability")[1].alias("probability"))
