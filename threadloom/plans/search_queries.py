"""Registered queries: vectors, lexical search, ranking and hybrid search.

Query texts are all benchmark items and query vectors the embeddings of the same ids, so the
work grows with documents, vectors and queries alike.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from threadloom.functions import text as X, vectors as V
from threadloom.operators import lexical, nearest as NN, planes, ranking, search, stems
from threadloom.plans.registry import query
from threadloom.plans.views import DIMS, rotate, tok
from threadloom.runtime import spread, stored

c = F.col


def r6(col):
    """Six places, after twelve: kernels round to twelve, and both sides must round alike."""
    return F.round(F.round(col, 12), 6) + F.lit(0.0)


def rounded(df, *names):
    """Scores to six places for comparison with the SQL twin."""
    return df.select(*[(r6(c(n)).alias(n) if n in names else c(n)) for n in df.columns])


def R(x: str) -> str:
    return f"round(round({x}, 12), 6) + 0.0"


CENTROID = """M AS (SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS m
    FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM V) GROUP BY label, i) GROUP BY label),
  W AS (SELECT V.id, V.label, V.v, M.q FROM V JOIN M USING (label))"""


def with_centroid(t):
    """Each vector next to the mean vector of its label."""
    return t.vectors.join(stored(NN.label_centroids(t.vectors, "label"), "centroids"), "label")


def pairwise(key, columns, sql):
    """A projection over (vector, label centroid) rows."""
    @query(key, views="V", sql=f"WITH {CENTROID} SELECT id, {sql} FROM W")
    def _(t):
        return with_centroid(t).select("id", *columns(c("v"), c("centroid")))


DOT = "list_inner_product({a}, {b})"
pairwise("cosine", lambda v, q: [r6(V.cosine(v, q)).alias("similarity"), r6(1 - V.cosine(v, q)).alias("distance")],
         f"{R('list_cosine_similarity(v, q)')} AS similarity, {R('1 - list_cosine_similarity(v, q)')} AS distance")
pairwise("euclidean", lambda v, q: [r6(V.euclidean(v, q)).alias("distance")], f"{R('list_distance(v, q)')} AS distance")
pairwise("l2_normalise", lambda v, q: [r6(V.norm(V.l2_normalise(q))).alias("unit"), r6(V.euclidean(V.l2_normalise(v), V.l2_normalise(q))).alias("distance"),
                                       r6(V.norm(V.l2_normalise(F.transform(v, lambda x: x * 0)))).alias("zero")],
         f"""CAST(1 AS DOUBLE) AS unit, {R('list_distance(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))), list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))))')} AS distance,
         CAST(0 AS DOUBLE) AS zero""")
pairwise("angular_closeness", lambda v, q: [r6(V.angular_closeness(v, q)).alias("closeness")], f"{R('1 / (2 - list_cosine_similarity(v, q))')} AS closeness")
pairwise("dot_closeness", lambda v, q: [r6(V.dot(v, q)).alias("score")], f"{R('list_inner_product(v, q)')} AS score")
pairwise("truncate_dims", lambda v, q: [r6(V.dot(V.truncate_dims(v, 32), V.truncate_dims(q, 32))).alias("half_dot"), F.size(V.truncate_dims(v, 32)).cast("bigint").alias("dims")],
         f"{R('list_inner_product(v[1:32], q[1:32])')} AS half_dot, CAST(len(v[1:32]) AS BIGINT) AS dims")
BITS = "list_transform({x}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
BYTES = "list_transform(range(8), lambda b: list_sum(list_transform(range(8), lambda i: CASE WHEN v[b * 8 + i + 1] > 0 THEN 1 << (7 - i) ELSE 0 END)))"
pairwise("binarise", lambda v, q: [F.concat_ws(",", V.code_bytes(v, DIMS).cast("array<string>")).alias("bytes"), F.concat_ws(",", V.signed_bytes(v, DIMS).cast("array<string>")).alias("signed"),
                                   F.bit_count(V.binarise(v, DIMS)[0]).cast("bigint").alias("ones")],
         f"""array_to_string(list_transform({BYTES}, lambda b: CAST(CAST(b AS BIGINT) AS VARCHAR)), ',') AS bytes,
         array_to_string(list_transform({BYTES}, lambda b: CAST(CAST(b AS BIGINT) - 128 AS VARCHAR)), ',') AS signed, CAST(list_sum({BITS.format(x='v')}) AS BIGINT) AS ones""")
HAM = "CAST(list_sum(list_transform(list_zip(v, q), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS BIGINT)"
pairwise("hamming", lambda v, q: [V.hamming(V.binarise(v, DIMS), V.binarise(q, DIMS)).alias("distance"),
                                  r6(V.closeness(V.hamming(V.binarise(v, DIMS), V.binarise(q, DIMS)))).alias("closeness")],
         f"{HAM} AS distance, {R(f'1 / (1 + CAST({HAM} AS DOUBLE))')} AS closeness")
pairwise("unpack_dot", lambda v, q: [r6(V.unpack_dot(V.binarise(v, DIMS), q, DIMS)).alias("score")],
         f"{R('list_sum(list_transform(list_zip(v, q), lambda p: CASE WHEN p[1] > 0 THEN p[2] ELSE -p[2] END))')} AS score")
pairwise("sigmoid_dot", lambda v, q: [r6(V.sigmoid_dot(v, q)).alias("probability")], f"{R('1 / (1 + exp(-list_inner_product(v, q)))')} AS probability")


@query("standardise", views="V", sql=f"""WITH E AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM V),
  S AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM E GROUP BY i)
  SELECT id, {R('sum(abs((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END))')} AS total, {R('max((x - m) / s)')} AS top FROM E JOIN S USING (i) GROUP BY id""")
def _(t):
    z = NN.standardise(t.vectors)
    return z.select("id", r6(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.abs(x))).alias("total"), r6(F.array_max("z")).alias("top"))


@query("scalar_quantise", views="V", sql="""WITH E AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM V),
  S AS (SELECT i, min(x) AS lo, max(x) AS hi FROM E GROUP BY i)
  SELECT id, string_agg(CAST(CAST(CASE WHEN hi > lo THEN least(255, floor((x - lo) / ((hi - lo) / 255))) ELSE 0 END AS BIGINT) - 128 AS VARCHAR), ',' ORDER BY i) AS code
  FROM E JOIN S USING (i) GROUP BY id""")
def _(t):
    return NN.scalar_quantise(t.vectors).select("id", F.concat_ws(",", c("code").cast("array<string>")).alias("code"))


ALLQ = "SELECT QV.qid, V.id, list_cosine_similarity(V.v, QV.v) AS s FROM V, QV"


@query("similarity_threshold", views="V QV", sql=f"SELECT qid, id, {R('s')} AS score FROM ({ALLQ}) WHERE s > 0.3")
def _(t):
    return rounded(search.hits_above(NN.nearest(t.vectors, t.query_vectors, threshold=0.3), 0.3), "score")


@query("distance_threshold_fast", views="V QV", sql=f"SELECT qid, id, {R('1 - s')} AS distance FROM ({ALLQ}) WHERE 1 - s < 0.7")
def _(t):
    near = NN.nearest(t.vectors, t.query_vectors, threshold=0.3)
    return search.hits_above(near, 0.3).select("qid", "id", r6(1 - c("score")).alias("distance"))


@query("exact_knn", views="V QV", sql=f"""SELECT qid, id, {R('s')} AS score FROM ({ALLQ})
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 20""")
def _(t):
    return rounded(NN.nearest(t.vectors, t.query_vectors, k=20), "score")


@query("knn_join", views="V", sql=f"""SELECT a.id AS qid, b.id, {R('list_inner_product(a.v, b.v)')} AS score FROM V a, V b WHERE a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) <= 5""")
def _(t):
    users = t.vectors.select(c("id").alias("qid"), "v")
    return rounded(NN.nearest(t.vectors, users, k=5, metric="dot", skip_self=True), "score")


@query("pairwise_matrix", views="V", sql=f"""SELECT a.id AS a, b.id AS b, {R('list_cosine_similarity(a.v, b.v)')} AS score FROM V a JOIN V b ON a.id < b.id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.3""")
def _(t):
    return rounded(NN.similar_pairs(t.vectors, 0.3), "score")


@query("ann_candidates")
def _(t):
    """The best of the probed bands; a test measures the recall against the exact search."""
    return rounded(planes.ann_candidates(t.vectors, t.query_vectors), "score")


@query("sign_code_candidates", views="V QV", sql=f"""WITH B AS (SELECT V.id, QV.qid, list_cosine_similarity(V.v, QV.v) AS s, len(list_filter(range(8), lambda b:
      len(list_filter(range(8), lambda i: (V.v[b * 8 + i + 1] > 0) <> (QV.v[b * 8 + i + 1] > 0))) = 0)) AS shared FROM V, QV)
  SELECT qid, id, {R('s')} AS score FROM B WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 5000""")
def _(t):
    return rounded(NN.sign_code_candidates(t.vectors, t.query_vectors), "score")


@query("maxsim_keywords", views="V", sql=f"""WITH {CENTROID} SELECT label, {R('max(s)')} AS best, {R('avg(s)')} AS mean, arg_max(id, s) AS closest
  FROM (SELECT label, id, list_cosine_similarity(v, q) AS s FROM W) GROUP BY label""")
def _(t):
    s = with_centroid(t).select("label", "id", V.cosine(c("v"), c("centroid")).alias("s"))
    return s.groupBy("label").agg(r6(F.max("s")).alias("best"), r6(F.avg("s")).alias("mean"), F.max_by("id", "s").alias("closest"))


@query("lookup_vectors", views="D V", sql=f"""SELECT D.id, CASE WHEN V.id IS NULL THEN 0 ELSE 1 END AS has_vector, {R('coalesce(list_sum(list_transform(v, lambda x: abs(x))), 0)')} AS total
  FROM D LEFT JOIN V USING (id)""")
def _(t):
    from threadloom.operators.recs import lookup_vectors
    got = lookup_vectors(t.docs.select("id"), t.vectors.select("id", "v"), "id", "v", DIMS)
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x))
    return got.select("id", F.when(size > 0, 1).otherwise(0).alias("has_vector"), r6(size).alias("total"))


# ---- lexical -----------------------------------------------------------------

def bm_sql(expr, k=700):
    return f"SELECT qid, id, {R(expr)} AS score FROM BW WHERE {expr} > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round({expr}, 12) DESC, id) <= {k}"


@query("bm25", views="D QT BM", sql=bm_sql("title + body + keywords"))
def _(t):
    return rounded(lexical.bm25_hits(t.docs, "id", lexical.document_fields(), t.query_terms), "score")


@query("bm25_sum4", views="D QT BM", sql=bm_sql("title + body + keywords + community"))
def _(t):
    return rounded(lexical.bm25_hits(t.docs, "id", lexical.document_fields(True), t.query_terms), "score")


@query("fieldset_search", views="D QT BM", sql=bm_sql("title + body + keywords", 400))
def _(t):
    return rounded(lexical.bm25_hits(t.docs, "id", lexical.document_fields(), t.query_terms, k=400), "score")


@query("fulltext_rank", views="D QT", sql=f"""WITH T AS (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM (SELECT id, {tok('body')} AS toks FROM D))
  SELECT qid, id, {R('count(*) / max(dl)')} AS score FROM T JOIN QT USING (term) GROUP BY qid, id
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(count(*) / max(dl), 12) DESC, id) <= 10000""")
def _(t):
    return rounded(lexical.fulltext_hits(t.docs, "id", "body", t.query_terms), "score")


# phrases: every three consecutive words of every benchmark item
PH = f"""PH AS (SELECT DISTINCT qid, array_to_string(w[i:i + 2], ' ') AS phrase FROM (SELECT qid, w, unnest(range(1, len(w) - 1)) AS i
    FROM (SELECT item_id AS qid, {tok('text')} AS w FROM benchmark))),
  HIT AS (SELECT DISTINCT id, phrase, created_utc FROM (SELECT id, created_utc, array_to_string(w[i:i + 2], ' ') AS phrase FROM (SELECT id, created_utc, w, unnest(range(1, len(w) - 1)) AS i
    FROM (SELECT id, created_utc, {tok('body')} AS w FROM D))) WHERE phrase IN (SELECT phrase FROM PH))"""


def phrases(t):
    w = X.tokens(c("text"))
    runs = t.benchmark.select(c("item_id").alias("qid"), w.alias("w")).filter(F.size("w") >= 3)
    return runs.select("qid", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("phrase")).distinct()


def phrase_docs(t):
    return lexical.phrase_hits(t.docs, "id", "body", phrases(t), [3], keep=("created_utc",))


@query("phrase_filter", views="D", sql=f"WITH {PH} SELECT id, phrase, created_utc FROM HIT")
def _(t):
    return phrase_docs(t).select("id", "phrase", "created_utc")


@query("phrase_filter_english")
def _(t):
    """Phrases over English word forms; a test compares with written-out code."""
    table = stems.token_table(t.docs, "id", "body", keep=("created_utc",))
    return stems.stem_phrase_hits(table, "id", phrases(t), keep=("created_utc",)).select("id", "phrase", "created_utc")


@query("fulltext_rank_english")
def _(t):
    table = stems.token_table(t.docs, "id", "body")
    return rounded(stems.stem_rank(table, "id", t.benchmark.select(c("item_id").alias("qid"), "text")), "score")


@query("phrase_then_semantic", views="D V QV", sql=f"""WITH {PH}, L AS (SELECT * FROM HIT)
  SELECT qid, id, {R('max(list_cosine_similarity(V.v, QV.v))')} AS score FROM L JOIN PH USING (phrase) JOIN V USING (id) JOIN QV USING (qid)
  WHERE list_cosine_similarity(V.v, QV.v) > 0.1 GROUP BY qid, id""")
def _(t):
    pairs = phrase_docs(t).join(phrases(t), "phrase").select("qid", "id").distinct()
    scored = NN.pair_scores(pairs.join(t.vectors.select("id", "v"), "id").join(t.query_vectors.select("qid", c("v").alias("q")), "qid"), {"score": ("v", "q")})
    return rounded(search.hits_above(scored, 0.1), "score")


@query("filtered_hybrid", views="D V QV QT BM", sql=f"""SELECT DISTINCT qid, id FROM (
    (SELECT qid, id FROM BW JOIN D USING (id) WHERE D.community = 'src7' AND BW.title + BW.body > 0)
    UNION ALL SELECT qid, id FROM ({ALLQ}) WHERE s > 0.25 AND id IN (SELECT id FROM D))""")
def _(t):
    f = lexical.document_fields()
    f = {k: f[k] for k in ("title", "body")}
    prepared = lexical.prepare(t.docs, f, t.query_terms, None)  # statistics of all documents
    wanted = lexical.bm25_hits(t.docs.filter(c("community") == "src7"), "id", f, t.query_terms, k=None, prepared=prepared)
    near = NN.nearest(t.vectors, t.query_vectors, threshold=0.25).join(t.docs.select("id"), "id", "left_semi")
    return search.union_candidates(wanted, near)


@query("atan_scale", views="D QT BM", sql=f"SELECT qid, id, {R('2 * atan(body / 8) / 3.14159')} AS scaled FROM BW WHERE body > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY body DESC, id) <= 700")
def _(t):
    s = lexical.bm25_hits(t.docs, "id", {"body": X.tokens(c("body"))}, t.query_terms)
    return s.select("qid", "id", r6(X.squash(c("score"))).alias("scaled"))


# ---- ranking and hybrid ------------------------------------------------------

DVV = "D V QV DV QT"


def dv(t):
    return t.doc_vectors


@query("best_query_per_doc", views="V QV", sql=f"SELECT id, {R('max(s)')} AS score, arg_max(qid, s) AS qid FROM ({ALLQ}) WHERE s > 0.1 GROUP BY id")
def _(t):
    return rounded(search.nearest_query(t.vectors, t.query_vectors, 0.1), "score")


@query("sort_asc_quirk", views="V QV", sql=f"""SELECT id, {R('s')} AS score, row_number() OVER (ORDER BY round(s, 6), id) AS place
  FROM (SELECT id, max(s) AS s FROM ({ALLQ}) WHERE s > 0.1 GROUP BY id)""")
def _(t):
    best = rounded(search.nearest_query(t.vectors, t.query_vectors, 0.1), "score")
    return ranking.with_row_index(best, [F.asc("score"), c("id")], "place").select("id", "score", "place")


@query("topk_by_score", views="V QV", sql=f"SELECT qid, id, {R('s')} AS score FROM ({ALLQ}) ORDER BY s DESC, id, qid LIMIT 700")
def _(t):
    per_query = NN.nearest(t.vectors, t.query_vectors, k=search.HITS)
    return rounded(ranking.top_k(per_query, [F.desc("score"), c("id"), c("qid")], search.HITS), "score")


@query("rerank_top", views="V QV", sql=f"""SELECT id, {R('s')} AS score FROM (SELECT id, max(s) AS s FROM ({ALLQ}) GROUP BY id)
  WHERE s > 0.15 ORDER BY s DESC, id LIMIT 1000""")
def _(t):
    best = search.nearest_query(t.vectors, t.query_vectors, 0.0)
    return rounded(search.rerank_top(best, 0.15, keep=1000).select("id", "score"), "score")


@query("rrf", views=f"{DVV} SC BM", sql=f"""WITH F1 AS (SELECT qid, id, bcos FROM SC QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ham DESC, id) <= 1000),
  F2 AS (SELECT qid, id, bcos, coalesce(body, 0) AS t FROM F1 LEFT JOIN BW USING (qid, id))
  SELECT qid, id, {R('1 / (60 + row_number() OVER (PARTITION BY qid ORDER BY t DESC, id)) + 1 / (60 + row_number() OVER (PARTITION BY qid ORDER BY bcos DESC, id))')} AS score FROM F2""")
def _(t):
    d, q = dv(t), t.query_vectors
    first = NN.nearest(d, q, k=1000, metric="hamming")
    text = lexical.bm25_pairs(t.docs, "id", {"body": X.tokens(c("body"))}, t.query_terms, first).withColumnRenamed("body", "t")
    pairs = first.join(text, ["qid", "id"], "left").fillna(0.0, ["t"]).drop("score")
    pairs = pairs.join(d.select("id", "v"), "id").join(q.select("qid", c("v").alias("q")), "qid")
    pairs = NN.pair_scores(pairs, {"s": ("v", "q")})
    return search.reciprocal_rank_fusion(pairs, ["t", "s"]).select("qid", "id", r6(c("rrf")).alias("score"))


@query("two_phase_rank", views=f"{DVV} SC BM", sql=f"""WITH S AS (SELECT qid, id, coalesce(bcos, 0) AS bcos, body + title AS t, row_number() OVER (PARTITION BY qid ORDER BY round(body + title, 12) DESC, id) AS rn
    FROM BW LEFT JOIN SC USING (qid, id) WHERE body + title > 0 QUALIFY rn <= 5000)
  SELECT qid, id, CASE WHEN rn <= 1000 THEN 2 ELSE 1 END AS phase, {R('CASE WHEN rn <= 1000 THEN bcos ELSE t END')} AS score FROM S""")
def _(t):
    d, f = dv(t), lexical.document_fields()
    cheap = lexical.bm25_hits(d, "id", {k: f[k] for k in ("title", "body")}, t.query_terms, k=search.ANN_HITS).withColumnRenamed("score", "cheap")
    out = search.two_phase(cheap, "cheap", lambda best: search.cosine_or_zero(best, d, t.query_vectors, "costly"))
    return rounded(out.select("qid", "id", "phase", "score"), "score")


def mm(leg_v, leg_t, alpha, name):
    unit = lambda s, src: f"SELECT qid, id, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 1 END AS u FROM ({src}) WINDOW w AS (PARTITION BY qid)"
    return f"""{name} AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, {alpha} * coalesce(a.u, 0) + (1 - {alpha}) * coalesce(b.u, 0) AS s
      FROM ({unit('s', leg_v)}) a FULL OUTER JOIN ({unit('s', leg_t)}) b ON a.qid = b.qid AND a.id = b.id)"""


# the reference distances select nothing on random vectors, so the legs are widened here
WIDE = {"keywords": (0.6, 0.9), "body": (0.9, 0.85), "title": (0.7, 0.9)}
LEGS_SQL = ", ".join([
    mm("SELECT qid, id, bcos AS s FROM SC WHERE bcos > 0.15", "SELECT qid, id, 3 * body + 2 * title + community AS s FROM BW WHERE body + title + community > 0", 0.9, "LB"),
    mm("SELECT qid, id, k1 AS s FROM K1", "SELECT qid, id, keywords AS s FROM BW WHERE keywords > 0", 0.6, "LK"),
    mm("SELECT qid, id, tcos AS s FROM SC WHERE tcos > 0.1", "SELECT qid, id, title AS s FROM BW WHERE title > 0", 0.7, "LT"),
])
K1 = "K1 AS (SELECT qid, id, list_cosine_similarity(DV.kv[1], QV.v) AS k1 FROM DV, QV WHERE list_cosine_similarity(DV.kv[1], QV.v) > 0.1)"
BM_DV = f"{DVV} SC BM"


@query("minmax_fusion", views=BM_DV, sql=f"""WITH {mm("SELECT qid, id, bcos AS s FROM SC WHERE bcos > 0.15",
  "SELECT qid, id, body AS s FROM BW WHERE body > 0", 0.9, "X")} SELECT qid, id, {R('s')} AS score FROM X""")
def _(t):
    d = dv(t)
    leg = search.hybrid_leg(d, t.query_vectors, t.query_terms, "v", {"body": X.tokens(c("body"))}, {}, 0.9, 0.85)
    return rounded(leg, "score")


@query("hybrid_leg_search", views=BM_DV, sql=f"WITH {K1}, {LEGS_SQL} SELECT qid, id, {R('(9 * LB.s + 2 * LK.s + LT.s) / 12')} AS score FROM LB JOIN LK USING (qid, id) JOIN LT USING (qid, id)")
def _(t):
    d = dv(t).withColumn("kw", c("kv")[0])
    return rounded(search.three_leg_search(d, t.query_vectors, t.query_terms, WIDE).select("qid", "id", "score"), "score")


@query("three_way_intersect", views=f"{DVV} SC", sql=f"""WITH S3 AS (SELECT SC.*, list_cosine_similarity(DV.kv[1], QV.v) AS k FROM SC JOIN DV USING (id) JOIN QV USING (qid)),
  TOP AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bcos, 12) DESC, id) AS p1, row_number() OVER (PARTITION BY qid ORDER BY round(tcos, 12) DESC, id) AS p2,
    row_number() OVER (PARTITION BY qid ORDER BY round(k, 12) DESC, id) AS p3 FROM S3)
  SELECT qid, id, {R('(9 * bcos + 2 * k + tcos) / 12')} AS score FROM TOP WHERE p1 <= 700 AND p2 <= 700 AND p3 <= 700""")
def _(t):
    d, q = dv(t).withColumn("kw", c("kv")[0]), t.query_vectors
    legs = [NN.nearest(d, q, k=search.HITS, vector=v) for v in ("v", "kw", "tv")]
    return rounded(search.three_way_intersect(*legs, ["qid", "id"]).select("qid", "id", "score"), "score")


@query("union_candidates", views=BM_DV, sql="""SELECT DISTINCT qid, id FROM (SELECT qid, id FROM BW WHERE title > 0
  UNION ALL (SELECT qid, id FROM SC QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ham DESC, id) <= 5000)
  UNION ALL (SELECT qid, id FROM SC QUALIFY row_number() OVER (PARTITION BY qid ORDER BY tcos DESC, id) <= 5000))""")
def _(t):
    d, q = dv(t), t.query_vectors
    text = lexical.text_matches(d, "id", {"title": X.tokens(c("title"))}, t.query_terms)
    return search.union_candidates(text, NN.nearest(d, q, k=search.ANN_HITS, metric="hamming"), NN.nearest(d, q, k=search.ANN_HITS, vector="tv"))


@query("funnel_search", views=BM_DV, sql=f"""WITH N1 AS (SELECT qid, id, tcos FROM SC WHERE round(bcos, 12) > 0)
  SELECT qid, id, {R('tcos')} AS score FROM N1 JOIN BW USING (qid, id) WHERE body + keywords > 0 AND tcos > 0""")
def _(t):
    f = lexical.document_fields()
    return rounded(search.funnel_search(dv(t), t.query_vectors, t.query_terms, {k: f[k] for k in ("body", "keywords")}), "score")


def rescoring(key, vector, first, second, **kw):
    @query(key, views="D V QV DV QT SC", sql=f"""WITH F1 AS (SELECT * FROM SC QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {first} DESC, id) <= 1000)
      SELECT qid, id, {R(first)} AS first_phase, {R(f'1 / (2 - {second})')} AS score FROM F1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {second} DESC, id) <= 700""")
    def _(t):
        return rounded(search.semantic_rescoring(dv(t), t.query_vectors, vector).select("qid", "id", "first_phase", "score"), "first_phase", "score")


rescoring("semantic_rescoring", "v", "inv", "bcos")
rescoring("title_semantic_rescoring", "tv", "tinv", "tcos")

SQ = "2 * atan({} / 8) / 3.14159"
def first_phase_sql(text):
    """Text OR sign-code neighbours; documents without a vector come in by their words, with vector parts of 0."""
    return f"""(SELECT * FROM (SELECT qid, id, ham, 1 / (2 - bcos) AS cb, tcos, kcos, 0 AS tx FROM SC
      UNION ALL SELECT qid, id, 0, 0, 0, 0, round({text}, 12) FROM BW WHERE id NOT IN (SELECT id FROM DV) AND qid IN (SELECT qid FROM QV) AND {text} > 0)
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ham DESC, tx DESC, id) <= 1000)"""


WC = f"""WCL AS (SELECT qid, id, ham, cb, tcos, kcos, coalesce(title, 0) AS t, coalesce(body, 0) AS b, coalesce(keywords, 0) AS k
    FROM {first_phase_sql('title + body + keywords')} LEFT JOIN BW USING (qid, id)),
  WC AS (SELECT *, 0.5 * (cb + {SQ.format('b')}) + 0.3 * ({SQ.format('k')} + kcos) + 0.2 * ({SQ.format('t')} + tcos) AS s FROM WCL
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 700)"""


def weighted(t):
    return search.weighted_closeness(dv(t), t.query_vectors, t.query_terms)


@query("weighted_closeness", views=BM_DV, sql=f"WITH {WC} SELECT qid, id, {R('s')} AS score FROM WC")
def _(t):
    return rounded(weighted(t).select("qid", "id", "score"), "score")


@query("match_features", views=BM_DV, sql=f"""WITH {WC} SELECT qid, id, {R('ham')} AS first_phase, {R('t')} AS bm25_title, {R('b')} AS bm25_body, {R('k')} AS bm25_keywords,
  {R('cb')} AS closeness_body, {R('tcos')} AS cosine_title, {R('kcos')} AS max_keyword_similarity, {R('s')} AS score FROM WC""")
def _(t):
    parts = ["first_phase", "bm25_title", "bm25_body", "bm25_keywords", "closeness_body", "cosine_title", "max_keyword_similarity", "score"]
    return rounded(weighted(t).select("qid", "id", *parts), *parts)


@query("multi_query_search", views=BM_DV, sql=f"WITH {WC} SELECT id, {R('s')} AS score, qid FROM WC QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, qid) = 1")
def _(t):
    return rounded(search.best_query_per_doc(weighted(t).select("qid", "id", "score")).select("id", "score", "qid"), "score")


@query("hit_projection", views=BM_DV, sql=f"""WITH {WC} SELECT id, {R('max(s)')} AS relevance_score, any_value(title) AS title, any_value(author) AS author, any_value(community) AS subreddit_name,
  any_value(permalink) AS permalink, any_value(strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%d %H:%M:%S')) AS created_utc FROM (SELECT qid, id, s FROM WC) JOIN D USING (id) GROUP BY id""")
def _(t):
    rows = search.hit_rows(weighted(t).select("qid", "id", "score"), t.docs)
    return rounded(rows.select("id", "relevance_score", "title", "author", "subreddit_name", "permalink", "created_utc"), "relevance_score")


@query("hybrid_rrf", views=BM_DV, sql=f"""WITH F1 AS (SELECT qid, id, cb, coalesce(title + body + keywords + community, 0) AS t
    FROM {first_phase_sql('title + body + keywords + community')} LEFT JOIN BW USING (qid, id)),
  F2 AS (SELECT qid, id, 1 / (60 + row_number() OVER (PARTITION BY qid ORDER BY t DESC, id)) + 1 / (60 + row_number() OVER (PARTITION BY qid ORDER BY cb DESC, id)) AS s FROM F1)
  SELECT qid, id, {R('s')} AS score FROM F2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 700""")
def _(t):
    return rounded(search.hybrid_rrf(dv(t), t.query_vectors, t.query_terms).select("qid", "id", "score"), "score")


@query("rerank_best_query", views="D", sql=f"""WITH T AS (SELECT id, {tok("'Subreddit:' || community || ' Title:' || title || ' Post: ' || body")} AS w FROM D),
  Q5 AS (SELECT item_id AS qid, list_distinct({tok('text')}) AS q FROM benchmark),
  S AS (SELECT id, qid, len(list_intersect(w, q)) / len(q) AS s FROM T, Q5)
  SELECT id, {R('max(s)')} AS score, min(qid) FILTER (s = m) AS qid FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM S) WHERE m > 0.25 GROUP BY id""")
def _(t):
    # the offline scorer: share of the query's distinct words that the whole text holds
    def overlap(queries, texts):
        wanted = [set(q.split()) for q in queries]
        held = [set(x.split()) for x in texts]
        return [[len(w & h) / len(w) for w in wanted] for h in held]

    words = lambda text: F.array_join(X.tokens(text), " ")
    d = spread(t.docs).select("id", words(X.rerank_text(c("community"), c("title"), c("body"))).alias("text"))
    best = search.rerank_best_query(d, t.benchmark.select(c("item_id").alias("qid"), words(c("text")).alias("query")), "text", overlap)
    return rounded(search.rerank_top(best, 0.25, keep=None).select("id", "score", "qid"), "score")
