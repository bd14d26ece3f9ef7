import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import vectors as V
from threadloom.operators import cluster as CL, infer, keywords, lexical, nearest as NN, search
from threadloom.operators.ranking import top_k_per_group


def vectors(spark, n, dims=16, seed=0, copies=0):
    m = np.random.default_rng(seed).standard_normal((n, dims))
    if copies:
        m[:copies] = m[0]  # a hot group of copies
    return m, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id bigint, v array<double>")


def cosines(a, b):
    return (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T


@pytest.mark.parametrize("sizes", [{}, {"matrix_rows": 30}, {"matrix_rows": 5, "block_rows": 7}])
def test_nearest_is_exact_on_all_paths(spark, sizes):
    items, idf = vectors(spark, 25, seed=1, copies=8)
    qs, qdf = vectors(spark, 40, seed=2)
    sim = cosines(qs, items)
    got = NN.nearest(idf, qdf.withColumnRenamed("id", "qid"), k=3, **sizes).collect()
    want = {(q, i) for q in range(40) for i in sorted(range(25), key=lambda i: (-round(sim[q, i], 12), i))[:3]}
    assert {(r["qid"], r["id"]) for r in got} == want
    above = NN.nearest(idf, qdf.withColumnRenamed("id", "qid"), threshold=0.2, **sizes).collect()
    assert {(r["qid"], r["id"]) for r in above} == {(q, i) for q in range(40) for i in range(25) if sim[q, i] > 0.2}


@pytest.mark.parametrize("sizes", [{}, {"matrix_rows": 30}, {"matrix_rows": 5, "block_rows": 7}])
def test_skipped_pairs_are_never_found_even_for_a_hot_query(spark, sizes):
    items, idf = vectors(spark, 25, seed=1)
    qs, qdf = vectors(spark, 40, seed=2)
    sim = cosines(qs, items)
    read = {(0, i) for i in range(23)} | {(q, q % 25) for q in range(40)} | {(7, 999)}
    skip = spark.createDataFrame(sorted(read), "qid bigint, id bigint")
    got = NN.nearest(idf, qdf.withColumnRenamed("id", "qid"), k=3, skip=skip, **sizes).collect()
    want = {(q, i) for q in range(40) for i in sorted((i for i in range(25) if (q, i) not in read), key=lambda i: -sim[q, i])[:3]}
    assert {(r["qid"], r["id"]) for r in got} == want


@pytest.mark.parametrize("sizes", [{}, {"matrix_rows": 5, "block_rows": 16}])
def test_coded_search_finds_exactly_the_items_sharing_a_byte(spark, sizes):
    items, idf = vectors(spark, 120, seed=4, copies=40)
    qs, qdf = vectors(spark, 20, seed=5)
    a, b = np.packbits(items > 0, axis=1), np.packbits(qs > 0, axis=1)
    want = {(q, i) for q in range(20) for i in range(120) if (a[i] == b[q]).any()}
    got = NN.sign_code_candidates(idf, qdf.withColumnRenamed("id", "qid"), k=200, **sizes).collect()
    assert {(r["qid"], r["id"]) for r in got} == want and len(got) == len(want)


def test_recall_of_the_coded_search_on_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 64))
    items = np.repeat(centres, 20, axis=0) + 0.2 * rng.standard_normal((400, 64))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(items)], "id bigint, v array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(centres)], "qid bigint, v array<double>")
    exact, approx = ({(r["qid"], r["id"]) for r in f.collect()} for f in (NN.nearest(df, q, k=10), NN.sign_code_candidates(df, q, k=10)))
    assert len(exact & approx) / len(exact) > 0.95


@pytest.mark.parametrize("metric,cut", [("cosine", 0.6), ("cosine", 0.999), ("euclid", 4.0)])
def test_similar_pairs_equal_brute_force_with_a_hot_group(spark, metric, cut):
    m, df = vectors(spark, 150, dims=12, seed=3, copies=60)
    dist = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    good = cosines(m, m) >= cut if metric == "cosine" else dist <= cut
    want = {(a, b) for a, b in itertools.combinations(range(150), 2) if good[a, b]}
    got = NN.similar_pairs(df, cut, metric=metric, block_rows=16).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("metric,cut", [("cosine", 0.6), ("euclid", 4.0)])
def test_forest_and_counts_agree_with_all_pairs(spark, metric, cut):
    m, df = vectors(spark, 150, dims=12, seed=3, copies=60)
    pairs = [(r["a"], r["b"]) for r in NN.similar_pairs(df, cut, metric=metric).collect()]
    forest = [(r["a"], r["b"]) for r in NN.similar_forest(df, cut, metric=metric, block_rows=16).collect()]
    labels = {}
    for name, edges in (("pairs", pairs), ("forest", forest)):
        lab = np.arange(150)
        labels[name] = NN._union(lab, np.array([a for a, _ in edges]), np.array([b for _, b in edges])).tolist()
    assert labels["pairs"] == labels["forest"] and len(forest) < len(pairs)
    counts = {r["id"]: r["n"] for r in NN.neighbour_counts(df, cut, metric=metric, block_rows=16).collect()}
    assert counts == {i: n for i in range(150) if (n := sum(i in p for p in pairs))}


def test_copies_are_handled_once_and_all_get_their_cluster(spark):
    m = np.vstack([np.tile([1.0, 0, 0], (300, 1)), np.tile([0, 1.0, 0], (2, 1)), [[0, 0, 1.0]]])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id bigint, v array<double>")
    reps, links = NN.collapse_copies(df)
    assert sorted((r["id"], r["weight"]) for r in reps.collect()) == [(0, 300), (300, 2), (302, 1)] and links.count() == 303
    got = {r["id"]: r["cluster"] for r in CL.exemplar_clusters(df).collect()}
    assert [got[i] for i in range(303)] == [0] * 300 + [300] * 2 + [CL.MISC]
    dense = {r["id"]: r["cluster"] for r in CL.dense_components(df, eps=0.1, min_size=2, min_samples=1).collect()}
    assert [dense[i] for i in range(303)] == [0] * 300 + [300] * 2 + [CL.MISC]


def test_components_of_a_chain_a_hub_and_pairs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5001, 5000), (5000, 5000)]
    got = {r["id"]: r["component"] for r in CL.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(61)} == {0}
    assert {got[1000 + i] for i in range(200)} == {1000}
    assert got[5001] == got[5000] == 5000 and len(got) == 61 + 200 + 2


def test_exemplar_clusters_default_threshold(spark):
    base = np.eye(8)
    rows = [base[0] + 0.01 * base[i] for i in range(1, 5)] + [base[5], base[5] + 0.05 * base[6], base[7]]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id bigint, v array<double>")
    got = {r["id"]: (r["cluster"], r["distance"]) for r in CL.exemplar_clusters(df).collect()}
    assert {got[i][0] for i in range(4)} == {got[0][0]} and got[0][0] in range(4)
    assert got[4][0] == got[5][0] == 4 and got[6] == (CL.MISC, None)
    assert all(d <= 0.15 for c, d in got.values() if c != CL.MISC)


def test_dense_components_leave_noise(spark):
    rng = np.random.default_rng(5)
    rows = list(rng.normal(0, 0.02, (6, 3))) + list(rng.normal(5, 0.02, (6, 3))) + [np.array([9.0, -9.0, 0.0])]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id bigint, v array<double>")
    got = [r["cluster"] for r in sorted(CL.dense_components(df, eps=0.5).collect(), key=lambda r: r["id"])]
    assert got == [0] * 6 + [6] * 6 + [-1]


def test_vector_columns(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0, -3.0, 4.0, 5.0, 6.0], [0.0] * 8)], "a array<double>, z array<double>")
    r = df.select(
        V.code_bytes(F.col("a"), 8)[0].alias("byte"), V.signed_bytes(F.col("a"), 8)[0].alias("signed"),
        V.cosine(F.col("a"), F.col("z")).alias("cos"), V.l2_normalise(F.col("z")).alias("unit"), V.truncate_dims(F.col("a"), 2).alias("cut"),
        V.unpack_signs(V.binarise(F.col("a"), 8), 8).alias("signs"),
    ).first()
    assert r["byte"] == 0b10010111 and r["signed"] == 0b10010111 - 128
    assert r["cos"] is None and r["unit"] == [0.0] * 8 and r["cut"] == [1.0, -1.0]
    assert r["signs"] == [1, -1, -1, 1, -1, 1, 1, 1]


DOCS = [(1, "red apple", "the red apple and the red pear", ["apple"], "x"), (2, "pear", "a pear", [], "x"), (3, "", "the the the", [], "y")]
TERMS = [(1, "red"), (1, "pear"), (2, "the"), (3, "absent")]


@pytest.fixture
def corpus(spark):
    docs = spark.createDataFrame(DOCS, "id bigint, title string, body string, keywords array<string>, community string")
    return docs, spark.createDataFrame(TERMS, "qid bigint, term string")


def test_in_task_bm25_equals_the_relational_form(spark, corpus, monkeypatch):
    docs, terms = corpus
    fields = lexical.document_fields(True)
    joined = {(r["qid"], r["id"]): r["score"] for r in lexical.bm25(docs, "id", fields, terms).collect()}
    hits = {(r["qid"], r["id"]): r["score"] for r in lexical.bm25_hits(docs, "id", fields, terms, k=10).collect()}
    assert hits.keys() == joined.keys() and len(hits) == 4
    assert all(abs(hits[k] - joined[k]) < 1e-9 for k in hits)
    pairs = spark.createDataFrame([(1, 1), (1, 3), (3, 2)], "qid bigint, id bigint")
    parts = {(r["qid"], r["id"]): sum(r[f] for f in fields) for r in lexical.bm25_pairs(docs, "id", fields, terms, pairs).collect()}
    assert abs(parts[1, 1] - joined[1, 1]) < 1e-9 and parts[1, 3] == 0
    # a query set too large to travel is joined instead, with the same result
    monkeypatch.setattr(lexical.QuerySet, "of", classmethod(lambda cls, terms, k=1, max_rows=0: None))
    slow = {(r["qid"], r["id"]): r["score"] for r in lexical.bm25_hits(docs, "id", fields, terms, k=10).collect()}
    assert all(abs(hits[k] - slow[k]) < 1e-9 for k in hits) and slow.keys() == hits.keys()
    one = lexical.bm25_hits(docs, "id", fields, terms, k=1).collect()
    assert {(r["qid"], r["id"]) for r in one} == {(1, 1), (2, 3)}


def test_phrases_need_adjacent_words_in_order(spark, corpus, rows):
    docs, _ = corpus
    phrases = spark.createDataFrame([("red apple",), ("apple red",), ("the red",), ("pear",)], "phrase string")
    got = rows(lexical.phrase_hits(docs, "id", "body", phrases, [1, 2]).select("id", "phrase"))
    assert got == [(1, "pear"), (1, "red apple"), (1, "the red"), (2, "pear")]


def test_bold(spark, corpus):
    docs, terms = corpus
    got = {r["id"]: r["marked"] for r in lexical.bold_field(docs, "id", "title", terms).collect()}
    assert got == {1: "<hi>red</hi> apple", 2: "<hi>pear</hi>", 3: ""}


def test_minmax_and_order_flags(spark, rows):
    leg = lambda d: spark.createDataFrame(d, "qid bigint, id bigint, score double")
    v, t = leg([(1, 1, 0.9), (1, 2, 0.5)]), leg([(1, 2, 7.0), (1, 3, 7.0)])
    assert rows(search.minmax_fusion(v, t, 0.6)) == [(1, 1, 0.6), (1, 2, 0.4), (1, 3, 0.4)]
    hits = leg([(1, 1, 0.2), (2, 1, 0.8), (1, 2, 0.5)])
    assert [r["id"] for r in search.best_query_per_doc(hits).collect()] == [1, 2]
    assert [r["id"] for r in search.best_query_per_doc(hits, ascending=True).collect()] == [2, 1]
    assert [r["score"] for r in search.rerank_top(hits, 0.2).collect()] == [0.8, 0.5]


def test_two_phase_keeps_the_rest_below(spark):
    c = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "qid bigint, id bigint, cheap double")
    seen = []
    out = search.two_phase(c, "cheap", lambda best: best.withColumn("costly", -F.col("id").cast("double")), depth=2)
    got = {r["id"]: (r["phase"], r["score"]) for r in out.collect()}
    assert got[5] == (2, -5.0) and got[4] == (2, -4.0) and got[3] == (1, 3.0) and got[0] == (1, 0.0) and not seen


def test_rerank_scores_whole_texts_with_all_queries_or_the_first_ones(spark):
    docs = spark.createDataFrame([(1, "x" * 5000 + " end"), (2, "none")], "id bigint, text string")
    queries = spark.createDataFrame([(i, "end" if i == 5 else "zzz") for i in range(7)], "qid bigint, query string")
    scorer = lambda qs, texts: [[float(q in x) for q in qs] for x in texts]
    assert search.rerank_best_query(docs, queries, "text", scorer, max_queries=5).collect() == []
    got = search.rerank_best_query(docs, queries, "text", scorer).collect()
    assert [(r["id"], r["qid"], r["score"]) for r in got] == [(1, 5, 1.0)]


def brute_phrases(words, idf, top=5, diversity=0.5, max_n=3):
    """The definition, written out with dictionaries."""
    from collections import Counter
    vec = lambda ws: {w: n * idf[w] for w, n in Counter(ws).items()}
    def cos(a, b):
        n = np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / n
    # repeated words inside a phrase count twice, as in the document
    cand = {tuple(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)}
    doc = vec(words)
    rel = {c: round(cos(vec(c), doc), 9) for c in cand}
    chosen = []
    while len(chosen) < min(top, len(cand)):
        def value(c):
            if not chosen:
                return rel[c]
            return round((1 - diversity) * rel[c] - diversity * max(cos(vec(c), vec(s)) for s in chosen), 9)
        best = max(value(c) for c in cand if c not in chosen)
        chosen.append(min((c for c in cand if c not in chosen and value(c) == best), key=lambda c: tuple(c) + ("￿",) * (max_n - len(c))))
    return [" ".join(c) for c in chosen]


def test_keyphrases_equal_the_written_out_definition(spark):
    texts = ["slow app slow login and the app crashes", "the login page", "crash after update the update", "one", "", "a b a b a c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: r["keywords"] for r in keywords.keyphrases(docs, "id", "text").collect()}
    toks = [t.split() for t in texts]
    idf = {w: np.log((1 + len(texts)) / (1 + sum(w in t for t in toks))) + 1 for t in toks for w in t}
    assert got == {i: brute_phrases(t, idf) for i, t in enumerate(toks)}


def test_inference_retries_and_keeps_neighbours(spark, tmp_path):
    def flaky(texts):
        import os
        if any(t == "bad" for t in texts):
            raise ValueError("bad text")
        mark = f"{tmp_path}/tried"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("first time")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id bigint, text string").coalesce(1)
    got = {r["id"]: (r["ok"], r["result"], r["error"]) for r in infer.batch_infer(df, "id", "text", flaky).collect()}
    assert got == {1: (True, "A", None), 2: (False, "", "ValueError: bad text"), 3: (True, "C", None)}


def test_embedding_function_is_cut_not_scaled(spark):
    df = spark.createDataFrame([(1, "abc")], "id bigint, text string")
    got = infer.embed_column(df, "text", fn=lambda s: [[3.0, 4.0, 5.0] for _ in s], dims=2, prefix="query: ").first()
    assert got["v"] == [3.0, 4.0]


def test_attached_keywords_are_the_phrases(spark):
    texts = ["slow app slow login and the app crashes", "the login page", "", None, "one"]
    docs = spark.createDataFrame([(i, f"t{i}", x) for i, x in enumerate(texts)], "id bigint, title string, body string")
    found = keywords.keyphrases(docs.filter("body IS NOT NULL").select("id", "body"), "id", "body")
    got = {r["id"]: r["keywords"] for r in keywords.attach_keywords(docs, found, "id").collect()}
    toks = [x.split() for x in texts if x is not None]
    idf = {w: np.log((1 + len(toks)) / (1 + sum(w in t for t in toks))) + 1 for t in toks for w in t}
    assert got == {i: brute_phrases((x or "").split(), idf) for i, x in enumerate(texts)}


def test_text_stats_count_whole_texts_as_python_does(spark):
    import re

    from threadloom.functions import text as X
    texts = ["One two. Three!\n\nFour's end?", "café crème naïve word", "Привет мир. Да!", "\u3053\u3093", " \n\t ", "", None, "x\n \n\n12 34\n\ny.z", "--\n\na"]

    def stats(x):
        if x is None or not re.sub(r"[ \t\n\x0b\f\r]", "", x):
            return None
        parts = [p for p in re.split(r"\n[ \t\n\x0b\f\r]*\n", x) if re.search("[a-zA-Z]", p)]
        kept = "\n\n".join(parts)
        return len(re.findall(r"\b[a-zA-Z0-9']+\b", kept)), len(re.findall("[.!?]", kept)), len(parts)

    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["s"] and tuple(r["s"]) for r in df.select("id", X.text_stats(F.col("text")).alias("s")).collect()}
    assert got == {i: stats(x) for i, x in enumerate(texts)}


@pytest.fixture(scope="module")
def half_embedded(spark):
    """Documents of which every second one has no vector."""
    words = ["alpha beta gamma", "alpha", "beta beta", "delta", "alpha beta", "gamma", "epsilon", "alpha alpha"]
    v = lambda i: [float(np.cos(i)), float(np.sin(i)), 0.5]
    rows = [(i, w, w, "c", v(i) if i % 2 == 0 else None) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "id bigint, title string, body string, community string, v array<double>")
    docs = docs.withColumn("keywords", F.split("title", " ")).withColumn("tv", F.reverse("v")).withColumn(
        "kv", F.when(F.col("v").isNotNull(), F.array("v", "tv")))
    queries = spark.createDataFrame([(1, v(0)), (2, v(3))], "qid bigint, v array<double>")
    terms = spark.createDataFrame([(1, "alpha"), (2, "gamma"), (2, "beta")], "qid bigint, term string")
    return docs, queries, terms


def test_documents_without_a_vector_are_found_by_their_words(half_embedded):
    docs, queries, terms = half_embedded
    hits = search.weighted_closeness(docs, queries, terms).collect()
    found = {(r["qid"], r["id"]): r for r in hits}
    assert {i for q, i in found if q == 1} == {0, 2, 4, 6} | {1, 7}  # neighbours, and bare documents with the word
    assert {i for q, i in found if q == 2} == {0, 2, 4, 6} | {5}
    bare = found[1, 7]
    assert bare["closeness_body"] == bare["cosine_title"] == bare["max_keyword_similarity"] == bare["first_phase"] == 0 and bare["score"] > 0
    assert {(r["qid"], r["id"]) for r in search.hybrid_rrf(docs, queries, terms).collect()} == set(found)
    assert [r["id"] for r in search.first_phase(docs, queries, terms, lexical.document_fields(), 5).filter("qid = 1").collect() if r["id"] % 2] == [7]


def test_the_large_query_way_finds_the_same_documents(half_embedded, monkeypatch):
    docs, queries, terms = half_embedded
    want = sorted(map(tuple, search.first_phase(docs, queries, terms, lexical.document_fields(), 6).collect()))
    monkeypatch.setattr(lexical, "QUERY_TERMS", 1)
    assert sorted(map(tuple, search.first_phase(docs, queries, terms, lexical.document_fields(), 6).collect())) == want


def test_funnel_and_nearest_query(half_embedded):
    docs, queries, terms = half_embedded
    f = lexical.document_fields()
    got = {(r["qid"], r["id"]) for r in search.funnel_search(docs, queries, terms, {"body": f["body"]}, k=4, cut=-2.0).collect()}
    assert got == {(1, 0), (1, 4), (2, 0), (2, 2), (2, 4)}
    best = {r["id"]: r["qid"] for r in search.nearest_query(docs, queries, -2.0).collect()}
    cos = lambda i, q: np.cos(i - (0 if q == 1 else 3)) + 0.25
    assert best == {i: 1 if cos(i, 1) >= cos(i, 2) else 2 for i in (0, 2, 4, 6)}


def test_rerank_in_shares_and_blocks_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5}") for i in range(40)], "id bigint, text string")
    queries = spark.createDataFrame([(i, f"w{i % 9}") for i in range(25)], "qid bigint, query string")
    scorer = lambda qs, texts: [[float(q in x.split()) for q in qs] for x in texts]
    run = lambda **o: sorted(map(tuple, search.rerank_best_query(docs, queries, "text", scorer, **o).collect()))
    want = run()
    assert want == [(i, min(i % 7, i % 5), 1.0) for i in range(40)] and run(block=3) == want
    monkeypatch.setattr(search, "RERANK_QUERIES", 6)
    assert run(block=2) == want


def test_text_matches_have_no_limit(half_embedded, monkeypatch):
    docs, _, terms = half_embedded
    more = docs.crossJoin(docs.sparkSession.range(700).withColumnRenamed("id", "n")).withColumn("id", F.col("n") * 8 + F.col("id"))
    fields = {"title": lexical.document_fields()["title"]}
    want = sorted([(1, n * 8 + i) for n in range(700) for i in (0, 1, 4, 7)] + [(2, n * 8 + i) for n in range(700) for i in (0, 2, 4, 5)])
    found = lexical.text_matches(more, "id", fields, terms)
    assert "Join" not in found.select("qid")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(lexical, "QUERY_TERMS", 1)
    assert sorted(map(tuple, lexical.text_matches(more, "id", fields, terms).collect())) == want


def test_union_candidates_takes_every_text_match():
    """More documents than the 5000 nearest that a vector leg may bring."""
    from threadloom.plans import registry, search_queries  # noqa: F401
    sql = registry.ORACLES["union_candidates"]
    text = sql[sql.index("BW WHERE title > 0"):].split("UNION ALL")[0]
    assert "QUALIFY" not in text and "LIMIT" not in text


def test_funnel_takes_every_body_hit(half_embedded):
    docs, queries, terms = half_embedded
    more = docs.crossJoin(docs.sparkSession.range(300).withColumnRenamed("id", "n")).withColumn("id", F.col("n") * 8 + F.col("id"))
    got = {(r["qid"], r["id"]) for r in search.funnel_search(more, queries, terms, {"body": lexical.document_fields()["body"]}, cut=-2.0).collect()}
    cos = lambda i, q: np.cos(i - (0 if q == 1 else 3)) + 0.25
    asked = {1: (0, 4), 2: (0, 2, 4)}  # those with a vector and a query word
    assert got == {(q, n * 8 + i) for q, ids in asked.items() for i in ids if cos(i, q) > 0 for n in range(300)} and len(got) > 2 * 200


def test_filtered_hybrid_keeps_every_document_with_a_query_word(spark, tmp_path):
    """More matches of one community than the 5000 that the text leg once kept; the twin in DuckDB agrees."""
    import duckdb

    import __spark_entry__ as entry

    n = 5200
    rows = [(i, f"Alpha {i}. common beta", "en", "src7", 20) for i in range(n)] + [(n, "common", "en", "src1", 6), (n + 1, "none", "en", "src7", 4)]
    tables = {"documents": (rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
              "benchmark": ([(1, "common"), (2, "beta 7")], "item_id bigint, text string"),
              "embeddings": ([(i, [0.0] * i + [1.0] + [0.0] * (63 - i), 0) for i in range(3)], "vec_id bigint, embedding array<float>, label int")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {tuple(r) for r in entry.queries()["filtered_hybrid"](spark, str(tmp_path)).collect()}
    assert got == {(q, i) for q in (1, 2) for i in range(n)}
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert set(con.execute(entry.oracle_sql()["filtered_hybrid"]).fetchall()) == got


def test_all_bm25_hits_are_the_same_by_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b" if i % 3 else "a c c") for i in range(40)], "id bigint, body string")
    terms = spark.createDataFrame([(1, "a"), (2, "c"), (2, "b"), (3, "z")], "qid bigint, term string")
    fields = {"body": lexical.tokens(F.col("body"))}
    run = lambda: {(r["qid"], r["id"]): r["score"] for r in lexical.bm25_hits(docs, "id", fields, terms, k=None).collect()}
    fast = run()
    assert set(fast) == {(q, i) for q in (1, 2) for i in range(40)}
    monkeypatch.setattr(lexical, "QUERY_TERMS", 1)
    slow = run()
    assert set(slow) == set(fast) and all(abs(slow[k] - fast[k]) < 1e-9 for k in fast)
