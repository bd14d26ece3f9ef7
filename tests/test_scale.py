"""Answers that must not depend on sizes, and plans that must split a hot key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import clean, cluster, keywords, lexical, nearest, ranking, recs, search


@pytest.fixture
def corpus(spark):
    docs = spark.createDataFrame(
        [(1, "red red fox", 2.0), (2, "blue fox", None), (3, "green", 1.0), (4, "", 3.0), (5, None, 3.0), (6, "red hen", None)],
        "id bigint, body string, bonus double")
    # query 1 names a term twice, query 3 knows no word, query 4 only a common one
    terms = spark.createDataFrame([(1, "red"), (1, "red"), (1, "fox"), (2, "blue"), (3, "nothing"), (4, "fox")], "qid bigint, term string")
    return docs, terms


@pytest.mark.parametrize("search", ["bm25", "bonus", "fulltext", "pairs"])
def test_joined_and_travelling_search_agree(monkeypatch, spark, corpus, search):
    docs, terms = corpus
    fields = {"body": X.tokens(F.col("body"))}
    pairs = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (3, 2), (9, 1), (1, 99)], "qid bigint, id bigint")
    run = {"bm25": lambda: lexical.bm25_hits(docs, "id", fields, terms),
           "bonus": lambda: lexical.bm25_hits(docs, "id", fields, terms, bonus="bonus"),
           "fulltext": lambda: lexical.fulltext_hits(docs, "id", "body", terms),
           "pairs": lambda: lexical.bm25_pairs(docs, "id", fields, terms, pairs)}[search]
    travelling = run()
    rows = sorted(tuple(r) for r in travelling.collect())
    monkeypatch.setattr(lexical, "QUERY_TERMS", 0)
    joined = run()
    assert joined.columns == travelling.columns and rows
    got = sorted(tuple(r) for r in joined.collect())
    assert [r[:2] for r in got] == [r[:2] for r in rows]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in rows], abs=1e-9)


def test_repeated_queries_fill_no_places(spark):
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id bigint, v array<double>")
    queries = spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0])], "qid bigint, v array<double>")
    for limit in (nearest.MATRIX_ROWS, 0):
        got = nearest.nearest(items, queries, k=3, metric="dot", matrix_rows=limit)
        assert sorted((r.qid, r.id) for r in got.collect()) == [(1, 3), (1, 4), (1, 5)]


def test_ids_beyond_32_bits_train(spark):
    rows = [(3_000_000_000 + u, 5_000_000_000 + i, 1, 1) for u in range(6) for i in range(u, u + 3)]
    users, items = recs.train_factors(spark.createDataFrame(rows, "user_id bigint, item bigint, label int, day int"), rank=2, iterations=2)
    assert {r.id for r in users.collect()} == {r[0] for r in rows} and {r.id for r in items.collect()} == {r[1] for r in rows}


HOT = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
       "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def hot(spark):
    old = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def half_on_one_key(n=20_000):
    rng = np.random.default_rng(1)
    return [(int(k) if i % 2 else 7, i, "".join(chr(97 + c) for c in rng.integers(0, 26, 30)))
            for i, k in enumerate(rng.integers(0, 3000, n))]


def test_hot_keys_are_split(spark, hot):
    rows = half_on_one_key()
    comments = spark.createDataFrame([(f"t3_{k}", t) for k, _, t in rows], "link_id string, body string").repartition(8)
    posts = spark.createDataFrame([(str(k), f"title {k}", "text " * 20) for k in range(3000)], "id string, title string, body string")
    assert "skew=true" in plan_of(clean.join_parent_post(comments, posts))
    shown = spark.createDataFrame([(k, i, i % 2, t) for k, i, t in rows], "imp_id bigint, item bigint, label int, text string").repartition(8)
    assert "skew=true" in plan_of(recs.mixed_label_groups(shown))
    members = spark.createDataFrame([(k, i, [1.0, float(i % 5)]) for k, i, _ in rows], "component bigint, id bigint, v array<double>").repartition(8)
    assert "skew=true" in plan_of(cluster.assign_exemplar_distance(members, "component"))


def test_levels_merge_to_the_same_rows(spark):
    """Forty tasks of 25 rows each, merged three at a time, against one window."""
    rows = spark.range(0, 1000, 1, 40).selectExpr("id % 3 AS qid", "id", "CAST(hash(id) % 50 AS DOUBLE) AS score")
    order = [F.desc("score"), F.col("id")]
    want = ranking.top_k_per_group(rows, ["qid"], order, 4).orderBy("qid", "rn").collect()
    levels = ranking.merged_top_k(rows, 40, ["qid"], order, 4, fan_in=3)
    assert levels.orderBy("qid", "rn").collect() == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert ranking.merged_top_k(rows, 40, ["qid"], order, 4, fan_in=3)._jdf.queryExecution().executedPlan().toString().count("Exchange") >= 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_phrases_do_not_depend_on_the_batch(spark):
    docs = spark.createDataFrame([(i, f"red fox {'jumps' if i % 2 else 'sleeps'} near stone{i % 3} water") for i in range(12)], "id bigint, body string")
    idf = keywords.word_weights(docs, "id", "body")
    whole = {r.id: r.keywords for r in keywords.keyphrases(docs, "id", "body").collect()}
    part = {r.id: r.keywords for r in keywords.keyphrases(docs.filter("id < 5"), "id", "body", idf=idf).collect()}
    assert part == {i: whole[i] for i in range(5)}


def test_keyphrases_ask_once_per_block_for_a_words_weight(spark, monkeypatch):
    """Documents that share their words send them once per block, and rows of a key keep their own phrases."""
    rows = [(i % 50, f"alpha beta gamma delta w{i % 7}") for i in range(200)] + [(None, "alpha beta"), (60, None), (61, "")]
    docs = spark.createDataFrame(rows, "id bigint, body string").coalesce(1)
    blocks = []
    real = keywords.stored
    monkeypatch.setattr(keywords, "stored", lambda df, name: blocks.append(real(df, name)) or blocks[-1])
    monkeypatch.setattr(keywords, "spread", lambda df: df)
    got = keywords.keyphrases(docs, "id", "body").collect()
    assert len(got) == 203
    assert all(r.keywords == [] for r in got if r.id is None or r.id >= 60) and all(len(r.keywords) == 5 for r in got if r.id is not None and r.id < 60)
    assert blocks[0].select("_block").distinct().count() == 1
    plan = keywords.keyphrases(docs, "id", "body")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "_block" in plan  # no list of words per document is shuffled


def test_python_workers_get_small_batches_and_work_on_small_pieces(spark, tmp_path):
    """Whole texts go to Python workers in batches of bounded bytes; lists are looked up in bounded pieces."""
    import pyarrow as pa

    from threadloom.plans.views import Tables

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text")).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    got = Tables(spark, str(tmp_path)).documents.coalesce(1).mapInArrow(sizes, "n bigint").collect()
    assert sum(r.n for r in got) > 32 << 20 and max(r.n for r in got) < 10 << 20

    lists = pa.array([["a"] * 100_000, None, ["b"] * 200_000, [], ["c"] * 600_000] + [["d"]] * 1000)
    pieces = list(lexical._pieces(pa.RecordBatch.from_arrays([lists], ["t"]), range(1)))
    assert sum(p.num_rows for p in pieces) == len(lists) and pa.concat_arrays([p.column(0) for p in pieces]) == lists
    assert all(p.num_rows <= lexical.DOCS for p in pieces)
    assert all(p.num_rows == 1 or len(p.column(0).flatten()) <= lexical.TOKENS for p in pieces)


def test_a_scorer_gets_few_texts_at_once(spark):
    docs = spark.range(1300).select("id", F.lit("a b").alias("text")).coalesce(1)
    queries = spark.createDataFrame([(1, "a")], "qid bigint, query string")

    def scorer(asked, texts):
        assert list(texts.index) == list(range(len(texts))) and len(texts) <= 512
        return [[1.0] * len(asked) for _ in texts]

    assert search.rerank_best_query(docs, queries, "text", scorer).count() == 1300


def test_report_tables_count_ids_in_bounded_shares(spark, tmp_path):
    from threadloom.plans import load

    rows = {"documents": ("doc_id bigint, text string, lang string, source string, n_chars bigint", [(1, "A b.", "en", "s", 4)]),
            "labels": ("doc_id bigint, quality int, toxic int", [(1, 1, 0)]),
            "orders": ("o_orderkey bigint, o_orderpriority string", [(1, "1-URGENT"), (2, "5-LOW")]),
            "part": ("p_partkey bigint, p_brand string", [(1, "B")]),
            "lineitem": ("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_extendedprice double", [(1, 1, 1, 2.0), (1, 1, 1, 2.0), (2, 1, 1, 3.0)])}
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = load().spark_queries()["report_to_tables"](spark, str(tmp_path))
    assert {r.tab: (r.n_rows, r.n_ids, r.orphans) for r in out.collect()}["pain_points"] == (2, 1, 0)
    assert "RepartitionByExpression [id" in out._jdf.queryExecution().optimizedPlan().toString()
