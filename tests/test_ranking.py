import random

from pyspark.sql import functions as F

from threadloom.operators import ranking, recs, report


def test_row_index_is_consecutive_and_ordered(spark):
    df = spark.createDataFrame([(i, i % 3) for i in random.Random(1).sample(range(5000), 5000)], "id int, g int")
    got = sorted(ranking.with_row_index(df, [F.col("g"), F.desc("id")], "rn").collect(), key=lambda r: r["rn"])
    assert [r["rn"] for r in got] == list(range(1, 5001))
    assert [(r["g"], -r["id"]) for r in got] == sorted((i % 3, -i) for i in range(5000))


def test_positions_in_a_hot_group_equal_a_window(spark):
    # one group holds most rows and is spread over all partitions
    df = spark.createDataFrame([("hot" if i % 10 else f"g{i % 7}", i * 7919 % 4001) for i in range(4000)] + [(None, 5)], "g string, v int")
    got = ranking.with_group_position(df, ["g"], [F.desc("v")], "pos", size="n").collect()
    want = {}
    for r in sorted(got, key=lambda r: (str(r["g"]), -r["v"])):
        want.setdefault(r["g"], []).append(r)
    for g, rs in want.items():
        assert [r["pos"] for r in rs] == list(range(1, len(rs) + 1))
        assert {r["n"] for r in rs} == {len(rs)}
    assert len(got) == 4001


def test_edge_reorder_puts_the_best_outside(spark):
    for n in (1, 2, 5, 6):
        df = spark.range(n)  # id 0 is best
        got = [r["id"] for r in sorted(ranking.edge_reorder(df, [F.col("id")]).collect(), key=lambda r: r["position"])]
        items, want = list(range(n)), []
        for i, x in enumerate(reversed(items)):
            want = want + [x] if i % 2 else [x] + want
        assert got == want


def test_keyset_pages_lose_nothing_on_a_shared_second(spark):
    df = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 7)], "ts int, id int")
    seen, after = [], None
    while page := ranking.keyset_page(df, "ts", "id", after, size=3).collect():
        seen += [r["id"] for r in page]
        after = (page[-1]["ts"], page[-1]["id"])
    assert seen == list(range(8))


def test_samples_repeat(spark):
    df = spark.range(1000)
    a, b = (sorted(r["id"] for r in ranking.sample_fixed(df.repartition(n), "id", 50).collect()) for n in (2, 5))
    assert a == b and len(set(a)) == 50
    n = ranking.sample_bernoulli(df, "id", 0.3).count()
    assert 220 < n < 380


def test_best_per_key_takes_the_lowest_query_on_a_tie(spark, rows):
    df = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (1, 9, 0.1), (2, 1, 0.0)], "id int, qid int, score double")
    assert rows(ranking.best_per_key(df, ["id"], "score", "qid", ["qid", "score"])) == [(1, 0.5, 3), (2, 0.0, 1)]


def impressions(spark, data):
    from datetime import date
    return spark.createDataFrame([(f"u{u}_{d}", u, date(2024, 1, d), i, l, n) for n, (u, d, i, l) in enumerate(data)],
                                 "imp_id string, user_id int, day date, item int, label int, seen int")


def test_negative_sampling_has_no_repeats_and_takes_what_there_is(spark):
    data = [(1, 1, i, int(i < 3)) for i in range(40)] + [(2, 1, 1, 1), (2, 1, 2, 0)] + [(3, 1, 1, 1)]
    out = recs.negative_sampling(impressions(spark, data), k=4).collect()
    by = {}
    for r in out:
        by.setdefault((r["imp_id"], r["positive"]), []).append((r["label"], r["item"]))
    assert {k: sum(1 for l, _ in v if not l) for k, v in by.items()} == {("u1_1", 0): 4, ("u1_1", 1): 4, ("u1_1", 2): 4, ("u2_1", 1): 1, ("u3_1", 1): 0}
    for (_, positive), v in by.items():
        assert len(set(v)) == len(v) and (1, positive) in v
        assert all(l or i >= 2 for l, i in v)


def test_history_uses_earlier_days_only(spark, rows):
    data = [(1, 1, 5, 1), (1, 1, 6, 0), (1, 2, 5, 0), (1, 2, 6, 1), (2, 2, 5, 1)]
    out = recs.not_in_history(impressions(spark, data)).select("imp_id", "item")
    assert rows(out) == [("u1_1", 5), ("u1_1", 6), ("u1_2", 6), ("u2_2", 5)]


def brute(labels, scores):
    import math
    order = sorted(range(len(labels)), key=lambda i: (-scores[i], i))
    pos = [i for i in range(len(labels)) if labels[i]]
    neg = [i for i in range(len(labels)) if not labels[i]]
    auc = sum((scores[p] > scores[n]) + 0.5 * (scores[p] == scores[n]) for p in pos for n in neg) / (len(pos) * len(neg))
    mrr = sum(labels[i] / (k + 1) for k, i in enumerate(order)) / len(pos)
    dcg = lambda seq, k: sum((2 ** l - 1) / math.log2(j + 2) for j, l in enumerate(seq[:k]))
    ndcg = lambda k: dcg([labels[i] for i in order], k) / dcg(sorted(labels, reverse=True), k)
    return auc, mrr, ndcg(5), ndcg(10)


def test_metrics_equal_brute_force_with_ties(spark):
    rnd = random.Random(3)
    groups = []
    while len(groups) < 30:
        n = rnd.randint(2, 40)
        labels = [rnd.randint(0, 1) for _ in range(n)]
        if 0 < sum(labels) < n:
            groups.append((labels, [rnd.randint(0, 6) / 4 for _ in range(n)]))
    data = [(f"g{g}", i, l, s) for g, (labels, scores) in enumerate(groups) for i, (l, s) in enumerate(zip(labels, scores))]
    data += [("all", 0, 1, 0.5), ("none", 0, 0, 0.5)]
    df = spark.createDataFrame(data, "imp_id string, item int, label int, score double")
    got = recs.evaluate(df).first()
    want = [sum(x) / len(groups) for x in zip(*(brute(*g) for g in groups))]
    assert got["n_impressions"] == 30
    assert [got["auc"], got["mrr"], got["ndcg5"], got["ndcg10"]] == [round(w, 4) for w in want]


def test_share_keeps_rejected_items_in_the_total(spark, rows):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "cluster string, id int")
    shares = report.cluster_share(m, spark.createDataFrame([("c",)], "cluster string"))
    assert rows(shares) == [("a", 2, 50.0), ("b", 1, 25.0)]
    assert rows(report.renormalise_share(shares).select("cluster", F.round("percentage", 3))) == [("a", 66.667), ("b", 33.333)]
    alone = shares.filter("cluster = 'b'")
    assert rows(report.renormalise_share(alone).select("percentage")) == [(25.0,)]


def test_pages_of_a_hot_cluster_are_bounded_and_whole(spark):
    m = spark.createDataFrame([("hot", i) for i in range(2500)] + [("b", 1)], "cluster string, id int")
    pages = report.collect_items(m, "cluster", [F.col("id")], ["id"], page_size=300).collect()
    assert max(len(r["items"]) for r in pages) == 300
    hot = [x["id"] for r in sorted(pages, key=lambda r: r["page"]) if r["cluster"] == "hot" for x in r["items"]]
    assert hot == list(range(2500))


def test_cluster_sample_takes_the_first_that_came(spark):
    m = spark.createDataFrame([("c", i, float(100 - i)) for i in range(30)], "cluster string, id int, d double")
    first = [r["id"] for r in sorted(report.cluster_sample(m, "id", "d", "id", n=10).collect(), key=lambda r: r["place"])]
    assert first == list(range(9, -1, -1))
    near = [r["id"] for r in sorted(report.cluster_sample(m, "id", "d", "id", n=10, nearest=True).collect(), key=lambda r: r["place"])]
    assert near == list(range(29, 19, -1))
