"""Tables that change by bucket, and answers that survive a restart."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.operators import infer
from threadloom.sources.buckets import BucketTable
from threadloom.streaming import incremental as inc


def files(path):
    return {p.parent.name + "/" + p.name: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(200).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("w"))
    table = BucketTable(spark, path, "id", buckets=16).create(df)
    before = files(path)
    touched = table.upsert(spark.createDataFrame([(3, -1), (500, 7), (4, 8)], "id bigint, v bigint"), ["v"])
    after = files(path)
    assert 1 <= len(touched) <= 2  # 4 has that value already
    assert {k for k in before if after.get(k) == before[k]} == {k for k in before if int(k.split("/")[0].split("=")[1]) not in touched}
    rows = {r["id"]: (r["v"], r["w"]) for r in table.rows().collect()}
    assert rows[3] == (-1, "x") and rows[500] == (7, None) and rows[4] == (8, "x") and len(rows) == 201
    assert table.upsert(spark.createDataFrame([(3, -1), (500, 7)], "id bigint, v bigint"), ["v"]) == [] and files(path) == after


def test_stream_keeps_the_newest_row_over_replays_and_late_files(spark, tmp_path):
    schema = "id bigint, ts int, v string"
    batches = [[(1, 5, "a"), (2, 5, "b"), (1, 6, "c")], [(2, 4, "late"), (3, 1, None)], [(1, 5, "a"), (4, 2, "d")], [(3, 2, "e"), (2, 5, "b")]]
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [1, 1, 3, 0, 2, 0]):
        table = BucketTable(spark, str(tmp_path / f"t{''.join(map(str, order))}"), "id", buckets=4)
        write = inc.upsert_newest(table, ["ts"])
        for n, b in enumerate(order):
            write(spark.createDataFrame(batches[b], schema), n)
        assert sorted(tuple(r) for r in table.rows().select("id", "ts", "v").collect()) == [(1, 6, "c"), (2, 5, "b"), (3, 2, "e"), (4, 2, "d")]
        before = files(table.path)
        write(spark.createDataFrame(batches[order[0]], schema), 0)
        assert files(table.path) == before


def test_a_killed_run_asks_only_for_what_is_missing(spark, tmp_path):
    ledger, log = str(tmp_path / "ledger"), str(tmp_path / "calls")
    spark.range(100).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).repartition(4, "id").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))

    def ask(die_at):
        def fn(texts):
            with open(log, "a") as f:
                f.write(" ".join(texts) + "\n")
            if die_at and sum(1 for _ in open(log)) >= die_at:
                os._exit(1)  # the worker is gone in the middle of a call
            return [x.upper() for x in texts]
        return fn

    with pytest.raises(Exception):
        infer.infer_with_ledger(df, "id", "text", ask(8), ledger, batch_rows=5, concurrency=1).collect()
    asked = [x for line in open(log) for x in line.split()]
    assert 0 < len(asked) < 100
    got = {r["id"]: r["result"] for r in infer.infer_with_ledger(df, "id", "text", ask(0), ledger, batch_rows=5).collect()}
    assert got == {i: f"T{i}" for i in range(100)}
    again = [x for line in open(log) for x in line.split()]
    assert len(set(again)) == 100 and len(again) <= 100 + 5  # only the list that was under way is asked for twice
    infer.infer_with_ledger(df, "id", "text", ask(0), ledger, batch_rows=5)
    assert [x for line in open(log) for x in line.split()] == again
    more = df.unionByName(spark.createDataFrame([(1000, "new")], "id bigint, text string"))
    assert infer.infer_with_ledger(more, "id", "text", ask(0), ledger, batch_rows=5).count() == 101
    assert [x for line in open(log) for x in line.split()] == [*again, "new"]


def test_ledger_keeps_errors_and_neighbours(spark, tmp_path):
    def fn(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id bigint, text string").coalesce(1)
    got = {r["id"]: (r["ok"], r["result"], r["error"]) for r in infer.infer_with_ledger(df, "id", "text", fn, str(tmp_path / "l"), attempts=1).collect()}
    assert got == {1: (True, "A", None), 2: (False, "", "ValueError: no"), 3: (True, "C", None)}


def test_a_report_goes_on_after_its_last_whole_stage(spark, tmp_path):
    from threadloom.operators import flow
    from threadloom.plans.report_queries import overlap_scores, plain_answers

    rows = [(i, f"{i} topic{i % 5} alpha beta", f"{'slow login page crashes ' * 6}word{i % 3}", "c", [float(i % 4), 1.0, float(i % 3)] if i % 2 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "id bigint, title string, body string, community string, v array<double>")
    docs = docs.withColumn("keywords", F.split("title", " ")).withColumn("tv", F.reverse("v")).withColumn("kv", F.when(F.col("v").isNotNull(), F.array("v")))
    queries = spark.createDataFrame([(1, "slow login"), (2, "beta")], "qid bigint, query string")
    vectors = spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, [0.0, 1.0, 2.0])], "qid bigint, v array<double>")
    terms = spark.createDataFrame([(1, "slow"), (1, "login"), (2, "beta")], "qid bigint, term string")
    log = str(tmp_path / "calls")

    def go(extract):
        run = flow.StagedRun(spark, str(tmp_path / "run"))
        lines = flow.report_request(run, docs, queries, vectors, terms, overlap_scores, extract, threshold=0.5, embed={"dims": 32})
        return run.ran, sorted(map(tuple, lines.collect()))

    def counted(fail):
        def extract(texts):
            with open(log, "a") as f:
                f.write("call\n")
            if fail:
                os._exit(1)
            return plain_answers(texts)
        return extract

    with pytest.raises(Exception):
        go(counted(True))
    assert (tmp_path / "run" / "reranked" / "_SUCCESS").exists() and not (tmp_path / "run" / "answers" / "_SUCCESS").exists()
    ran, lines = go(counted(False))
    assert "candidates" not in ran and "reranked" not in ran and ran[0] == "answers" and ran[-1] == "result"
    parts = {p for p, _, _ in lines}
    assert "Pain Points" in parts and "Ids" in parts
    calls = len(open(log).readlines())
    assert go(counted(True)) == ([], lines) and len(open(log).readlines()) == calls  # nothing left to do, nothing asked
    import shutil
    shutil.rmtree(tmp_path / "run" / "result")
    assert go(counted(True)) == (["result"], lines)
