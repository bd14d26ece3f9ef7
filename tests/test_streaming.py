import logging
from datetime import datetime

from pyspark.sql import functions as F

from threadloom.streaming import incremental as inc


def events(spark, data):
    return spark.createDataFrame([(k, datetime(2024, 1, 1, 0, 0, s), v) for k, s, v in data], "id int, ts timestamp, value string")


def test_stream_upsert_equals_batch_and_survives_replay(spark, tmp_path, rows):
    data = [(i % 5, i, f"v{i}") for i in range(20)]
    src = events(spark, data)
    src.repartition(4, "ts").write.parquet(f"{tmp_path}/in")
    stream = inc.read_files(spark, f"{tmp_path}/in", src.schema)
    write = inc.upsert_log(f"{tmp_path}/log")
    inc.run_to_end(stream, write, f"{tmp_path}/cp")
    want = sorted((i, f"v{15 + i}") for i in range(5))
    current = lambda: rows(inc.current_rows(spark, f"{tmp_path}/log", "id", ["ts"]).select("id", "value"))
    assert current() == want
    inc.run_to_end(stream, write, f"{tmp_path}/cp2")  # everything again, from scratch
    assert current() == want
    events(spark, [(2, 59, "new")]).write.mode("append").parquet(f"{tmp_path}/in")
    inc.run_to_end(stream, write, f"{tmp_path}/cp2")
    inc.compact_log(spark, f"{tmp_path}/log", f"{tmp_path}/log2", "id", ["ts"])
    assert rows(inc.current_rows(spark, f"{tmp_path}/log2", "id", ["ts"]).select("id", "value")) == current()
    assert current() == sorted([w for w in want if w[0] != 2] + [(2, "new")])


def test_feed_keeps_the_rows_of_a_failed_batch_and_goes_on(spark, tmp_path, caplog):
    for i in range(3):
        spark.createDataFrame([(str(i),)], "value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    failed = []

    def prepare(batch):
        if batch.first()["value"] == "1":
            raise RuntimeError("cannot")
        return batch

    with caplog.at_level(logging.CRITICAL):
        inc.run_to_end(inc.read_files(spark, f"{tmp_path}/in", "value string"), inc.feed(prepare, f"{tmp_path}/out", failed), f"{tmp_path}/cp")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()) == ["0", "2"]
    assert len(failed) == 1
    assert [r["value"] for r in spark.read.parquet(f"{tmp_path}/out-dead/batch={failed[0]:010d}").collect()] == ["1"]


def test_resume_appends_and_keeps_what_is_there(spark, tmp_path):
    data = [(i, i // 3, f"v{i}") for i in range(12)]
    events(spark, data[:5]).write.parquet(f"{tmp_path}/t")
    inc.resume_append(events(spark, data), f"{tmp_path}/t", "ts", "id")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == list(range(12))
    inc.resume_append(events(spark, data), f"{tmp_path}/t", "ts", "id")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 12


def test_windows_of_a_new_community_cover_the_whole_horizon(spark):
    stored = spark.createDataFrame([("a", datetime(2024, 1, 10)), ("a", datetime(2024, 1, 20))], "c string, ts timestamp")
    both = spark.createDataFrame([("a",), ("b",)], "c string")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    w = {r["c"]: r for r in inc.pull_windows(stored, both, "c", "ts", now, years=1).collect()}
    assert w["a"]["forward_start"] == datetime(2024, 1, 20, 0, 0, 1) and w["a"]["back_end"] == datetime(2024, 1, 9, 23, 59, 59)
    assert w["a"]["back_start"] == w["b"]["forward_start"] == w["b"]["back_start"] == datetime(2023, 2, 1)
    assert w["b"]["forward_end"] == datetime(2024, 2, 1)


def test_bounded_state_drops_repeats(spark, tmp_path):
    src = events(spark, [(1, 1, "a"), (1, 2, "b"), (2, 3, "c")])
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = inc.distinct_within(inc.read_files(spark, f"{tmp_path}/in", src.schema), "id", "ts", "10 minutes")
    inc.run_to_end(out, inc.upsert_log(f"{tmp_path}/log"), f"{tmp_path}/cp")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [1, 2]


def test_checkpoint_folder_comes_from_the_session(spark):
    from threadloom.runtime import durable, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert durable(spark.range(3)).count() == 3
