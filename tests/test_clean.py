from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.functions import text as X
from threadloom.operators import clean
from threadloom.operators.extract import pain_point_filter, pain_points_of, parse_judgements
from threadloom.sources import files


def posts(spark, data):
    """(id, title, selftext, archived, num_comments) rows in the raw schema."""
    full = [("a", r[3], r[1], 1, r[2], "/p", "s", 0, 0, r[0], r[4]) for r in data]
    return spark.createDataFrame(full, schemas.POSTS)


def comments(spark, data):
    """(id, body, link_id) rows in the raw schema."""
    return spark.createDataFrame([("a", 1, 0, "/p", r[1], "s", r[0], r[2], r[2]) for r in data], schemas.COMMENTS)


def test_removed_post_gives_blank_parent_and_removed_comment_stays(spark):
    p = posts(spark, [("1", "kept", "text", None, None), ("2", "gone", "[removed]", None, None), ("3", "null", None, None, None)])
    c = comments(spark, [("c1", "x", "t3_1"), ("c2", "[removed]", "t3_2"), ("c3", None, "t3_1"), ("c4", "y", "t3_9")])
    out = {r["id"]: r for r in clean.clean_threads(p, c).collect()}
    assert set(out) == {"1", "c1", "c2", "c4"}
    assert (out["c1"]["title"], out["c1"]["parent_post"]) == ("kept", "text")
    assert out["c2"]["parent_post"] == out["c4"]["parent_post"] == ""
    assert out["c2"]["body"] == "[removed]"
    assert out["1"]["parent_post"] == "" and out["1"]["is_post"] and not out["c1"]["is_post"]
    assert out["c1"]["num_comments"] == -1


def test_duplicate_post_ids_do_not_multiply_comments(spark):
    p = posts(spark, [("1", "b", "x", None, None), ("1", "a", "x", None, None)])
    c = comments(spark, [("c1", "hi", "t3_1")])
    got = clean.join_parent_post(c, clean.tag_posts(p)).collect()
    assert [(r["id"], r["title"]) for r in got] == [("c1", "a")]


def test_repeats_are_strictly_more_than_the_limit_and_all_copies_go(spark):
    df = spark.createDataFrame([("a",)] * 25 + [("b",)] * 26 + [(None,)] * 30, "body string")
    out = {r["body"]: r["count"] for r in clean.drop_repeated_bodies(df).groupBy("body").count().collect()}
    assert out == {"a": 25, None: 30}


def test_missing_archived_is_true_only_in_the_compatible_form(spark):
    df = spark.createDataFrame([(None, None), (False, 3), (True, 0)], "archived boolean, num_comments bigint")
    assert [r["archived"] for r in clean.fill_defaults(df).collect()] == [True, False, True]
    assert [r["archived"] for r in clean.fill_defaults(df, False).collect()] == [False, False, True]


def test_upsert_reduces_equal_keys_and_keeps_other_columns(spark, rows):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, None)], "k int, v string")
    out = rows(clean.upsert_by_key(old, new, "k", ["v"]).fillna("-"))
    assert out == [(1, "a", "x"), (2, "d", "y"), (3, "-", "-")]


def test_file_priority(spark, rows):
    a, b = (spark.createDataFrame(d, "k int, v string") for d in ([(1, "old"), (2, "old")], [(2, "new"), (3, "new")]))
    assert rows(clean.first_by_priority([a, b], "k")) == [(1, "old"), (2, "old"), (3, "new")]
    assert rows(clean.first_by_priority([a, b], "k", last_wins=True)) == [(1, "old"), (2, "new"), (3, "new")]


def test_missing_field_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError, match="link_id"):
        files.project_fields(spark.createDataFrame([("a",)], "author string"), schemas.COMMENTS)


def test_no_input_is_an_error(spark, tmp_path):
    import pytest

    posts(spark, [("1", "t", "x", None, None)]).limit(0).write.parquet(f"{tmp_path}/a-posts.parquet")
    comments(spark, [("1", "t", "t3_1")]).limit(0).write.parquet(f"{tmp_path}/a-comments.parquet")
    with pytest.raises(ValueError):
        files.scan_threads(spark, str(tmp_path))


def test_a_missing_kind_is_empty(spark, tmp_path):
    comments(spark, [("1", "t", "t3_1")]).write.parquet(f"{tmp_path}/a-comments.parquet")
    p, c = files.scan_threads(spark, str(tmp_path))
    assert (p.count(), c.count()) == (0, 1)


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()["x"]


def test_titles(spark):
    url = "https://h/r/s/comments/id/it's_a-2nd_don't.html/"
    assert one(spark, X.post_slug_title(F.col("u")), u=url) == "It'S A 2Nd Don'T"
    assert one(spark, X.post_slug_title(F.col("u")), u="/r/s/other/") is None
    assert one(spark, X.permalink_title(F.col("u")), u="/comments/1/lack_of-x/") == "lack of-x"


def test_bracket_lists(spark):
    get = lambda s: one(spark, X.parse_bracket_list(F.col("s")), s=s)
    assert get("[a, b ,]<Finish>") == ["a", "b", "None"]
    assert get(" plain <Finish>") == ["plain"]
    assert get("<Finish>") == ["None"]


def test_json_helpers(spark):
    from pyspark.sql import types as T

    el = T.StructType([T.StructField("a", T.LongType())])
    get = lambda s: one(spark, X.tagged_json_list(F.col("s"), "PainPoints", el), s=s)
    assert [r["a"] for r in get('x <json>{"PainPoints":\n[{"a": 1}]}</json> <json>{}</json>')] == [1]
    assert get("no tags") == [] and get("<json>{broken</json>") == [] and get('<json>{"Other": []}</json>') == []
    assert one(spark, X.escape_quotes(F.col("s")), s='a "b" \\"c\\"') == 'a \\"b\\" \\"c\\"'
    verdict = spark.createDataFrame([('{"space_match": true, "perspective_match": true}',), ("sorry",)], "j string")
    got = parse_judgements(verdict, "j", []).collect()
    assert [r["space_match"] for r in got] == [True, None]


def test_emotions(spark):
    get = lambda e: one(spark, X.emotion_polarity(F.col("e")), e=e)
    assert get("Fear") == -0.8 and get('{"enum": ["Joy", "Fear"]}') == 1.0 and get("0.3") == 0.3 and get("Nope") == 0.0


def test_pain_point_defaults(spark):
    import json

    def answer(i, topic, **kw):
        return json.dumps({"pain_points": [{"post_id": str(i), "issue_emotion": "Fear", "is_quote_relevant": True, "issue_topic": topic, **kw}]})

    ok = {"match_space_topic": True}
    cases = [answer(0, ok), answer(1, {}), answer(2, {**ok, "match_quote_pain": False}), answer(3, "text"),
             answer(4, ok, issue_emotion="Confusion"), answer(5, ok, is_quote_relevant=None), answer(9, ok), "broken"]
    df = spark.createDataFrame([(c,) for c in cases], "a string")
    known = spark.createDataFrame([(str(i),) for i in range(8)], "post_id string")
    assert [r["post_id"] for r in pain_point_filter(pain_points_of(df, "a", []), known).collect()] == ["0"]


def test_text_stats_and_uuid(spark):
    import uuid

    r = one(spark, X.text_stats(F.col("t")), t="One. Two it's!\n\n123 ?\n \nlast")
    assert (r["word_count"], r["sentence_count"], r["paragraph_count"]) == (4, 2, 2)
    assert one(spark, X.text_stats(F.col("t")), t=" \n ") is None
    for name in ("a", "t3_é", ""):
        assert one(spark, X.uuid5(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_audit_finds_broken_files(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/good")
    spark.range(0).write.parquet(f"{tmp_path}/empty")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"PAR1 not really")
    got = files.audit_files(spark, [f"{tmp_path}/*/part-*"]).collect()
    state = {("bad" in r["path"].rsplit("/", 2)[1]): r["readable"] for r in got}
    assert state == {True: False, False: True}
    assert all(r["readable"] for r in got if "/empty/" in r["path"])


def test_failed_row_is_reported_and_the_rest_goes_on(spark):
    def fn(pdf):
        if (pdf["id"] == 3).any():
            raise RuntimeError("no")
        return pdf

    out = files.map_batches(spark.range(0, 10, 1, 1), fn, "id bigint", batch_rows=5).collect()
    assert sorted(r["id"] for r in out if r["error"] is None) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    assert [(r["id"], r["error"]) for r in out if r["error"]] == [(3, "RuntimeError: no")]
