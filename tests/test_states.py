import pytest
from pixelloom.functions import noise, schedule, text
from pixelloom.operators import numbering, states
from pyspark.sql import functions as F


def test_a_missing_part_is_an_error(spark):
    rows = [("a", "q", [1, 2]), ("a", "v", [5]), ("a", "k", [3])]
    made = states.fuse_attention(spark.createDataFrame(rows, "layer string, part string, values array<long>")).collect()
    assert [(r.layer, r["values"]) for r in made] == [("a", [1, 2, 3, 5])]
    with pytest.raises(Exception, match="missing"):
        states.fuse_attention(spark.createDataFrame(rows[:2], "layer string, part string, values array<long>")).collect()


def test_merge(spark):
    one, two = (spark.createDataFrame(rows, "name string, shape array<long>") for rows in ([("a", [1, 2])], [("p.weight", [3, 4]), ("a", [5])]))
    got = {r.name: r["shape"] for r in states.merge_components({"u.": one, "t.": two}, {"t.p.weight": "t.p"}).collect()}
    assert got == {"u.a": [1, 2], "t.a": [5], "t.p": [4, 3]}


def test_caption_rewrites_reach_their_end(spark):
    said = ["yoyoyoyoung ung ung ung girl", "yoyoyoyoyoyoung ung ung ung ung ung lady x", "young young  y", "no change"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in said], "t string").select(text.clean_caption(F.col("t")).alias("c")).collect()]
    assert got == ["girl", "girl x", " y", "no change"]


def test_rows_without_a_group_are_numbered(spark):
    df = spark.createDataFrame([("a", 1, "00f"), (None, 2, "1ff"), (None, 3, "0ff")], "g string, k long, d string")
    got = {r.k: r.n for r in numbering.numbered(df, ["g"], "d", "k", "n").collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    got = {r.k: r.n for r in numbering.numbered_in_order(df, ["g"], ["k"], "n").collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError, match="unknown strategy"):
        schedule.sample_timesteps(spark.range(1), "other", "s", "id")
    r = spark.range(1).select(noise.prediction("sample", F.array(F.lit(3.0)), F.array(F.lit(1.0))).alias("x"), noise.prediction("epsilon", F.array(F.lit(3.0)), F.array(F.lit(1.0))).alias("y")).first()
    assert r.x == [2.0] and r.y == [3.0]
