"""Tags, captions and prompts on cases worked out by hand, and against a string-walking model."""

import random
import re

import pytest
from pixelloom.functions import text
from pyspark.sql import functions as F

TAGS = {
    "long_hair, hair": "long hair",
    "2girls, long_hair, short_hair, red_eyes, blue_eyes, smile": "2girls, smile",
    "1girl, long_hair, short_hair": "1girl, long hair, short hair",
    "multiple_boys, long_hair, pink_hair, blue_hair": "multiple boys, long hair",
    "^_^, white_shirt, shirt": "^_^, white shirt",
    "flower_hair_ornament, hair_ornament, ornament": "flower hair ornament",
    "t-shirt, shirt": "t-shirt, shirt",
    "blue-green_eyes, eyes": "blue-green eyes, eyes",
    "a, , b": "a, , b",
    "2girls, ponytail, side_braid": "2girls",
    "grand_été, été": "grand été",
}


def test_tags(spark):
    df = spark.createDataFrame([(k,) for k in TAGS], "t string")
    assert {r.t: r.c for r in df.select("t", text.clean_tags(F.col("t")).alias("c")).collect()} == TAGS


def _fixpoint(s: str) -> str:
    for what, by in text.CAPTION_RULES:
        while what in s:
            s = s.replace(what, by)
    return s


def test_captions(spark):
    rng = random.Random(4)
    words = ["anime", "cartoon", "girl", "young", "woman", "female", "a", "figure", "person", "xgirl", "lady", "image", "an", "drawing", ","]
    said = ["", "anime anime anime girl", "cartoon cartoon girl", "girl girl girl", "young woman", "a cartoon figure"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in said], "t string")
    for r in df.select("t", text.clean_caption(F.col("t")).alias("c")).collect():
        assert r.c == _fixpoint(r.t), r.t


@pytest.mark.parametrize(("given", "parsed", "raw", "listed"), [(None, [], [], []), ("", [], [""], [""]), ("a, b", ["a", "b"], ["a", " b"], ["a", "b"]), ("a,b", ["a", "b"], ["a", "b"], ["a,b"]), (" a , ,b \n", ["a", "b"], [" a ", " ", "b \n"], [" a ", ",b \n"])])
def test_tag_lists(spark, given, parsed, raw, listed):
    r = spark.createDataFrame([(given,)], "t string").select(text.parse_tags(F.col("t")).alias("p"), text.raw_tags(F.col("t")).alias("r"), text.listed_tags(F.col("t")).alias("l")).first()
    assert (r.p, r.r, r.l) == (parsed, raw, listed)


def test_prompt(spark):
    df = spark.createDataFrame([("cap", ["a", "b"], "cap, a, b"), ("", ["a"], "a"), (None, ["a"], "a"), ("cap", [], "cap"), ("", [], "")], "c string, t array<string>, x string")
    assert all(r.p == r.x for r in df.select("x", text.prompt(F.col("c"), F.col("t")).alias("p")).collect())


def test_run_patterns_are_those_of_words():
    assert re.fullmatch(r"[\w\-]+", "é-1_")
    assert "\\p{L}" in text.RUN
