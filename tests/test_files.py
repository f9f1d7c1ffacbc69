"""Files: what is found, what is hidden, what comes back."""

import json

import numpy as np
import pytest
from pixelloom.functions import naming
from pixelloom.operators import manifest
from pixelloom.sources import files, posts
from pixelloom.streaming.prep import Progress, prepare, set_broken_state_aside
from pyspark.sql import functions as F


def test_images(spark, tmp_path):
    for name in ("a.JPG", "ab/b.png", ".c.png", ".hid/d.png", "t.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = files.images(spark, str(tmp_path)).collect()
    assert sorted(r.rel for r in found) == ["a.JPG", "ab/b.png"]
    import hashlib

    assert {r.rel: r.key for r in found}["a.JPG"] == hashlib.sha256(b"a.JPG").hexdigest()


def test_latents(spark, tmp_path):
    good = files.npz_bytes(np.ones((4, 2, 2), np.float16), [0, 1, 2, 3], [640, 480], [1152, 896])
    for stem, data in (("a" * 64, good), ("b" * 63, good), ("c" * 64, b"broken")):
        folder = tmp_path / stem[:2] / stem[2:4]
        folder.mkdir(parents=True)
        (folder / f"{stem}.npz").write_bytes(data)
    (tmp_path / "flat.npz").write_bytes(good)
    found = files.sharded_latents(spark, str(tmp_path))
    assert sorted(r.key[0] for r in found.collect()) == ["a", "c"]
    rows = {r.path[-5]: r for r in files.read_npz(found).collect()}
    assert rows["a"].shape == [4, 2, 2] and rows["a"].train_resolution == [1152, 896] and rows["a"].error is None
    assert rows["c"].latents is None and rows["c"].error


def test_metadata(spark, tmp_path):
    given = {"k1": {"tags": "long_hair, hair", "caption": "young woman", "train_resolution": [8, 9]}, "k2": {"caption": ""}}
    (tmp_path / "m.json").write_text(json.dumps(given))
    rows = {r.key: r for r in files.clean_metadata(files.metadata_json(spark, str(tmp_path / "m.json"))).collect()}
    assert rows["k1"].tags == "long hair" and rows["k1"].caption == "girl" and rows["k1"].train_resolution == [8, 9]
    assert rows["k2"].tags is None and rows["k2"].caption == ""
    back = [json.loads(r.value) for r in files.to_metadata_json(files.metadata_json(spark, str(tmp_path / "m.json"))).collect()]
    assert {k for b in back for k in b} == {"k1", "k2"}


def test_tags_are_written_and_read(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / "k.txt").write_text("a, b")
    assert [(r.key, r.text) for r in files.tag_files(spark, str(tmp_path)).collect()] == [("k", "a, b")]
    files.write_tags(spark.createDataFrame([("abc", ["x", "y"])], "key string, tags array<string>"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").first().text == "x, y"


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('save_dir = "out"\nmodel_name = "m"\nlora_rank = 8\n')
    assert files.run_config(tmp_path / "c.toml") == {"save_dir": "out", "model_name": "m", "lora_rank": 8, "lora_dim": 8, "save_path": "out/m"}


def test_previews_and_arguments(tmp_path):
    (tmp_path / "c.toml").write_text('[[preview_sample_options]]\nprompt = "p"\nnegative_prompt = ""\nsteps = 20\nseed = 1\nwidth = 512\n')
    assert files.run_config(tmp_path / "c.toml")["preview_sample_options"] == [{"prompt": "p", "negative_prompt": "", "steps": 20, "seed": 1, "width": 512, "height": None, "clip_skip": 2}]
    for given in ({"prompt": "p"}, {"prompt": "", "negative_prompt": "", "steps": 1, "seed": 1, "other": 2}):
        with pytest.raises(ValueError, match="preview options"):
            files.sample_options(given)
    assert files.checked(f"file://{tmp_path}", thresholds={"general": 0.35}) and files.checked(str(tmp_path / "c.toml"), folder=False)
    with pytest.raises(FileNotFoundError):
        files.checked(f"{tmp_path}/none")
    with pytest.raises(NotADirectoryError):
        files.checked(f"{tmp_path}/c.toml")
    with pytest.raises(IsADirectoryError):
        files.checked(str(tmp_path), folder=False)
    with pytest.raises(ValueError, match="between 0 and 1"):
        files.checked(str(tmp_path), thresholds={"general": 1.5})


def test_manifest_edges(spark):
    latents = spark.createDataFrame([("a", [1, 2]), ("b", [3, 4])], "key string, train_resolution array<long>").withColumn("original_size", F.col("train_resolution")).withColumn("crop_ltrb", F.col("train_resolution"))
    tags = spark.createDataFrame([("a", " x , ,y\n"), ("z", "q")], "key string, text string")
    rows = {r.key: r for r in manifest.build(latents, tags).collect()}
    assert rows["a"].tags == ["x", "y"] and rows["b"].tags == [] and rows["b"].caption is None and len(rows) == 2
    places = spark.createDataFrame([("a", 2, "p2"), ("a", 0, None), ("a", 1, "p1")], "key string, prio int, text string").where("text IS NOT NULL")
    assert manifest.first_existing(places).first().text == "p1"
    assert [r.key for r in manifest.missing(latents, tags).collect()] == ["b"]
    assert manifest.valid_tags(spark.createDataFrame([(" \t\n",), ("x",)], "text string")).count() == 1


def test_posts(spark):
    answers = spark.createDataFrame([(1, 200, json.dumps({"id": 1, "filePath": "p", "caption": None, "tags": [{"tagInfo": {"name": "t"}}]})), (2, 404, "")], "id long, status int, body string")
    rows = posts.posts(answers).collect()
    assert len(rows) == 1 and rows[0].caption == "" and rows[0].tags == ["t"]


def test_pages_follow_cursors(monkeypatch):
    pages = {"u": {"items": [{"id": 1}, {"id": 2}], "nextCursor": 7}, "u?cursor=7": {"items": [{"id": 3}], "nextCursor": None}}
    monkeypatch.setattr(posts, "get", lambda url: (200, json.dumps(pages[url])))
    assert list(posts._Pages("u").read(None)) == [(1,), (2,), (3,)]


def test_preparation_restarts(spark, tmp_path):
    def run():
        schema = spark.read.parquet(f"{tmp_path}/in").schema
        prepare(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", lambda b: b.select(F.sha2("text", 256).alias("key")), max_files=1).awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").count()

    spark.createDataFrame([("a",), ("b",), ("a",)], "text string").write.parquet(f"{tmp_path}/in")
    assert run() == 2 == run()
    spark.createDataFrame([("b",), ("c",)], "text string").write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 3
    # A state that can't be read is kept under another name, and nothing is prepared twice.
    (tmp_path / "state" / "offsets" / "0").write_text("broken")
    spark.createDataFrame([("d",), ("a",)], "text string").write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 4 and len(list(tmp_path.glob("state_corrupted_*"))) == 1
    assert set_broken_state_aside(spark, f"{tmp_path}/state") is None and set_broken_state_aside(spark, f"{tmp_path}/none") is None


def test_progress_counts_rows_and_tells_stalls(spark, tmp_path):
    import time

    spark.createDataFrame([("a",), ("b",), ("c",)], "text string").write.parquet(f"{tmp_path}/in")
    progress = Progress(stall=0.05)
    spark.streams.addListener(progress)
    try:
        schema = spark.read.parquet(f"{tmp_path}/in").schema
        prepare(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", lambda b: b.withColumnRenamed("text", "key")).awaitTermination()
        until = time.monotonic() + 10
        while (progress.running or not progress.batches) and time.monotonic() < until:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(progress)
    assert progress.rows == 3 and not progress.stalled()
    progress.running, progress.last = 1, progress.last - 1
    assert progress.stalled()


@pytest.mark.parametrize(("name", "renamed"), [("lycoris_a_b_c_d_e_f_g_h", "a.b.c.d.e.f.g_h"), ("lycoris_a_b_c_d_e_f_g", "a.b.c.d.e.f.g"), ("lycoris_a_b", "a.b"), ("a_b", "a_b")])
def test_adapter_keys(spark, name, renamed):
    assert spark.range(1).select(naming.adapter_key(F.lit(name)).alias("k")).first().k == renamed


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(naming.is_sharded_output(F.lit("/r/ab/cd/" + "e" * 64 + ".npz"))) and not one(naming.is_sharded_output(F.lit("/r/abc/cd/" + "e" * 64 + ".npz")))
    assert one(naming.relative_key(F.lit("/r/a/b.c.png"), F.lit("/r"))) == "a/b.c"
    assert one(naming.human_size(F.lit(999))) == "999" and one(naming.human_size(F.lit(1_250_000_000))) == "1.3B"
    with pytest.raises(Exception, match="unknown dtype"):
        spark.createDataFrame([("int9",)], "n string").select(naming.dtype_name(F.col("n")).alias("d")).collect()
    # What a rule has put in is not rewritten by a later one.
    assert one(naming.text_encoder_key(F.lit("text_model.encoder.layers.0.self_attn.x"))) == "transformer.resblocks.0.attn.x"


def test_sizes_of_numbers_beyond_64_bits(spark, tmp_path):
    """The query's numbers grow with the cube of a key; the SQL has no result for these keys."""
    from pixelloom import catalogue

    keys = [0, 19_999, 1_096_000, 1_200_000, 5_000_000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = {r.p_partkey: (int(r.n), r.size) for r in catalogue.QUERIES["human_size"](spark, str(tmp_path)).collect()}
    large = {k: 7 * k**3 + k for k in keys[1:]}
    tenths = {k: (n + 50_000_000) // 100_000_000 for k, n in large.items()}
    assert found == {0: (0, "0")} | {k: (n, f"{tenths[k] // 10}.{tenths[k] % 10}B") for k, n in large.items()}


def test_sizes_round_whole_numbers(spark):
    """Numbers at which a quotient of doubles, or adding half a digit, would be off."""
    numbers = [9_000_000_049_999_999, 9_000_000_050_000_000, 9_223_372_000_049_999_999, (1 << 63) - 1, 999_950, 1_049, 1_050]
    found = spark.createDataFrame([(n,) for n in numbers], "n long").select(naming.human_size(F.col("n")).alias("s")).collect()
    assert [r.s for r in found] == ["9000000.0B", "9000000.1B", "9223372000.0B", "9223372036.9B", "1000.0K", "1.0K", "1.1K"]
