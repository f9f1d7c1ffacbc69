"""Trees of files: what is found, what is written, what a failed task leaves; latent files and one-object JSON."""

import json
import os
import random

import numpy as np
import pytest
from pixelloom.sources import json_object, npz
from pixelloom.sources.files import npz_bytes
from pixelloom.sources.tree import Tree, register
from pyspark.sql import functions as F


def touch(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())


NAMES = ["a.JPG", "_b.png", "ab/cd/e.jpeg", "ab/cd/_f.PNG", "ab/_cd/g.png", ".h.png", ".hid/i.png", "ab/.hid/j.png", "ab/cd/ef/gh/ij/k.png", "ab/cd/.l.png", "t.txt", "png", ".png", "m.png.txt", "ünï/n.png", "o p.png"]


def walked(root, suffixes, hidden=False, recursive=True):
    found = []
    for folder, _, files in os.walk(root):
        rel = os.path.relpath(folder, root)
        for f in files:
            name = f if rel == "." else f"{rel}/{f}"
            if (recursive or rel == ".") and os.path.splitext(f)[1][1:].lower() in suffixes and (hidden or not any(p.startswith(".") for p in name.split("/"))):
                found.append(name)
    return sorted(found)


@pytest.mark.parametrize("options", [{}, {"hidden": "true"}, {"recursive": "false"}, {"depth": "0"}, {"depth": "5", "tasks": "3"}])
def test_scan_equals_a_walk(spark, tmp_path, options):
    touch(tmp_path, NAMES)
    register(spark)
    for address in (str(tmp_path), f"file://{tmp_path}"):
        df = spark.read.format("tree").options(path=address, suffixes="png,jpg,jpeg", **options).load()
        rows = df.collect()
        assert sorted(r.rel for r in rows) == walked(tmp_path, {"png", "jpg", "jpeg"}, options.get("hidden") == "true", options.get("recursive") != "false")
        assert all(bytes(r.content) == r.rel.encode() and r.length == len(r.content) and r.path == f"{address}/{r.rel}" for r in rows)
    assert df.rdd.getNumPartitions() <= 16


def test_scan_without_contents_and_without_root(spark, tmp_path):
    touch(tmp_path, NAMES)
    register(spark)
    rows = spark.read.format("tree").options(path=str(tmp_path), suffixes="png", content="false").load().collect()
    assert rows and all(r.content is None and r.length for r in rows)
    assert spark.read.format("tree").options(path=str(tmp_path), suffixes=".PNG", exact="true").load().count() == 1
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("tree").options(path=f"{tmp_path}/nowhere").load().collect()


def left(root):
    return sorted(os.path.relpath(f"{d}/{f}", root) for d, _, files in os.walk(root) for f in files)


def test_rows_become_files(spark, tmp_path):
    register(spark)
    rows = [(f"{k:04x}{'0' * 60}", bytes([k % 256]) * k) for k in range(300)]
    spark.createDataFrame(rows, "key string, content binary").repartition(5).write.format("tree").mode("append").options(path=str(tmp_path), suffix="bin").save()
    assert left(tmp_path) == sorted(f"{k[:2]}/{k[2:4]}/{k}.bin" for k, _ in rows)
    back = spark.read.format("tree").options(path=str(tmp_path), suffixes="bin").load()
    assert sorted((r.rel[6:-4], bytes(r.content)) for r in back.collect()) == rows
    # Again, with other contents: files are replaced.
    spark.createDataFrame([(rows[7][0], b"new")], "key string, content binary").write.format("tree").mode("append").options(path=str(tmp_path), suffix="bin").save()
    assert back.count() == 300 and back.where(F.col("content") == b"new").count() == 1


def test_failed_tasks_leave_no_file(spark, tmp_path):
    register(spark)
    kept = spark.createDataFrame([("abcd" + "0" * 60, b"old")], "key string, content binary")
    kept.write.format("tree").mode("append").options(path=str(tmp_path)).save()
    before = left(tmp_path)
    many = spark.range(40, numPartitions=4).select(F.concat(F.lpad(F.col("id").cast("string"), 4, "x"), F.lit("_key")).alias("key"), F.when(F.col("id") == 35, F.raise_error(F.lit("broken row"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken row"):
        many.unionByName(kept).write.format("tree").mode("append").options(path=str(tmp_path)).save()
    assert left(tmp_path) == before
    for key in (None, "", "a/b", ".hidden"):
        with pytest.raises(Exception, match="can't be a file's name"):
            spark.createDataFrame([("good" * 16, b"x"), (key, b"x")], "key string, content binary").coalesce(1).write.format("tree").mode("append").options(path=str(tmp_path)).save()
        assert left(tmp_path) == before
    with pytest.raises(Exception, match="only appended"):
        kept.write.format("tree").mode("overwrite").options(path=str(tmp_path)).save()


def test_a_job_that_breaks_off_takes_back_what_finished_tasks_wrote(tmp_path):
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StringType, StructType

    schema = StructType().add("key", StringType()).add("content", BinaryType())
    batch = pa.RecordBatch.from_arrays([pa.array(["abcd1", "abcd2"]), pa.array([b"1", b"2"])], ["key", "content"])
    first = Tree({"path": str(tmp_path)}).writer(schema, False)
    first.commit([first.write(iter([batch.slice(0, 1)]))])
    second = Tree({"path": str(tmp_path)}).writer(schema, False)
    done = second.write(iter([batch]))
    assert left(tmp_path)[-2:] == ["ab/cd/abcd1.npz", "ab/cd/abcd2.npz"] and done.files == 2 and done.bytes == 2
    second.abort([done, None])
    assert left(tmp_path) == ["ab/cd/abcd1.npz"]
    # A task whose job ends while it writes, and one that begins later.
    third = Tree({"path": str(tmp_path)}).writer(schema, False)

    def slow():
        yield batch
        third.abort([None])

    with pytest.raises(RuntimeError, match="over"):
        third.write(slow())
    with pytest.raises(RuntimeError, match="over"):
        third.write(iter([batch]))
    assert left(tmp_path) == ["ab/cd/abcd1.npz"] and not list(tmp_path.glob(".tree*"))


def key(k):
    return f"{k:064x}"


def test_latents_and_texts_come_back(spark, tmp_path):
    root = str(tmp_path)
    rows = [(key(k << 240), [float(x) for x in range(8)], [2, 2, 2], [0, k, 2, 3], [640, 480], [1152, 896]) for k in range(6)]
    df = spark.createDataFrame(rows, "key string, latents array<float>, shape array<int>, crop_ltrb array<long>, original_size array<long>, train_resolution array<long>")
    npz.write_latents(df, f"{root}/latents")
    npz.write_tags(df.where("crop_ltrb[1] < 3").select("key", F.array(F.lit("a b"), F.lit(" c")).alias("tags")), f"{root}/tags")
    npz.write_texts(df.where("crop_ltrb[1] = 1").select("key", F.lit("été\n").alias("text")), f"{root}/caption")
    touch(tmp_path, [f"tags/{rows[4][0]}.txt", f"tags/00/00/{rows[5][0]}.TXT"])
    found = {r.key: r for r in npz.training_items(spark, root).collect()}
    assert len(found) == 6 and all(r.error is None and r.shape == [2, 2, 2] and r.original_size == [640, 480] for r in found.values())
    assert [found[r[0]].crop_ltrb for r in rows] == [r[3] for r in rows]
    assert [found[r[0]].tags for r in rows] == [["a b", "  c"]] * 3 + [[]] * 3
    assert [found[r[0]].caption for r in rows] == ["", "été\n", "", "", "", ""]
    from pixelloom.sources.files import read_npz

    whole = read_npz(npz.latents(spark, root, content=True)).collect()
    assert len(whole) == 6 and all(r.error is None and r.latents == rows[0][1] for r in whole)


def test_headers_read_little_and_find_damage(spark, tmp_path):
    rng = np.random.default_rng(1)
    good = npz_bytes(rng.standard_normal((4, 300, 300)).astype(np.float32), [0, 1, 2, 3], [640, 480], [1152, 896])
    without = __import__("io").BytesIO()
    np.savez_compressed(without, latents=np.zeros((1, 2)), crop_ltrb=np.zeros(4))
    cases = {"good": good, "cut": good[: len(good) // 2], "short": good[:-5], "empty": b"", "text": b"no archive", "keyless": without.getvalue()}
    for k, data in enumerate(cases.values()):
        place = tmp_path / key(k)[:2] / key(k)[2:4] / f"{key(k)}.npz"
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(data)
    rows = {list(cases)[int(r.path[-6:-4], 16)]: r for r in npz.headers(npz.latents(spark, str(tmp_path))).collect()}
    assert rows["good"].shape == [4, 300, 300] and rows["good"].dtype == "float32" and rows["good"].train_resolution == [1152, 896]
    assert all((rows[c].error is None) == (c == "good") for c in cases)
    assert len(good) > 1_000_000 and all(r.bytes_read < 80_000 for r in rows.values()) and rows["good"].bytes_read < 6_000
    items = spark.createDataFrame([(key(k), k) for k in range(8)], "key string, k int")
    assert sorted(r.k for r in npz.to_process(items, str(tmp_path)).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_legacy_latents_are_copied(spark, tmp_path):
    touch(tmp_path, ["old/broken.npz"])
    good = npz_bytes(np.ones((4, 2, 2), np.float16), [0, 1, 2, 3], [640, 480], [1152, 896])
    for name in ("one", "two", "sub/three", "_four"):
        (tmp_path / "old" / f"{name}.npz").parent.mkdir(exist_ok=True)
        (tmp_path / "old" / f"{name}.npz").write_bytes(good)
    metadata = spark.createDataFrame([("one", "a, b", "c"), ("sub/three", None, None), ("_four", "x", ""), ("gone", "y", "z")], "key string, tags string, caption string")
    rows = {r.key: r for r in npz.convert_legacy(spark, metadata, f"{tmp_path}/old", f"{tmp_path}/new").collect()}
    assert set(rows) == {"one", "sub/three", "_four"}
    assert rows["one"].tags == ["a", "b"] and rows["one"].train_resolution == [1152, 896] and rows["sub/three"].tags == [] and rows["sub/three"].caption == ""
    assert all((tmp_path / "new" / "latents" / f"{k}.npz").read_bytes() == good for k in rows)


def test_a_folder_is_written_by_one_task(spark, tmp_path, monkeypatch):
    """However rows come, each folder is made by a single task, and there are several tasks."""
    import hashlib

    keys = [hashlib.sha256(str(k % 20).encode()).hexdigest()[:4] + f"{k:060d}" for k in range(200)]
    items = spark.createDataFrame([(k, f"text {k}") for k in keys], "key string, text string").repartition(16)
    dealt = npz._by_folder(items).select(F.substring("key", 1, 4).alias("f"), F.spark_partition_id().alias("p")).distinct().collect()
    assert len(dealt) == len({r.f for r in dealt}) == 20 and len({r.p for r in dealt}) > 4
    npz.write_texts(items, str(tmp_path / "t"))
    for k in range(3000):
        (tmp_path / "t" / f"{k % 60:02d}" / f"{k // 60:02d}").mkdir(parents=True, exist_ok=True)
    found = npz.texts(spark, str(tmp_path / "t"))
    assert found.rdd.getNumPartitions() <= 16 * spark.sparkContext.defaultParallelism < 3000 // 32
    assert {r.key: r.text for r in found.collect()} == {k: f"text {k}" for k in keys}


def test_flat_folder_is_dealt_out_by_keys(spark, tmp_path, monkeypatch):
    """Files of one folder are read by several tasks; keys that no listing would give find nothing."""
    good = npz_bytes(np.ones((4, 2, 2), np.float16), [0, 1, 2, 3], [640, 480], [1152, 896])
    (tmp_path / "old" / "sub").mkdir(parents=True)
    (tmp_path / "old" / "folder.npz").mkdir()
    (tmp_path / "out.npz").write_bytes(good)
    for name in (*range(60), "sub/a", "UP", "x.npz"):
        (tmp_path / "old" / f"{name}.npz").write_bytes(good)
    (tmp_path / "old" / "5.npz").write_bytes(good[:40])
    kept = {*map(str, range(60)), "sub/a", "UP", "x.npz"} - {"5"}
    odd = ["../out", "./1", "sub/../1", "sub//a", "folder", "up", "", None, "/1", "a\0b", "n" * 300, "5"]
    metadata = spark.createDataFrame([(k, "a, b", None) for k in [*sorted(kept), *odd, "1"]], "key string, tags string, caption string")
    found = npz.by_key(metadata.select("key").repartition(8), f"{tmp_path}/old", True)
    assert {r.key for r in found.select("key").collect()} == kept | {"5"}
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    # No listing: the reader of trees isn't asked.
    monkeypatch.setattr(npz, "_tree", None)
    rows = npz.convert_legacy(spark, metadata, f"{tmp_path}/old/", f"{tmp_path}/new/").collect()
    assert sorted(r.key for r in rows) == sorted([*kept, "1"])
    assert (tmp_path / "new" / "latents" / "5.npz").read_bytes() == good[:40]


WORDS = ['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", '\\"', "\\\\", "😀", "key", " "]


def random_object(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices(WORDS, k=rng.randrange(12)))
    value = lambda d: rng.choice([text(), 1.5, None, True, {text(): text(), "tags": [text()]} if d else 1, [value(d - 1) for _ in range(3)] if d else [], {}])
    return {f"{text()}{k}": value(2) for k in range(n)}


@pytest.mark.parametrize("seed", range(4))
def test_any_split_reads_the_same(spark, tmp_path, monkeypatch, seed):
    given = random_object(seed, 40)
    path = tmp_path / "m.json"
    path.write_text(json.dumps(given, indent=[None, 2][seed % 2], ensure_ascii=seed < 2))
    data = path.read_bytes()
    monkeypatch.setattr(json_object, "PIECE", 13)
    for split in (1, 2, 3, 7, 64, 10**6):
        n = -(-len(data) // split)
        with path.open("rb") as f:
            cuts = [json_object.begin_of(f, min(len(data), k * split), len(data)) for k in range(n + 1)]
            inside, depth, found = False, 0, []
            for at, end in zip(cuts, cuts[1:], strict=False):
                found += [x for x in map(json_object._parted, (e for _, e in json_object.entries_of(f, at, end, len(data), inside, depth))) if x]
                toggles, out, within = json_object.summary(f, at, end)
                inside, depth = inside ^ toggles, depth + (within if inside else out)
        assert not inside and depth == 0
        assert [(k, json.loads(v)) for k, v in found] == list(given.items())
    rows = json_object.read_object(spark, str(path), 100).orderBy("place").collect()
    assert [(r.key, json.loads(r.value)) for r in rows] == list(given.items())


def test_objects_are_written_in_order(spark, tmp_path):
    given = random_object(9, 60) | {"z": {"tags": "long_hair, hair", "caption": "young woman", "train_resolution": [8, 9], "x": {"y": [1, 2.5, None]}}, "a": {"tags": "", "caption": None, "n": 5}}
    (tmp_path / "m.json").write_text(json.dumps(given))
    entries = json_object.read_object(spark, str(tmp_path / "m.json"), 200)
    json_object.write_object(entries, f"{tmp_path}/copy.json")
    assert list(json.loads((tmp_path / "copy.json").read_text()).items()) == list(given.items())
    assert sorted(p.name for p in tmp_path.iterdir()) == ["copy.json", "m.json"]
    json_object.write_object(json_object.cleaned(entries.where("key IN ('z', 'a')")), f"file://{tmp_path}/clean.json")
    assert list(json.loads((tmp_path / "clean.json").read_text()).items()) == [("z", {"tags": "long hair", "caption": "girl", "train_resolution": [8, 9], "x": {"y": [1, 2.5, None]}}), ("a", {"tags": "", "caption": None, "n": 5})]
    for text, n in (("{}", 0), (" { } ", 0), ('{"a": 1}', 1)):
        (tmp_path / "e.json").write_text(text)
        back = json_object.read_object(spark, str(tmp_path / "e.json"), 2)
        assert back.count() == n
        json_object.write_object(back, str(tmp_path / "f.json"))
        assert json.loads((tmp_path / "f.json").read_text()) == json.loads(text)
    (tmp_path / "e.json").write_text('{"a": "b')
    with pytest.raises(ValueError, match="one whole"):
        json_object.read_object(spark, str(tmp_path / "e.json"))


def test_small_ranges_read_little_and_share_tasks(spark, tmp_path):
    """A range of 4 KB doesn't look at a piece of a megabyte, and ranges beside each other are one task's."""
    from pixelloom.sources.storage import Counted

    given = {f"k{k}": {"text": "x" * 50, "n": [k]} for k in range(20_000)}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(given))
    size = path.stat().st_size
    with path.open("rb") as f:
        counted = Counted(f)
        assert len(list(json_object.entries_of(counted, 0, 4096, size, False, 0))) > 10
        assert counted.bytes <= 3 * 4096
    back = json_object.read_object(spark, str(path), 4096)
    assert back.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < size // 4096
    assert {r.key: json.loads(r.value) for r in back.collect()} == given
