"""The post service as a stream against a local server, retries by key, counters, chunks and pixels."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pixelloom.operators import chunks, counters
from pixelloom.sources import pixels, posts
from pixelloom.streaming import retries
from pyspark.sql import functions as F


@pytest.fixture
def service():
    """25 posts, by pages; every third request fails at first."""
    state = {"n": 25, "asked": 0, "refused": 0, "limits": set()}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            state["asked"] += 1
            if state["asked"] % 3 == 2:
                state["refused"] += 1
                self.send_response(503)
                self.end_headers()
                return
            url = urlparse(self.path)
            asked = {k: int(v[0]) for k, v in parse_qs(url.query).items()}
            if url.path == "/posts":
                start, limit = asked.get("start", 0), asked.get("limit", 10)
                state["limits"].add(limit)
                end = min(state["n"], start + limit)
                body = {"items": [{"id": k} for k in range(start, end)], "nextCursor": end if end < state["n"] else None}
            elif url.path == "/posts/13":
                self.send_response(404)
                self.end_headers()
                return
            else:
                k = int(url.path.rpartition("/")[2])
                body = {"id": k, "filePath": f"f{k}", "caption": None, "tags": [{"tagInfo": {"name": "t"}}], "sha256": "x"}
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/posts", state
    server.shutdown()


def test_stream_goes_on_where_it_was(spark, service, tmp_path):
    url, state = service
    posts.register(spark)
    fails = {"left": 1}

    def run():
        def keep(batch, n):
            if n == 2 and fails["left"]:
                fails["left"] = 0
                raise RuntimeError("stopped here")
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")

        stream = spark.readStream.format("post_ids").options(url=url, limit=4, wait=0.01).load()
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="stopped here"):
        run()
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(25))
    assert state["limits"] == {4} and state["refused"] > 2


def test_bodies_are_asked_again(spark, service, monkeypatch):
    url, _ = service
    ids = spark.range(10, 20).coalesce(1)
    fetch = lambda u: posts.patiently(u, wait=0.01)
    rows = posts.posts(posts.bodies(ids, url, fetch)).collect()
    assert sorted(r.id for r in rows) == [k for k in range(10, 20) if k != 13] and all(r.caption == "" and r.tags == ["t"] for r in rows)


def test_patience_ends(monkeypatch):
    answers = [(503, ""), (429, ""), (200, "x")]
    monkeypatch.setattr(posts, "get", lambda url: answers.pop(0))
    assert posts.patiently("u", 3, 0) == (200, "x")
    answers = [(500, "")] * 3
    assert posts.patiently("u", 3, 0) == (500, "") and not answers
    answers = [(404, "")]
    assert posts.patiently("u", 3, 0) == (404, "")


def test_failed_keys_are_tried_again_after_a_restart(spark, tmp_path):
    def work(row):
        if row["fails"]:
            raise ValueError(row["key"])
        return f"made {row['key']}"

    def run(n, rows):
        spark.createDataFrame(rows, "key string, fails boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, fails boolean").parquet(f"{tmp_path}/in")
        out = retries.attempts(stream, work)
        out.writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out/run={n}")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return {r.key: (r.status, r.tries, r.result) for r in spark.read.parquet(f"{tmp_path}/out/run={n}").collect()}

    assert run(0, [("a", True), ("b", False), ("c", True)]) == {"a": ("failed", 1, "ValueError: a"), "b": ("done", 1, "made b"), "c": ("failed", 1, "ValueError: c")}
    assert run(1, [("a", True), ("b", False), ("c", True)]) == {"a": ("failed", 2, "ValueError: a"), "b": ("skipped", 1, None), "c": ("failed", 2, "ValueError: c")}
    assert run(2, [("a", False), ("c", True)]) == {"a": ("done", 3, "made a"), "c": ("failed", 3, "ValueError: c")}
    assert run(3, [("a", False), ("c", False)]) == {"a": ("skipped", 3, None), "c": ("given up", 3, None)}


def test_a_call_takes_many_keys(spark, tmp_path):
    """Outcomes by bucket are those by key, whatever the number of buckets, and Spark's state has a row a bucket."""
    rows = [(f"k{k}", k % 4) for k in range(200)] + [(None, 1), ("k7", 3)]

    def work(row):
        if row["fails"] > row["round"]:
            raise ValueError(row["key"])
        return f"{row['key']} in {row['round']}"

    for buckets in (1, 7):
        folder, states = f"{tmp_path}/{buckets}", []
        for n in range(4):
            spark.createDataFrame([(*r, n) for r in rows], "key string, fails int, round int").write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema("key string, fails int, round int").parquet(f"{folder}/in")
            out = retries.attempts(stream, work, buckets=buckets).writeStream.outputMode("update")
            asked = out.foreachBatch(lambda b, _, n=n: b.write.parquet(f"{folder}/out/{n}")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            asked.awaitTermination()
            states.append(asked.lastProgress["stateOperators"][0]["numRowsTotal"])
            found = {r.key: (r.status, r.tries, r.result) for r in spark.read.parquet(f"{folder}/out/{n}").collect()}
            expected = {}
            for key, fails in dict(reversed(rows)).items():
                done = fails < n
                status = "skipped" if done else "given up" if n == 3 else "done" if fails == n else "failed"
                expected[key] = (status, min(n, fails, 2) + 1, {"done": f"{key} in {n}", "failed": f"ValueError: {key}"}.get(status))
            assert found == expected
        assert states == [buckets] * 4


def test_counts_come_with_the_write(spark, tmp_path):
    rows, seen = counters.counted(spark.range(100), odd=F.col("id") % 2 == 1, none=F.col("id") > 200)
    rows.write.parquet(f"{tmp_path}/out")
    assert seen.get == {"rows": 100, "odd": 50, "none": 0}


def test_chunks_are_full_and_bounded(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0, 1, 5, 50, 120])) for k in range(257)]
    df = spark.createDataFrame(rows, "id long, n long").repartition(5)
    got = sorted(map(tuple, chunks.chunked(df, ["id"], 20, "n", 100).select("id", "n", "chunk", "part").collect()))
    assert [r[2] for r in got] == [k // 20 for k in range(257)]
    held = {}
    for _, n, c, p in got:
        held.setdefault((c, p), []).append(n or 0)
    assert all(sum(x) <= 100 or sum(v > 0 for v in x) == 1 for x in held.values())
    for (c, p), x in held.items():
        if p:
            assert sum(held[c, p - 1]) + x[0] > 100
    assert [r.chunk for r in chunks.chunked(df, ["id"], 100).orderBy("id").collect()] == [k // 100 for k in range(257)]


def boxes(image, width, height):
    """Means over boxes, pixel by pixel."""
    h, w, _ = image.shape
    out = np.zeros((height, width, 3))
    for y in range(height):
        for x in range(width):
            y0, y1, x0, x1 = y * h / height, (y + 1) * h / height, x * w / width, (x + 1) * w / width
            total = 0
            for i in range(int(y0), min(h, int(np.ceil(y1)))):
                for j in range(int(x0), min(w, int(np.ceil(x1)))):
                    total = total + image[i, j].astype(float) * (min(y1, i + 1) - max(y0, i)) * (min(x1, j + 1) - max(x0, j))
            out[y, x] = total / ((y1 - y0) * (x1 - x0))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_resampling_is_a_box_average(seed):
    rng = np.random.default_rng(seed)
    h, w, height, width = rng.integers(1, 24, 4)
    image = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
    expected = boxes(image, width, height)
    assert np.abs(pixels.resized(image, int(width), int(height)) - expected).max() <= 0.5 + 1e-6
    assert np.array_equal(pixels.resized(image, int(w), int(h)), image)


def test_pictures_are_fitted(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (300, 500, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(pixels.png(image))
    (tmp_path / "b.png").write_bytes(b"no picture")
    rows = pixels.fitted(pixels.pictures(spark, str(tmp_path))).collect()
    assert len(rows) == 1 and (rows[0].width, rows[0].height, rows[0].bucket_w, rows[0].bucket_h) == (500, 300, 1344, 768)
    got = np.frombuffer(rows[0].pixels, np.uint8).reshape(768, 1344, 3)
    scale = max(1344 / 500, 768 / 300)
    rw, rh = round(500 * scale), round(300 * scale)
    whole = pixels.resized(image, rw, rh)
    assert np.array_equal(got, whole[(rh - 768) // 2 : (rh - 768) // 2 + 768, (rw - 1344) // 2 : (rw - 1344) // 2 + 1344])
