"""A paged service of posts, read through a Spark data source.

The service answers ``{items: [{id}], nextCursor}`` page by page and each post by
its id. Which pages there are is only known by following cursors, so one
partition lists ids; details are then fetched by all partitions.

As a stream the cursor is the offset: a batch is ``pages`` pages, and a run that is
stopped goes on behind the last batch that its checkpoint has.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

POST = "id long, filePath string, fileName string, extension string, width int, height int, aspectRatio double, score int, source string, caption string, tags array<struct<tagInfo:struct<name:string>>>, sha256 string"


def get(url: str) -> tuple[int, str]:
    """Status and body of an address."""
    try:
        with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310  (the caller names the service)
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


#: Tries of a request, and seconds before the second one; each further wait is twice as long.
TRIES, WAIT = 5, 0.5


def patiently(url: str, tries: int = TRIES, wait: float = WAIT) -> tuple[int, str]:
    """As ``get``, again after a pause when the service is busy (429), fails (5xx) or can't be reached; the last answer stays."""
    for k in range(tries):
        try:
            status, body = get(url)
            if status != 429 and status < 500:
                break
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if k == tries - 1:
                raise
        if k < tries - 1:
            time.sleep(wait * 2**k)
    return status, body


def page(url: str, cursor, limit: int | None, parameter: str, wait: float = WAIT) -> tuple[list[int], int | None]:
    """Ids of a page and the cursor of the next one."""
    asked = {k: v for k, v in ((("limit", limit)), (parameter, cursor)) if v is not None}
    status, body = patiently(url + ("?" + urllib.parse.urlencode(asked) if asked else ""), wait=wait)
    if status != 200:
        raise OSError(f"{url} answers {status}")
    found = json.loads(body)
    return [item["id"] for item in found["items"]], found.get("nextCursor")


class PostIds(DataSource):
    """Ids of all posts: ``spark.read.format("post_ids").option("url", ...).load()``, or ``readStream``.

    Of a stream: ``limit`` (posts of a page), ``pages`` (of a batch, default 1), ``cursor`` (the name of that parameter, default
    ``start``), ``first`` (the first cursor, default 0) and ``wait`` (seconds before a second try).
    """

    @classmethod
    def name(cls) -> str:
        return "post_ids"

    def schema(self) -> str:
        return "id long"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options["url"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _PageStream(dict(self.options))


class _PageStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.parameter, self.first = options["url"], options.get("cursor", "start"), int(options.get("first", 0))
        self.limit, self.pages, self.wait = int(options["limit"]) if "limit" in options else None, int(options.get("pages", 1)), float(options.get("wait", WAIT))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.first, "ended": False}

    def _batch(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        """Rows of the pages from ``start`` to ``end``, or of so many as a batch has."""
        rows, at, n = [], start, 0
        while not at["ended"] and at != end and (end is not None or n < self.pages):
            ids, following = page(self.url, at["cursor"], self.limit, self.parameter, self.wait)
            rows += [(k,) for k in ids]
            at, n = ({"cursor": following, "ended": False} if following is not None else {"cursor": at["cursor"], "ended": True}), n + 1
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._batch(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._batch(start, end)[0])

    def commit(self, end: dict) -> None:
        """Pages needn't be let go of."""


class _Pages(DataSourceReader):
    def __init__(self, url: str):
        self.url = url

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        cursor = None
        while True:
            status, body = patiently(self.url + ("" if cursor is None else f"?cursor={cursor}"))
            if status != 200:
                raise OSError(f"{self.url} answers {status}")
            page = json.loads(body)
            yield from ((item["id"],) for item in page["items"])
            cursor = page.get("nextCursor")
            if cursor is None:
                return


def bodies(ids: DataFrame, url: str, fetch: Callable[[str], tuple[int, str]] = patiently) -> DataFrame:
    """id, status and body of each post."""

    def run(batches):
        for batch in batches:
            answers = [fetch(f"{url}/{k}") for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in answers], pa.int32()), pa.array([b for _, b in answers], pa.string())], ["id", "status", "body"])

    return ids.select("id").mapInArrow(run, "id long, status int, body string")


def posts(answers: DataFrame) -> DataFrame:
    """Posts of the answers that succeeded, with plain tags; a missing caption is empty."""
    flat = answers.where("status = 200").select(F.from_json("body", POST).alias("p")).select("p.*")
    return flat.select("id", F.col("filePath").alias("file_path"), F.col("fileName").alias("file_name"), "extension", "width", "height", "aspectRatio", "score", "source", F.coalesce("caption", F.lit("")).alias("caption"), F.transform("tags", lambda t: t["tagInfo"]["name"]).alias("tags"), "sha256").withColumnRenamed("aspectRatio", "aspect_ratio")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PostIds)
