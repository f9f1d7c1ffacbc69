"""Latent files: written from rows, read whole, or known by their headers alone.

A latent file is a zip archive of arrays. What it holds stands in the directory at its end,
shapes and types in the first bytes of each member, and the three small arrays take a
few bytes; so ``headers`` tells which files are usable, and everything the manifest needs,
without reading or unpacking the latents. Damage inside the latents' own bytes
doesn't show there; ``files.read_npz`` finds it.
"""

from __future__ import annotations

import errno
import io
import math
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Counted, exists, opened
from .tree import register

#: Bytes of files that go on together.
HELD = 16 << 20
SMALL = ("crop_ltrb", "original_size", "train_resolution")
HEADERS = "path string, names array<string>, shape array<int>, dtype string, crop_ltrb array<bigint>, original_size array<bigint>, train_resolution array<bigint>, bytes_read bigint, error string"


@lru_cache(1024)
def _declared(version: tuple[int, int], said: bytes) -> tuple[tuple[int, ...], bool, np.dtype]:
    """What an array's header says; most files of a data set say the same."""
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(io.BytesIO(said))


def _shape(member) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(member)
    length = member.read(2 if version == (1, 0) else 4)
    shape, _, dtype = _declared(version, length + member.read(int.from_bytes(length, "little")))
    return shape, dtype


def _small(data: bytes) -> list[int]:
    """The whole numbers of a small array of one dimension."""
    member = io.BytesIO(data)
    shape, dtype = _shape(member)
    if dtype.hasobject or len(shape) != 1:
        raise ValueError("not an array of numbers in one dimension")
    return [int(x) for x in np.frombuffer(data, dtype, math.prod(shape), member.tell())]


def header(path: str) -> dict:
    """What the directory, the latents' first bytes and the small arrays of a file say; its error if it can't be used."""
    out = dict.fromkeys([c.split()[0] for c in HEADERS.split(", ")]) | {"path": path, "bytes_read": 0}
    try:
        system, place = opened(path)
        with system.open_input_file(place) as file:
            counted = Counted(file)
            try:
                with zipfile.ZipFile(counted) as archive:
                    out["names"] = sorted(n.removesuffix(".npy") for n in archive.namelist())
                    with archive.open("latents.npy") as member:
                        member.MIN_READ_SIZE = 512
                        shape, dtype = _shape(member)
                        out |= {"shape": list(shape), "dtype": dtype.name}
                    for name in SMALL:
                        with archive.open(f"{name}.npy") as member:
                            out[name] = _small(member.read())
            finally:
                out["bytes_read"] = counted.bytes
    except Exception as e:  # noqa: BLE001  (a damaged file is a result here)
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def headers(files: DataFrame) -> DataFrame:
    """``header`` of each file of ``files`` (path)."""
    names = [c.split()[0] for c in HEADERS.split(", ")]
    fields = files.sparkSession.createDataFrame([], HEADERS).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [header(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in zip(names, schema, strict=True)], schema=schema)

    return files.select("path").mapInArrow(run, HEADERS)


def packed(latents: DataFrame, dtype: str = "float16") -> DataFrame:
    """key and content of the latent file of each row: latents (flat), shape, crop_ltrb, original_size, train_resolution."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                file = io.BytesIO()
                np.savez_compressed(file, latents=np.array(row["latents"], dtype).reshape(row["shape"]), **{name: np.array(row[name]) for name in SMALL})
                out.append(file.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "content"])

    return latents.select("key", "latents", "shape", *SMALL).mapInArrow(run, "key string, content binary")


def _tree(spark: SparkSession, root: str, suffixes: str, **options) -> DataFrame:
    register(spark)
    # Trees of up to 65,536 folders are dealt out in as many tasks as keep the cores busy, not one for each few folders.
    options = {"tasks": 16 * spark.sparkContext.defaultParallelism} | options
    return spark.read.format("tree").options(path=root, suffixes=suffixes, **{k: str(v).lower() for k, v in options.items()}).load()


def _by_folder(items: DataFrame) -> DataFrame:
    """``items`` dealt out by the folders that their keys go to, so that a folder is one task's, and by number, as files take long and their rows are short."""
    return items.repartition(4 * items.sparkSession.sparkContext.defaultParallelism, F.substring("key", 1, 4))


def write_latents(latents: DataFrame, root: str, dtype: str = "float16") -> None:
    """One file per row at ``root``/ab/cd/key.npz."""
    register(latents.sparkSession)
    packed(_by_folder(latents), dtype).write.format("tree").mode("append").options(path=root, suffix="npz").save()


def write_texts(items: DataFrame, root: str, text: str = "text") -> None:
    """One text per row (key, text) at ``root``/ab/cd/key.txt; a null text is an empty file."""
    register(items.sparkSession)
    _by_folder(items.select("key", F.col(text).cast("binary").alias("content"))).write.format("tree").mode("append").options(path=root, suffix="txt").save()


def write_tags(items: DataFrame, root: str) -> None:
    """One file per row (key, tags) with comma-joined tags."""
    write_texts(items.select("key", F.array_join("tags", ", ").alias("text")), root)


def texts(spark: SparkSession, root: str) -> DataFrame:
    """key and text of the texts at ``root``/ab/cd/key.txt, and nowhere else."""
    found = _tree(spark, root, "txt", exact=True, hidden=True)
    key = F.regexp_extract("rel", r"([^/]+)\.txt$", 1)
    place = F.concat_ws("/", F.substring(key, 1, 2), F.substring(key, 3, 2), F.concat(key, F.lit(".txt")))
    return found.where(F.col("rel") == place).select(key.alias("key"), F.col("content").cast("string").alias("text"))


def latents(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Latent files below ``root``, in any folder, with their key; the content is read if asked for."""
    return _tree(spark, root, "npz", content=content).withColumn("key", F.regexp_extract("rel", r"([^/]+)\.[^./]+$", 1))


def training_items(spark: SparkSession, root: str) -> DataFrame:
    """key, path, tags, caption, sizes and bucket of every usable latent file below ``root``, with the texts of ``tags`` and ``caption`` beside it.

    Tags are parted at commas and not trimmed; without a file they are [], a caption is "". Files that can't be used have their error and nothing else.
    """
    seen = headers(latents(spark, root)).withColumn("key", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    none = spark.createDataFrame([], "key string, text string")

    def beside(folder: str) -> DataFrame:
        return texts(spark, f"{root}/{folder}") if exists(*opened(f"{root}/{folder}")) else none

    met = seen.join(beside("tags").withColumnRenamed("text", "t"), "key", "left").join(beside("caption").withColumnRenamed("text", "c"), "key", "left")
    tags = F.coalesce(F.split("t", ","), F.array().cast("array<string>"))
    return met.select("key", "path", tags.alias("tags"), F.coalesce("c", F.lit("")).alias("caption"), "shape", *SMALL, "error")


def to_process(items: DataFrame, root: str) -> DataFrame:
    """Items (key) without a usable latent file at its place: none there, or one that is damaged, cut short or lacks an array."""
    system_path = F.concat_ws("/", F.lit(root.rstrip("/")), F.substring("key", 1, 2), F.substring("key", 3, 2), F.concat(F.col("key"), F.lit(".npz")))
    done = headers(items.select("key").distinct().select(system_path.alias("path"))).where("error IS NULL").select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("key"))
    return items.join(done, "key", "left_anti")


def _plain(key: str | None) -> bool:
    """Whether a key is the path of a file below a folder, as a listing would give it."""
    return key is not None and "\0" not in key and not {"", ".", ".."} & set(key.split("/"))


def by_key(keys: DataFrame, root: str, content: bool) -> DataFrame:
    """key, path and content (or null) of the files ``root``/key.npz that exist.

    Each key of ``keys`` is looked for at its place, so the work is dealt out by keys, however many files a folder has, and nothing is listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)

        def there(key: str) -> bool:
            try:
                return system.get_file_info(f"{base}/{key}.npz").type == fs.FileType.File
            except OSError as e:
                if e.errno == errno.ENAMETOOLONG:
                    return False
                raise

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["key", "path", "content"])

        for batch in batches:
            rows, held = [], 0
            for key in filter(_plain, batch.column(0).to_pylist()):
                if not there(key):
                    continue
                data = None
                if content:
                    with system.open_input_stream(f"{base}/{key}.npz") as f:
                        data = f.read()
                    held += len(data)
                rows.append((key, f"{root}/{key}.npz", data))
                if held >= HELD:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    return keys.select("key").mapInArrow(run, "key string, path string, content binary")


def convert_legacy(spark: SparkSession, metadata: DataFrame, latents_root: str, target: str) -> DataFrame:
    """Copy the latent files of ``metadata`` (key, tags, caption) that exist, byte by byte, to ``target``/latents, and give their manifest.

    Keys may have folders. Missing tags are [], a missing caption is "".
    """
    from ..functions.text import listed_tags

    if not exists(*opened(latents_root)):
        raise FileNotFoundError(latents_root)
    target = f"{target.rstrip('/')}/latents"
    # Keys are short and their files take long: they are dealt out by number and not by size.
    keys = metadata.select("key").repartition(4 * spark.sparkContext.defaultParallelism, "key").dropDuplicates(["key"])
    register(spark)
    by_key(keys, latents_root.rstrip("/"), True).select("key", "content").write.format("tree").mode("append").options(path=target, suffix="npz", sharded="false").save()
    below = F.substring("path", len(target) + 2, 1 << 20)
    seen = headers(by_key(keys, target, False)).where("error IS NULL").withColumn("key", F.regexp_replace(below, r"\.npz$", ""))
    return seen.join(metadata, "key").select("key", listed_tags(F.col("tags")).alias("tags"), F.coalesce("caption", F.lit("")).alias("caption"), "train_resolution", "original_size", "crop_ltrb")
