"""Files of a data set: pictures, latents, tag texts and metadata, as DataFrames and back."""

from __future__ import annotations

import io
import tomllib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import IMAGE_SUFFIXES, is_sharded_output, storage_path
from . import json_object, tree
from .storage import opened

LATENTS = "path string, latents array<float>, shape array<int>, crop_ltrb array<bigint>, original_size array<bigint>, train_resolution array<bigint>, error string"
RECORD = "tags string, caption string, train_resolution array<bigint>"


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...], *, recursive: bool = True, ignore_hidden: bool = True, content: bool = True) -> DataFrame:
    """path, rel (path below root), length and content of files with one of ``suffixes``, in any case.

    Hidden means a dot before a component below ``root``; what lies above it
    doesn't count. Names that begin with ``_`` aren't hidden. Without ``content`` no file is opened.
    """
    tree.register(spark)
    options = {"path": root, "suffixes": ",".join(suffixes), "recursive": recursive, "hidden": not ignore_hidden, "content": content}
    return spark.read.format("tree").options(**{k: str(v) if k in ("path", "suffixes") else str(v).lower() for k, v in options.items()}).load().select("path", "rel", "length", "content")


def images(spark: SparkSession, root: str, **options) -> DataFrame:
    """Picture files with their content key; the content is read by who selects it."""
    return scan(spark, root, IMAGE_SUFFIXES, **options).withColumn("key", F.sha2("content", 256))


def sharded_latents(spark: SparkSession, root: str) -> DataFrame:
    """Latent files at ab/cd/<64 characters>.npz and nowhere else, with their key."""
    found = scan(spark, root, ("npz",)).where(is_sharded_output(F.col("rel")) & F.col("rel").endswith(".npz"))
    return found.withColumn("key", F.regexp_extract("rel", r"([^/]{64})\.npz$", 1))


def read_npz(files: DataFrame) -> DataFrame:
    """The arrays of latent files (path, content); a file that can't be read gives a row with its error."""

    whole = ("crop_ltrb", "original_size", "train_resolution")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rest = [], {c: [] for c in ("shape", *whole, "error")}
            for content in batch.column(1):
                row, flat = dict.fromkeys(rest), None
                try:
                    with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as arrays:
                        latents = arrays["latents"].astype(np.float32)
                        row |= {"shape": list(latents.shape)} | {c: [int(x) for x in arrays[c]] for c in whole}
                        flat = latents.ravel()
                except Exception as e:  # noqa: BLE001  (a damaged file is a result here)
                    row = dict.fromkeys(rest) | {"error": f"{type(e).__name__}: {e}"}
                found.append(flat)
                for c, values in rest.items():
                    values.append(row[c])
            # Latents go from numpy to Arrow as they are, not number by number.
            ends = np.cumsum([0, *[0 if f is None else len(f) for f in found]]).astype(np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.float32), *[f for f in found if f is not None]]))
            lists = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([f is None for f in found], pa.bool_()))
            types = {"shape": pa.list_(pa.int32()), "error": pa.string()}
            others = {c: pa.array(v, types.get(c, pa.list_(pa.int64()))) for c, v in rest.items()}
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *others.values()], ["path", "latents", *others])

    return files.select("path", "content").mapInArrow(read, LATENTS)


def npz_bytes(latents: np.ndarray, crop_ltrb, original_size, train_resolution) -> bytes:
    """A compressed latent file."""
    out = io.BytesIO()
    np.savez_compressed(out, latents=latents, crop_ltrb=np.array(crop_ltrb), original_size=np.array(original_size), train_resolution=np.array(train_resolution))
    return out.getvalue()


def encode(files: DataFrame, encoder: Callable[[pd.Series], pd.Series], result: str) -> DataFrame:
    """``files`` with the result of a caller's batch function on their content, such as a model; Arrow batches in and out."""
    return files.withColumn("encoded", F.pandas_udf(encoder, result)("content"))


def write_tags(items: DataFrame, path: str) -> None:
    """Keys with their tags, comma-joined, partitioned by the key's first two characters."""
    items.select("key", F.array_join("tags", ", ").alias("text"), F.substring("key", 1, 2).alias("d1")).write.mode("append").partitionBy("d1").parquet(path)


def tag_files(spark: SparkSession, root: str) -> DataFrame:
    """Whole texts of tag or caption files, with the file's stem as key; hidden ones, and suffixes in another case, as in ``scan``."""
    return scan(spark, root, ("txt",)).select(F.regexp_extract("rel", r"([^/]+)\.[^./]+$", 1).alias("key"), F.col("content").cast("string").alias("text"))


def metadata_json(spark: SparkSession, path: str, split: int = json_object.SPLIT) -> DataFrame:
    """key, tags, caption and train_resolution of a metadata file: one JSON object from keys to records, read in ranges of ``split`` bytes."""
    entries = json_object.read_object(spark, path, split)
    return entries.select("key", F.from_json("value", RECORD).alias("m")).select("key", "m.*")


def to_metadata_json(items: DataFrame) -> DataFrame:
    """One JSON line per key, to be written as text; a record keeps what it has."""
    return items.select(F.to_json(F.create_map("key", F.struct("tags", "caption", "train_resolution"))).alias("value"))


def clean_metadata(metadata: DataFrame) -> DataFrame:
    """Metadata with clean tags and captions; empty ones stay as they are."""
    from ..functions.text import clean_caption, clean_tags

    cleaned = lambda c, f: F.when(F.coalesce(F.col(c), F.lit("")) != "", f(F.col(c))).otherwise(F.col(c))
    return metadata.withColumns({"tags": cleaned("tags", clean_tags), "caption": cleaned("caption", clean_caption)})


def output_path(root: str, key: Column, suffix: str) -> Column:
    return storage_path(F.lit(root), key, suffix)


#: Preview options with what they are when they aren't given; null: they have to be.
SAMPLE_OPTIONS = {"prompt": None, "negative_prompt": None, "steps": None, "seed": None, "width": ..., "height": ..., "clip_skip": 2}


def sample_options(given: dict) -> dict:
    """One preview's options, whole; a missing or an unknown one is an error. Width and height may stay open."""
    unknown = set(given) - set(SAMPLE_OPTIONS)
    lacking = {name for name, default in SAMPLE_OPTIONS.items() if default is None and name not in given}
    if unknown or lacking:
        raise ValueError(f"preview options: unknown {sorted(unknown)}, missing {sorted(lacking)}")
    return {name: given.get(name, None if default is ... else default) for name, default in SAMPLE_OPTIONS.items()}


def run_config(path: str | Path) -> dict:
    """A run's settings from TOML: the save folder gets the model's name, ``lora_rank`` is another name for ``lora_dim``, and previews get all their options."""
    with Path(path).open("rb") as f:
        config = tomllib.load(f)
    if "lora_rank" in config:
        config["lora_dim"] = config["lora_rank"]
    if "save_dir" in config and "model_name" in config:
        config["save_path"] = f"{config['save_dir']}/{config['model_name']}"
    if "preview_sample_options" in config:
        config["preview_sample_options"] = [sample_options(x) for x in config["preview_sample_options"]]
    return config


def checked(address: str, folder: bool = True, thresholds: dict[str, float] | None = None) -> str:
    """``address``, if it is there and a folder (or a file); ``thresholds`` have to lie between 0 and 1. Anything else is an error."""
    system, place = opened(address)
    kind = system.get_file_info(place).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(f"{address} does not exist")
    if (kind == fs.FileType.Directory) != folder:
        raise NotADirectoryError(f"{address} is not a folder") if folder else IsADirectoryError(f"{address} is a folder")
    for name, value in (thresholds or {}).items():
        if not 0 <= value <= 1:
            raise ValueError(f"{name} must be between 0 and 1, not {value}")
    return address
