"""Shared plumbing: where intermediate tables live, and how they are cut from their lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace between words, wherever a contract says ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Rows per Arrow batch. Texts can be long, so a batch of Spark's default 10,000 rows may not fit a worker.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20

#: The application that has this package's archive, and the folder that goes when it ends.
_SENT: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_python(spark: SparkSession) -> None:
    """Make a session ready for Python code on executors: small Arrow batches, and this package where it isn't installed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if _SENT.get("to") != context.applicationId:
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="pixelloom-")) / "pixelloom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for f in sorted((root / "pixelloom").rglob("*.py")):
                out.write(f, f.relative_to(root))
        context.addPyFile(str(archive))
        _SENT["to"] = context.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps start from files that every executor can read, so a lost
    executor costs a re-read and not the whole lineage.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/pixelloom-{spark.sparkContext.applicationId}"
    if _SENT.get("cleans") != folder:
        # The application's intermediate tables go when it ends.
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        _SENT["cleans"] = folder
    path = f"{folder}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let go of shuffle files of plans that nobody holds any more, before a step that needs disk itself."""
    gc.collect()
    spark._jvm.System.gc()


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def row_keys(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit numbers that stand for all columns of a row; what Spark can't hash (maps) counts by its JSON text."""

    def hashable(field) -> Column:
        one = F.col(f"`{field.name}`")
        kind = field.dataType.simpleString()
        return F.to_json(F.struct(one.alias("x"))) if "map<" in kind or "variant" in kind else one

    columns = [hashable(f) for f in df.schema.fields]
    return F.xxhash64(F.lit("k1"), *columns), F.xxhash64(F.lit("k2"), *columns)


def row_of(df: DataFrame, but: str | None = None) -> Column:
    """A whole row (``but`` one column) as one struct, so that its names can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c != but] or [F.lit(None).cast("string").alias("none")])


def beside(found: DataFrame, names: list[str], own: list[str], row: str = "row") -> DataFrame:
    """The fields ``names`` of the struct ``row`` and the columns ``own``; an own name that the row has, too, gets underscores behind it."""
    taken, columns = set(names), [F.col(row).getField(c).alias(c) for c in names]
    for name in own:
        free = name
        while free in taken:
            free += "_"
        taken.add(free)
        columns.append(F.col(name).alias(free))
    return found.select(*columns)


def null_last(name: str) -> tuple[Column, Column]:
    """What sorts by ``name`` with nulls behind all others, in structs and minima too."""
    return F.col(name).isNull().alias("none"), F.col(name)


def hash_uniform(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys only: 52 bits of an MD5 digest, plus half a step."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def joined(spans: str | Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str | Column, kind: str) -> Column:
    """How many of the spans are of ``kind``."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
