"""Queries over preparation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.prep import prepare
from .data_queries import _scratch, docs, query


@query("incremental_prep", "SELECT DISTINCT sha256(text) AS key, length(text)::BIGINT AS size FROM documents")
def incremental_prep(spark, sf_dir):
    root = _scratch(spark)
    docs(spark, sf_dir).select("text").repartition(8).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    prepare(spark, f"{root}/in", schema, f"{root}/out", f"{root}/state", lambda b: b.select(F.sha2("text", 256).alias("key"), F.length("text").cast("long").alias("size")), max_files=3).awaitTermination()
    return spark.read.parquet(f"{root}/out")
