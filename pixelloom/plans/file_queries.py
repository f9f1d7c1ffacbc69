"""Queries that write files, damage some, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks, counters
from ..operators.numbering import numbered_in_order
from ..sources import json_object, npz, pixels, tree
from ..streaming import retries
from .data_queries import CAPTION, ITEMS, TAG_TEXT, _scratch, caption, docs, items, query, tag_texts

#: The first document of each content, with what its latent file holds.
FIRST = f"{ITEMS}, fi AS (SELECT * FROM it WHERE doc_id IN (SELECT min(doc_id) FROM it GROUP BY key))"


def first_items(spark, sf_dir) -> DataFrame:
    """One row per content key, the document with the smallest id, with small latents that depend on that id."""
    one = items(spark, sf_dir).groupBy("key").agg(F.min_by(F.struct("doc_id", "width", "height", "bucket"), "doc_id").alias("d")).select("key", "d.*")
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: ((F.col("doc_id") + k) % 128).cast("float") / 8)
    return one.select(
        "key", "doc_id", cells.alias("latents"), F.array(*map(F.lit, (4, 2, 2))).alias("shape"), F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("bucket.w"), F.col("bucket.h")).alias("crop_ltrb"),
        F.array("width", "height").alias("original_size"), F.array("bucket.w", "bucket.h").alias("train_resolution"),
    )


@query(
    "tree_roundtrip",
    f"""WITH {FIRST}, x AS (SELECT doc_id AS xid, {TAG_TEXT} AS text FROM documents WHERE doc_id % 3 <> 1)
SELECT key, array_to_string(coalesce(string_split(text, ','), []), '|') AS tags, CASE WHEN doc_id % 2 = 0 THEN {CAPTION} ELSE '' END AS caption,
  [4, 2, 2] AS shape, [0, 0, w, h] AS crop_ltrb, [width, height] AS original_size, [w, h] AS train_resolution
FROM fi LEFT JOIN x ON doc_id = xid""",
)
def tree_roundtrip(spark, sf_dir):
    """Latents, tags and captions written as a file each and composed again from the files."""
    root, once = _scratch(spark), _scratch(spark)
    # Texts are hashed once for the three kinds of files.
    first_items(spark, sf_dir).write.parquet(once)
    first = spark.read.parquet(once)
    npz.write_latents(first, f"{root}/latents")
    npz.write_texts(first.join(tag_texts(spark, sf_dir), "doc_id").where("doc_id % 3 <> 1"), f"{root}/tags")
    npz.write_texts(first.where("doc_id % 2 = 0").select("key", caption().alias("text")), f"{root}/caption")
    found = npz.training_items(spark, root).where("error IS NULL")
    return found.select("key", F.array_join("tags", "|").alias("tags"), "caption", "shape", "crop_ltrb", "original_size", "train_resolution")


@query("reprocess_damaged", f"WITH {FIRST} SELECT doc_id, key FROM fi WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0")
def reprocess_damaged(spark, sf_dir):
    """Items whose latent file is cut short (ids divisible by 5), isn't an archive (7) or isn't there (11)."""
    root, first = _scratch(spark), first_items(spark, sf_dir)
    tree.register(spark)
    files = npz.packed(first).join(first.select("key", "doc_id"), "key").where("doc_id % 11 <> 0")
    damaged = F.when(F.col("doc_id") % 5 == 0, F.expr("substring(content, 1, length(content) div 2)")).when(F.col("doc_id") % 7 == 0, F.lit(b"damaged")).otherwise(F.col("content"))
    files.select("key", damaged.alias("content")).write.format("tree").mode("append").options(path=root, suffix="npz").save()
    return npz.to_process(first.select("key", "doc_id"), root).select("doc_id", "key")


@query(
    "legacy_copy",
    f"""WITH {ITEMS}, l AS (SELECT it.*, {TAG_TEXT.replace("doc_id", "it.doc_id")} AS text FROM it JOIN labels USING (doc_id))
SELECT doc_id::VARCHAR AS key, array_to_string(string_split(text, ', '), '|') AS tags, CASE WHEN doc_id % 2 = 0 THEN {CAPTION} ELSE '' END AS caption,
  [w, h] AS train_resolution, [width, height] AS original_size, [0, 0, w, h] AS crop_ltrb FROM l""",
)
def legacy_copy(spark, sf_dir):
    """Legacy metadata of all documents with the latent files of those that have labels, copied as they are."""
    root = _scratch(spark)
    tree.register(spark)
    sized = items(spark, sf_dir).join(docs(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    zero = F.lit(0).cast("long")
    latents = sized.select(
        F.col("doc_id").cast("string").alias("key"), F.array(F.lit(0.5).cast("float")).alias("latents"), F.array(F.lit(1)).alias("shape"),
        F.array(zero, zero, "bucket.w", "bucket.h").alias("crop_ltrb"), F.array("width", "height").alias("original_size"), F.array("bucket.w", "bucket.h").alias("train_resolution"),
    )
    npz.packed(latents).write.format("tree").mode("append").options(path=f"{root}/old", suffix="npz", sharded="false").save()
    metadata = tag_texts(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").alias("tags")).withColumn("caption", F.when(F.col("doc_id") % 2 == 0, caption())).drop("doc_id")
    return npz.convert_legacy(spark, metadata, f"{root}/old", f"{root}/new").withColumn("tags", F.array_join("tags", "|"))


@query(
    "metadata_object",
    f"SELECT doc_id::VARCHAR AS key, {TAG_TEXT} AS tags, {CAPTION} AS caption, text, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents",
)
def metadata_object(spark, sf_dir):
    """Records of all documents as one JSON object in order of ids, read back in byte ranges of 64 KB; place is the record's rank in the file."""
    path = f"{_scratch(spark)}.json"
    record = F.to_json(F.struct(F.col("text").alias("tags"), F.col("caption"), F.col("whole")))
    rows = tag_texts(spark, sf_dir).withColumn("caption", caption()).join(docs(spark, sf_dir).select("doc_id", F.col("text").alias("whole")), "doc_id")
    json_object.write_object(rows.select(F.col("doc_id").cast("string").alias("key"), record.alias("value"), "doc_id"), path, "doc_id")
    back = json_object.read_object(spark, path, 64 << 10).withColumn("m", F.from_json("value", "tags string, caption string, whole string")).select("key", "m.*", "place")
    # Numbering looks at its rows three times; the object is read once.
    kept = _scratch(spark)
    back.write.parquet(kept)
    ordered = numbered_in_order(spark.read.schema(back.schema).parquet(kept), [], ["place"], "rank")
    return ordered.select("key", "tags", "caption", F.col("whole").alias("text"), (F.col("rank") - 1).alias("place"))


@query(
    "picture_means",
    """WITH p AS (SELECT vec_id, k, 16 * (k // 4) + 2 * (k % 4) AS c FROM embeddings, range(16) AS r(k)),
v AS (SELECT vec_id, k, list_transform([c, c + 1, c + 8, c + 9], lambda i: (vec_id * 31 + i * 7) % 256) AS r, list_transform([c, c + 1, c + 8, c + 9], lambda i: i * 4) AS b FROM p)
SELECT vec_id, k AS cell, floor(list_sum(r) / 4.0 + 0.5)::BIGINT AS red, floor(list_sum(list_transform(r, lambda x: 255 - x)) / 4.0 + 0.5)::BIGINT AS green, floor(list_sum(b) / 4.0 + 0.5)::BIGINT AS blue FROM v""",
)
def picture_means(spark, sf_dir):
    """A picture of 8 x 8 pixels for each embedding, written as PNG, decoded again and resampled to 4 x 4."""
    import numpy as np
    import pyarrow as pa

    root = _scratch(spark)

    def drawn(batches):
        for batch in batches:
            ids, cell = batch.column(0).to_pylist(), np.arange(64)
            red = [(k * 31 + cell * 7) % 256 for k in ids]
            files = [pixels.png(np.stack([r, 255 - r, cell * 4], axis=1).astype(np.uint8).reshape(8, 8, 3)) for r in red]
            yield pa.RecordBatch.from_arrays([pa.array([f"{k:08d}" for k in ids]), pa.array(files, pa.binary())], ["key", "content"])

    tree.register(spark)
    docs(spark, sf_dir, "embeddings").select("vec_id").mapInArrow(drawn, "key string, content binary").write.format("tree").mode("append").options(path=root, suffix="png").save()
    four, zero = F.lit(4), F.lit(0)
    small = pixels.shaped(pixels.pictures(spark, root), (four, four), (four, four), (zero, zero))
    byte = lambda channel: F.conv(F.hex(F.expr(f"substring(pixels, cell * 3 + {channel + 1}, 1)")), 16, 10).cast("long")
    cells = small.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"), "pixels", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("cell"))
    return cells.select("vec_id", F.col("cell").cast("long").alias("cell"), byte(0).alias("red"), byte(1).alias("green"), byte(2).alias("blue"))


@query(
    "chunked_work",
    """WITH n AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
s AS (SELECT i // 100 AS chunk, list(n_chars ORDER BY i) AS sizes FROM n GROUP BY 1),
p AS (SELECT chunk, list_reduce([{'part': 0, 'held': 0::BIGINT, 'parts': []::INT[]}] || list_transform(sizes, lambda x: {'part': 0, 'held': x, 'parts': []::INT[]}),
  lambda a, x: CASE WHEN a.held > 0 AND a.held + x.held > 20000 THEN {'part': a.part + 1, 'held': x.held, 'parts': a.parts || [a.part + 1]} ELSE {'part': a.part, 'held': a.held + x.held, 'parts': a.parts || [a.part]} END) AS r FROM s)
SELECT doc_id, i // 100 AS chunk, (r.parts)[i % 100 + 1] AS part FROM n JOIN p ON p.chunk = i // 100""",
)
def chunked_work(spark, sf_dir):
    """Documents in chunks of 100, each in parts of 20,000 characters."""
    return chunks.chunked(docs(spark, sf_dir).select("doc_id", "n_chars"), ["doc_id"], 100, "n_chars", 20_000).select("doc_id", "chunk", "part")


@query("write_counts", "SELECT count(*) AS rows, count(*) FILTER (l.doc_id IS NULL) AS processed, count(*) FILTER (l.doc_id IS NOT NULL AND quality <> 0) AS skipped, count(*) FILTER (quality = 0) AS failed FROM documents d LEFT JOIN labels l USING (doc_id)")
def write_counts(spark, sf_dir):
    """What a run has processed, skipped and failed, counted while its outcomes are written."""
    known = docs(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("seen"))
    met = docs(spark, sf_dir).select("doc_id").join(known, "doc_id", "left")
    counted, seen = counters.counted(met, processed=F.col("seen").isNull(), skipped=F.col("seen").isNotNull() & (F.col("quality") != 0), failed=F.col("quality") == 0)
    counted.write.parquet(_scratch(spark))
    return spark.createDataFrame([tuple(seen.get[c] for c in ("rows", "processed", "skipped", "failed"))], "rows long, processed long, skipped long, failed long")


@query(
    "retry_outcomes",
    """SELECT doc_id::VARCHAR AS key, CASE WHEN r < doc_id % 4 THEN 'failed' WHEN r = doc_id % 4 THEN 'done' ELSE 'skipped' END AS status, least(r, doc_id % 4)::INT + 1 AS tries FROM documents, range(3) AS x(r)""",
)
def retry_outcomes(spark, sf_dir):
    """Three batches that list every document; work on it fails in the first doc_id % 4 of them."""
    root = _scratch(spark)

    def work(row):
        if row["fails"]:
            raise ValueError("not this time")
        return "ok"

    def run():
        stream = spark.readStream.schema("key string, fails boolean").parquet(f"{root}/in")
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
        retries.attempts(stream, work).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()

    for k in range(3):
        docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"), (F.lit(k) < F.col("doc_id") % 4).alias("fails")).write.mode("append").parquet(f"{root}/in")
        run()
    return spark.read.parquet(f"{root}/out").select("key", "status", "tries")
