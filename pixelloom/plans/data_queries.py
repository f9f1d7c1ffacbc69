"""Queries over items, buckets, manifests, batches and prompts, with their SQL.

The tables have texts, not pictures, so widths, heights, tags and captions are
derived from ids by the same rule in both engines.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, rng, text
from ..functions.naming import storage_path
from ..operators import buckets, manifest, prompts, sampler
from ..sources import posts

# Stand-ins for tags and captions.
TAGS = (
    "1girl, 2girls, multiple_boys, long_hair, short_hair, medium_hair, blue_hair, pink_hair, hime_cut, bob_cut, red_eyes, blue_eyes, green-blue_eyes, "
    "long_sleeves, sleeveless, puffy_sleeves, ponytail, side_braid, hair_bun, twintails, ahoge, smile, ^_^, white_shirt, shirt, t-shirt, flower_hair_ornament, "
    "hair_ornament, ornament, été, grand_été, open_mouth, mouth, outdoors, night_sky, sky, solo"
).split(", ")
CAPTIONS = (
    "anime anime anime girl with a hat",
    "a cartoon girl and young lady",
    "a cartoon figure of a person",
    "an anime cartoon image of women",
    "girl girl girl standing",
    "a cartoon drawing of people",
    "young woman, female knight",
    "a plain landscape",
    "cartoon cartoon girl",
    "",
)
SEED = 47


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, key, width, height and the nearest bucket of every document."""
    sized = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("key"), (256 + (F.col("doc_id") * 37) % 1800).alias("width"), (256 + (F.col("doc_id") * 91) % 1700).alias("height"))
    return sized.withColumn("bucket", geometry.nearest_bucket(F.col("width"), F.col("height")))


def flat_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", F.col("doc_id").alias("key"), F.col("bucket.w").alias("w"), F.col("bucket.h").alias("h"))


def tag_list() -> Column:
    pick = lambda k: F.get(F.array(*map(F.lit, TAGS)), F.floor(rng.uniform("tag", F.col("doc_id"), k) * len(TAGS)).cast("int"))
    return F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 9).cast("int")), pick)


def caption() -> Column:
    return F.get(F.array(*map(F.lit, CAPTIONS)), (F.col("doc_id") % len(CAPTIONS)).cast("int"))


# --- SQL pieces -----------------------------------------------------------------------------------------------------

_BUCKETS = ", ".join(f"({k}, {w}, {h}, {w}::DOUBLE / {h})" for k, (w, h) in enumerate(geometry.BUCKETS))
ITEMS = f"""
b(i, bw, bh, ar) AS (VALUES {_BUCKETS}),
d AS (SELECT doc_id, sha256(text) AS key, 256 + (doc_id * 37) % 1800 AS width, 256 + (doc_id * 91) % 1700 AS height FROM documents),
n AS (SELECT doc_id, any_value(key) AS key, any_value(width) AS width, any_value(height) AS height,
    arg_min({{'w': bw::BIGINT, 'h': bh::BIGINT}}, {{'e': abs(ar - width::DOUBLE / height), 'i': i}}) AS bk FROM d, b GROUP BY doc_id),
it AS (SELECT doc_id, key, width, height, bk.w AS w, bk.h AS h FROM n)"""


def _u(*parts: str) -> str:
    return f"(('0x' || substring(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _q(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TAG_LIST = f"list_transform(range(0, doc_id % 9 + 1), lambda k: {_q(TAGS)}[CAST(floor({_u(chr(39) + 'tag' + chr(39), 'doc_id', 'k')} * {len(TAGS)}) AS BIGINT) + 1])"
CAPTION = f"{_q(CAPTIONS)}[doc_id % {len(CAPTIONS)} + 1]"
WIDER = "width::DOUBLE / height > w::DOUBLE / h"
Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- buckets and geometry -------------------------------------------------------------------------------------------


@query(
    "bucket_inventory",
    f"""WITH {ITEMS}, c AS (SELECT w, h, count(*) AS n FROM it GROUP BY w, h)
SELECT w, h, n, (sum(n) OVER (ORDER BY w, h) - n)::BIGINT AS start_index, (sum(n) OVER (ORDER BY w, h))::BIGINT AS end_index, ceil(n / 8.0)::BIGINT AS n_batches FROM c""",
)
def bucket_inventory(spark, sf_dir):
    return buckets.inventory(items(spark, sf_dir))


@query(
    "crop_geometry",
    f"""WITH {ITEMS}, r AS (SELECT *, CASE WHEN {WIDER} THEN h::DOUBLE / height ELSE w::DOUBLE / width END AS s,
  CASE WHEN {WIDER} THEN w::DOUBLE ELSE h * (width::DOUBLE / height) END AS fw, CASE WHEN {WIDER} THEN w / (width::DOUBLE / height) ELSE h::DOUBLE END AS fh FROM it),
f AS (SELECT *, floor(fw)::BIGINT AS iw, floor(fh)::BIGINT AS ih FROM r)
SELECT doc_id, w, h, floor(width * s + 0.5)::BIGINT AS resized_w, floor(height * s + 0.5)::BIGINT AS resized_h,
  floor((w - iw) / 2)::BIGINT AS crop_left, floor((h - ih) / 2)::BIGINT AS crop_top,
  floor((w - iw) / 2)::BIGINT + iw AS crop_right, floor((h - ih) / 2)::BIGINT + ih AS crop_bottom FROM f""",
)
def crop_geometry(spark, sf_dir):
    w, h, bw, bh = F.col("width"), F.col("height"), F.col("bucket.w"), F.col("bucket.h")
    rw, rh = geometry.cover_size(w, h, bw, bh)
    crop = items(spark, sf_dir).withColumn("crop", geometry.fit_rectangle(w, h, bw, bh))
    return crop.select("doc_id", bw.alias("w"), bh.alias("h"), rw.alias("resized_w"), rh.alias("resized_h"), *[F.col("crop")[k].alias(f"crop_{side}") for k, side in enumerate(("left", "top", "right", "bottom"))])


@query(
    "trim_offsets",
    f"""WITH {ITEMS}, r AS (SELECT *, CASE WHEN {WIDER} THEN h::DOUBLE / height ELSE w::DOUBLE / width END AS s FROM it),
z AS (SELECT *, floor(width * s + 0.5)::BIGINT AS rw, floor(height * s + 0.5)::BIGINT AS rh FROM r)
SELECT doc_id, CASE WHEN rw > w THEN floor((rw - w) / 2) ELSE 0 END::BIGINT AS off_x, CASE WHEN rh > h THEN floor((rh - h) / 2) ELSE 0 END::BIGINT AS off_y FROM z""",
)
def trim_offsets(spark, sf_dir):
    w, h, bw, bh = F.col("width"), F.col("height"), F.col("bucket.w"), F.col("bucket.h")
    x, y = geometry.trim_offsets(*geometry.cover_size(w, h, bw, bh), bw, bh)
    return items(spark, sf_dir).select("doc_id", x.alias("off_x"), y.alias("off_y"))


@query(
    "time_ids",
    f"""WITH {ITEMS}, r AS (SELECT *, floor(CASE WHEN {WIDER} THEN w::DOUBLE ELSE h * (width::DOUBLE / height) END)::BIGINT AS iw,
  floor(CASE WHEN {WIDER} THEN w / (width::DOUBLE / height) ELSE h::DOUBLE END)::BIGINT AS ih FROM it)
SELECT doc_id, [height, width, floor((h - ih) / 2)::BIGINT, floor((w - iw) / 2)::BIGINT, h, w] AS time_ids FROM r""",
)
def time_ids(spark, sf_dir):
    w, h, bw, bh = F.col("width"), F.col("height"), F.col("bucket.w"), F.col("bucket.h")
    return items(spark, sf_dir).select("doc_id", geometry.time_ids(F.array(w, h), geometry.fit_rectangle(w, h, bw, bh), F.array(bw, bh)).alias("time_ids"))


@query("content_keys", "SELECT doc_id, sha256(text) AS key FROM documents")
def content_keys(spark, sf_dir):
    return items(spark, sf_dir).select("doc_id", "key")


@query("storage_paths", "SELECT doc_id, 'latents/' || key[1:2] || '/' || key[3:4] || '/' || key || '.npz' AS path FROM (SELECT doc_id, sha256(text) AS key FROM documents)")
def storage_paths(spark, sf_dir):
    return items(spark, sf_dir).select("doc_id", storage_path(F.lit("latents"), F.col("key"), "npz").alias("path"))


@query("dedupe_by_key", "SELECT sha256(text) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_by_key(spark, sf_dir):
    return manifest.dedupe(items(spark, sf_dir), "key", "doc_id")


# --- outputs and manifests ------------------------------------------------------------------------------------------


@query("skip_existing", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, sf_dir):
    return manifest.missing(docs(spark, sf_dir).select("doc_id", "source"), docs(spark, sf_dir, "labels"), "doc_id")


#: A tag text per document; every seventh is blank.
TAG_TEXT = f"CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(9) || chr(10) ELSE array_to_string({TAG_LIST}, ', ') END"


def tag_texts(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(" \t\n")).otherwise(F.array_join(tag_list(), ", ")).alias("text"))


@query("valid_outputs", f"SELECT doc_id, text FROM (SELECT doc_id, {TAG_TEXT} AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''")
def valid_outputs(spark, sf_dir):
    return manifest.valid_tags(tag_texts(spark, sf_dir).join(docs(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"))


PARSED = "list_filter(list_transform(string_split({0}, ','), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"


@query(
    "manifest_build",
    f"""WITH {ITEMS}, x AS (SELECT doc_id, {TAG_TEXT} AS text FROM documents WHERE doc_id % 3 <> 1)
SELECT it.doc_id::VARCHAR AS key, array_to_string({PARSED.format("coalesce(x.text, '')")}, '|') AS tags, [w, h] AS train_resolution, [width, height] AS original_size,
  CASE WHEN it.doc_id % 2 = 0 THEN {CAPTION.replace("doc_id", "it.doc_id")} END AS caption
FROM it LEFT JOIN x ON it.doc_id = x.doc_id""",
)
def manifest_build(spark, sf_dir):
    latents = items(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"), F.array("bucket.w", "bucket.h").alias("train_resolution"), F.array("width", "height").alias("original_size"), F.lit(None).cast("array<bigint>").alias("crop_ltrb"))
    tags = tag_texts(spark, sf_dir).where("doc_id % 3 <> 1").select(F.col("doc_id").cast("string").alias("key"), "text")
    captions = docs(spark, sf_dir).where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("key"), caption().alias("text"))
    return manifest.build(latents, tags, captions).select("key", F.array_join("tags", "|").alias("tags"), "train_resolution", "original_size", "caption")


@query(
    "manifest_priority_lookup",
    """WITH c AS (SELECT doc_id AS key, p AS prio, 'place' || p || '/' || doc_id AS text FROM documents, range(4) AS r(p) WHERE (doc_id * 7 + p * 13) % 5 < 2)
SELECT key, arg_min(text, prio) AS text, min(prio) AS prio FROM c GROUP BY key""",
)
def manifest_priority_lookup(spark, sf_dir):
    places = docs(spark, sf_dir).select(F.col("doc_id").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("prio")).where((F.col("key") * 7 + F.col("prio") * 13) % 5 < 2)
    return manifest.first_existing(places.withColumn("text", F.concat(F.lit("place"), F.col("prio").cast("string"), F.lit("/"), F.col("key").cast("string"))))


@query(
    "legacy_convert",
    f"""WITH {ITEMS} SELECT it.doc_id AS key, array_to_string(string_split({TAG_TEXT.replace("doc_id", "it.doc_id")}, ', '), '|') AS tags,
  coalesce(CASE WHEN it.doc_id % 2 = 0 THEN {CAPTION.replace("doc_id", "it.doc_id")} END, '') AS caption, [w, h] AS train_resolution
FROM it JOIN labels USING (doc_id)""",
)
def legacy_convert(spark, sf_dir):
    metadata = tag_texts(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("text").alias("tags"), F.when(F.col("doc_id") % 2 == 0, caption()).alias("caption"))
    latents = items(spark, sf_dir).join(docs(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("key"), F.array("bucket.w", "bucket.h").alias("train_resolution"))
    return manifest.from_metadata(metadata, latents).withColumn("tags", F.array_join("tags", "|"))


def _scratch(spark: SparkSession) -> str:
    """A folder for round trips: in the shared one that the session names, or a temporary one on a single machine."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"

    return f"{root}/roundtrip-{uuid.uuid4().hex}"


@query("manifest_roundtrip", f"WITH {ITEMS} SELECT doc_id, key, [w, h] AS train_resolution, array_to_string({TAG_LIST}, '|') AS tags FROM it")
def manifest_roundtrip(spark, sf_dir):
    path = _scratch(spark)
    items(spark, sf_dir).select("doc_id", "key", F.array("bucket.w", "bucket.h").alias("train_resolution"), tag_list().alias("tags")).write.parquet(path)
    return spark.read.parquet(path).withColumn("tags", F.array_join("tags", "|"))


@query("json_roundtrip", f"SELECT doc_id, {TAG_TEXT} AS tags, {CAPTION} AS caption FROM documents")
def json_roundtrip(spark, sf_dir):
    path = _scratch(spark)
    tag_texts(spark, sf_dir).select(F.to_json(F.struct("doc_id", F.col("text").alias("tags"), caption().alias("caption"))).alias("value")).write.text(path)
    return spark.read.text(path).select(F.from_json("value", "doc_id long, tags string, caption string").alias("m")).select("m.*")


@query("status_counts", "SELECT CASE WHEN l.doc_id IS NULL THEN 'processed' WHEN quality = 0 THEN 'error' ELSE 'skipped' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def status_counts(spark, sf_dir):
    seen = docs(spark, sf_dir).select("doc_id").join(docs(spark, sf_dir, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    status = F.when(F.col("seen").isNull(), "processed").when(F.col("quality") == 0, "error").otherwise("skipped")
    return seen.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("output_counts", "SELECT 'latents' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'tags', count(*) FROM labels")
def output_counts(spark, sf_dir):
    kinds = docs(spark, sf_dir).select(F.lit("latents").alias("kind")).unionByName(docs(spark, sf_dir, "labels").select(F.lit("tags").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- batches --------------------------------------------------------------------------------------------------------


def _plan_sql(epoch: int) -> str:
    return f"""WITH {ITEMS}, r AS (SELECT doc_id AS key, w, h, row_number() OVER (PARTITION BY w, h ORDER BY md5(concat_ws(':', '{SEED}', '{epoch}', doc_id)), doc_id) AS rn FROM it),
p AS (SELECT key, w, h, floor((rn - 1) / 8)::BIGINT AS batch, ((rn - 1) % 8)::BIGINT AS slot FROM r),
o AS (SELECT w, h, batch, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', '{epoch}', w || 'x' || h, batch)), w, h, batch) - 1 AS batch_ord FROM p WHERE slot = 0),
plan AS (SELECT p.key, p.w, p.h, p.batch, o.batch_ord, p.slot FROM p JOIN o USING (w, h, batch))"""


@query("batch_plan", _plan_sql(0) + " SELECT * FROM plan")
def batch_plan(spark, sf_dir):
    return sampler.plan_batches(flat_items(spark, sf_dir))


@query("batch_plan_epoch2", _plan_sql(2) + " SELECT * FROM plan")
def batch_plan_epoch2(spark, sf_dir):
    return sampler.plan_batches(flat_items(spark, sf_dir), epoch=2)


@query("batch_plan_in_order", f"""WITH {ITEMS}, f AS (SELECT w, h, min(doc_id) AS first, count(*) AS n FROM it GROUP BY w, h),
s AS (SELECT w, h, coalesce(sum(ceil(n / 8.0)) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
r AS (SELECT doc_id AS key, w, h, row_number() OVER (PARTITION BY w, h ORDER BY doc_id) - 1 AS rn FROM it)
SELECT key, w, h, (floor(rn / 8) + before)::BIGINT AS batch_ord, (rn % 8)::BIGINT AS slot FROM r JOIN s USING (w, h)""")
def batch_plan_in_order(spark, sf_dir):
    return sampler.plan_in_order(flat_items(spark, sf_dir), position="doc_id")


@query("batch_rows", _plan_sql(0) + " SELECT batch_ord, w, h, list(key ORDER BY slot) AS keys FROM plan GROUP BY batch_ord, w, h")
def batch_rows(spark, sf_dir):
    return sampler.batch_rows(sampler.plan_batches(flat_items(spark, sf_dir)))


@query("batch_count", f"WITH {ITEMS} SELECT sum(ceil(n / 8.0))::BIGINT AS n_batches, sum(n)::BIGINT AS n_items FROM (SELECT count(*) AS n FROM it GROUP BY w, h)")
def batch_count(spark, sf_dir):
    return buckets.inventory(items(spark, sf_dir)).agg(F.sum("n_batches").alias("n_batches"), F.sum("n").alias("n_items"))


@query("resume_skip", _plan_sql(1) + " SELECT key, batch_ord FROM plan WHERE batch_ord >= 37 * 2")
def resume_skip(spark, sf_dir):
    return sampler.resume(sampler.plan_batches(flat_items(spark, sf_dir), epoch=1), global_step=100 + 37, steps_per_epoch=100, accumulation=2).select("key", "batch_ord")


@query("split_work", _plan_sql(0) + " SELECT batch_ord % 4 AS worker, count(*) AS n FROM plan GROUP BY 1")
def split_work(spark, sf_dir):
    return sampler.split_work(sampler.plan_batches(flat_items(spark, sf_dir)), 4).groupBy("worker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "index_to_bucket",
    f"""WITH {ITEMS}, c AS (SELECT w, h, count(*) AS n FROM it GROUP BY w, h), s AS (SELECT w, h, sum(n) OVER (ORDER BY w, h) - n AS a, sum(n) OVER (ORDER BY w, h) AS z FROM c)
SELECT doc_id AS idx, w, h, (doc_id - a)::BIGINT AS place FROM documents JOIN s ON doc_id >= a AND doc_id < z""",
)
def index_to_bucket(spark, sf_dir):
    return buckets.locate(docs(spark, sf_dir).select(F.col("doc_id").alias("idx")), buckets.inventory(items(spark, sf_dir)))


# --- tags, captions and prompts -------------------------------------------------------------------------------------


@query("tags_parse", f"SELECT doc_id, array_to_string({PARSED.format('x')}, '|') AS parsed, array_to_string(string_split(x, ','), '|') AS raw FROM (SELECT doc_id, {TAG_TEXT} AS x FROM documents)")
def tags_parse(spark, sf_dir):
    return tag_texts(spark, sf_dir).select("doc_id", F.array_join(text.parse_tags(F.col("text")), "|").alias("parsed"), F.array_join(text.raw_tags(F.col("text")), "|").alias("raw"))


@query("tags_dedupe_ordered", f"SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS tags FROM (SELECT doc_id, {TAG_LIST} || ['solo', 'smile'] AS l FROM documents)")
def tags_dedupe_ordered(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.ordered_distinct(tag_list(), F.array(F.lit("solo"), F.lit("smile"), F.lit(""))), "|").alias("tags"))


def _clean_sql() -> str:
    steps, last = "", "a"
    for k, pattern in enumerate(text.SEVERAL):
        steps += f", c{k} AS (SELECT doc_id, s, CASE WHEN s AND len(list_filter(t, lambda x: regexp_full_match(x, '{pattern}'))) > 1 THEN list_filter(t, lambda x: NOT regexp_full_match(x, '{pattern}')) ELSE t END AS t FROM {last})"
        last = f"c{k}"
    hair = f"regexp_full_match(x, '{text.HAIR}') AND NOT regexp_full_match(x, '{text.HAIR_LENGTH}')"
    covered = rf"ends_with(y, ' ' || x) AND length(y) > length(x) + 1 AND regexp_full_match(y[1:length(y) - length(x)], '({text.WORD}+ )+')"
    return rf"""WITH p AS (SELECT doc_id, replace(replace(replace(array_to_string({TAG_LIST}, ', '), '^_^', '^@@@^'), '_', ' '), '^@@@^', '^_^') AS x FROM documents),
a AS (SELECT doc_id, contains(x, 'girls') OR contains(x, 'boys') AS s, string_split(x, ', ') AS t FROM p){steps},
h AS (SELECT doc_id, CASE WHEN s AND len(list_filter(t, lambda x: {hair})) > 1 THEN list_filter(t, lambda x: NOT ({hair})) ELSE t END AS t FROM {last})
SELECT doc_id, array_to_string(list_filter(t, lambda x: NOT (regexp_full_match(x, '{text.RUN}|hair ornament') AND len(list_filter(t, lambda y: {covered})) > 0)), ', ') AS tags FROM h"""


@query("tags_clean", _clean_sql())
def tags_clean(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.clean_tags(F.array_join(tag_list(), ", ")).alias("tags"))


def _caption_sql() -> str:
    x = f"{CAPTION} || ' ' || text"
    again = {"anime anime": ("anime( anime)+", "anime"), "anime girl": ("(anime )+girl", "girl"), "cartoon girl": ("(cartoon )+girl", "girl"), "girl girl": ("girl( girl)+", "girl")}
    for what, by in text.CAPTION_RULES:
        if what in again:
            x = f"regexp_replace({x}, '{again[what][0]}', '{again[what][1]}', 'g')"
        else:
            for _ in range(3 if what == "young " else 1):
                x = f"replace({x}, '{what}', '{by}')"
    return f"SELECT doc_id, {x} AS caption FROM documents"


@query("caption_clean", _caption_sql())
def caption_clean(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.clean_caption(F.concat(caption(), F.lit(" "), F.col("text"))).alias("caption"))


@query("prompt_build", f"SELECT doc_id, concat_ws(', ', nullif({CAPTION}, ''), nullif(array_to_string({TAG_LIST}, ', '), '')) AS prompt FROM documents")
def prompt_build(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.prompt(caption(), tag_list()).alias("prompt"))


@query(
    "prompt_dropout",
    f"""WITH a AS (SELECT doc_id, CASE WHEN {_u("'5'", "'caption'", "doc_id")} < 0.1::DOUBLE THEN '' ELSE {CAPTION} END AS c, {TAG_LIST} AS t FROM documents),
b AS (SELECT doc_id, c, CASE WHEN {_u("'5'", "'tags'", "doc_id")} < 0.2::DOUBLE THEN [] ELSE list_filter(t, lambda x, i: {_u("'5'", "'tag'", "doc_id", "i - 1")} >= 0.3::DOUBLE) END AS t FROM a),
s AS (SELECT doc_id, c, list_transform(list_sort(list_transform(t, lambda x, i: {{'d': md5(concat_ws(':', '5', 'shuffle', doc_id, i - 1)), 'i': i, 't': x}})), lambda z: z.t) AS t FROM b)
SELECT doc_id, CASE WHEN {_u("'5'", "'condition'", "doc_id")} < 0.05::DOUBLE THEN '' ELSE concat_ws(', ', nullif(c, ''), nullif(array_to_string(t, ', '), '')) END AS prompt FROM s""",
)
def prompt_dropout(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", prompts.augmented(caption(), tag_list(), F.col("doc_id"), caption_p=0.1, all_tags_p=0.2, tag_p=0.3, condition_p=0.05, shuffle=True, seed=5).alias("prompt"))


@query("nested_json_flatten", "SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def nested_json_flatten(spark, sf_dir):
    parsed = docs(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("p"))
    return parsed.select("event_id", "event_type", "p.k").where("k IS NOT NULL")


@query(
    "http_flatten_filter",
    """SELECT page_id, 'post/' || page_id AS file_path, coalesce(CASE WHEN page_id % 3 > 0 THEN 'Caption ' || page_id END, '') AS caption, 't' || (page_id % 5) || '|u' AS tags
FROM pages WHERE page_id % 4 <> 0 AND page_id > 10""",
)
def http_flatten_filter(spark, sf_dir):
    """Posts as a paged service answers them: JSON with nested tags, a status, and a cursor from which to go on."""
    post = F.to_json(F.struct(F.col("page_id").alias("id"), F.concat(F.lit("post/"), F.col("page_id").cast("string")).alias("filePath"), F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("Caption "), F.col("page_id").cast("string"))).alias("caption"), F.array(*[F.struct(F.struct(n.alias("name")).alias("tagInfo")) for n in (F.concat(F.lit("t"), (F.col("page_id") % 5).cast("string")), F.lit("u"))]).alias("tags")))
    answers = docs(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 4 == 0, 404).otherwise(200).alias("status"), post.alias("body"))
    return posts.posts(answers).where("id > 10").select(F.col("id").alias("page_id"), "file_path", "caption", F.array_join("tags", "|").alias("tags"))


@query("score_threshold", "SELECT event_id, value FROM events WHERE value / 100 >= CASE WHEN user_id % 2 = 0 THEN 0.35::DOUBLE ELSE 0.9::DOUBLE END")
def score_threshold(spark, sf_dir):
    least = F.when(F.col("user_id") % 2 == 0, F.lit(0.35)).otherwise(F.lit(0.9))
    return docs(spark, sf_dir, "events").where(F.col("value") / 100 >= least).select("event_id", "value")


@query("tags_by_score", "WITH t AS (SELECT user_id, event_type, max(value / 100) AS s FROM events GROUP BY 1, 2) SELECT user_id, array_to_string(list(event_type ORDER BY event_type) FILTER (s >= CASE WHEN event_type < 'm' THEN 0.35::DOUBLE ELSE 0.9::DOUBLE END), '|') AS tags FROM t GROUP BY user_id HAVING count(*) FILTER (s >= CASE WHEN event_type < 'm' THEN 0.35::DOUBLE ELSE 0.9::DOUBLE END) > 0")
def tags_by_score(spark, sf_dir):
    scored = docs(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.col("value") / 100).alias("s"))
    tags = scored.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_type", "s"))).alias("t"))
    kept = F.filter("t", lambda x: x["s"] >= F.when(x["event_type"] < "m", F.lit(0.35)).otherwise(F.lit(0.9)))
    return tags.select("user_id", F.array_join(F.transform(kept, lambda x: x["event_type"]), "|").alias("tags")).where("tags <> ''")
