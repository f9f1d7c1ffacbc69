"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words: a share of all words by weight, stopped at
``max_repeats`` times the source's size, the excess reshared by weight. Within a
source, documents are expected as often as their length class weighs
(``2 ** (TILT * b)`` for texts of 2**b words or more), scaled to the source's target and
stopped at ``max_repeats``. The whole part of that number is allocated as
certain copies, its fraction is a document's inclusion probability p.
The rest of the target is then a sample of fixed size in Pareto order: documents
are ranked by their random odds divided by their inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and taken from the smallest on.

The sample is fixed in words, not in rows: going through the order, a document
is taken if it still fits. So what is left of a target is less than any document
that isn't taken.

At scale: texts are read once and their sizes written to the shared folder.
The order is cut into 2**24 bins. Sums of words by (source, bin) give the bin in
which a source's words run out, 64 sums a step (``narrowed``), so that no task gets
the bins of a hot source. All before that bin is taken. Behind it, of the documents
of one size only the first few can still fit, as many as the words left hold:
R words are left for at most R / n documents of n words. That bin and these
documents (R log R at most, where R is no more than one bin's words) are gone
through one by one.

Defined results
* null or empty text: size 0, never taken. Null source: a source of its own, ranked last.
* equal or null doc_ids: u depends on the text too, and on the number of a copy among rows equal in all, so each row is sampled by itself.
* a source without words: target 0. Empty table: empty result.
* extra columns: not carried; names with ``__`` are internal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import for_python, hash_uniform, table, words_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix-1"
TILT = 0.25
#: Bins of the order: LEVELS times DIGIT bits.
DIGIT, LEVELS = 6, 4


def class_weights(tilt: float) -> list[int]:
    """The weight of each length class, in whole numbers."""
    return [round(16 * 2 ** (tilt * b)) for b in range(63)]


def source_targets(per: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """One row per source (source, source_size) with its target.

    Runs over one row per source. Water filling in closed form: with sources by
    ``cap / weight``, a source is stopped at its cap where the level that the
    sources from it on would share reaches that cap.
    """
    ranked = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    by_cap = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    weighted = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(ranked) - 1) % len(weights)).cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    level = (
        weighted.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("__left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("__weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("__level", F.col("__left") / F.col("__weights"))
        .withColumn("stopped", F.col("cap") <= F.col("weight") * F.col("__level"))
    )
    shared = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), "source", "__level"))).over(everything)["__level"]
    target = F.round(F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.col("weight") * shared), 6)
    return level.withColumn("target", target).select("source", "source_size", "target")


def class_copies(classes: DataFrame, targets: DataFrame, max_repeats: int, tilt: float) -> DataFrame:
    """``classes`` (source, b, words) with target, source_size, certain copies, p and room (words to sample) - at most 63 rows a source."""
    met = _with_source(classes, targets).withColumn("g", F.get(F.array(*map(F.lit, class_weights(tilt))), F.col("b")).cast("long"))
    heavier = W.partitionBy("source").orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    lighter = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    source = W.partitionBy("source")
    met = met.withColumn("__level", (F.col("target") - max_repeats * F.coalesce(F.sum("words").over(heavier), F.lit(0))) / F.sum(F.col("words") * F.col("g")).over(lighter))
    met = met.withColumn("stopped", F.col("g") * F.col("__level") >= max_repeats)
    shared = F.max(F.when(~F.col("stopped"), F.struct("b", "__level"))).over(source)["__level"]
    expected = F.when(F.col("stopped"), F.lit(float(max_repeats))).otherwise(F.col("g") * shared)
    met = met.withColumn("__expected", expected).withColumn("copies", F.floor(F.col("__expected") + 1e-9).cast("long"))
    room = F.floor(F.col("target") - F.sum(F.col("copies") * F.col("words")).over(source) + 1e-6)
    return met.withColumn("p", F.greatest(F.col("__expected") - F.col("copies"), F.lit(0.0))).withColumn("room", F.greatest(room, F.lit(0)).cast("long")).select("source", "b", "copies", "p", "room")


def pareto_order(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, mapped into [0, 1) without changing the order; 1 where p is 0."""
    odds = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p <= 0, F.lit(1.0)).otherwise(odds / (1 + odds))


def narrowed(bins: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the first bin x at which the running sum of ``value`` goes over ``limit``, and the sum before it.

    ``bins`` has keys, x, value and limit; keys whose sum stays within their
    limit have no row. Goes down LEVELS times, over 2**DIGIT sums a key.
    """
    found = None
    for level in range(LEVELS - 1, -1, -1):
        some = bins if found is None else bins.join(found.select(*[F.col(k).alias(f"__{k}") for k in keys], "__x", "before"), _same(keys) & (F.shiftright("x", DIGIT * (level + 1)) == F.col("__x")))
        before = F.lit(0).cast("long") if found is None else F.col("before")
        sums = some.groupBy(*keys, F.shiftright("x", DIGIT * level).alias("__x")).agg(F.sum("value").alias("value"), F.first("limit").alias("limit"), F.first(before).alias("before"))
        upto = sums.withColumn("upto", F.col("before") + F.sum("value").over(W.partitionBy(*keys).orderBy("__x").rowsBetween(W.unboundedPreceding, 0)))
        over = upto.where(F.col("upto") > F.col("limit"))
        found = over.groupBy(*keys).agg(F.min(F.struct("__x", (F.col("upto") - F.col("value")).alias("before"))).alias("f")).select(*keys, "f.__x", "f.before")
    return found.withColumnRenamed("__x", "x")


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out


def mix_sizes(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, seed: str = SEED, tilt: float = TILT) -> DataFrame:
    """``sizes`` (doc_id, source, size and perhaps tag, a digest of the text) with source_size, target and copies of each row."""
    for_python(sizes.sparkSession)
    if "tag" not in sizes.columns:
        sizes = sizes.withColumn("tag", F.lit(""))
    # The length class of a text of 2**b words or more is b.
    length = F.when(F.col("size") > 0, F.length(F.bin("size")) - 1)
    rows = written(sizes.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "tag", "source", "size", length.alias("b")), "mix-sizes")
    rows = written(_with_copies(rows), "mix-rows")
    words = written(rows.groupBy("source", "b").agg(F.sum("size").alias("words")), "mix-words")
    targets = written(source_targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_repeats), "mix-targets")
    classes = written(class_copies(words.where("b IS NOT NULL"), targets, max_repeats, tilt), "mix-classes")

    order = pareto_order(hash_uniform(seed, F.col("doc_id"), F.col("tag"), F.nullif("copy", F.lit(0))), F.col("p"))
    x = F.least(F.floor(F.col("at") * (1 << DIGIT * LEVELS)), F.lit((1 << DIGIT * LEVELS) - 1)).cast("int")
    met = rows.join(classes.select(F.col("source").alias("__source"), F.col("b").alias("__b"), "copies", "p", "room"), _same(["source", "b"]), "left")
    placed = met.withColumn("at", order).withColumn("x", F.when((F.col("p") > 0) & (F.col("room") > 0), x))
    placed = written(placed.select(*rows.columns, F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), "room", "at", "x"), "mix-placed")

    sampled = placed.where("x IS NOT NULL")
    by_bin = sampled.groupBy("source", "x").agg(F.sum("size").alias("value"), F.first("room").alias("limit"))
    cut = narrowed(written(by_bin, "mix-bins"), ["source"])
    rooms = classes.select("source", "room").distinct()
    cut = written(_with_source(cut, rooms).select("source", F.col("x").alias("cut"), (F.col("room") - F.col("before")).alias("left")), "mix-cut")
    tail = written(_with_source(sampled, cut).where("x >= cut AND size <= left").select("source", "size", "x", "cut", "left", "rid", "doc_id", "tag", "copy", "at"), "mix-tail")
    # Behind the bin in which the words run out, ``left`` words hold so many documents of one size at most.
    behind = tail.where("x > cut").groupBy("source", "size", "x").agg(F.count(F.lit(1)).alias("value"), F.first(F.expr("left div size")).alias("limit"))
    last = written(narrowed(written(behind, "mix-behind"), ["source", "size"]).withColumnRenamed("x", "last"), "mix-last")
    tail = tail.join(last.select(F.col("source").alias("__source"), F.col("size").alias("__size"), "last"), _same(["source", "size"]), "left").where("last IS NULL OR x <= last")
    tail = written(tail.select("source", "rid", "doc_id", "tag", "copy", "size", "at", "left"), "mix-walk")

    def fill(rows):
        rows = rows.sort_values(["at", "doc_id", "tag", "size", "copy"], na_position="last")
        left, took = int(rows["left"].iloc[0]) if len(rows) else 0, []
        for size in rows["size"]:
            took.append(size <= left)
            left -= size if took[-1] else 0
        return rows.loc[took, ["rid"]]

    took = written(tail.groupBy("source").applyInPandas(fill, "rid long"), "mix-took")
    marked = _with_source(placed, cut).join(took.select("rid", F.lit(True).alias("took")), "rid", "left")
    # A source whose words don't run out has no cut: all that is sampled is taken.
    taken = F.col("x").isNotNull() & (F.col("cut").isNull() | (F.col("x") < F.col("cut")) | F.col("took").isNotNull())
    return _with_source(marked, targets).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + taken.cast("long")).alias("copies"))


def _with_copies(rows: DataFrame, parts: int = 256) -> DataFrame:
    """``rows`` with ``copy``: 0, 1, ... among rows equal in id, text, source and size, so that equal rows get draws of their own.

    Equal rows are counted in ``parts`` parts, whose sizes give each part its first number; no task gets all copies of a row.
    """
    keyed = rows.withColumn("__k", F.xxhash64("doc_id", "tag", "source", "size")).withColumn("__part", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int"))
    sizes = keyed.groupBy("__k", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__k").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("__k", "__part").orderBy("rid")) - 1
    return keyed.withColumn("__in", inside).join(sizes.withColumn("__before", before).drop("__n"), ["__k", "__part"]).withColumn("copy", F.col("__in") + F.col("__before")).drop("__k", "__part", "__in", "__before")


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source's row (null matches null); rows without one get nulls."""
    other = per_source.withColumnRenamed("source", "__source")
    return rows.join(other, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Word counts of ``docs`` mixed as by ``mix_sizes``: doc_id, source, size, source_size, target, copies."""
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"))
    return mix_sizes(counted, **options)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def oracle_sql(weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, seed: str = SEED, tilt: float = TILT, docs: str = "documents") -> str:
    """The same mix in plain SQL: water filling in closed form, and a walk through each source's order, one document a step."""
    weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    heavy = ", ".join(map(str, class_weights(tilt)))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS tag, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}),
e AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) - 1 END AS b, row_number() OVER () AS rid FROM d),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * {max_repeats} AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END AS weight FROM per),
l AS (SELECT *, (sum(source_size) OVER () * {share}::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
c AS (SELECT *, cap <= weight * level AS stopped FROM l),
t AS (SELECT source, source_size, round(CASE WHEN stopped THEN cap::DOUBLE ELSE weight * (SELECT arg_min(level, cap::DOUBLE / weight) FROM c WHERE NOT stopped) END, 6) AS target FROM c),
k AS (SELECT e.source, b, target, CAST(sum(size) AS BIGINT) AS words, ([{heavy}])[b + 1] AS g FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY ALL),
kl AS (SELECT k.*, (target - {max_repeats} * coalesce((SELECT sum(words) FROM k o WHERE o.source IS NOT DISTINCT FROM k.source AND o.b > k.b), 0))
    / (SELECT CAST(sum(words * g) AS BIGINT) FROM k o WHERE o.source IS NOT DISTINCT FROM k.source AND o.b <= k.b)::DOUBLE AS level FROM k),
kc AS (SELECT *, coalesce(g * (SELECT arg_max(o.level, o.b) FROM kl o WHERE o.source IS NOT DISTINCT FROM kl.source AND o.g * o.level < {max_repeats}), 0.0) AS free, g * level >= {max_repeats} AS stopped FROM kl),
kx AS (SELECT *, CASE WHEN stopped THEN {max_repeats}::DOUBLE ELSE free END AS expected FROM kc),
kp AS (SELECT *, CAST(floor(expected + 1e-9::DOUBLE) AS BIGINT) AS copies FROM kx),
kr AS (SELECT source, b, copies, greatest(expected - copies, 0) AS p, CAST(greatest(floor(target - CAST(sum(copies * words) OVER (PARTITION BY source) AS BIGINT) + 1e-6::DOUBLE), 0) AS BIGINT) AS room FROM kp),
u AS (SELECT e.rid, e.doc_id, e.tag, e.source, e.size, kr.p, kr.room,
    (('0x' || substring(md5(concat_ws(':', '{seed}', e.doc_id, e.tag)), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE AS u
  FROM e JOIN kr ON e.source IS NOT DISTINCT FROM kr.source AND e.b = kr.b WHERE kr.p > 0 AND kr.room > 0),
o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS LAST) AS s, row_number() OVER (PARTITION BY source
    ORDER BY ((u / (1 - u)) * ((1 - p) / p)) / (1 + (u / (1 - u)) * ((1 - p) / p)), doc_id NULLS LAST, tag, size) AS nth FROM u),
walk AS (SELECT s, 0::BIGINT AS nth, max(room) AS room, NULL::BIGINT AS rid, false AS took FROM o GROUP BY s
  UNION ALL SELECT walk.s, o.nth, walk.room - CASE WHEN o.size <= walk.room THEN o.size ELSE 0 END, o.rid, o.size <= walk.room FROM walk JOIN o ON o.s = walk.s AND o.nth = walk.nth + 1)
SELECT e.doc_id, e.size, t.source_size, t.target, CAST(e.size * (coalesce(kr.copies, 0) + coalesce(walk.took, false)::INT) AS BIGINT) AS taken,
  CAST(coalesce(kr.copies, 0) + coalesce(walk.took, false)::INT AS BIGINT) AS copies
FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source LEFT JOIN kr ON e.source IS NOT DISTINCT FROM kr.source AND e.b = kr.b LEFT JOIN walk ON walk.rid = e.rid
"""
