"""SimHash near-duplicates, verified and completed by the similarity of word shingles, for the pipeline's near-dedup stage.

A text is the set of its 64-bit shingle hashes; sets with a Jaccard similarity
of at least ``LIKE`` (a fraction) are linked, and a class is what links connect.

Search. Equal sets are one set first. Each set has a SimHash fingerprint of 64 bits, and those that differ
in at most ``RADIUS`` bits are found by the index of ``simhash``. What it
finds is verified over whole sets, and its links stand.

Links that the fingerprints miss. Sets at a similarity of 0.8 differ in some 10 of 64 bits, a distance at which
no index of fingerprints is selective. So sets that aren't connected yet are searched by sketches. A set's sketch is its ``SKETCH`` smallest
hashes. Of the smallest hashes of two sets' union, each is in both sets with the
probability of their similarity, so similar sets have ``OVERLAP`` or more hashes
of their sketches in common: at a similarity of exactly 0.8 all but 8 pairs in
ten millions, above it still fewer are missed, and sets up to the size of a sketch are compared whole. Two
sketches with that much in common share one of their first
SKETCH - OVERLAP + 1 hashes, in whatever order all sketches are sorted by, and
sets are joined by these only. The order is that of the hashes, but those
which a sample of the rows shows to be common come last; the sample decides what
a search costs, not what it finds. So a passage joins no documents of which it
makes less than half. What is joined is verified over whole sets.

Hot groups. More than ``HOT`` sets under one hash are compared with the group's
first set. Those linked to it need no links among each other, nor do any that
the links found so far connect. Where others are left, the group's sets are joined
again, by the first hashes of whole sets instead of sketches: similar sets share one of
the first 1 - LIKE of all their hashes, rare ones (among the sets of hot groups) first.
Groups that are hot then, too, are compared with their first set, and two others
only if their distances from it differ by at most 1 - LIKE, which the
triangle inequality of the Jaccard distance allows.

At scale: some 25 numbers a document are shuffled, and texts once, to keep one row of each
class. Sets that have to be verified are made in a pass over the texts that a
Bloom filter of their rows spares the other texts; it costs nothing but time if it is full.

Defined results
* null text, or no words: the empty set, all of one class. Fewer words than a shingle: one shingle.
* repeated rows, ids and null ids: each row counts by all its columns; one row of each class stays, null ids last.
* empty table: empty result. Extra columns: kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .bloom import bloom, holds
from . import simhash
from .common import for_python, null_last, row_keys, row_of, tidy, written
from .components import components
from .wordhash import Words, mixed, place_factors

SHINGLE, LIKE = 5, (4, 5)
RADIUS = 3
SKETCH, OVERLAP = 48, 24
HOT = 8
#: One row in SAMPLE is read for common hashes: those in OFTEN sampled rows or more, the MOST common at most.
SAMPLE, OFTEN, MOST = 8, 8, 200_000
MAX_BITS = 28
KEY = ("k1", "k2")


def shingles(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles, as signed numbers."""
    words = Words(texts, lines=False)
    factors, out = place_factors(shingle, 7), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        codes = words.hash[a:b]
        size = min(shingle, len(codes))
        if not size:
            out.append(np.zeros(0, np.int64))
            continue
        sums = codes[: len(codes) - size + 1] * factors[0]
        for k in range(1, size):
            sums = sums + codes[k : len(codes) - size + 1 + k] * factors[k]
        out.append(np.unique(mixed(sums + np.uint64(size)).view(np.int64)))
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set as a signed number: a bit is set if over half of the hashes set it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def print_pairs(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a < b) of ``sets`` (sid, fp) that connect all whose fingerprints links of at most ``radius`` bits connect: each set with the first of its fingerprint, and those along links."""
    prints = written(sets.groupBy("fp").agg(F.min("sid").alias("lead")), "similar-prints")
    equal = sets.join(prints, "fp").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    lead = lambda end: prints.select(F.col("fp").alias(end), F.col("lead").alias(f"lead_{end}"))
    found = simhash.links(prints.select("fp"), radius).join(lead("a"), "a").join(lead("b"), "b")
    near = found.select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    return written(equal.unionByName(near).where("a <> b").distinct(), "similar-prints-near")


def prefix(hashes: np.ndarray, common: np.ndarray, like: tuple[int, int] = LIKE) -> np.ndarray:
    """The first hashes of a set's sketch, one of which every similar set has among its own first ones."""
    n = len(hashes)
    overlap = min(OVERLAP, -(-like[0] * n // like[1]))
    hashes = hashes[:SKETCH]
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = common[at] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: len(hashes) - overlap + 1] if n else hashes


def common_hashes(keyed: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes that a sample of rows often has in its sketches, sorted. At most MOST numbers come to the driver."""

    def run(batches):
        for batch in batches:
            found = [h[:SKETCH] for h in shingles(batch.column(0), shingle)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64())], ["h"])

    some = keyed.where(F.col("k2") % SAMPLE == 0).select("text")
    often = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= OFTEN)
    return np.sort(np.array([r.h for r in often.orderBy(F.desc("c"), "h").limit(MOST).collect()], np.int64))


def whole_prefix(hashes: np.ndarray, common: np.ndarray, often: np.ndarray, like: tuple[int, int] = LIKE) -> np.ndarray:
    """The first hashes of a whole set, rare ones first; sets that are similar share one of them, without exception."""
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.argsort(np.where(common[at] == hashes, often[at], 0), kind="stable")]
    return hashes[: len(hashes) - -(-like[0] * len(hashes) // like[1]) + 1] if len(hashes) else hashes


def whole_sets(keyed: DataFrame, sets: DataFrame, sids: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The whole sets (sid, hashes) of ``sids``, from the texts."""
    wanted = written(sets.join(sids.distinct(), "sid").select("sid", *KEY), "similar-wanted")
    asked = keyed.sparkSession.sparkContext.broadcast(bloom(wanted, "k1", MAX_BITS))

    def run(batches):
        for batch in batches:
            hit = pa.array(holds(asked.value, batch.column(0).to_numpy()))
            some = batch.filter(hit)
            found = shingles(some.column(2), shingle)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(found, pa.list_(pa.int64()))], [*KEY, "hashes"])

    made = keyed.select(*KEY, "text").mapInArrow(run, "k1 long, k2 long, hashes array<long>")
    return written(made.join(wanted, list(KEY)).dropDuplicates(["sid"]).select("sid", "hashes"), "similar-sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid")))


def similarities(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the numbers of hashes that both sets have (``both``) and that any has (``either``)."""
    one = lambda name: held.select(F.col("sid").alias(name), F.col("hashes").alias(f"h{name}"))
    met = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "ha", "hb")

    def overlap(batches):
        for batch in batches:
            counts = []
            for a, b in zip(batch.column("ha"), batch.column("hb"), strict=True):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                counts.append((both, len(a) + len(b) - both))
            more = [pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *more], ["a", "b", "both", "either"])

    return written(met.mapInArrow(overlap, "a long, b long, both long, either long"), "similar-known")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b, ...) whose ends ``roots`` (node, root) doesn't connect."""
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    met = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return met.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def met_at(places: DataFrame, like: tuple[int, int], hot: int) -> DataFrame:
    """Pairs (a, b, star) that share a hash of ``places`` (sid, n, h): all of a small group, each with the first (star = 1) of a hot one."""
    p, q = like
    shared = written(places.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("sid").alias("lead")).where("c > 1"), "similar-hashes")
    places = written(places.join(shared, "h"), "similar-shared")
    few = places.where(F.col("c") <= hot).select("h", "sid", "n")
    x, y = (few.select("h", F.col("sid").alias(s), F.col("n").alias(f"n{s}")) for s in ("a", "b"))
    could = F.least("na", "nb") * q >= F.greatest("na", "nb") * p
    pairs = x.join(y, "h").where((F.col("a") < F.col("b")) & could).select("a", "b")
    many = places.where(F.col("c") > hot).select("sid", "lead").distinct()
    stars = many.where("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    every = pairs.withColumn("star", F.lit(0)).unionByName(stars.withColumn("star", F.lit(1))).groupBy("a", "b").agg(F.max("star").alias("star"))
    return written(every, "similar-pairs")


def whole_places(held: DataFrame, like: tuple[int, int] = LIKE) -> DataFrame:
    """Places (sid, n, h) at which similar ones of the whole sets ``held`` meet. The MOST common hashes and their counts come to the driver."""
    counts = held.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    top = sorted((r.h, r.c) for r in counts.orderBy(F.desc("c"), "h").limit(MOST).collect())
    common = held.sparkSession.sparkContext.broadcast(np.array(top, np.int64).reshape(-1, 2))

    def run(batches):
        hashes, often = (np.ascontiguousarray(x) for x in common.value.T)
        for batch in batches:
            found = [h.values.to_numpy() for h in batch.column(1)]
            firsts = [whole_prefix(h, hashes, often, like) for h in found]
            sizes = [len(f) for f in firsts]
            sids, n = np.repeat(batch.column(0).to_numpy(), sizes), np.repeat([len(h) for h in found], sizes)
            every = np.concatenate([np.zeros(0, np.int64), *firsts])
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(n, pa.int32()), pa.array(every, pa.int64())], ["sid", "n", "h"])

    return held.mapInArrow(run, "sid long, n int, h long")


def links(keyed: DataFrame, rows: DataFrame, shingle: int = SHINGLE, like: tuple[int, int] = LIKE, hot: int = HOT, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of sets whose components are those of all pairs that are similar enough."""
    p, q = like
    linked = F.col("both") * q >= F.col("either") * p
    sets = rows.groupBy("sid").agg(F.min(F.struct(*KEY, "n", "fp", "prefix")).alias("s")).select("sid", "s.*")
    sets = written(sets, "similar-distinct")

    # First what the fingerprints find.
    near = print_pairs(sets.select("sid", "fp"), radius)
    known = similarities(whole_sets(keyed, sets, _ends(near), shingle), near)
    every = met_at(sets.select("sid", "n", F.explode("prefix").alias("h")), like, hot)

    # Then each other set with one that its sketch meets, and then only pairs that the links found so far don't connect.
    open_pairs = _apart(every, components(known.where(linked).select("a", "b")))
    nearest = open_pairs.groupBy("b").agg(F.min("a").alias("a"))
    first = written(nearest.select("a", "b").join(known, ["a", "b"], "left_anti"), "similar-first-pairs")
    known = known.unionByName(similarities(whole_sets(keyed, sets, _ends(first), shingle), first))
    apart = _apart(every.join(known, ["a", "b"], "left_anti"), components(known.where(linked).select("a", "b")))
    apart = written(apart.select("a", "b"), "similar-apart")
    known = known.unionByName(similarities(whole_sets(keyed, sets, _ends(apart), shingle), apart))
    roots = written(components(known.where(linked).select("a", "b")), "similar-roots")

    # Groups whose first set isn't connected with all others: there the others may be like each other.
    def unsettled(every: DataFrame, roots: DataFrame) -> DataFrame:
        stars = every.where("star = 1").select("a", "b")
        return written(stars.join(_apart(stars, roots).select("a").distinct(), "a", "left_semi"), "similar-open")

    stars = unsettled(every, roots)
    if stars.isEmpty():
        return known.where(linked).select("a", "b")
    # Their members meet at hashes of their whole sets.
    held = whole_sets(keyed, sets, _ends(stars), shingle)
    every = met_at(whole_places(held, like), like, hot)
    apart = written(_apart(every.select("a", "b"), roots).join(known, ["a", "b"], "left_anti"), "similar-apart")
    known = known.unionByName(similarities(held, apart))
    roots = written(components(known.where(linked).select("a", "b")), "similar-roots")
    stars = unsettled(every, roots)
    if stars.isEmpty():
        return known.where(linked).select("a", "b")
    known = known.unionByName(similarities(held, stars.join(known, ["a", "b"], "left_anti")))
    # Distances in steps of the largest distance of linked sets: those of linked pairs are in the same or in neighbouring steps.
    far = known.join(stars, ["a", "b"], "left_semi").withColumn("near", linked)
    far = far.select(F.col("a").alias("lead"), F.col("b").alias("sid"), "near", ((1 - F.col("both") / F.col("either")) * q / (q - p) + 1e-9).alias("d"))
    rooted = roots.select(F.col("node").alias("sid"), "root")
    far = far.join(sets.select("sid", "n"), "sid").join(rooted, "sid", "left").withColumn("root", F.coalesce("root", "sid")).withColumn("step", F.floor("d").cast("int"))
    far = written(far, "similar-far")
    x = far.where("NOT near").select("lead", F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("d").alias("dx"), F.col("root").alias("rx"), F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    y = far.select("lead", "step", F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("d").alias("dy"), F.col("root").alias("ry"), "near")
    close = (F.col("rx") != F.col("ry")) & (F.abs(F.col("dx") - F.col("dy")) <= 1 + 1e-6) & (F.least("nx", "ny") * q >= F.greatest("nx", "ny") * p)
    rest = x.join(y, ["lead", "step"]).where(close & (F.col("near") | (F.col("x") < F.col("y")))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rest = written(rest.join(known, ["a", "b"], "left_anti"), "similar-rest")
    return known.unionByName(similarities(held, rest)).where(linked).select("a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, like: tuple[int, int] = LIKE, hot: int = HOT, radius: int = RADIUS) -> DataFrame:
    """``docs`` without all but one row of each class: the first by id, then by content."""
    spark = docs.sparkSession
    for_python(spark)
    tidy(spark)
    k1, k2 = row_keys(docs)
    keyed = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(common_hashes(keyed, shingle))

    def run(batches):
        for batch in batches:
            found = shingles(batch.column(3), shingle)
            ids = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in found], np.uint64)
            arrays = [pa.array(ids.view(np.int64), pa.int64()), pa.array([len(h) for h in found], pa.int32()), pa.array(list(map(fingerprint, found)), pa.int64()), pa.array([prefix(h, shared.value, like) for h in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], [*batch.schema.names[:3], "sid", "n", "fp", "prefix"])

    lean = keyed.select("id", *KEY, "text")
    schema = StructType([*lean.schema.fields[:3], *_parse_datatype_string("sid long, n int, fp long, prefix array<long>").fields])
    rows = written(lean.mapInArrow(run, schema), "similar-rows")
    roots = components(links(keyed, rows, shingle, like, hot, radius)).withColumnRenamed("node", "sid")
    classes = rows.select("id", *KEY, "sid").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    first = classes.groupBy("root").agg(F.min(F.struct(*null_last("id"), *KEY)).alias("f")).select(*[F.col(f"f.{k}").alias(k) for k in KEY])
    kept = keyed.join(written(first, "similar-first"), list(KEY), "left_semi")
    repeated = written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*KEY), "similar-repeated")
    if not repeated.isEmpty():
        # Of rows that are equal in all columns one stays.
        one = W.partitionBy(*KEY).orderBy("k1")
        again = kept.join(repeated, list(KEY), "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
        kept = kept.join(repeated, list(KEY), "left_anti").unionByName(again)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
