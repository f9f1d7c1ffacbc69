"""Hard negatives for anchors by bit-sliced integer products.

Components become whole numbers, and a row's score is its inner product with the
anchor. Of a row's components only one bit-plane at a time is multiplied, the most
significant (the sign) first. With the planes from p down still open, each
component can grow by 0 to 2**p - 1, so the score lies within

    partial + (2**p - 1) * (sum of the anchor's negative components ... of its positive ones)

and this interval halves with every plane. A row goes as soon as its interval
can't qualify: for positives, when it ends below the last of the best rows found
so far; for negatives, when it misses every wanted range of scores or
ends below the last row found so far in each of them. Dense planes are matrix
products; when few pairs of an anchor and a row are left, only those go on.

At scale: anchors are a stated share of all rows, so their products are looked
at in blocks and not joined. Rows are dealt out evenly, by a hash of the row, into
groups of bounded size. Each group's rows and all anchors behind them come as one
sorted stream that Spark spills; a task holds one group's numbers and a batch of
anchors. Each gives no more than its best rows for each anchor (and range), and
windows over those merge the groups. Neither labels nor repeated vectors decide where a
row goes, so hot ones are spread like others. Nothing goes through the driver
but counts and the largest component.

Defined results
* rows with a null label or vector, or a component that is null or not finite, take no part. Empty table, or no anchors: empty result.
* equal scores: smaller id first, null ids last, then by a number of the row. Equal rows count each; an anchor isn't its own positive, but an equal row may be.
* rows with equal ids that are anchors: each has its own results. Null ids are never anchors.
* vectors of different lengths: missing components count as 0. Components of 24 bits and more: an error, for scores have to fit 64 bits.
* extra columns: not carried, their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import for_python, table, written

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Hundredths of the positive's score within which a negative's lies.
LOW, HIGH = 30, 90
#: Rows of a group, at least and at most; rows and anchors that are multiplied at once.
LEAST, MOST, TILE, BATCH = 2048, 1 << 18, 1024, 128
#: Pairs go on one by one when fewer than one in SPARSE is left.
SPARSE = 64
LARGEST = 1 << 24
_FOUND = "anchor long, slot int, row long, id long, score long"


def whole_numbers(vectors: DataFrame, vec_id: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """Rows that take part: row, id, label and parts (whole numbers), written so that row numbers stay."""
    value = F.col(f"`{vector}`")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    parts = F.transform(value, lambda x: F.floor(x.cast("double") * scale))
    taking = vectors.where(F.col(f"`{label}`").isNotNull() & value.isNotNull() & F.coalesce(finite, F.lit(False)))
    return written(taking.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), parts.alias("parts")), "vectors")


def _matrix(parts: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten().to_numpy()
    if np.any(np.abs(flat) >= LARGEST):
        raise ValueError("a component has more than 24 bits")
    if np.all(sizes == width):
        return flat.reshape(-1, width).astype(np.int32)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def bounded(rows: np.ndarray, anchors: np.ndarray, bits: int, mask: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs in ``mask`` with low[anchor] <= score <= high[anchor], by bit-planes.

    Components have a sign and ``bits`` bits below it.
    """
    kind = np.float32 if (np.abs(anchors).sum(axis=1).max(initial=0) < 1 << 24) else np.float64
    left, up, down = anchors.astype(kind), np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    partial = np.zeros((len(anchors), len(rows)))
    for p in range(bits, -1, -1):
        plane = ((rows >> p) & 1).astype(kind)
        partial += (-(2.0**p) if p == bits else 2.0**p) * (left @ plane.T)
        rest = (1 << p) - 1
        mask = mask & (partial >= (low - up * rest)[:, None]) & (partial <= (high - down * rest)[:, None])
        if p and np.count_nonzero(mask) * SPARSE < mask.size:
            a, r = np.nonzero(mask)
            return _pairs(rows, anchors, p, a, r, partial[a, r].astype(np.int64), low, high, up, down)
    a, r = np.nonzero(mask)
    return a, r, partial[a, r].astype(np.int64)


def _pairs(rows, anchors, done, a, r, partial, low, high, up, down):
    """The planes below ``done`` for the pairs that are left, in pieces of bounded memory."""
    found = [(a[:0], r[:0], partial[:0])]
    size = max(1, (1 << 22) // max(1, rows.shape[1]))
    for at in range(0, len(a), size):
        x, y, s = a[at : at + size], r[at : at + size], partial[at : at + size]
        for p in range(done - 1, -1, -1):
            s = s + (np.einsum("ij,ij->i", (rows[y] >> p) & 1, anchors[x], dtype=np.int64) << p)
            rest = (1 << p) - 1
            keep = (s + up[x] * rest >= low[x]) & (s + down[x] * rest <= high[x])
            x, y, s = x[keep], y[keep], s[keep]
        found.append((x, y, s))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class _Best:
    """The first ``k`` rows of each slot of each anchor of a batch, by score, id and row. A slot is a range of scores."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray, k: int):
        self.lows, self.highs, self.k = lows, highs, k
        self.last = lows.copy()  # No row below this gets into a slot.
        self.kept = [np.zeros(0, np.int64)] * 6

    def low(self) -> np.ndarray:
        return self.last.min(axis=1)

    def high(self) -> np.ndarray:
        return self.highs.max(axis=1)

    def add(self, a: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        slots = self.lows.shape[1]
        keys = [self.kept]
        for j in range(slots):
            fit = (score >= self.last[a, j]) & (score <= self.highs[a, j])
            keys.append([a[fit] * slots + j, score[fit], none[fit], ids[fit], row[fit], np.zeros(0)])
        slot, score, none, ids, row = (np.concatenate([k[c] for k in keys]).astype(np.int64) for c in range(5))
        order = np.lexsort((row, ids, none, -score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order, slot, rank = order[rank < self.k], slot[rank < self.k], rank[rank < self.k]
        self.kept = [slot, score[order], none[order], ids[order], row[order], rank]
        full = rank == self.k - 1
        self.last.reshape(-1)[slot[full]] = np.maximum(self.last.reshape(-1)[slot[full]], self.kept[1][full])


def _searched(spark: SparkSession, rows: DataFrame, anchors: DataFrame, shape: tuple[int, int, int], k: int, same: bool) -> DataFrame:
    """For each anchor and slot the first ``k`` rows of each group (``_FOUND``). ``anchors`` has lows and highs, a range for each slot."""
    count, width, bits = shape
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-count // min(MOST, max(LEAST, count // partitions))))
    none = F.array().cast("array<long>")
    here = rows.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "row", "id", "label", "parts", none.alias("lows"), none.alias("highs"))
    there = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "row", "id", "label", "parts", "lows", "highs")
    stream = here.unionByName(there).repartition(partitions, "g").sortWithinPartitions("g", "kind", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, loaded, block = None, [], None
        for batch in batches:
            g, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(g)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                part = batch.slice(at, end - at)
                if g[at] != group:
                    group, loaded, block = g[at], [], None
                if kind[at] == 0:
                    loaded.append(_columns(part, width))
                    continue
                if block is None:
                    block = [np.concatenate(c) for c in zip(*loaded, strict=True)] if loaded else None
                    loaded = []
                if block is not None:
                    for first in range(0, len(part), BATCH):
                        yield _look(block, part.slice(first, BATCH), width, bits, k, same)

    return stream.mapInArrow(run, _FOUND)


def _columns(part: pa.RecordBatch, width: int) -> list[np.ndarray]:
    ids = part.column(3)
    return [part.column(2).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(5), width)]


def _look(block: list[np.ndarray], anchors: pa.RecordBatch, width: int, bits: int, k: int, same: bool) -> pa.RecordBatch:
    row, none, ids, label, parts = block
    own, _, _, own_label, own_parts = _columns(anchors, width)
    slots = max(1, len(anchors.column(6).flatten()) // len(anchors))
    best = _Best(anchors.column(6).flatten().to_numpy().reshape(-1, slots).copy(), anchors.column(7).flatten().to_numpy().reshape(-1, slots), k)
    for at in range(0, len(row), TILE):
        here = slice(at, at + TILE)
        mask = (own_label[:, None] == label[here]) == same
        if same:
            mask &= own[:, None] != row[here]
        columns = np.flatnonzero(mask.any(axis=0))
        if len(columns):
            a, r, score = bounded(parts[here][columns], own_parts, bits, mask[:, columns], best.low(), best.high())
            r = columns[r] + at
            best.add(a, score, none[r], ids[r], row[r])
    slot, score, none, ids, row, _ = best.kept
    return pa.RecordBatch.from_arrays([pa.array(own[slot // slots]), pa.array((slot % slots).astype(np.int32)), pa.array(row), pa.array(ids, mask=none.astype(bool)), pa.array(score)], ["anchor", "slot", "row", "id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the rows of ``whole_numbers`` for which ``anchor`` (over id and label) holds.

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    for_python(spark)
    seen = rows.agg(F.count(F.lit(1)), F.max(F.size("parts")), F.min(F.array_min("parts")), F.max(F.array_max("parts"))).first()
    shape = (seen[0], seen[1] or 0, max(1, int(seen[3] or 0).bit_length(), (-int(seen[2] or 0)).bit_length()))
    anchors = rows.where(F.coalesce(anchor & F.col("id").isNotNull(), F.lit(False)))
    # A first range that nothing is out of: 2**62 is more than any score.
    whole = anchors.withColumn("lows", F.array(F.lit(-(1 << 62)))).withColumn("highs", F.array(F.lit(1 << 62)))
    best = _ranked(_searched(spark, rows, whole, shape, positives, True), positives)
    per = written(best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("of")), "positives")
    # Negatives' scores lie within these hundredths of the positive's, in whole numbers; what can't be is an empty range.
    lows, highs = F.transform("of", lambda x: -_floor(-low * x["score"])), F.transform("of", lambda x: _floor(high * x["score"]))
    fill = lambda c, v: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.coalesce(F.get(c, k), F.lit(v)))
    ranged = anchors.join(per.select(F.col("anchor").alias("row"), lows.alias("l"), highs.alias("h")), "row").withColumn("lows", fill(F.col("l"), 1 << 62)).withColumn("highs", fill(F.col("h"), -(1 << 62))).drop("l", "h")
    hard = _ranked(_searched(spark, rows, ranged, shape, negatives, False), negatives)
    who = per.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", F.posexplode("of").alias("slot", "p"))
    met = hard.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(who, ["anchor", "slot"])
    return met.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("p.score").alias("positive_score"), "negative_score")


def _floor(hundredths: Column) -> Column:
    """A number of hundredths in whole ones, rounded down without leaving whole numbers."""
    return F.floor(F.call_function("div", hundredths - F.pmod(hundredths, F.lit(100)), F.lit(100)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 hard negatives of each anchor (ids divisible by 100) and positive."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(whole_numbers(vectors.select("vec_id", label.alias("label"), "embedding"), "vec_id", "label", "embedding"), F.col("id") % 100 == 0)


def oracle_sql() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
), n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
