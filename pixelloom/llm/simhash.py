"""SimHash near-duplicates with a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint: a bit is set if over half of the XXH64
hashes of its word shingles set it. Fingerprints that differ in at most
``radius`` bits are linked, and a class is what links connect.

Search. Equal fingerprints are one row first (copies cost nothing further).
The 64 bits are cut into ``radius + 1`` parts; two linked fingerprints agree on
at least one, so each fingerprint is routed to one group per part. Inside a
group the fingerprints are sorted by Gray rank and indexed bottom-up: a node
over ``FAN`` neighbours holds the bits they share, factored so that each node
keeps only what its parent doesn't; a search adds up the differences on the way
down and drops a node with all below it once they exceed the radius.

Hot groups. A group of more than ``HOT`` fingerprints is routed again by the
parts of its remaining bits, and so on; a group that has ``LAST_BITS`` or fewer
free bits can't hold more than 2**LAST_BITS fingerprints. So no task gets an
unbounded group, and no pair is lost. Each group gives at most one link per
fingerprint (a spanning forest), not its pairs.

Defined results
* null text, or no words: fingerprint zero, linked like any other. Fewer words than a shingle: one shingle.
* very long text: hashed whole, in pieces of bounded memory. Repeated rows: one class.
* null doc_id: takes part; a class's id is its smallest doc_id that isn't null.
* empty table: empty result. Extra columns: kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import beside, for_python, null_last, row_keys, row_of, table, written
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
HOT = 2048
LAST_BITS = 14
FAN = 8
_PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        grams: list[bytes] = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[k:] for k in range(shingle)), strict=False)]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(grams), _PIECE):
        hashes = np.array([digest(g, SEED) for g in grams[at : at + _PIECE]], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(grams)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the text replaced by a column ``fp`` (fp_ where the input has an fp)."""
    for_python(docs.sparkSession)
    lean = docs.select(row_of(docs, text_col).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["row", "fp"])

    from pyspark.sql.types import LongType, StructType

    found = lean.mapInArrow(run, StructType([lean.schema["row"]]).add("fp", LongType()))
    return beside(found, [c for c in docs.columns if c != text_col], ["fp"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = codes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    return rank


class GrayIndex:
    """Hierarchical index over fingerprints in Gray order.

    ``levels[0]`` is the root level, ``levels[-1]`` the fingerprints; a level
    has for each node the bits (``mask``) it adds to its ancestors' and their
    values (``pattern``). Children of node i are FAN * i up to FAN * i + FAN - 1.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        ones, zeros = self.codes, ~self.codes
        shared, values = [np.full(len(codes), every)], [self.codes]
        while len(ones) > FAN:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            shared.append(ones | zeros)
            values.append(ones)
        self.levels = []
        for depth in range(len(shared) - 1, -1, -1):
            mask = shared[depth]
            if depth < len(shared) - 1:
                mask = mask & ~np.repeat(shared[depth + 1], FAN)[: len(mask)]
            self.levels.append((mask, values[depth] & mask))

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, code) of all pairs that differ in at most ``radius`` bits."""
        top = len(self.levels[0][0])
        at = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        gone = np.zeros(len(at), np.uint8)
        for depth, (mask, pattern) in enumerate(self.levels):
            gone = gone + np.bitwise_count((queries[at] ^ pattern[node]) & mask[node])
            near = gone <= radius
            at, node, gone = at[near], node[near], gone[near]
            if depth + 1 < len(self.levels):
                below = (node[:, None] * FAN + np.arange(FAN)).ravel()
                at, gone = np.repeat(at, FAN), np.repeat(gone, FAN)
                there = below < len(self.levels[depth + 1][0])
                at, node, gone = at[there], below[there], gone[there]
        return at, node


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of the pairs (a, b); parents are never larger than their children."""
    while len(a):
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def group_links(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct ``codes`` (unsigned): pairs (code, root code)."""
    index = GrayIndex(codes)
    n = len(codes)
    parent = np.arange(n)
    step = max(16, (1 << 21) // max(n, 1))
    for start in range(0, n, step):
        at, node = index.within(index.codes[start : start + step], radius)
        at = at + start
        later = node > at
        _unite(parent, at[later], node[later])
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    linked = np.flatnonzero(parent != np.arange(n))
    return index.codes[linked], index.codes[parent[linked]]


def _parts(mask: int, radius: int) -> list[int]:
    """``mask`` widened by each of ``radius + 1`` parts of its free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(free) * k / (radius + 1)) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def routed(fps: DataFrame, radius: int, hot: int = HOT, last_bits: int = LAST_BITS) -> DataFrame:
    """Rows (mask, value, fp): the groups in which to search; groups over ``hot`` are refined."""
    done, level = [], [0]
    rows = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        children = {m: _parts(m, radius) for m in level}
        cases = F.create_map(*[x for m, c in children.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)).cast("long") for k in c]))])
        rows = rows.select(F.explode(cases[F.col("mask")]).alias("mask"), "fp").withColumn("value", F.col("mask").bitwiseAND(F.col("fp")))
        level = [k for c in children.values() for k in c]
        if min(64 - bin(m).count("1") for m in level) <= last_bits:
            break
        large = written(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("mask", "value"), "simhash-hot")
        if large.isEmpty():
            break
        rows = written(rows, "simhash-routed")
        done.append(rows.join(large, ["mask", "value"], "left_anti"))
        rows = rows.join(large, ["mask", "value"], "left_semi").select("mask", "fp")
    for part in done:
        rows = rows.unionByName(part)
    return rows.select("mask", "value", "fp")


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT, last_bits: int = LAST_BITS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps.fp`` (distinct) within ``radius`` bits."""
    groups = routed(fps, radius, hot, last_bits).repartition("mask", "value").sortWithinPartitions("mask", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(codes: np.ndarray) -> pa.RecordBatch:
            a, b = group_links(codes.view(np.uint64), radius) if len(codes) > 1 else (codes, codes)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in ((a, b) if len(codes) > 1 else (a[:0], b[:0]))], ["a", "b"])

        def grouped() -> Iterator[np.ndarray]:
            key, held = None, []
            for batch in batches:
                mask, value, fp = (batch.column(k).to_numpy() for k in range(3))
                if not len(fp):
                    continue
                cuts = [0, *(np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1), len(fp)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    if key != (mask[x], value[x]):
                        if len(held) > 1 or held and len(held[0]) > 1:
                            yield np.concatenate(held)
                        key, held = (mask[x], value[x]), []
                    held.append(fp[x:y].copy())
            if len(held) > 1 or held and len(held[0]) > 1:
                yield np.concatenate(held)

        for codes in grouped():
            yield found(codes)

    return groups.mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, **options) -> DataFrame:
    """fp, root (of the class) and component_id for each distinct fingerprint of ``prints`` (id_col, fp)."""
    distinct = written(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-prints")
    roots = components(links(distinct, radius, **options)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, **options) -> DataFrame:
    """id_col, fp (signed) and component_id of every row."""
    prints = written(fingerprints(docs.select(id_col, text_col), text_col, shingle), "simhash-docs")
    return prints.join(classes(prints, id_col, radius, **options), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without all but one row of each class of fingerprints: the first by id (null last), then by content."""
    k1, k2 = row_keys(docs)
    keyed = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    prints = written(fingerprints(keyed.select("id", "k1", "k2", "text"), "text", options.pop("shingle", SHINGLE)), "simhash-docs")
    roots = written(classes(prints, "id", **options).select("fp", "root"), "simhash-roots")
    first = F.min(F.struct(*null_last("id"), "k1", "k2", "copy")).alias("f")
    # Rows that are equal in all columns are told apart by a number; there is one for most keys.
    numbered = lambda df: df.withColumn("copy", F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1")))
    kept = numbered(prints).join(roots, "fp").groupBy("root").agg(first).select("f.k1", "f.k2", "f.copy")
    return numbered(keyed).join(kept, ["k1", "k2", "copy"], "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
