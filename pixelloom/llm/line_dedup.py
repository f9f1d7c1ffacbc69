"""Line deduplication by a deletion-neighbourhood join.

A line goes if an earlier line - by document id, then position - equals it, or,
among lines of ``FUZZY_WORDS`` or more words, is one word edit away (a word
replaced, put in or left out). Lines are compared by their words with A-Z in
lower case.

The join. Every line emits its variants within the edit bound as hashed keys:
itself, and itself without its k-th word for every k. Two lines of n words that
share the variant "without the k-th" differ in that word alone; a line that is
another's variant lacks one of its words. The earliest line of each key is an
aggregate, so lines that share a key are never paired with each other; each
meets its key's earliest line only, and that pair's edit distance is verified
on the texts.

Less to emit. Lines one edit apart have a half in common, so a line emits only
the variants that differ in the half which it doesn't share with another line,
and those of another length only where such a line is of that length. Shared
halves are found by an aggregate and joined; a Bloom filter of at most
2**MAX_BITS bits spares most other lines that join. A false hit, even a full
filter, sends more lines through the join and changes nothing.

At scale: a pass over the texts gives a narrow row per line (keys and hashes, no
text); copies are found by the first row per line hash and shared halves by the
smallest and largest line hash per half, all with partial sums, so a line that
a third of the documents repeat is never gathered. A second pass cuts out the
lines whose halves are shared. Words are hashed a batch at a time
(``wordhash``). Texts are shuffled once, to apply the decisions.

Rows. A row is known by two 64-bit hashes of all its columns, not by its id:
rows of one id, or of none, are deduplicated like any others, first by id
(null last), then by these hashes.

Defined results
* null text: stays null. Lines without a word, and lines under ``MIN_WORDS`` words: always stay.
* a document that loses all its lines with words goes; one that had none stays.
* rows equal in all columns: the first stays as it is decided, the others lose all lines of ``MIN_WORDS`` words.
* equal or null ids over different texts: each row keeps its own unique lines.
* very long text: whole. Empty table: empty result. Extra columns: kept, whatever their names; n_chars is renewed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .bloom import bloom, holds
from .common import SPACE_RUN, for_python, null_last, row_keys, row_of, table, written
from .wordhash import LineHashes, Words, mixed

MIN_WORDS = 2
FUZZY_WORDS = 8
MAX_BITS = 30

#: What a row is known by.
KEY = ("k1", "k2")


def line_words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").lower().split()


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two word lists are equal or one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k:]


def _again(rows: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether the same line stands earlier in the same row; lines come by row and position."""
    again = np.ones(len(rows), bool)
    again[np.unique(mixed(h1 + mixed(h2 + rows.astype(np.uint64))), return_index=True)[1]] = False
    return again


def _fields(docs: DataFrame, more: str) -> StructType:
    """A schema that begins with the id and the keys of ``docs``."""
    return StructType([docs.schema["id"], docs.schema["k1"], docs.schema["k2"], *_parse_datatype_string(more).fields])


def hashed_lines(docs: DataFrame, min_words: int, fuzzy_words: int) -> DataFrame:
    """The lines of ``docs`` (id, k1, k2, text) by hashes; halves only of first and long enough ones, ``head`` for one line of each row."""
    schema = _fields(docs, "pos int, n int, h1 long, h2 long, again boolean, head boolean, halves array<long>")

    def run(batches):
        for batch in batches:
            words = Words(batch.column(3))
            hashed = LineHashes(words)
            some = np.flatnonzero(words.n >= min_words)
            h1, h2 = (h[some] for h in hashed.lines())
            rows, n = words.row[some], words.n[some]
            again = _again(rows, h1, h2)
            fuzzy = (n >= fuzzy_words) & ~again
            sizes = np.concatenate([[0], np.cumsum(4 * fuzzy)]).astype(np.int32)
            halves = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), _longs(hashed.halves()[some[fuzzy]].ravel()))
            head = np.append(True, rows[1:] != rows[:-1])[: len(rows)]
            at = pa.array(rows, pa.int64())
            arrays = [*(batch.column(k).take(at) for k in range(3)), pa.array(words.pos[some].astype(np.int32)), pa.array(n.astype(np.int32)), _longs(h1), _longs(h2), pa.array(again), pa.array(head), halves]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.mapInArrow(run, schema)


def candidate_lines(docs: DataFrame, shared: DataFrame, fuzzy_words: int, max_bits: int) -> DataFrame:
    """One row for each different line that may share a half, at its first place: id, k1, k2, pos, line, n, halves."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom(shared, "half", max_bits))
    schema = _fields(docs, "pos int, n int, h1 long, h2 long, halves array<long>, line string")

    def run(batches):
        for batch in batches:
            words = Words(batch.column(3))
            hashed = LineHashes(words)
            some = np.flatnonzero(words.n >= fuzzy_words)
            halves = hashed.halves()[some]
            hit = holds(filter_.value, halves).any(axis=1)
            some, halves = some[hit], halves[hit]
            h1, h2 = (h[some] for h in hashed.lines())
            first = ~_again(words.row[some], h1, h2)
            some, halves, h1, h2 = some[first], halves[first], h1[first], h2[first]
            at = pa.array(words.row[some], pa.int64())
            listed = pa.ListArray.from_arrays(pa.array(4 * np.arange(len(some) + 1), pa.int32()), _longs(halves.ravel()))
            lines = pa.array([words.line(k) for k in some], pa.string())
            arrays = [*(batch.column(k).take(at) for k in range(3)), pa.array(words.pos[some].astype(np.int32)), pa.array(words.n[some].astype(np.int32)), _longs(h1), _longs(h2), listed, lines]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    every = docs.mapInArrow(run, schema)
    first = F.min(F.struct(*null_last("id"), *KEY, "pos", "n", "halves", "line")).alias("f")
    return every.groupBy("h1", "h2").agg(first).select("f.id", *[f"f.{k}" for k in KEY], "f.pos", "f.n", "f.halves", "f.line")


def near_copies(docs: DataFrame, lines: DataFrame, fuzzy_words: int, max_bits: int) -> DataFrame:
    """(k1, k2, pos) of the first places of lines that are one edit away from an earlier line."""
    halves = lines.select("h1", "n", F.explode("halves").alias("half"))
    spread = [F.min("h1").alias("low"), F.max("h1").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")]
    shared = written(halves.groupBy("half").agg(*spread).where("low <> high").select("half", "least", "most"), "lines-halves")
    every = written(candidate_lines(docs, shared, fuzzy_words, max_bits), "lines-candidates")
    # Sorted over all partitions, so that the numbers of rows are in the order of lines.
    ordered = every.orderBy(F.col("id").asc_nulls_last(), *KEY, "pos").withColumn("ord", F.monotonically_increasing_id())
    texts = written(ordered.select(*KEY, "pos", "line", "halves", "n", "ord"), "lines-texts")

    # Which variants a line needs, as bits. The word that differs is in the half that isn't shared (1, 4); where a word is
    # left out (2, 8), another line is one word shorter, and as a whole (16) a line counts if another is one word longer.
    longer = F.when(F.col("most") > F.col("n"), 16).otherwise(0)
    shorter = F.col("least") < F.col("n")
    needs = F.when(F.col("j") == 0, longer + 1).when(F.col("j") == 2, longer + 4).when((F.col("j") == 1) & shorter, 2).when((F.col("j") == 3) & shorter, 8).otherwise(0)
    needed = texts.select("ord", "n", F.posexplode("halves").alias("j", "half")).join(shared, "half").groupBy("ord").agg(F.bit_or(needs).alias("needs")).where("needs <> 0")
    wanted = texts.select("ord", "line").join(needed, "ord")

    def emit(batches):
        for batch in batches:
            hashed, needs, ord_ = LineHashes(Words(batch.column("line"), lines=False)), batch.column("needs").to_numpy(), batch.column("ord").to_numpy()
            line, place, without, placed = hashed.variants()
            n, bit = hashed.n[line], lambda k: (needs[line] >> k) & 1 == 1
            swapped = np.where(place >= n // 2, bit(0), bit(2))
            fewer = np.where(place >= (n - 1) // 2, bit(1), bit(3))
            whole = (needs >> 4) & 1 == 1
            keys = np.concatenate([hashed.whole()[whole], without[fewer], placed[swapped]])
            kinds = np.repeat([0, 1, 2], [whole.sum(), fewer.sum(), swapped.sum()]).astype(np.int32)
            ords = np.concatenate([ord_[whole], ord_[line[fewer]], ord_[line[swapped]]])
            yield pa.RecordBatch.from_arrays([_longs(keys), pa.array(kinds), pa.array(ords, pa.int64())], ["key", "kind", "ord"])

    variants = wanted.select("line", "needs", "ord").mapInArrow(emit, "key long, kind int, ord long")
    least = [F.min(F.when(F.col("kind") == k, F.col("ord"))).alias(f"least{k}") for k in range(3)]
    groups = variants.groupBy("key").agg(*least, F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    # A line meets the earliest line that lacks one of its words, that has one more, or that differs at the same place.
    met = variants.join(groups, "key").withColumn("earlier", F.when(F.col("kind") == 0, F.col("least1")).when(F.col("kind") == 1, F.col("least0")).otherwise(F.col("least2")))
    pairs = met.where(F.col("earlier") < F.col("ord")).select("ord", "earlier").distinct()
    ours = texts.select("ord", *KEY, "pos", F.col("line").alias("mine"))
    theirs = texts.select(F.col("ord").alias("earlier"), F.col("line").alias("theirs"))
    both = pairs.join(ours, "ord").join(theirs, "earlier").select(*KEY, "pos", "mine", "theirs")

    def verify(batches):
        for batch in batches:
            good = [one_edit(line_words(a), line_words(b)) for a, b in zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*KEY, "pos")], [*KEY, "pos"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(verify, "k1 long, k2 long, pos int").distinct()


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """The lines of ``docs`` (id, k1, k2, text) that go, (k1, k2, pos, near): copies, and near copies where ``near``; and the keys of repeated rows."""
    for_python(docs.sparkSession)
    lines = written(hashed_lines(docs, min_words, fuzzy_words), "lines-hashed")
    once = lines.where(~F.col("again"))
    first = F.min(F.struct(*null_last("id"), *KEY)).alias("first")
    first = once.groupBy("h1", "h2").agg(first, F.count(F.lit(1)).alias("places")).where("places > 1").select("h1", "h2", *[F.col(f"first.{k}").alias(f"first_{k}") for k in KEY])
    # Written, so that both sides of the join are plain shuffles, whose hot partitions Spark splits.
    first = written(first, "lines-first")
    copies = once.select(*KEY, "pos", "h1", "h2").join(first, ["h1", "h2"]).where("k1 <> first_k1 OR k2 <> first_k2").select(*KEY, "pos")
    copies = copies.unionByName(lines.where("again").select(*KEY, "pos")).withColumn("near", F.lit(False))
    near = near_copies(docs, lines, fuzzy_words, max_bits).withColumn("near", F.lit(True))
    repeated = lines.where("head").groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*KEY)
    return copies.unionByName(near), written(repeated, "lines-rows")


def _kept_text(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the positions ``gone``."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(F.array(lines), lambda ls: F.transform(left, lambda k: F.get(ls, k)))[0], "\n")


def _without_later_rows(decided: DataFrame, repeated: DataFrame, min_words: int) -> DataFrame:
    """``decided`` where rows that are equal to an earlier one lose all their lines of ``min_words`` words or more."""
    if repeated.isEmpty():
        return decided
    rest, rows = decided.join(repeated, list(KEY), "left_anti"), decided.join(repeated, list(KEY), "left_semi")
    words = lambda x: F.size(F.filter(F.split(x, SPACE_RUN), lambda w: w != ""))
    said = F.filter(F.transform(F.split("text", "\n"), lambda x, k: F.when(words(x) >= min_words, k)), lambda k: k.isNotNull())
    later = F.row_number().over(W.partitionBy(*KEY).orderBy("n_copies")) > 1
    numbered = rows.withColumn("later", later).withColumn("gone", F.when(F.col("later"), said).otherwise(F.col("gone")))
    counts = {"n_copies": F.when(F.col("later"), F.size("gone").cast("long")).otherwise(F.col("n_copies")), "n_near": F.when(F.col("later"), F.lit(0).cast("long")).otherwise(F.col("n_near"))}
    return rest.unionByName(numbered.withColumns(counts).drop("later"))


def _decided(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """row, text, gone, left (the text without its repeated lines), n_copies and n_near of every row."""
    k1, k2 = row_keys(docs)
    lean = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    gone, repeated = repeated_lines(lean.select("id", *KEY, "text"), min_words, **options)
    by_row = gone.groupBy(*KEY).agg(F.collect_set(F.struct("pos", "near")).alias("g"))
    by_row = by_row.select(*KEY, F.col("g.pos").alias("gone"), F.size(F.filter("g", lambda x: ~x["near"])).cast("long").alias("n_copies"), F.size(F.filter("g", lambda x: x["near"])).cast("long").alias("n_near"))
    met = lean.join(by_row, list(KEY), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_copies", "n_near")})
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_kept_text(F.col("text"), F.col("gone")))
    return _without_later_rows(met, repeated, min_words).withColumn("left", left)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without repeated lines, and without documents that have nothing else."""
    decided = _decided(docs, id_col, text_col, **options)
    has_word = r"[^\x20\x09-\x0D]"
    some = F.col("gone").isNull() | F.col("left").rlike(has_word)
    types = {f.name: f.dataType for f in docs.schema.fields}
    new = {text_col: F.col("left")} | ({"n_chars": F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast(types["n_chars"]))} if "n_chars" in types else {})
    return decided.where(some).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _decided(docs, "doc_id", "text").select("row.doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), "n_copies", "n_near", F.sha2(F.coalesce("left", F.lit("")), 256).alias("left_sha256"))


def oracle_sql(docs: str = "documents", min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS) -> str:
    """The same decisions from spelled-out variants."""
    low = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
l AS (SELECT doc_id, pos, line, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d)),
k AS (SELECT doc_id, pos, ws, array_to_string(ws, ' ') AS w FROM l WHERE len(ws) >= {min_words}),
f AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth, row_number() OVER (ORDER BY doc_id, pos) AS o FROM k),
u AS (SELECT * FROM f WHERE nth = 1 AND len(ws) >= {fuzzy_words}),
i AS (SELECT o, ws, w, unnest(range(1, len(ws) + 1)) AS i FROM u),
v AS (SELECT o, i, len(ws) AS n, array_to_string(ws[1:i - 1] || ws[i + 1:], ' ') AS v FROM i),
placed AS (SELECT n, i, v, min(o) AS o FROM v GROUP BY n, i, v),
near AS (SELECT v.o FROM v JOIN placed p ON v.n = p.n AND v.i = p.i AND v.v = p.v WHERE p.o < v.o
  UNION SELECT v.o FROM v JOIN u ON u.w = v.v AND u.o < v.o
  UNION SELECT u.o FROM v JOIN u ON u.w = v.v AND v.o < u.o),
gone AS (SELECT doc_id, pos, false AS near FROM f WHERE nth > 1 UNION ALL SELECT doc_id, pos, true FROM u WHERE o IN (SELECT o FROM near)),
g AS (SELECT doc_id, count(*) FILTER (NOT near) AS n_copies, count(*) FILTER (near) AS n_near FROM gone GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS t FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos WHERE gone.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_copies, 0)::BIGINT AS n_copies, coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(t, '')) AS left_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
