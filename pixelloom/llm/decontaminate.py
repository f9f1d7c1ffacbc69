"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items build one automaton that recognises every word
sequence inside an item. Each document streams its words through it; the state
and the matching length after a word tell the longest item passage that ends
there. Passages of ``window`` words or more, and whole items shorter than that,
are hits; ``clean`` removes the hit words of a document up to a share of it and
drops the document beyond.

At scale: documents are read once and never shuffled; the automaton is built on
the driver from the benchmark and broadcast. It holds at most ``shard_words``
words: larger benchmarks are dealt into shards of so many (an item longer than a
shard is cut into pieces that overlap by ``window - 1`` words), one automaton
after the other. Each shard's hits, of the few documents that have some, are
written by row key, and united and joined to the documents at the end.

Defined results
* null text or a text without words: no words, no hits. Null item text: no words, never hit.
* items without an id: their words are hit; all of them count as one item, which no list of ids names.
* very long text: streamed whole, in linear time whatever repeats in it. Repeated rows: alike, one row out for each row in.
* empty benchmark: no hits. Empty documents: empty result. Items with equal texts are each counted.
* extra columns: ``clean`` keeps the input's columns, whatever their names; ``hits`` too, and its own are
  n_words_ and so on where the input has such names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, for_python, row_keys, row_of, table, written

WINDOW = 10
#: A document with more than this share of hit words goes; up to it, only its hit words go.
MAX_COVERAGE = 0.5
SHARD_WORDS = 2_000_000

#: A-Z to lower case; every other ASCII character that is no digit and no letter to a space.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass
class Automaton:
    """Suffix automaton over word numbers, with the items that end windows in each state."""

    vocabulary: dict[bytes, int]
    moves: list[dict[int, int]]
    link: list[int]
    length: list[int]
    window: int
    #: state -> items that hold the state's suffix of ``window`` words
    holders: dict[int, tuple[str, ...]]
    #: state -> the state of its suffix of ``window`` words (itself, if it is shorter)
    anchor: list[int]
    #: state -> ((length, items), ...) of whole items shorter than a window that are suffixes of the state
    whole: dict[int, tuple[tuple[int, tuple[str, ...]], ...]]
    shortest: int


def _by_id(item: str | None) -> tuple[bool, str]:
    """Items by id, those without one last."""
    return item is None, item or ""


def build(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Automaton:
    """The automaton of ``items`` (id, words)."""
    vocabulary: dict[bytes, int] = {}
    moves, link, length = [{}], [-1], [0]

    def new(size: int, out: dict[int, int], to: int) -> int:
        moves.append(out)
        link.append(to)
        length.append(size)
        return len(moves) - 1

    def split(p: int, c: int, q: int) -> int:
        """A copy of q that holds only its strings of up to length[p] + 1 words."""
        copy = new(length[p] + 1, dict(moves[q]), link[q])
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def extend(last: int, c: int) -> int:
        if c in moves[last]:
            q = moves[last][c]
            return q if length[q] == length[last] + 1 else split(last, c, q)
        state, p = new(length[last] + 1, {}, 0), last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            link[state] = q if length[q] == length[p] + 1 else split(p, c, q)
        return state

    coded = []
    for item, words in items:
        if words:
            codes = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            coded.append((item, codes))
            last = 0
            for c in codes:
                last = extend(last, c)

    # Links lead to shorter states, so each state's ancestor is known when its own turn comes.
    anchor = list(range(len(moves)))
    for state in sorted(range(1, len(moves)), key=length.__getitem__):
        if length[link[state]] >= window:
            anchor[state] = anchor[link[state]]

    holders: dict[int, set[str]] = {}
    ends: dict[int, tuple[int, list[str]]] = {}
    for item, codes in coded:
        state = 0
        for k, c in enumerate(codes, 1):
            state = moves[state][c]
            if k >= window:
                holders.setdefault(anchor[state], set()).add(item)
        if len(codes) < window:
            # A state that a string leads to from the start holds it: its link is shorter than the string.
            ends.setdefault(state, (len(codes), []))[1].append(item)
    whole: dict[int, list] = {}
    if ends:
        for state in sorted(range(1, len(moves)), key=length.__getitem__):
            found = list(whole.get(link[state], []))
            if state in ends:
                found.append((ends[state][0], tuple(sorted(ends[state][1], key=_by_id))))
            if found:
                whole[state] = found
    shortest = min((min(len(c), window) for _, c in coded), default=0)
    return Automaton(vocabulary, moves, link, length, window, {k: tuple(sorted(v, key=_by_id)) for k, v in holders.items()}, anchor, {k: tuple(v) for k, v in whole.items()}, shortest)


def scan(words: list[bytes], automaton: Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Hit word ranges [start, end) in order, disjoint, and the items with occurring windows."""
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    get = automaton.vocabulary.get
    codes = [get(w, -1) for w in words]
    n, at = len(codes), 0
    moves, link, length, window, holders, whole, anchor = automaton.moves, automaton.link, automaton.length, automaton.window, automaton.holders, automaton.whole, automaton.anchor
    seen: set[int] = set()
    if not automaton.shortest:
        return ranges, items
    while at < n:
        # Words outside the vocabulary reset the automaton: only runs of known words can hold a hit.
        while at < n and codes[at] < 0:
            at += 1
        stop = at
        while stop < n and codes[stop] >= 0:
            stop += 1
        if stop - at < automaton.shortest:
            at = stop
            continue
        state = size = 0
        for k in range(at, stop):
            c = codes[k]
            while state and c not in moves[state]:
                state = link[state]
                size = length[state]
            if c in moves[state]:
                state, size = moves[state][c], size + 1
            longest = 0
            if size >= window:
                longest, holder = size, anchor[state]
                if holder not in seen:
                    seen.add(holder)
                    items.update(holders.get(holder, ()))
            for short, ids in whole.get(state, ()):
                if short <= size:
                    longest = max(longest, short)
                    items.update(ids)
            if longest:
                start = k + 1 - longest
                while ranges and ranges[-1][1] >= start:
                    start = min(start, ranges.pop()[0])
                ranges.append((start, k + 1))
        at = stop
    return ranges, items


def shards(items: list[tuple[str, list[bytes]]], window: int, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items dealt into groups of at most ``limit`` words; longer items are cut into overlapping pieces."""
    group, held = [], 0
    for item, words in items:
        step = max(1, limit - window + 1)
        pieces = [words[k : k + limit] for k in range(0, max(1, len(words) - window + 1), step)] if len(words) > limit else [words]
        for piece in pieces:
            if group and held + len(piece) > limit:
                yield group
                group, held = [], 0
            group.append((item, piece))
            held += len(piece)
    if group:
        yield group


def benchmark_shards(benchmark: DataFrame, id_col: str, text_col: str, window: int, limit: int) -> Iterator[Automaton]:
    """Automata of the benchmark, read item by item."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).orderBy(F.col(id_col)).toLocalIterator()
    for group in shards(((r[0], folded_words(r[1])) for r in rows), window, limit):
        yield build(group, window)


_FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>"


def _scanner(shared, keep: int, only_hits: bool = False):
    """A scan of batches whose last column is the text; the first ``keep`` columns stay."""

    def run(batches):
        automaton = shared.value
        for batch in batches:
            starts, ends, counts, items, rows = [], [], [], [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                words = folded_words(text)
                ranges, found = scan(words, automaton)
                if only_hits and not ranges:
                    continue
                rows.append(row)
                counts.append(len(words))
                starts.append([r[0] for r in ranges])
                ends.append([r[1] for r in ranges])
                items.append(sorted(found, key=_by_id))
            at = pa.array(rows, pa.int64())
            kept = [batch.column(k).take(at) if only_hits else batch.column(k) for k in range(keep)]
            arrays = [pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], [*batch.schema.names[:keep], "n_words", "starts", "ends", "items"])

    return run


def _found(docs: DataFrame, text_col: str, benchmark: DataFrame, bench_id: str, bench_text: str, window: int, shard_words: int, keep_text: bool) -> DataFrame:
    """row (with the text, if it is kept, else without), text (if it is kept), n_words, starts, ends and items."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    spark = docs.sparkSession
    for_python(spark)
    k1, k2 = row_keys(docs)
    lean = docs.select(row_of(docs, None if keep_text else text_col).alias("row"), F.col(text_col).alias("text"))
    fields = _parse_datatype_string(_FOUND).fields
    kept = ["row", "text"] if keep_text else ["row"]
    out = StructType([*[lean.schema[c] for c in kept], *fields])
    send = spark.sparkContext.broadcast
    automata = benchmark_shards(benchmark, bench_id, bench_text, window, shard_words)
    first = next(automata, None) or build([], window)
    second = next(automata, None)
    if second is None:
        return lean.mapInArrow(_scanner(send(first), len(kept)), out)

    keyed, parts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text")), []
    for automaton in chain([first, second], automata):
        shared = send(automaton)
        hit = keyed.mapInArrow(_scanner(shared, 2, only_hits=True), f"k1 long, k2 long, {_FOUND}")
        # Equal rows have equal hits: one of them speaks for all.
        parts.append(written(hit.dropDuplicates(["k1", "k2"]), "decontaminate-hits"))
        shared.destroy()
    united = _united(reduce(DataFrame.unionByName, parts))
    counted = docs.select(row_of(docs, None if keep_text else text_col).alias("row"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    bare = counted.withColumn("n_words", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long"))
    none = F.array().cast("array<int>")
    return bare.join(united, ["k1", "k2"], "left").select(*kept, "n_words", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _united(hits: DataFrame) -> DataFrame:
    """One row per key (k1, k2) from the hits of several shards: ranges merged, items united."""
    grouped = hits.groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.array().cast("array<struct<starts:int,ends:int>>")

    def merge(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], x["ends"]).alias("ends"))
        return F.when((F.size(acc) > 0) & (last["ends"] >= x["starts"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    merged = grouped.withColumn("r", F.aggregate("r", empty, merge))
    return merged.select("k1", "k2", F.col("r.starts").alias("starts"), F.col("r.ends").alias("ends"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with the text replaced by n_words, starts, ends (disjoint hit ranges of words) and items."""
    found = _found(docs, text_col, benchmark, bench_id, bench_text, window, shard_words, keep_text=False)
    return beside(found, [c for c in docs.columns if c != text_col], ["n_words", "starts", "ends", "items"])


def _word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_coverage: float = MAX_COVERAGE, bench_id: str = "item_id", bench_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without benchmark passages.

    Hit ranges are cut out of the text from their first word to their last; a
    document whose hits cover more than ``max_coverage`` of its words goes.
    Columns stay; ``n_chars``, where there is one, is that of the new text.
    """
    names = docs.columns
    found = _found(docs, text_col, benchmark, bench_id, bench_text, window, shard_words, keep_text=True)
    covered = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda x, y: x + y)
    kept = found.where(covered <= F.lit(max_coverage) * F.col("n_words"))

    def cut(batches):
        for batch in batches:
            texts, changed = [], []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
                changed.append(bool(starts))
                if starts:
                    spans, parts, at = _word_spans(text), [], 0
                    for a, b in zip(starts, ends, strict=True):
                        parts.append(text[at : spans[a][0]])
                        at = spans[b - 1][1]
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(changed)], ["row", "text", "changed"])

    from pyspark.sql.types import BooleanType, StructType

    cleaned = kept.select("row", "text", "starts", "ends").mapInArrow(cut, StructType([found.schema["row"], found.schema["text"]]).add("changed", BooleanType()))
    types = {f.name: f.dataType for f in docs.schema.fields}
    new = {text_col: F.col("text")}
    if "n_chars" in types:
        new["n_chars"] = F.when(F.col("changed"), F.length("text").cast(types["n_chars"])).otherwise(F.col("row.n_chars"))
    return cleaned.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def oracle_sql(docs: str = "documents", benchmark: str = "benchmark", window: int = WINDOW) -> str:
    """Windows of items joined to windows of documents, in plain SQL."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({low}, '{word}') AS ws FROM {docs}),
b AS (SELECT item_id, regexp_extract_all({low}, '{word}') AS ws FROM {benchmark}),
bl AS (SELECT *, least(len(ws), {window}) AS n FROM b WHERE len(ws) > 0),
bi AS (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bl),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM bi),
lens AS (SELECT DISTINCT n FROM iw),
di AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lens WHERE len(ws) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM di),
occ AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN iw ON dw.k = iw.k AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM occ, range({window}) AS r(j) WHERE j < n GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN its ON w.doc_id = its.doc_id
"""
