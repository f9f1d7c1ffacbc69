"""Alignment of two tokenizers: which tokens of one end where tokens of the other do, and how usual each such pair is.

Both tokenizers read space + text, A by byte pairs and B by pieces. Where tokens of both
end at one byte, the text is cut into groups, and the two tokens that end there are linked.
A pair's count is how many links in the whole corpus hold it.

Postings cogroup. The tokens of each document give its distinct pairs with their
multiplicities (postings). These are shuffled by their B id, and so are the pairs'
counts, pre-aggregated before they move. Each task reads one stream, sorted by side,
counts in front of postings, that Spark spills: it knows a side's counts and their maximum
when the side's postings come, holds one side's counts (no more than A has ids) and one
batch of postings, and emits each posting's contribution to its document. Contributions are summed by
document.

At scale: a B id that holds more than a quarter of a task's even share is dealt
out over several salts, by document, and its counts go to each of them; how many is decided
from the number of postings of each B id, a table bounded by B's vocabulary. Neither
tokenizer carries anything over a space between two characters that aren't white
space, so words are aligned by themselves, many in one go, and a worker remembers the latest ones.
Tokens are made once and written to the shared folder.

Defined results
* null or empty text, or one whose tokens don't spell space + text (a U+2581 in it): no tokens, zeros and an empty digest. Such texts give no links.
* special tokens' strings inside texts are plain text. Very long texts are aligned whole.
* repeated rows, null and equal ids: each row is a document of its own, counted as often as it stands there.
* ties: all A ids with the highest count of a B id are best. Empty table: empty result.
* extra columns: kept, whatever their names; own names get underscores where they clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import beside, for_python, row_of, table, written
from .pieces import model_path, pieces_of

#: Tasks of the cogroup, at least, and the share of a task's even load above which a B id is salted.
TASKS, SHARE = 64, 4
#: White space at an edge or beside other white space.
_UNEVEN = re.compile(r"\s\s|^\s|\s$")
#: Words that a worker keeps, besides those of the batch it is at, and words that are aligned together.
REMEMBERED, PIECE = 400_000, 20_000
#: Longer words aren't kept.
LONGEST = 64
_NONE = np.zeros(0, np.int64)
_TOKENS = ["n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]


def bytes_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligned:
    """Both tokenizers, and the alignment of words that a worker has seen lately."""

    def __init__(self, byte_pairs: bytes, model: bytes):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        spec, letters = json.loads(byte_pairs), _byte_letters()
        special = {t["id"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if k not in special}
        steps = spec["pre_tokenizer"]
        if spec["normalizer"] or steps["type"] != "ByteLevel" or steps["add_prefix_space"] or not steps["use_regex"]:
            raise ValueError("only byte-level vocabularies that leave the text as it is are read")
        pieces = pieces_of(model)
        if pieces.normalise.map.units or pieces.fold or not pieces.prefix:
            raise ValueError("only models that put a mark in front and rewrite nothing are read")
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.b_bytes = pieces.texts
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            a_bytes[k] = token
        self.sizes = [np.array([len(t) for t in table], np.int64) for table in (a_bytes, self.b_bytes)]
        # Ids as text, inside a run of a group's ids and at its end.
        self.texts = [[np.array([f"{k}{sign}" for k in range(len(table))], object) for sign in signs] for table, signs in ((a_bytes, ",|"), (self.b_bytes, ",;"))]
        self.words: dict[str, tuple[int, int, bytes, str] | None] = {}

    def learn(self, words: list[str]) -> None:
        """Of space + word, for each: tokens of A and B, pairs (B id << 32 | A id, as bytes) and groups as text; None if it isn't spelt by both."""
        b_ids = self.b.encode(words, num_threads=1)
        spelt = [(" " + w).encode("utf-8", "replace") for w in words]
        if b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(b_ids))) != b"".join(spelt):
            good = [b"".join(map(self.b_bytes.__getitem__, ids)) == whole for ids, whole in zip(b_ids, spelt, strict=True)]
            self.words.update((w, None) for w, fine in zip(words, good, strict=True) if not fine)
            words, b_ids = [w for w, fine in zip(words, good, strict=True) if fine], [x for x, fine in zip(b_ids, good, strict=True) if fine]
        if not words:
            return
        a_ids = [self.a.encode_ordinary(" " + w) for w in words]
        n_a, n_b = [len(x) for x in a_ids], [len(x) for x in b_ids]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_ids, b_ids))
        # Both spell the same bytes, all words behind each other.
        ends, at_a, at_b = np.intersect1d(np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]), assume_unique=True, return_indices=True)
        pairs = ((b[at_b] << 32) | a[at_a]).astype("<i8").tobytes()
        written = np.empty(len(a) + len(b), object)
        for ids, last, here, others in ((a, at_a, 0, np.concatenate([[0], at_b[:-1] + 1])), (b, at_b, 1, at_a + 1)):
            closing = np.zeros(len(ids), bool)
            closing[last] = True
            group = np.cumsum(closing) - closing
            inner, outer = self.texts[here]
            written[np.arange(len(ids)) + others[group]] = np.where(closing, outer[ids], inner[ids])
        tokens, groups = written.tolist(), np.searchsorted(at_a, np.cumsum(n_a) - 1, side="right").tolist()
        at = first = 0
        for w, x, y, g in zip(words, n_a, n_b, groups, strict=True):
            self.words[w] = x, y, pairs[8 * first : 8 * g], "".join(tokens[at : at + x + y])[:-1]
            at, first = at + x + y, g

    def documents(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, the digest of the groups, distinct pairs and how often each is linked, of each text."""
        cut = [stretches(t) if t else [] for t in texts]
        used = set(chain.from_iterable(cut))
        new = [w for w in used if w not in self.words]
        if len(self.words) + len(new) > REMEMBERED:
            self.words = {w: self.words[w] for w in used if w in self.words}
        for at in range(0, len(new), PIECE):
            self.learn(new[at : at + PIECE])
        out = [self._document(keys) for keys in cut]
        for w in new:
            if len(w) > LONGEST:
                del self.words[w]
        return out

    def _document(self, keys: list[str]) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        found = list(map(self.words.__getitem__, keys))
        if not found or None in found:
            return 0, 0, 0, "", _NONE, _NONE
        n_a, n_b, pairs, groups = zip(*found, strict=True)
        linked = np.frombuffer(b"".join(pairs), "<i8")
        return sum(n_a), sum(n_b), len(linked), hashlib.sha256(";".join(groups).encode()).hexdigest(), *np.unique(linked, return_counts=True)


def stretches(text: str) -> list[str]:
    """A text cut at those spaces that neither tokenizer crosses: between two characters that aren't white space."""
    words = text.split(" ")
    if not _UNEVEN.search(text):
        return words
    out: list[list[str]] = [[words[0]]]
    for before, word in zip(words, words[1:], strict=False):
        if before and not before[-1].isspace() and word and not word[0].isspace():
            out.append([word])
        else:
            out[-1].append(word)
    return [" ".join(run) for run in out]


@lru_cache(maxsize=2)
def aligned_of(byte_pairs: bytes, model: bytes) -> Aligned:
    return Aligned(byte_pairs, model)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), kind))


def tokens(docs: DataFrame, text_col: str = "text", byte_pairs: str | None = None, model: str | None = None) -> DataFrame:
    """A number and the row of each document with its counts, digest, distinct pairs and their multiplicities, written."""
    spark = docs.sparkSession
    for_python(spark)
    sent = []
    for path in (byte_pairs or bytes_path(), model or model_path()):
        with open(path, "rb") as f:
            sent.append(f.read())
    files = spark.sparkContext.broadcast(sent)
    lean = docs.select(F.monotonically_increasing_id().alias("n"), row_of(docs, text_col).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        both = aligned_of(*files.value)
        for batch in batches:
            found = both.documents(batch.column(2).to_pylist())
            n_a, n_b, n_groups, digests, pairs, times = zip(*found, strict=True) if found else [[]] * 6
            columns = [*[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)], pa.array(digests, pa.string()), _lists(pairs, pa.int64()), _lists(times, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["n", "row", *_TOKENS])

    schema = StructType([lean.schema["n"], lean.schema["row"]])
    for name in _TOKENS:
        schema = schema.add(name, {"pairs": ArrayType(LongType()), "times": ArrayType(IntegerType()), "groups_sha256": StringType()}.get(name, LongType()))
    return written(lean.mapInArrow(run, schema), "tokens")


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream (key, a, value, n), sorted by key: what each posting adds to its document.

    A key is B id, salt and kind; kind 0 has a pair's count, kind 1 a document's multiplicity.
    """
    sides, ids, counts = (np.zeros(0, np.int64) for _ in range(3))
    for batch in batches:
        key, a, value, n = (batch.column(k).to_numpy() for k in range(4))
        if not len(key):
            continue
        side, posting = key >> 1, (key & 1).astype(bool)
        # This batch's counts, behind those of the side that goes on from the batch before.
        sides, ids, counts = (np.concatenate([x, y[~posting]]) for x, y in ((sides, side), (ids, a), (counts, value)))
        here, rank = np.unique(sides, return_inverse=True)
        code = (rank << 32) | ids
        order = np.argsort(code)
        code, sorted_counts = code[order], counts[order]
        most = np.maximum.reduceat(sorted_counts, np.searchsorted(code, np.arange(len(here), dtype=np.int64) << 32)) if len(here) else sorted_counts
        of = np.searchsorted(here, side[posting])
        count = sorted_counts[np.searchsorted(code, (of << 32) | a[posting])]
        best = np.where(count == most[of], value[posting], 0)
        yield pa.RecordBatch.from_arrays([pa.array(n[posting]), pa.array(best), pa.array(value[posting] * count)], ["n", "best", "total"])
        last = sides == side[-1]
        sides, ids, counts = sides[last], ids[last], counts[last]


def align(docs: DataFrame, text_col: str = "text", byte_pairs: str | None = None, model: str | None = None) -> DataFrame:
    """``docs`` with its text replaced by n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    made = tokens(docs, text_col, byte_pairs, model)
    postings = made.select("n", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("n", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    counts = written(postings.groupBy("pair").agg(F.sum("times").alias("links"), F.count(F.lit(1)).alias("rows")), "pair-counts")
    b, a = F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")
    tasks = max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    even = max(1, (counts.agg(F.sum("rows")).first()[0] or 0) // (SHARE * tasks))
    # One row for each hot B id: no more than its vocabulary has, and than SHARE * tasks.
    salts = F.broadcast(counts.groupBy(b.alias("b")).agg(F.ceil(F.sum("rows") / even).cast("int").alias("salts")).where("salts > 1"))
    spread = F.coalesce("salts", F.lit(1))

    def keyed(rows: DataFrame, salt, kind: int, value: str, n) -> DataFrame:
        met = rows.withColumn("b", b).join(salts, "b", "left").select(F.col("b"), salt.alias("salt"), a.alias("a"), F.col(value).alias("value"), n.alias("n"))
        side = F.shiftleft(F.col("b").cast("long"), 31).bitwiseOR(F.col("salt").cast("long"))
        return met.select(F.shiftleft(side, 1).bitwiseOR(F.lit(kind).cast("long")).alias("key"), "a", "value", "n")

    known = keyed(counts, F.explode(F.sequence(F.lit(0), spread - 1)), 0, "links", F.lit(0).cast("long"))
    of_docs = keyed(postings, F.pmod(F.xxhash64("n"), spread), 1, "times", F.col("n"))
    stream = known.unionByName(of_docs).repartition(tasks, F.shiftright("key", 1)).sortWithinPartitions("key")
    added = stream.mapInArrow(_contributions, "n long, best long, total long").groupBy("n").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    found = made.drop("pairs", "times").join(added, "n", "left").withColumn("n_links", F.col("n_groups"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    found = found.select("row", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    return beside(found, [c for c in docs.columns if c != text_col], found.columns[1:])


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the byte pairs and the pieces of every document end together, and how usual its pairs are in all documents."""
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))
