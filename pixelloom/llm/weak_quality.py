"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns estimates how often each labeller
votes what on good and on bad documents, and so the probability that a pattern's
documents are good. Those posteriors label a sample of documents, on which a
hashed linear scorer is trained; the scorer grades every document by its text
alone, so that it also decides where labellers are silent.

At scale: votes are one native projection, and pattern counts one aggregation
with partial sums: at most 3 ** len(LABELLERS) rows reach the driver. The
training sample is ``TRAIN_ROWS`` documents at most, the first by a hash of all
their columns from all documents, and comes to the driver as hashed counts of
``BUCKETS`` numbers; a sampled row's votes and counts are made in one pass. Scoring is one pass with the weights (some 16 KB) broadcast.

Defined results
* null text, or no words: score 0, not kept. Very long text: hashed whole.
* repeated rows: scored alike, one of them in the sample at most. Equal or null doc_ids: rows of their own.
* empty table: empty result. Extra columns: kept by ``score``; its own are score_ and kept_ where the input has such names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, for_python, hash_uniform, row_keys, row_of, table
from .quality_rules import measure

#: (name, metric, bad over, good under): a vote in between is silent; negative pairs are read the other way round.
#: Texts of fewer than ENOUGH words say little: nothing but their length is held against them.
LABELLERS = (
    ("symbols", "symbol_ratio", 0.40, 0.02),
    ("shouting", "mark_ratio", 0.60, 0.05),
    ("repetition", "repeat_ratio", 0.30, 0.15),
    ("duplicate lines", "dup_line_ratio", 0.50, 0.25),
    ("letters", "letter_ratio", -0.75, -0.88),
    ("stop words", "n_stop_words", -1.0, -4.0),
    ("length", "n_words", -4.0, -50.0),
    ("word length", "mean_word_chars", 7.5, 6.5),
)
ENOUGH = 20
TRAIN_ROWS = 4000
BUCKETS = 4096
EM_ROUNDS = 50
KEEP = 0.72


def votes(q: Column) -> Column:
    """The labellers' votes on a measurement: 1 good, -1 bad, 0 silent."""
    out = []
    for _, metric, bad, good in LABELLERS:
        value = q[metric].cast("double")
        is_bad, is_good = (value < -bad, value >= -good) if bad < 0 else (value > bad, value <= good)
        if metric != "n_words":
            is_bad = is_bad & (q["n_words"] >= ENOUGH)
        out.append(F.when(is_bad, -1).when(is_good, 1).otherwise(0))
    return F.array(*out)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray]:
    """Share of good documents, and the table (labeller, class, vote) of vote probabilities; votes -1, 0, 1, classes bad, good.

    Starts from labellers that are right three times in four where they vote;
    one pseudo-document per class and vote keeps probabilities off zero.
    """
    n = patterns.shape[1]
    chance = np.tile(np.array([[0.6, 0.2, 0.2], [0.2, 0.2, 0.6]]), (n, 1, 1))
    good = 0.7
    for _ in range(rounds if len(patterns) else 0):
        p = posterior(patterns, good, chance)
        weight = np.stack([counts * (1 - p), counts * p])
        good = float((weight[1].sum() + 1) / (weight.sum() + 2))
        for vote in range(3):
            chance[:, :, vote] = 1 + ((patterns == vote - 1).T[:, None, :] * weight[None]).sum(axis=2)
        chance /= chance.sum(axis=2, keepdims=True)
    return good, chance


def posterior(patterns: np.ndarray, good: float, chance: np.ndarray) -> np.ndarray:
    """Probability that documents with these votes are good."""
    at = patterns + 1
    logs = np.log(np.array([1 - good, good]))[:, None] + sum(np.log(chance[j][:, at[:, j]]) for j in range(at.shape[1]))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of hashed byte triples; the last bucket has the share of repeated word windows."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words = (text or "").split()
    if not words:
        return None
    codes = np.zeros(len(data) + 2, np.uint32)
    for k in range(3):
        codes[k : k + len(data)] = codes[k : k + len(data)] * np.uint32(257) + data
    hashed = (codes * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS - 1).bit_length())
    counts = np.bincount(hashed, minlength=BUCKETS).astype(np.float32)
    out = np.sqrt(counts / counts.sum())
    # Python's hashes of words differ between processes, which of them are equal does not.
    window = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for by in (1, 2, 4):
        window = window[:-by] * np.uint64(0x9E3779B97F4A7C15) + (window[by:] ^ (window[by:] >> np.uint64(29)))
    out[-1] = 1 - len(np.unique(window)) / len(window) if len(window) else 0
    return out


def train(rows: np.ndarray, labels: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer on soft labels, by Adam over all rows."""
    x = np.concatenate([rows, np.ones((len(rows), 1), np.float32)], axis=1)
    w = np.zeros(BUCKETS + 1, np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1 if len(rows) else 1):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - labels).astype(np.float32) / len(x) + decay * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return w


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, seed: str = "weak-1") -> np.ndarray:
    """The scorer's weights, from the votes of all documents and the texts of at most ``train_rows`` different rows."""
    for_python(docs.sparkSession)
    k1, k2 = row_keys(docs)
    lean = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    metrics = tuple(metric for _, metric, _, _ in LABELLERS)
    voted = lambda df: measure(df, "text", "q", metrics).withColumn("votes", votes(F.col("q"))).drop("q")
    counted = voted(lean).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([r["votes"] for r in counted], np.int64).reshape(-1, len(LABELLERS))
    good, chance = fit_labels(patterns, np.array([r["n"] for r in counted], np.float64))
    # Somewhat more than asked for, then the first by draw; equal rows share their draw and count once.
    share = min(1.0, 1.25 * train_rows / max(1, sum(r["n"] for r in counted)))
    drawn = lean.withColumn("draw", hash_uniform(seed, F.col("k1"), F.col("k2"))).where(F.col("draw") < share)
    drawn = drawn.groupBy("k1", "k2", "draw").agg(F.first("text").alias("text")).where(F.col("text").isNotNull())

    def hashed(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            packed = [None if r is None else r.astype("<f2").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("votes"), pa.array(packed, pa.binary())], ["draw", "votes", "x"])

    sample = voted(drawn).select("draw", "votes", "text").mapInArrow(hashed, "draw double, votes array<int>, x binary").where("x IS NOT NULL")
    rows = sample.orderBy("draw", "x").limit(train_rows).select("x", "votes").collect()
    x = np.array([np.frombuffer(r["x"], "<f2") for r in rows], np.float32).reshape(-1, BUCKETS)
    return train(x, posterior(np.array([r["votes"] for r in rows], np.int64).reshape(-1, len(LABELLERS)), good, chance))


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``docs`` with the text replaced by ``score`` (0 to 1) and ``kept``."""
    for_python(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    lean = docs.select(row_of(docs, text_col).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                x = features(text)
                out.append(0.0 if x is None else round(float(1 / (1 + np.exp(-np.clip(x @ shared.value[:-1] + shared.value[-1], -500, 500)))), 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array([s >= keep for s in out], pa.bool_())], ["row", "score", "kept"])

    from pyspark.sql.types import BooleanType, DoubleType, StructType

    found = lean.mapInArrow(run, StructType([lean.schema["row"]]).add("score", DoubleType()).add("kept", BooleanType()))
    return beside(found, [c for c in docs.columns if c != text_col], ["score", "kept"])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs))
