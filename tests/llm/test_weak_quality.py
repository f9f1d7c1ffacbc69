import math
import random
import re

import numpy as np
import pytest
from helpers import clashing, docs, empty, odd
from pixelloom.llm import weak_quality as w
from pixelloom.llm.quality_rules import STOP_WORDS

BENCH = "/root/testdata/sf0.01"


def test_em_recovers_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    accuracy = np.array([0.95, 0.8, 0.7, 0.9, 0.6])
    right = rng.random((4000, 5)) < accuracy
    votes = np.where(right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random((4000, 5)) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, chance = w.fit_labels(patterns, counts.astype(float))
    assert good == pytest.approx(0.7, abs=0.04)
    for j, a in enumerate(accuracy):
        assert chance[j, 1, 2] / (chance[j, 1, 2] + chance[j, 1, 0]) == pytest.approx(a, abs=0.05)
    assert ((w.posterior(votes, good, chance) > 0.5) == truth).mean() > 0.93


def test_features():
    assert w.features(None) is None and w.features(" \n") is None
    x = w.features("some words here")
    assert len(x) == w.BUCKETS and x[-1] == 0 and (x[:-1] ** 2).sum() <= 1.0001
    assert w.features("one two three four five six seven eight nine " * 20)[-1] > 0.9


def test_held_out_accuracy(spark):
    found = spark.read.parquet(f"{BENCH}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BENCH}/labels.parquet")
    got = w.score(found, w.fit(found)).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.35


def test_rows(spark):
    weights = w.fit(odd(spark))
    rows = w.score(clashing(odd(spark)), weights).collect()
    assert len(rows) == 8 and all(r.score_ == 0 and not r.kept_ and r.kept == "mine kept" for r in rows if r.doc_id in (2, 3, 5))
    assert len({r.score_ for r in rows if r.doc_id in (1, 4)}) == 1
    assert w.score(empty(spark), w.fit(empty(spark))).count() == 0
    assert w.score(docs(spark, ["a b"]), weights).count() == 1


def plain_votes(text):
    """The labellers' votes by counting in plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows, repeated = [tuple(words[k : k + 8]) for k in range(len(words) - 7)], set()
    for k, window in enumerate(windows):
        if windows.count(window) > 1:
            repeated |= set(range(k, k + 8))
    n, chars = len(words), sum(map(len, words))
    ratio = lambda a, b: a / b if b else 0.0
    symbols, marks = (sum(c in some for c in text) for some in ("#*$%&|<>", "!?"))
    letters = 1 - sum(0x20 < ord(c) < 0x7F and not c.isalpha() for c in text) / chars if chars else 0.0
    stops = len({x.lower() for x in words} & set(STOP_WORDS))
    long = n >= 20
    high = [(ratio(symbols, n), 0.40, 0.02), (ratio(marks, n), 0.60, 0.05), (ratio(len(repeated), n), 0.30, 0.15), (ratio(len(lines) - len(set(lines)), len(lines)), 0.50, 0.25)]
    out = [-1 if x > bad and long else 1 if x <= good else 0 for x, bad, good in high]
    out += [-1 if x < bad and long else 1 if x >= good else 0 for x, bad, good in ((letters, 0.75, 0.88), (stops, 1, 4))]
    out.append(-1 if n < 4 else 1 if n >= 50 else 0)
    mean = ratio(chars, n)
    return [*out, -1 if mean > 7.5 and long else 1 if mean <= 6.5 else 0]


def plain_posteriors(votes):
    """Expectation maximisation over documents, one at a time."""
    n = len(votes[0])
    chance = [{c: dict(zip((-1, 0, 1), ps)) for c, ps in ((0, (0.6, 0.2, 0.2)), (1, (0.2, 0.2, 0.6)))} for _ in range(n)]
    good = 0.7

    def of(v):
        bad_way, good_way = (math.prod([share, *(chance[j][c][v[j]] for j in range(n))]) for c, share in ((0, 1 - good), (1, good)))
        return good_way / (good_way + bad_way)

    for _ in range(50):
        ps = [of(v) for v in votes]
        good = (sum(ps) + 1) / (len(ps) + 2)
        for j in range(n):
            for c in (0, 1):
                seen = {x: 1.0 for x in (-1, 0, 1)}
                for v, p in zip(votes, ps, strict=True):
                    seen[v[j]] += p if c else 1 - p
                chance[j][c] = {x: y / sum(seen.values()) for x, y in seen.items()}
    return [of(v) for v in votes]


def plain_features(text):
    """Byte triples one at a time; None without words."""
    words, data = (text or "").split(), (text or "").encode()
    if not words:
        return None
    counts = [0] * 4096
    for p in range(len(data) + 2):
        code = 0
        for k in range(3):
            if k <= p < k + len(data):
                code = (code * 257 + data[p - k]) % 2**32
        counts[(code * 2654435761 % 2**32) >> 20] += 1
    out = [math.sqrt(c / (len(data) + 2)) for c in counts]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    out[-1] = 1 - len(set(windows)) / len(windows) if windows else 0.0
    return out


def plain_scores(rows):
    """Scores of (id, text) rows: labels from all of them, weights by Adam in double precision from the different ones with words."""
    votes = [plain_votes(text) for _, text in rows]
    labels = dict(zip(rows, plain_posteriors(votes), strict=True))
    taught = [row for row in dict.fromkeys(rows) if plain_features(row[1]) is not None]
    x = np.array([[*np.array(plain_features(text)).astype(np.float16).astype(float), 1.0] for _, text in taught])
    y = np.array([labels[row] for row in taught])
    weights, m, v = (np.zeros(4097) for _ in range(3))
    for k in range(1, 301):
        g = ((1 / (1 + np.exp(-x @ weights)) - y)[:, None] * x).mean(axis=0) + 1e-4 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return [0.0 if plain_features(t) is None else 1 / (1 + math.exp(-float(np.dot([*plain_features(t), 1.0], weights)))) for _, t in rows]


def test_scores_against_brute_force(spark):
    rng = random.Random(4)
    plain = "the house and of garden is that with bird on wall was in old from tree a river small light".split()
    prose = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    said = [prose(rng.randint(5, 120)) for _ in range(30)] + ["\n".join([prose(12)] * rng.randint(2, 6)) for _ in range(8)]
    said += [" ".join(rng.choice(["##", "$%&", "buy!!!", "<<>>", "12345", "xqzv"]) for _ in range(rng.randint(2, 60))) for _ in range(15)]
    # Prose with more or less of other things in it: its labels and its bytes don't always agree.
    other = ["#", "!", "12345", "xqzv", "incomprehensible"]
    said += [" ".join(rng.choice(other if rng.random() < k / 30 else plain) for _ in range(rng.randint(3, 70))) for k in range(30)]
    said += ["incomprehensibilities " * 25, "é ñ ü " * 30, None, "", " \n\t", "one two"]
    rows = [(k, t) for k, t in enumerate(said)] + [(3, said[3])] * 4 + [(None, said[7]), (None, said[7])]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), round(r.score, 6), r.kept) for r in w.score(found, w.fit(found)).collect())
    expected = sorted((str(k), s) for (k, _), s in zip(rows, plain_scores(rows), strict=True))
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert max(abs(g[1] - e[1]) for g, e in zip(got, expected, strict=True)) < 2e-3
    assert all(g[2] == (e[1] >= w.KEEP) for g, e in zip(got, expected, strict=True) if abs(e[1] - w.KEEP) > 2e-3)
    assert sum(0.03 < s < 0.97 for _, s in expected) > 5
