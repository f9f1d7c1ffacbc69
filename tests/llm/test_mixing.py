import hashlib
import random

import pytest
from helpers import clashing, empty, odd
from pixelloom.llm import mixing as m
from pyspark.sql import functions as F


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Water filling round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= cap * sizes[s]}
        if not over:
            out |= {s: weight[s] * level for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def plain_mix(rows, tilt=m.TILT, seed=m.SEED, cap=2):
    """Copies of each row (doc_id, source, size): expected copies by bisection, then one walk through each source's order."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    out, goal = [0] * len(rows), targets(sizes)
    for s, target in goal.items():
        mine = [(k, d, n, round(16 * 2 ** (tilt * (n.bit_length() - 1)))) for k, (d, x, n) in enumerate(rows) if x == s and n]
        low, high = 0.0, 1.0
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(n * min(cap, c * g) for _, _, n, g in mine) < target - 1e-7 else (low, c)
        order, room = [], target + 1e-6
        for k, d, n, g in mine:
            expected = min(cap, high * g)
            out[k] = int(expected + 1e-7)
            room -= out[k] * n
            p = expected - out[k]
            if p > 1e-7:
                tie = f"{seed}:{d}:" if d is not None else f"{seed}:"
                u = (int(hashlib.md5(tie.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                order.append((u / (1 - u) / (p / (1 - p)), d, n, k))
        room = int(room)
        for _, _, n, k in sorted(order):
            if n <= room:
                out[k], room = out[k] + 1, room - n
    return out, goal


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_takes(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "ä", None, "Z", "hot"]
    rows = [(k, rng.choice(names + ["hot"] * 6), rng.choice([0, 1, 5, 40, 300, rng.randint(1, 2000)])) for k in range(900)]
    got = m.mix_sizes(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(got) == 900
    copies, expected = plain_mix(rows)
    sizes, taken = {}, {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    for r in got:
        assert r.target == pytest.approx(expected[r.source], abs=1e-5) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        assert r.copies == copies[r.doc_id], r
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(40, 0.01 * t)


def test_what_is_left_is_less_than_any_document_left_out():
    """Over 50 tables, by the plain version that the operator is held against."""
    for seed in range(50):
        rng = random.Random(1000 + seed)
        rows = [(k, f"s{rng.randrange(1, 5)}", rng.randint(0, 400)) for k in range(rng.randint(20, 200))]
        copies, goal = plain_mix(rows)
        for s, t in goal.items():
            mine = [(n, c) for (_, x, n), c in zip(rows, copies, strict=True) if x == s and n]
            left = t - sum(n * c for n, c in mine)
            assert -1 <= left and (left < 1 or left <= max([n for n, c in mine if c < 2], default=1)), (seed, s)


def test_longer_texts_are_likelier(spark):
    rows = [(k, "a" if k < 2000 else "b", 20 if k % 2 else 400) for k in range(2600)]
    got = m.mix_sizes(spark.createDataFrame(rows, "doc_id long, source string, size long")).where("source = 'a'").collect()
    share = [sum(r.copies for r in got if r.size == n) / 1000 for n in (20, 400)]
    assert share[0] * 1.5 < share[1]


def test_reruns_agree_whatever_the_bins(spark, monkeypatch):
    rows = [(k, f"s{k % 4}", k % 97) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    once = sorted(map(str, m.mix_sizes(df).collect()))
    assert once == sorted(map(str, m.mix_sizes(df.repartition(7)).collect()))
    monkeypatch.setattr(m, "DIGIT", 1)
    monkeypatch.setattr(m, "LEVELS", 2)
    assert once == sorted(map(str, m.mix_sizes(df).collect()))


def test_every_document_has_its_chance(spark):
    rows = [(k, "a" if k % 3 else "b", 10) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    runs = [{r.doc_id: r.copies for r in m.mix_sizes(df, seed=f"s{k}").collect()} for k in range(3)]
    assert len({tuple(sorted(r.items())) for r in runs}) == 3


def test_null_ids_are_sampled_one_by_one(spark):
    rows = [(None, " ".join(f"w{k}" for k in range(n % 7 + 3)) + f" {n}", "a" if n % 5 else "b") for n in range(200)]
    got = m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 'a'").collect()
    assert len({(r.copies) for r in got if r.size == 6}) == 2


def test_copies_of_one_row_are_spread(spark, monkeypatch):
    """50,000 equal rows without an id among 60,000: few rows are left to walk through, and reruns agree."""
    df = spark.range(60_000).select(F.when(F.col("id") >= 50_000, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.when(F.col("id") >= 50_000, F.col("id") % 90).otherwise(7).alias("size"))
    walked, once = [], m.written

    def seen(df, name):
        out = once(df, name)
        if name == "mix-walk":
            walked.append(max([r["count"] for r in out.groupBy("source").count().collect()], default=0))
        return out

    monkeypatch.setattr(m, "written", seen)
    counts = [sorted(map(tuple, m.mix_sizes(d).groupBy("doc_id", "source", "size", "copies").count().collect()), key=repr) for d in (df, df.repartition(5))]
    assert counts[0] == counts[1] and max(walked) < 2000
    copies = {(r[1], r[3]) for r in counts[0] if r[0] is None and r[1] == "b"}
    assert len(copies) == 2


def test_order_follows_odds(spark):
    r = spark.range(1).select(*[m.pareto_order(F.lit(u), F.lit(p)).alias(f"x{k}") for k, (u, p) in enumerate([(0.2, 0.5), (0.4, 0.5), (0.2, 0.9), (0.5, 0.0)])]).first()
    assert r.x2 < r.x0 < r.x1 < r.x3 == 1.0 and r.x0 == pytest.approx(0.2)


def test_rows(spark):
    got = m.mix(clashing(odd(spark))).collect()
    assert len(got) == 8 and sum(r.size for r in got) == 3 * 6 + 27000 + 5
    assert m.mix(empty(spark)).count() == 0
    assert all(r.copies == 0 or r.size == 0 for r in m.mix_sizes(spark.createDataFrame([(1, "a", 0)], "doc_id long, source string, size long")).collect())
