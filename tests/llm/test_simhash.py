import random

import numpy as np
import pytest
import xxhash
from helpers import clashing, docs, empty, odd
from pixelloom.llm import simhash as s
from pixelloom.llm.components import components


def slow_print(text, shingle=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(codes, radius):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for k in range(len(codes)):
        groups.setdefault(find(k), []).append(codes[k])
    return sorted(sorted(g) for g in groups.values())


def test_fingerprints():
    for text in (None, "", " \n", "One", "one TWO", "one two three", "a b c d e a b c", "é ñ x y z", "w " * 70_000):
        assert s.fingerprint(text) & (1 << 64) - 1 == slow_print(text)


def cluster(seed, n, spread, strays):
    rng = random.Random(seed)
    base, codes = rng.getrandbits(64), set()
    while len(codes) < n:
        code = base
        for _ in range(rng.randint(0, spread)):
            code ^= 1 << rng.randrange(64)
        codes.add(code)
    return sorted(codes | {rng.getrandbits(64) for _ in range(strays)})


def test_index_finds_all_pairs():
    for seed, spread in ((1, 3), (2, 6)):
        codes = np.array(cluster(seed, 300, spread, 700), np.uint64)
        index = s.GrayIndex(codes)
        at, node = index.within(index.codes, 2)
        expected = {(i, int(j)) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(index.codes ^ index.codes[i]) <= 2)}
        assert set(zip(at.tolist(), node.tolist(), strict=True)) == expected


@pytest.mark.parametrize(("hot", "last_bits"), [(2048, 14), (20, 14), (5, 40)])
def test_links_against_brute_force(spark, hot, last_bits):
    codes = cluster(3, 300, 4, 100)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    root = {r.node: r.root for r in components(s.links(df, 2, hot, last_bits)).collect()}
    groups = {}
    for c in codes:
        signed = c - (1 << 64) if c >> 63 else c
        groups.setdefault(root.get(signed, signed), []).append(c)
    assert sorted(sorted(g) for g in groups.values()) == brute_classes(codes, 2)


def test_components(spark):
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(200)]
    loose = [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(50)]
    rows = [*chain, *loose, (5, 5), (None, 3), *chain[:3]]
    root = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(root[k] == 0 for k in range(201))
    for a, b in loose:
        assert a == b or root[a] == root[b] <= min(a, b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows(spark):
    rows = s.near_duplicates(odd(spark)).collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(by[1]) == [1, 4, 4] and sorted(by[2]) == [2, 3, 5] and by[6] == [6] and by[None] == [None]
    assert s.near_duplicates(empty(spark)).count() == 0


def test_keep_one(spark):
    text = " ".join(f"w{k}" for k in range(400))
    said = [text, text, text.upper(), "something else entirely here", None, ""]
    kept = s.keep_one(clashing(docs(spark, said)))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4] and kept.first().fp == "mine fp"
    assert sorted(str(r.doc_id) for r in s.keep_one(odd(spark)).collect()) == ["1", "2", "6", "None"]
    assert s.keep_one(empty(spark)).count() == 0


def test_keep_one_of_equal_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text, {"a": 1})] * 4 + [(7, "an own text of this id", {"a": 2}), (7, "another text under the same id", {"a": 2}), (None, "only here", {})]
    kept = s.keep_one(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")).collect()
    assert sorted(r.text[:9] for r in kept) == ["an own te", "another t", "only here", text[:9]]
