import random

import corpus_pipeline as p
import pytest
from helpers import docs, empty, odd
from pixelloom.llm import similar as s


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """Positions of the first text of each class, by all pairs."""
    held, root = [sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(held[i] & held[j])
            if 5 * both >= 4 * (len(held[i]) + len(held[j]) - both) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return sorted(set(root))


def said(seed, n):
    """Texts and changed copies of them, some at the edge of the similarity, some with a shared passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, out = [word() for _ in range(20)], []
    for _ in range(n):
        words = [word() for _ in range(rng.choice([3, 8, 40, 150]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [s.HOT, 3, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(s, "OFTEN", 3)
    texts = said(1, 60)
    assert max(len(sets(t)) for t in texts) > 2 * s.SKETCH
    assert sorted(r.doc_id for r in s.keep_one(docs(spark, texts), hot=hot).collect()) == brute(texts)


def test_stage_drops_copies_with_two_changed_words_a_line(spark):
    rng = random.Random(2)
    lines = [[f"w{rng.randrange(9000)}" for _ in range(60)] for _ in range(4)]
    copy = [[*x[:20], "other", *x[21:40], "words", *x[41:]] if k < 2 else x for k, x in enumerate(lines)]
    texts = ["\n".join(" ".join(x) for x in t) for t in (lines, copy)]
    assert [r.doc_id for r in p.near_dedup_stage(spark, docs(spark, texts), "").collect()] == [0]


def test_one_row_of_a_class_stays_with_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (7, text), (7, text), (7, "another text of this id"), (None, "only here"), (None, "only here")]
    kept = s.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text[:9]) for r in kept) == [("7", "another t"), ("7", text[:9]), ("None", "only here")]
    assert s.keep_one(empty(spark)).count() == 0 and s.keep_one(odd(spark)).columns == odd(spark).columns


def test_hot_groups_against_brute_force(spark):
    """Many changed copies of one text, some of them like each other but not like the first."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    base, texts = [word() for _ in range(120)], []
    for _ in range(25):
        changed = list(base)
        for _ in range(rng.randint(3, 14)):
            changed[rng.randrange(len(changed))] = word()
        for _ in range(rng.randint(1, 3)):
            copy = list(changed)
            copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    assert sorted(r.doc_id for r in s.keep_one(docs(spark, texts), hot=2).collect()) == brute(texts)


def test_fingerprints_find_what_lies_within_the_radius(spark):
    """The pairs that SimHash gives connect what all pairs of fingerprints within the radius connect, and the stage goes through them."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    words, texts = [f"w{rng.randrange(5000)}" for _ in range(600)], []
    for _ in range(40):
        copy = list(words)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = "other"
        texts.append(" ".join(copy))
    texts += said(8, 20)
    found = s.shingles(pa.array(texts))
    prints = [s.fingerprint(h) for h in found]
    hashes = found[0].view(np.uint64)
    assert prints[0] & (1 << 64) - 1 == sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in hashes) > len(hashes))

    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= s.RADIUS and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    pairs = [tuple(r) for r in s.print_pairs(spark.createDataFrame(list(enumerate(prints)), "sid long, fp long")).collect()]
    mine = list(range(len(texts)))
    for a, b in pairs:
        old, new = max(mine[a], mine[b]), min(mine[a], mine[b])
        mine = [new if r == old else r for r in mine]
    assert mine == root and len(set(root)) < len(set(found[k].tobytes() for k in range(len(texts))))


def test_stage_goes_through_fingerprints(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(s.simhash, "links", lambda *a, f=s.simhash.links, **b: asked.append(a) or f(*a, **b))
    text = " ".join(f"w{k}" for k in range(300))
    assert [r.doc_id for r in p.near_dedup_stage(spark, docs(spark, [text, text + " more", "another text"]), "").collect()] == [0, 2] and asked
