"""Alignment against a brute-force version that uses the libraries over whole texts."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from helpers import clashing, docs, empty, odd
from pixelloom.llm import align_tokens as m
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(m.bytes_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=m.model_path())


def brute(texts, libraries):
    a, b = libraries
    letters, spelt, links = m._byte_letters(), {k: w for w, k in a.get_vocab().items()}, []
    for text in texts:
        groups, pairs = [], []
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        part_a = [bytes(letters[c] for c in spelt[k]) for k in ids_a]
        part_b = [bytes([int(b.id_to_piece(k)[1:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if text and b"".join(part_a) == b"".join(part_b) == (" " + text).encode():
            ends_a, ends_b = _ends(part_a), _ends(part_b)
            i = j = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                x, y = ends_a[end] + 1, ends_b[end] + 1
                groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
                pairs.append((ids_a[x - 1], ids_b[y - 1]))
                i, j = x, y
        else:
            ids_a = ids_b = []
        links.append((len(ids_a), len(ids_b), groups, pairs))
    count = Counter(p for x in links for p in x[3])
    most = Counter()
    for (_, k), c in count.items():
        most[k] = max(most[k], c)
    return [
        (n_a, n_b, len(g), len(p), sum(count[x] == most[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
        for n_a, n_b, g, p in links
    ]


def _ends(parts):
    out, at = {}, 0
    for k, p in enumerate(parts):
        at += len(p)
        out[at] = k
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def found(df, names=FIELDS):
    return sorted(tuple(r[c] for c in names) for r in m.align(df).collect())


def generated(seed, n):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\n ", " \n", "\t", " ", "\x1c", "a", "the", " the", "tion", "'s", "1", "23", ".", "...", "é", "漢字", "🙂", "<|endoftext|>", "<s>", " an", "\x00", "́", "▁"]
    weights = [3] * (len(parts) - 1) + [0.05]
    return ["".join(rng.choices(parts, weights, k=rng.choice([1, 3, 8, 40]))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_generated_texts(spark, libraries, seed):
    texts = [*generated(seed, 400), None, "", " ", "  ", "▁", "a ▁b"]
    assert found(docs(spark, texts).repartition(3)) == sorted(brute(texts, libraries))


def test_hot_ids_and_small_batches(spark, libraries, monkeypatch):
    """One B id holds most links; salts and batches that cut a side leave the sums as they are."""
    texts = [*["the " * k + "end" for k in range(1, 60)], *generated(7, 100)]
    monkeypatch.setattr(m, "SHARE", 50)
    expected = sorted(brute(texts, libraries))
    assert found(docs(spark, texts)) == expected
    once = m.for_python

    def tiny(session):
        once(session)
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")

    monkeypatch.setattr(m, "for_python", tiny)
    assert found(docs(spark, texts)) == expected


def test_odd_rows(spark, libraries):
    texts = [r.text for r in odd(spark).collect()]
    assert found(odd(spark)) == sorted(brute(texts, libraries))
    rows = m.align(clashing(odd(spark)).withColumnRenamed("items", "n_best").withColumnRenamed("of", "n"))
    assert rows.where("n_best = 'mine items' and n = 'mine of' and row = 'mine row'").count() == len(texts)
    assert sorted(r["n_best_"] for r in rows.collect()) == sorted(x[4] for x in brute(texts, libraries))
    assert m.align(empty(spark)).count() == 0


def test_words_are_forgotten(spark, libraries, monkeypatch):
    with open(m.bytes_path(), "rb") as f, open(m.model_path(), "rb") as g:
        both = m.Aligned(f.read(), g.read())
    texts = generated(11, 120)
    expected = [x[:3] for x in brute(texts, libraries)]
    monkeypatch.setattr(m, "REMEMBERED", 30)
    monkeypatch.setattr(m, "LONGEST", 12)
    monkeypatch.setattr(m, "PIECE", 7)
    for at in range(0, 120, 8):
        assert [x[:3] for x in both.documents(texts[at : at + 8])] == expected[at : at + 8]
        assert not any(len(w) > 12 for w in both.words)


def test_stretches():
    assert m.stretches("a b  c\n d") == ["a", "b  c\n d"] and m.stretches(" a b") == [" a", "b"] and m.stretches("a b ") == ["a", "b "]


def test_query(spark, libraries):
    from support import DATA

    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    expected = sorted((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], libraries), strict=True))
    got = m.op11_align_tokens(spark, DATA)
    assert set(got.columns) == {"doc_id", *FIELDS}
    assert sorted(tuple(r[c] for c in ("doc_id", *FIELDS)) for r in got.collect()) == expected
