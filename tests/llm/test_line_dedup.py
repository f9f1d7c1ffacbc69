import random

import numpy as np
import pyarrow as pa
from helpers import clashing, docs, empty, odd
from pixelloom.llm import common
from pixelloom.llm import line_dedup as d
from pixelloom.llm import wordhash


def brute(texts):
    """Positions (doc, line) that go."""
    lines = [(k, p, d.line_words(x)) for k, t in enumerate(texts) for p, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= d.MIN_WORDS]
    gone = set()
    for i, (k, p, ws) in enumerate(lines):
        for _, _, other in lines[:i]:
            if ws == other or min(len(ws), len(other)) >= d.FUZZY_WORDS and d.one_edit(ws, other):
                gone.add((k, p))
    return gone


def edited(rng, words):
    words, k = list(words), rng.randrange(len(words))
    return rng.choice([words[:k] + words[k + 1 :], words[:k] + ["new"] + words[k + 1 :], words[:k] + ["more"] + words[k:], words])


def texts(seed, n=60):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 14))] for _ in range(25)]
    out = []
    for _ in range(n):
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(base)
            for _ in range(rng.randint(0, 2)):
                words = edited(rng, words) or words
            lines.append(" ".join(words).title() if rng.random() < 0.3 else "  ".join(words))
        out.append("\n".join(lines))
    return out


def found(spark, said, **options):
    """Positions (doc, line) that the operator finds."""
    keyed = docs(spark, said).selectExpr("doc_id AS id", "doc_id AS k1", "-doc_id AS k2", "text")
    gone, repeated = d.repeated_lines(keyed, **options)
    assert repeated.isEmpty()
    return {(r.k1, r.pos) for r in gone.collect()}


def test_against_brute_force(spark):
    for seed in range(3):
        said = texts(seed)
        assert found(spark, said) == brute(said)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    said = texts(9, 30)
    monkeypatch.setattr(d, "holds", lambda filter_, numbers: np.ones(numbers.shape, bool))
    assert found(spark, said, max_bits=17) == brute(said)


def test_equal_and_null_ids_against_brute_force(spark):
    """Rows go by their own lines, whatever id they share; equal ids and null ones are ordered by their hashes."""
    rng = random.Random(4)
    said = texts(11, 80)
    rows = [(rng.choice([None, None, 7, 7, 7, 8, k]), t) for k, t in enumerate(said)]
    rows = list({(i, t): None for i, t in rows})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    k1, k2 = common.row_keys(df)
    order = sorted(((r.doc_id is None, r.doc_id or 0, r.k1, r.k2, r.text) for r in df.withColumn("k1", k1).withColumn("k2", k2).collect()))
    gone, expected = brute([t for *_, t in order]), []
    for k, (none, i, _, _, t) in enumerate(order):
        left = [x for p, x in enumerate(t.split("\n")) if (k, p) not in gone]
        if any(map(d.line_words, left)):
            expected.append((None if none else i, "\n".join(left)))
    got = [(r.doc_id, r.text) for r in d.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_unique_lines_of_rows_without_id_stay(spark):
    rows = [(1, "a copied line\nfirst"), (None, "a copied line\nunique precious sentence of A"), (None, "unique precious sentence of B\na copied line")]
    got = sorted(r.text for r in d.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == ["a copied line\nfirst", "unique precious sentence of A", "unique precious sentence of B"]


def test_maps_and_repeated_rows(spark):
    rows = [(1, "one line\ntwo lines", {"a": 1})] * 3 + [(1, "one line\nother words", {"a": 2})]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    got = sorted(r.text for r in d.dedup_lines(df).collect())
    assert len(got) == 2 and sorted("\n".join(got).split("\n")) == ["one line", "other words", "two lines"]


def test_one_edit():
    one = lambda a, b: d.one_edit(list(a), list(b))
    assert one("abc", "abc") and one("abc", "abd") and one("abc", "ac") and one("ac", "abc") and one("abc", "abcd") and one("", "a")
    assert not one("abc", "bca") and not one("abc", "cba") and not one("ab", "abcd")


def test_documents(spark):
    long = "one two three four five six seven eight nine"
    said = [f"{long}\nown line", f"{long} ten\nother line", f"{long}", "word", "word", None, ""]
    rows = {r.doc_id: r for r in d.dedup_lines(clashing(docs(spark, said))).collect()}
    assert rows[0].text == said[0] and rows[1].text == "other line" and rows[1].n_chars == 10 and rows[1].gone == "mine gone"
    assert 2 not in rows and rows[3].text == rows[4].text == "word" and rows[5].text is None and rows[6].text == ""


def test_rows(spark):
    rows = d.dedup_lines(odd(spark)).collect()
    # Documents 4 (twice) say what 1 says; all others stay.
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "5", "6", "None"]
    assert d.dedup_lines(empty(spark)).count() == 0
    same = docs(spark, ["a b c"]).unionByName(docs(spark, ["a b c"]))
    assert d.dedup_lines(same).count() == 1


def test_hashes_of_many_words():
    words = [str(k) for k in range(3000)]
    hashed = wordhash.LineHashes(wordhash.Words(pa.array([" ".join(words), " ".join(words[:-1]), ""]), lines=False))
    line, place, without, _ = hashed.variants()
    assert without[(line == 0) & (place == 2999)][0] == hashed.whole()[1] and len(set(without.tolist())) == len(without)


def test_words_and_lines_of_a_batch():
    rng = random.Random(0)
    pieces = ["a", "B", "word", "longerthaneightbytes", "é", "x" * 300, " ", "\n", "\t", "\n\n", "\r", "  ", "ABCdefgh", "abcdefgh"]
    said = [None, "", "\n"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got, numbers = wordhash.Words(pa.array(said)), {}
    expected = [(r, p, line) for r, t in enumerate(said) for p, line in enumerate((t or "").split("\n"))]
    assert [(r, p) for r, p, _ in expected] == list(zip(got.row.tolist(), got.pos.tolist(), strict=True))
    for k, (_, _, line) in enumerate(expected):
        hashes = got.hash[got.first[k] : got.first[k + 1]].tolist()
        assert got.line(k) == line and len(hashes) == len(d.line_words(line))
        for w, h in zip(d.line_words(line), hashes, strict=True):
            assert numbers.setdefault(w, h) == h
    assert len(set(numbers.values())) == len(numbers)
    assert wordhash.Words(pa.array(["zz", *said]).slice(1)).hash.tolist() == got.hash.tolist()
