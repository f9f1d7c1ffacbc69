"""Pieces and spans against the library, over generated texts, other character maps and whole documents."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from helpers import clashing, docs, empty, odd
from pixelloom.llm import pieces as m
from sentencepiece import sentencepiece_model_pb2 as schema

ALPHABET = [" ", "  ", "▁", "a", "e", "t", "h", "\n", "\t", "é", "漢", "🙂", " ", "1", "2", ".", "=", "\x00", "́", "the", " the", "<s>", "<0x41>"]


@pytest.fixture(scope="module")
def own():
    with open(m.model_path(), "rb") as f:
        return m.Pieces(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=m.model_path())


def texts(seed, n, alphabet=ALPHABET):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 5, 30, 120]))) for _ in range(n)]


def test_pieces_and_spans(own, library):
    for text in texts(1, 1500):
        ids, begins, ends = own.encode(text)
        assert ids.tolist() == library.encode(text)
        data = text.encode()
        theirs = library.encode(text, return_type="proto").pieces
        assert [data[b:e].decode() for b, e in zip(begins, ends, strict=True)] == [p.surface for p in theirs]
        assert [(b, e) for b, e in zip(begins, ends, strict=True)] == [(p.begin, p.end) for p in theirs]


def test_decoding(own, library):
    rng = random.Random(2)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.choice([0, 1, 2, 259, 260, 29871])]) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == library.decode(ids), ids
    for text in texts(3, 1000):
        assert own.decode(library.encode(text)) == library.decode(library.encode(text))
    with pytest.raises(IndexError):
        own.decode([-1])
    with pytest.raises(IndexError):
        own.decode([32000])


def test_long_words(own, library):
    rng = random.Random(4)
    for size in (m.HEAP, m.HEAP + 1, 5000):
        for alphabet in ("ab", "ethanos", "0123", "漢字a"):
            text = "".join(rng.choices(alphabet, k=size))
            assert own.encode(text)[0].tolist() == library.encode(text)


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf", "identity"])
def test_character_maps(rule):
    alphabet = [*ALPHABET, "Ａ", "ﬁ", "①", "㌔", "ｶﾞ", "ß", "Σ", "İ", "　", "​", "が", "½", "…"]
    for prefix in (False, True):
        for fold in (False, True):
            theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, escape_whitespaces=True, add_dummy_prefix=prefix, remove_extra_whitespaces=fold)
            proto = schema.ModelProto()
            proto.ParseFromString(theirs.serialized_model_proto())
            own = m.Normaliser(proto.normalizer_spec.precompiled_charsmap, prefix, fold)
            for text in texts(5, 300, alphabet):
                expected, source = theirs.normalize(text, with_offsets=True)
                got, bytes_of = own(text)
                assert got == expected
                assert bytes_of.tolist() == [len(text[:k].encode()) for k in source]


def test_spans_through_a_character_map(own):
    """Pieces of rewritten characters have the span of what they came from."""
    theirs = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", escape_whitespaces=True, add_dummy_prefix=True, remove_extra_whitespaces=False)
    proto = schema.ModelProto()
    proto.ParseFromString(theirs.serialized_model_proto())
    with open(m.model_path(), "rb") as f:
        mapped = m.Pieces(f.read())
    mapped.normalise = m.Normaliser(proto.normalizer_spec.precompiled_charsmap, True, False)
    text = "ﬁne Ａ① test"
    ids, begins, ends = mapped.encode(text)
    assert ids.tolist() == own.encode("fine A1 test")[0].tolist()
    data = text.encode()
    assert b"".join(data[b:e] for b, e in zip(begins, ends, strict=True)) == data


def test_words_are_forgotten(own, library, monkeypatch):
    monkeypatch.setattr(m, "REMEMBERED", 5)
    text = " ".join(random.Random(6).choices(["one", "two", "three", "onetwo", "4", "five5", "sixes", "seven", "éé"], k=400))
    monkeypatch.setattr(own, "words", {})
    for at in range(0, len(text), 60):
        some = text[at : at + 60]
        assert own.encode(some)[0].tolist() == library.encode(some) and len(own.words) <= 5 + len(set(some.split(" ")))


@pytest.mark.parametrize("seed", range(3))
def test_many_words_at_once_are_merged_like_one(own, library, seed, monkeypatch):
    rng = random.Random(seed)
    words = list({"".join(rng.choices("▁ethanosr1é漢🙂\n=", [3, 9, 9, 6, 6, 6, 6, 6, 4, 1, 1, 1, 1, 1, 1], k=rng.randrange(1, 40))) for _ in range(3000)})
    assert own.table.segments(words) == [own.segment(w) for w in words]
    monkeypatch.setattr(m, "TOGETHER", 11)
    fresh = m.Pieces(open(m.model_path(), "rb").read())  # noqa: SIM115
    some = texts(seed + 20, 200)
    assert [f[0].tolist() for f in fresh.encode_many([*some, None, ""])] == [*map(library.encode, some), [], []]


def test_other_models_are_refused():
    proto = schema.ModelProto()
    with open(m.model_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.pieces[500].piece = "a▁b"
    with pytest.raises(ValueError):
        m.Pieces(proto.SerializeToString())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    with pytest.raises(ValueError):
        m.Pieces(proto.SerializeToString())


def test_odd_rows_and_round_trip(spark, library):
    for df in (odd(spark), clashing(odd(spark)).withColumnRenamed("items", "ids").withColumnRenamed("starts", "decoded").withColumnRenamed("ends", "begins")):
        found = m.encode(df)
        names = found.columns
        ids = "ids_" if "ids" in df.columns else "ids"
        rows = m.decode(found, ids).collect()
        assert len(rows) == df.count() and names[: len(df.columns) - 1] == [c for c in df.columns if c != "text"]
        expected = sorted(tuple(library.encode(r.text or "")) for r in df.collect())
        assert sorted(tuple(r[ids]) for r in rows) == expected
        out = "decoded_" if "decoded" in df.columns else "decoded"
        assert sorted(r[out] for r in rows) == sorted(library.decode(list(x)) for x in expected)
    assert m.decode(m.encode(empty(spark))).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.decoded for r in m.decode(nulls).orderBy("k").collect()] == ["", ""]


def test_query(spark, library):
    from support import DATA

    source = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = m.op13_pieces(spark, DATA).collect()
    assert len(rows) == len(source)
    for r in rows:
        ids = library.encode(source[r.doc_id])
        assert r.n_tokens == len(ids) and r.n_span_bytes == len(source[r.doc_id].encode())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_identity_alignment_is_contiguous(own):
    for text in texts(7, 200):
        _, begins, ends = own.encode(text)
        assert np.all(begins[1:] == ends[:-1]) and (not text or ends[-1] == len(text.encode()))


def test_documents_of_one_word(spark, library):
    rows = m.encode(docs(spark, ["x" * 300_000, "ab" * 10_000])).collect()
    assert sorted(len(r.ids) for r in rows) == sorted([len(library.encode("x" * 300_000)), len(library.encode("ab" * 10_000))])
