import corpus_pipeline as p
from helpers import SCHEMA, clashing, empty, odd
from pixelloom.llm import decontaminate, quality_rules
from pixelloom.llm.common import written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    documents = docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        kept = written(stage(spark, docs, DATA), "t")
        assert kept.columns == documents.columns and kept.dtypes == documents.dtypes, name
        assert 0 < kept.count() <= docs.count()
        docs = kept
    assert quality_rules.keep_good(docs).count() > 0.8 * docs.count()
    found = decontaminate.hits(docs, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert found.where("size(starts) > 0").count() == 0
    mixed = p.STAGES[-1][1](spark, docs, DATA)
    assert mixed.count() == docs.count()


def test_run(spark):
    once, twice = (sorted(map(str, p.run(spark, DATA).collect())) for _ in range(2))
    assert once == twice and once


def test_odd_rows(spark):
    for name, stage in p.STAGES:
        for docs in (odd(spark), empty(spark), clashing(odd(spark))):
            stage(spark, docs, DATA).count()
    assert SCHEMA


def test_against_brute_force(spark, duck):
    """The first four stages, each by a plain version over all documents."""
    import re

    from pixelloom.llm import line_dedup
    from test_decontaminate import brute as hits
    from test_line_dedup import brute as repeated
    from test_similar import brute as similar

    kept = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({quality_rules.oracle_sql()}) WHERE kept").fetchall()}
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.doc_id in kept)

    gone, left = repeated([t for _, t in rows]), []
    for k, (doc, text) in enumerate(rows):
        lines = [x for p, x in enumerate(text.split("\n")) if (k, p) not in gone]
        if any(line_dedup.line_words(x) for x in lines):
            left.append((doc, "\n".join(lines)))

    left = [left[k] for k in similar([t for _, t in left])]

    items = [(str(i), decontaminate.folded_words(t)) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()]
    word, expected = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), []
    for doc, text in left:
        words = decontaminate.folded_words(text)
        hit, _ = hits(words, items, decontaminate.WINDOW)
        if len(hit) <= decontaminate.MAX_COVERAGE * len(words):
            spans, out, at = [m.span() for m in word.finditer(text)], "", 0
            for k in sorted(hit):
                if k - 1 not in hit:
                    out += text[at : spans[k][0]]
                if k + 1 not in hit:
                    at = spans[k][1]
            expected.append((doc, out + text[at:]))

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in p.STAGES[:4]:
        docs = written(stage(spark, docs, DATA), "t")
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == expected
