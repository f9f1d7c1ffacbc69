import random
import re

from helpers import clashing, docs, empty, odd
from pixelloom.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, hit = {}, set()
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    for starts in seen.values():
        if len(starts) > 1:
            hit.update(x for k in starts for x in range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_measurements(spark):
    rng = random.Random(3)
    said = [None, "", " \x0b\n", "# a\n# a\n#  a", "a b c d e f g h " * 2, "a " * 40, "x y z \x1c w"]
    said += ["".join(rng.choice(["a", "bé", " ", "\n", "\t", "#", "|", "𝒳 "]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    rows = q.measure(docs(spark, said)).select("doc_id", "q.*").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(said[r.doc_id]), said[r.doc_id]


PROSE = "the cat of the house is in the garden and it sees that a bird was on the old wall with some other birds"


def test_verdicts(spark):
    said = [PROSE, " ".join(f"{w}&&&" for w in PROSE.split()), " ".join(f"{w.upper()}!!" for w in PROSE.split()), f"{PROSE} " * 5, "too short", "\n".join([PROSE] * 5), " ".join(f"xq{k}zz" for k in range(30))]
    kept = q.keep_good(clashing(docs(spark, said)))
    assert [r.doc_id for r in kept.collect()] == [0] and kept.first().q == "mine q"


def test_one_projection(spark):
    plan = q.measure(docs(spark, [PROSE]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_rows(spark):
    assert q.keep_good(odd(spark)).count() == 0
    assert q.measure(odd(spark)).count() == 8
    assert q.measure(empty(spark)).count() == 0


def test_columns_called_like_the_operators_own_stay(spark):
    mine = docs(spark, [PROSE, None]).selectExpr("*", "'w' AS __words", "'l' AS __LINES", "'m' AS __m", "'r' AS __row", "'t' AS __text")
    measured = q.measure(mine)
    assert measured.columns == [*mine.columns, "q"]
    rows = measured.orderBy("doc_id").collect()
    assert [(r["__words"], r["__LINES"], r["__m"], r["q"]["n_words"]) for r in rows] == [("w", "l", "m", len(PROSE.split())), ("w", "l", "m", 0)]
    assert q.keep_good(mine).columns == mine.columns and [r["__text"] for r in q.keep_good(mine).collect()] == ["t"]
