import random

from helpers import clashing, docs, empty, odd
from pixelloom.llm import decontaminate as d


def brute(words, items, window):
    hit, held = set(), set()
    for item, ws in items:
        size = min(len(ws), window)
        wins = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in wins:
                hit.update(range(k, k + size))
                held.add(item)
    return hit, held


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(800):
        alphabet = [bytes([97 + k]) for k in range(rng.choice([1, 2, 3]))]
        items = [(str(k), [rng.choice(alphabet) for _ in range(rng.randint(0, 7))]) for k in range(rng.randint(0, 4))]
        words = [rng.choice([*alphabet, b"z"]) for _ in range(rng.randint(0, 30))]
        window = rng.randint(1, 5)
        ranges, held = d.scan(words, d.build(items, window))
        assert ({x for a, b in ranges for x in range(a, b)}, held) == brute(words, items, window)
        assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))


def test_words():
    assert d.folded_words("Ab-c 1é\x00Ñ_z") == ["ab".encode(), b"c", "1é".encode(), "Ñ".encode(), b"z"]
    assert d.folded_words(None) == []


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_shards_give_the_same(spark):
    texts = [f"x {ITEM} y", ITEM, ITEM, "one two", None, "", "short words here", " ".join(ITEM.split()[::-1])]
    items = bench(spark, [ITEM, "short words here", None, "", " ".join(ITEM.split()[3:] + ["more", "of", "it"])])
    one = d.hits(docs(spark, texts).select("doc_id", "text"), items)
    for size in (10, 11, 13, 20):
        more = d.hits(docs(spark, texts).select("doc_id", "text"), items, shard_words=size)
        assert sorted(map(str, one.collect())) == sorted(map(str, more.select(one.columns).collect()))


def test_shards_take_maps_null_ids_and_clashes(spark):
    texts = [f"x {ITEM} y", "short words here", f"{ITEM} short words here", "nothing at all"]
    items = spark.createDataFrame([(1, ITEM), (None, "short words here"), (None, ITEM + " more"), (3, "other words of an item")], "item_id long, text string")
    rows = [(k, t, {"a": k}, "mine") for k, t in enumerate(texts)] + [(0, texts[0], {"a": 0}, "mine")]
    held = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, items string")
    one = sorted((r.doc_id, r["items"], r.n_words, r.starts, r.ends, r.items_) for r in d.hits(held, items).collect())
    assert one == sorted((r.doc_id, r["items"], r.n_words, r.starts, r.ends, r.items_) for r in d.hits(held, items, shard_words=12).collect())
    assert one[0] == one[1] == (0, "mine", 14, [1], [13], ["1", None]) and one[2][5] == [None] and one[4][5] == []


def test_clean(spark):
    long = " ".join(f"w{k}" for k in range(40))
    texts = [f"{long}. {ITEM.upper()}! end", ITEM, long, None, ""]
    rows = {r.doc_id: r for r in d.clean(clashing(docs(spark, texts)), bench(spark, [ITEM])).collect()}
    assert rows[0].text == f"{long}. ! end" and rows[0].n_chars == len(rows[0].text) and rows[0].items == "mine items"
    assert 1 not in rows and rows[2].text == long and rows[3].text is None and rows[4].text == ""


def test_rows(spark):
    assert d.hits(odd(spark), bench(spark, [ITEM])).count() == 8
    assert d.hits(odd(spark), bench(spark, [])).where("size(starts) > 0").count() == 0
    assert d.hits(empty(spark), bench(spark, [ITEM])).count() == 0
    assert sorted(map(str, d.clean(odd(spark), bench(spark, [ITEM])).collect())) == sorted(map(str, odd(spark).collect()))


def test_repeated_words_take_linear_time():
    import time

    def seconds(n):
        words = [b"junk"] * n
        began = time.process_time()
        automaton = d.build([("a", words), ("b", [b"junk"] * 3)], 10)
        ranges, items = d.scan(words, automaton)
        assert ranges == [(0, n)] and items == {"a", "b"}
        return time.process_time() - began

    seconds(1000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.02)
