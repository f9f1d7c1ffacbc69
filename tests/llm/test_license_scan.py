from helpers import clashing, docs, empty, odd
from pixelloom.llm import license_scan as s

WORDS = "some words of a text that says nothing at all about terms "


def test_places():
    index = s.Index()
    r = s.scan("MIT license, mit License. CC-BY cc by cc BY gnu general public licenses", index, {})
    assert r[:6] == (14, 5, 0, 8, ["cc-by", "mit"], ["cc-by", "mit"])
    assert s.scan(None, index, {}) == (0, 0, None, None, [], [], 0.0)
    assert s.scan("mit\nlicense", index, {})[1:4] == (1, 0, 0)


def test_brute_force():
    import random

    rng = random.Random(1)
    index = s.Index()
    pool = "gnu general public license apache mit cc by x".split()
    for _ in range(300):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 40))]
        starts = [k for k in range(len(words)) for p in s.PHRASES if words[k : k + len(p.split())] == p.split()]
        got = s.scan(" ".join(words), index, {})
        assert got[1:4] == (len(starts), min(starts, default=None), max(starts, default=None))


def test_texts_are_found_by_position():
    index = s.Index()
    for label, (text, _) in s.TEMPLATES.items():
        assert label in s.scan(WORDS * 9 + text + " " + WORDS, index, {})[5], label
    scattered = " ".join(w for word in s.TEMPLATES["mit"][0].split() for w in (word, *WORDS.split()))
    assert s.scan(scattered, index, {})[5] == []
    assert s.scan(WORDS * 50, index, {})[5] == []


def test_frequencies_are_of_all_documents(spark):
    index = s.Index()
    idf = s.word_idf(docs(spark, ["software"] * 9 + ["permission granted", None]), "text", index)
    assert idf[b"software"] < idf[b"permission"] < idf[b"merchantability"]


def test_rows(spark):
    rows = s.find(clashing(odd(spark))).collect()
    assert len(rows) == 8 and all(r.labels_ == [] and r.labels == "mine labels" and r.first_word is None and r.score_ == 0 for r in rows)
    assert s.find(empty(spark)).count() == 0


def test_two_notices_under_skewed_frequencies():
    """The words of the one notice are all rarer than those of the other."""
    index = s.Index()
    for rare in s.TEMPLATES:
        for other in s.TEMPLATES:
            idf = {w: 5.0 if w in index.words[rare] and w not in index.words[other] else 0.1 for w in index.vocabulary}
            text = WORDS + s.TEMPLATES[rare][0] + " " + WORDS * 3 + s.TEMPLATES[other][0]
            assert {rare, other} <= set(s.scan(text, index, idf)[5]), (rare, other)


def test_chance_words_take_no_places():
    index = s.Index()
    idf = {w: 0.1 if w in index.words["bsd"] else 5.0 for w in index.vocabulary}
    chance = " ".join(w.decode() for w in sorted(index.vocabulary) if w not in index.words["bsd"])
    assert "bsd" in s.scan(chance + " " + WORDS * 5 + s.TEMPLATES["bsd"][0], index, idf)[5]


def exhaustive(words, index):
    """Labels by trying every offset with every word of every template."""
    found = set()
    for label, template in index.words.items():
        cells = {}
        for k, w in enumerate(words):
            for place, t in enumerate(template):
                if t == w:
                    for c in ((k - place) // s.SLACK, (k - place) // s.SLACK + 1):
                        cells.setdefault(c, set()).add(w)
        for c, agreeing in cells.items():
            stretch = words[max(0, (c - 2) * s.SLACK) : max(0, (c + 2) * s.SLACK) + len(template)]
            inside = b" %b " % b" ".join(stretch)
            if len(agreeing) >= s.AGREE and any(key in inside for key in index.keys[label]):
                found.add(label)
    return found


def test_labels_are_those_of_an_exhaustive_alignment():
    import random

    rng, index = random.Random(3), s.Index()
    pool = [w.decode() for w in sorted(index.vocabulary)]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            template = rng.choice(list(s.TEMPLATES.values()))
            words = template[0].split()
            at = rng.randrange(len(words))
            parts += [" ".join(words[at : at + rng.randint(3, 60)]), rng.choice(template[1]), " ".join(rng.choices(pool, k=rng.randint(0, 30)))]
        rng.shuffle(parts)
        text, idf = " ".join(parts), {w: rng.choice([0.1, 2.0, 5.0]) for w in index.vocabulary}
        assert set(s.aligned(s.folded_words(text), index, idf)) == exhaustive(s.folded_words(text), index)


def test_rare_words_elsewhere_hide_nothing():
    """A notice's beginning, and further down rarer words of the same licence than any in it."""
    index = s.Index()
    words = s.TEMPLATES["mit"][0].split()
    begin, rest = set(s.folded_words(" ".join(words[:40]))), s.folded_words(" ".join(words[40:]))
    elsewhere = [w for w in dict.fromkeys(rest) if w not in begin][:14]
    idf = {w: 9.0 if w in elsewhere else 0.2 for w in index.vocabulary}
    text = " ".join(words[:40]) + " " + WORDS * 20 + " ".join(f"{w.decode()} {WORDS}" for w in reversed(elsewhere))
    assert len(elsewhere) == 14 and "mit" in s.scan(text, index, idf)[5]
