"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each rule bounds one measured ratio of the whole text. ``measure`` adds the
measurements, ``judge`` turns a rule table into the list of failed rules. Both
are narrow projections: no shuffle, no Python, rows are independent, so hot
sources and repeated rows cost nothing extra.

Defined results
* null or empty text: no words; ``min_words`` fails, every ratio is 0.
* very long text: measured whole (arrays of its words live in one row).
* repeated rows: judged alike. Empty table: empty result.
* extra columns, also with names used here: the query selects its own columns; ``measure`` keeps the input's
  (but one that is called like ``into``, which the measurements replace), ``keep_good`` all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, row_of, table, words_of

WINDOW = 8
SYMBOLS, MARKS = "#*$%&|<>", "!?"
#: Visible ASCII that is no letter, as characters and as a class.
OTHERS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalpha())
NOT_TEXT = "[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]"
HAS_WORD = r"[^\x20\x09-\x0D]"

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this from at or an "
    "le la les de des et en un une du que qui dans pour par sur est au avec "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch "
    "el los las y a se del con no su para al lo como o si sus son"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a text whose ``metric`` is under ``low`` or over ``high``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("min_words", "n_words", low=20),
    Rule("repeated_windows", "repeat_ratio", high=0.30),
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.40),
    Rule("shouting", "mark_ratio", high=0.60),
    Rule("letters", "letter_ratio", low=0.60),
    Rule("stop_words", "n_stop_words", low=1),
    Rule("duplicate_lines", "dup_line_ratio", high=0.50),
    Rule("bullets", "bullet_ratio", high=0.90),
    Rule("ellipses", "ellipsis_ratio", high=0.50),
)


def _found(text: Column, some: str) -> Column:
    """How many code points of ``text`` are in ``some``."""
    return (F.length(text) - F.length(F.translate(text, some, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text.

    Windows are hashed by doubling: XXH64 of each word, then of pairs one, two
    and four apart. If all windows are distinct the answer is 0; otherwise
    equal neighbours in sorted order give the repeated starts, and the
    windows' union is the sum of the gaps between starts, at most WINDOW each.
    """

    def doubled(hs: Column, by: int) -> Column:
        pairs = lambda a: F.zip_with(F.slice(a, 1, F.size(a) - by), F.slice(a, by + 1, F.size(a) - by), lambda x, y: F.xxhash64(x, y))
        return F.transform(F.array(hs), pairs)[0]

    hashes = doubled(doubled(doubled(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)

    def covered(hs: Column) -> Column:
        ranked = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        repeated = F.transform(F.array(ranked), lambda r: F.filter(r, lambda x, j: same(x, F.get(r, j - 1)) | same(x, F.get(r, j + 1))))[0]
        at = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        gaps = F.transform(F.array(at), lambda a: F.transform(a, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(a, k + 1) - s, F.lit(WINDOW)))))[0]
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    many = F.transform(F.array(hashes), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(covered(hs)))[0]
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(many)


def _free(name: str, docs: DataFrame) -> str:
    """``name``, with underscores behind it if ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


#: Ratios and the counts that they divide; ``letter_ratio`` is what is left of one.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "mark_ratio": ("n_marks", "n_words"),
    "letter_ratio": ("n_other", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "bullet_ratio": ("n_bullets", "n_lines"),
    "ellipsis_ratio": ("n_ellipses", "n_lines"),
}


def measure(docs: DataFrame, text: str = "text", into: str = "q", metrics: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with a struct column ``into`` of measurements of ``text``: all, or the named ones and the counts behind them."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(HAS_WORD))
    held_words, held_lines, held = (_free(name, docs) for name in ("__words", "__lines", "__m"))
    named = docs.withColumn(held_words, words_of(F.col(text))).withColumn(held_lines, lines)
    words, full = F.col(held_words), F.col(held_lines)
    n_words, n_lines = F.size(words).cast("long"), F.size(full).cast("long")
    counts = {
        "n_words": n_words,
        "n_lines": n_lines,
        "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
        "n_symbols": _found(body, SYMBOLS),
        "n_marks": _found(body, MARKS),
        "n_other": _found(body, OTHERS),
        "n_dup_lines": (n_lines - F.size(F.array_distinct(full))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_stop_words": F.size(F.array_intersect(F.transform(F.array_distinct(words), F.lower), F.array(*map(F.lit, sorted(set(STOP_WORDS)))))).cast("long"),
        "n_bullets": F.size(F.filter(full, lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long"),
        "n_ellipses": F.size(F.filter(full, lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))).cast("long"),
    }
    asked = [*counts, *RATIOS] if metrics is None else list(metrics)
    needed = {c for m in asked for c in RATIOS.get(m, (m,))}
    counted = named.withColumn(held, F.struct(*[c.alias(name) for name, c in counts.items() if name in needed]))
    m = F.col(held)

    def ratio(name: str) -> Column:
        a, b = RATIOS[name]
        out = F.coalesce(F.try_divide(m[a].cast("double"), m[b].cast("double")), F.lit(0.0))
        return F.when(m[b] > 0, 1.0 - out).otherwise(0.0) if name == "letter_ratio" else out

    measured = F.struct(*[m[name].alias(name) for name in counts if name in needed], *[ratio(name).alias(name) for name in RATIOS if name in asked])
    return counted.withColumn(into, measured).drop(held_words, held_lines, held)


def failed_rules(measured: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a measurement breaks, in table order."""
    broken = []
    for r in rules:
        value = measured[r.metric].cast("double")
        out = F.lit(False)
        if r.low is not None:
            out = out | (value < r.low)
        if r.high is not None:
            out = out | (value > r.high)
        broken.append(F.when(out, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that break no rule, with the columns of ``docs``.

    A row is generated where it is kept. As a filter, the verdict would be moved
    below the measurements, and each rule would measure the text again.
    """
    lean = docs.select(row_of(docs).alias("__row"), F.col(text).alias("__text"))
    good = F.size(failed_rules(F.col("__q"), rules)) == 0
    return measure(lean, "__text", "__q").select(F.inline(F.when(good, F.array("__row"))))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = F.col("q")
    base_failed = (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])
    return measure(docs).select(
        "doc_id",
        q["n_words"].alias("n_words"),
        q["word_chars"].alias("word_chars"),
        q["n_symbols"].alias("n_symbols"),
        q["n_dup_lines"].alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & (F.size(failed_rules(q)) == 0)).alias("kept"),
    )


def oracle_sql(docs: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The measurements and the verdict of ``rules`` in plain SQL, windows and lines unnested."""
    broken = " OR ".join(f"{r.metric} < {r.low}" if side == "low" else f"{r.metric} > {r.high}" for r in rules for side in ("low", "high") if getattr(r, side) is not None)
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM w WHERE len(ws) >= {WINDOW}),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW} - 1], ' ') AS k FROM starts),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range({WINDOW}) AS r(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ls) AS n_lines, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[{SYMBOLS}]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '[{MARKS}]')) AS n_marks,
    len(regexp_extract_all(text, '{NOT_TEXT}')) AS n_other, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(list_intersect(list_transform(list_distinct(ws), lambda x: lower(x)), [{stops}])) AS n_stop_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ellipses
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
q AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
    coalesce(n_marks / nullif(n_words, 0), 0) AS mark_ratio, coalesce(1.0::DOUBLE - n_other / nullif(word_chars, 0), 0) AS letter_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio,
    coalesce(n_bullets / nullif(n_lines, 0), 0) AS bullet_ratio, coalesce(n_ellipses / nullif(n_lines, 0), 0) AS ellipsis_ratio FROM m),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({broken}) AS kept FROM f
"""
