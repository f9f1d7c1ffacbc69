"""Personal data: pattern spans, and a character tagger for what patterns miss.

The patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and
phone numbers. A character-level bidirectional LSTM with CRF transitions,
trained here from generated texts with labelled spans, adds forms that the
patterns don't cover, such as phone numbers without a country code. It reads
the surroundings (``MARGIN`` characters, and on to the ends of the words there) of every
digit and at sign, written-out ones too - no kind can be without one - in overlapping windows; each character takes its scores from the window
in whose middle it lies, and one decoding over the whole region settles the
labels. An added span must meet its kind's own checks and must not touch a
pattern's span.

Runs as one pass over the texts in Arrow batches: no shuffle, rows are
independent, only the model (some 20 KB) is broadcast, and windows are tagged
``ROWS`` at a time whatever a text's length. A region of more than ``REGION`` characters is
decoded in pieces that are joined to the labels of a single decoding.

Defined results
* null or empty text: no spans. Very long text: searched whole, in linear time.
* repeated rows: alike. Empty table: empty result. Null doc_id: passed through.
* extra columns: ``find`` keeps them; its own are base and spans (base_, spans_ where the input has such names).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tagger
from .common import beside, count_of, for_python, joined, row_of, table

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN, ROWS, REGION, PIECE = 64, 32, 20, 256, 8192, 1024
TRAIN_TEXTS, TRAIN_STEPS, TRAIN_SEED = 6000, 600, 11

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SIGN = re.compile(r" ?(?:@|\[at\]|\(at\)) ?")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+|\[at\]|\(at\)")
#: Dates, ISBNs and other numbers in groups that telephone numbers don't have.
_NUMBERED = re.compile(r"(?:19|20)\d\d[-./](?:0[1-9]|1[0-2])[-./][0-3]\d|97[89][ -]?(?:\d[ -]?){9}\d$|\d{4}([ -])\d{4}\1\d{4}(?:\1\d{1,3})?$|\d{5}-\d{5}-\d{3}$|(?:\d{3}-)?\d{7}-\d{7}$")
_ADDED_EMAIL = re.compile(r"[^\s@]+ ?(?:@|\[at\]|\(at\)) ?[^\s@]+\.[^\s@]+")


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(x - 9 if x > 9 else x for x in (2 * int(d) for d in even))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p and len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in parts)


def _emails(text: str) -> list[Span]:
    """From each at sign to the left over local characters, to the right over a domain; linear in the text."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start, after = at, at + 1
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            floor = after = m.end()
        at = text.find("@", after)
    return out


def base_spans(text: str | None) -> list[Span]:
    """Spans of the patterns, by start and then kind."""
    if not text or not _TRIGGER.search(text):
        return []
    out = _emails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- labelled texts -------------------------------------------------------------------------------------------------


def _examples(n: int, seed: int):
    """``n`` texts with labelled spans: invented words around one or two items, some of which are no personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = ("an", "the", "er", "ou", "ti", "le", "re", "sch", "en", "ion", "é", "ñ", "ü", "al", "st", "or", "in", "qu", "o", "a")
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def card() -> str:
        digits = pick("3456") + number(14)
        check = next(c for c in "0123456789" if luhn(digits + c))
        digits, gap = digits + check, pick(("", "", " ", "-"))
        return gap.join(digits[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return pick((f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{number(3)} {number(7)}", f"0{number(2)}/{number(7)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"+{number(2)}-{a}-{b}-{c}"))

    def email() -> str:
        name = word().encode("ascii", "ignore").decode() or "me"
        return pick((f"{name}.{number(2)}@mail{number(1)}.example.com", f"{name}@{name}.org", f"{name}_{name}@post.{name}.net", f"{name} @ {word()}.com", f"{name}[at]{name}.com", f"{name}(at){word()}.org", f"{name}+{number(1)}@{name}.de"))

    def other() -> str:
        hexed = "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(16, 40))))
        date = f"20{number(2)}-{pick(('01', '05', '12'))}-{pick(('03', '15', '28'))}"
        if rng.random() < 0.5:
            return pick((f"{date} {number(2)}.{number(2)}.{number(2)}", f"{date} {number(2)}:{number(2)}:{number(2)}", date, f"97{pick('89')}-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"97{pick('89')} {number(1)} {number(3)} {number(5)} {number(1)}", f"{number(5)}-{number(5)}-{number(3)}", f"{number(4)} {number(4)} {number(4)}", f"{number(3)}-{number(7)}-{number(7)}"))
        return pick((number(4), f"{number(1)}.{number(2)}", f"{number(2)},{number(3)}", hexed, f'"{hexed}"', f"{number(4)}-{number(2)}-{number(2)}", f"v{number(1)}.{number(1)}.{number(2)}", f"{number(2)}:{number(2)}", number(22), f"{word()}{number(2)}", f"@{word()}"))

    make = {"email": email, "ip": lambda: ".".join(str(int(x)) for x in rng.integers(1, 256, 4)), "card": card, "phone": phone, "": other}
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(int(rng.integers(0, 9)))), []
        for _ in range(int(rng.integers(1, 4))):
            kind = pick(("email", "email", "ip", "card", "phone", "phone", "phone", "", ""))
            item = make[kind]()
            text += pick((" ", " ", ": ", "\n", " (")) if text else ""
            if kind:
                spans.append((kind, len(text), len(text) + len(item)))
            # Every third item has the next one right behind it.
            text += item + pick((" ", ". ", ", ", " "))
            if rng.random() < 0.33:
                text = text.rstrip(" ")
            else:
                text += " ".join(word() for _ in range(int(rng.integers(0, 6))))
        yield text, spans


def labelled_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of one window from each of ``n`` texts; labels: 0 none, 2k + 1 first and 2k + 2 other characters of kind k."""
    rng = np.random.default_rng(seed + 1)
    codes, labels = np.ones((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for row, (text, spans) in enumerate(_examples(n, seed)):
        marks = np.zeros(len(text), np.int64)
        for kind, start, end in spans:
            marks[start:end] = 2 * KINDS.index(kind) + 2
            marks[start] -= 1
        at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        size = min(WINDOW, len(text) - at)
        codes[row, :size], labels[row, :size] = tagger.encode(text)[at : at + size], marks[at : at + size]
    # A window may begin inside a span: its label goes on, it doesn't begin.
    return codes, labels


@functools.lru_cache(maxsize=2)
def trained(texts: int = TRAIN_TEXTS, steps: int = TRAIN_STEPS, seed: int = TRAIN_SEED) -> tagger.Model:
    return tagger.train(*labelled_windows(texts, seed), n_labels=2 * len(KINDS) + 1, steps=steps, seed=seed)


# --- tagging --------------------------------------------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches of ``text`` within MARGIN characters of a digit or an at sign, widened to whole words, in order."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        before = out[-1][1] if out else 0
        start, end = max(0, m.start() - MARGIN), max(before, min(len(text), m.end() + MARGIN))
        while start > before and not text[start - 1].isspace():
            start -= 1
        while 0 < end < len(text) and not text[end - 1].isspace() and not text[end].isspace():
            end += 1
        if out and start <= before:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(start, end) for start, end in out]


def _region_scores(model: tagger.Model, pieces: list[np.ndarray]) -> list[np.ndarray]:
    """Scores of each coded region, every character's from the window in whose middle it lies."""
    place = [(r, at) for r, codes in enumerate(pieces) for at in range(0, max(1, len(codes) - WINDOW + STRIDE), STRIDE)]
    out = [np.zeros((len(codes), 2 * len(KINDS) + 1), np.float32) for codes in pieces]
    for k in range(0, len(place), ROWS):
        some = place[k : k + ROWS]
        block = np.ones((len(some), WINDOW), np.int64)
        for row, (r, at) in enumerate(some):
            piece = pieces[r][at : at + WINDOW]
            block[row, : len(piece)] = piece
        scores = tagger.emissions(model, block)
        for row, (r, at) in enumerate(some):
            size, own = len(pieces[r]), STRIDE // 2 if at else 0
            end = WINDOW if at + WINDOW >= size else WINDOW - STRIDE // 2
            out[r][at + own : min(at + end, size)] = scores[row, own : min(end, size - at)]
    return out


def tag(model: tagger.Model, texts: list[str | None]) -> list[list[Span]]:
    """Spans that the model labels in each text."""
    where = [(t, start, end) for t, text in enumerate(texts) if text for start, end in regions(text)]
    found: list[list[Span]] = [[] for _ in texts]
    where.sort(key=lambda w: w[2] - w[1])

    def keep(t: int, start: int, path: np.ndarray) -> None:
        kinds = (path + 1) // 2
        cuts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]) | (path[1:] % 2 == 1)) + 1), len(path)]
        found[t].extend((KINDS[kinds[a] - 1], start + int(a), start + int(b)) for a, b in zip(cuts, cuts[1:], strict=False) if kinds[a])

    k, short = 0, sum(end - start <= REGION for _, start, end in where)
    while k < short:
        # As many as fit one padded block, whose width is that of its longest region.
        rows = max(1, min(ROWS, ROWS * WINDOW * 8 // max(1, where[min(k + ROWS, short) - 1][2] - where[min(k + ROWS, short) - 1][1])))
        some, k = where[k : min(k + rows, short)], k + rows
        scores = _region_scores(model, [tagger.encode(texts[t][start:end]) for t, start, end in some])
        lengths = np.array([len(s) for s in scores])
        padded = np.zeros((len(some), lengths.max(), 2 * len(KINDS) + 1), np.float32)
        for row, s in enumerate(scores):
            padded[row, : len(s)] = s
        for (t, start, _), path in zip(some, tagger.viterbi(model, padded, lengths), strict=True):
            keep(t, start, path)
    for t, start, end in where[short:]:
        # Windows stand at multiples of STRIDE, so a stretch with one more on either side has the region's own scores.
        def scores_of(a: int, b: int, text: str = texts[t], start: int = start, end: int = end) -> np.ndarray:
            low = max(0, a - STRIDE)
            return _region_scores(model, [tagger.encode(text[start + low : min(end, start + b + STRIDE)])])[0][a - low : b - low]

        keep(t, start, tagger.viterbi_in_pieces(model, scores_of, end - start, PIECE))
    return found


def _trimmed(text: str, span: Span) -> Span:
    kind, start, end = span
    while start < end and not (text[start].isalnum() or text[start] in "+(" and kind == "phone"):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    sign = _SIGN.search(text, start, end) if kind == "email" else None
    if sign and (m := _DOMAIN.match(text, sign.end())):
        # Parts may be labelled in part, or with a word beside them: the address is the local part and the domain around its sign.
        start, end = sign.start(), m.end()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
    return kind, start, end


def _plausible(text: str, span: Span) -> bool:
    """The checks of an added span's kind; a span must not begin or end inside a word."""
    kind, start, end = span
    said = text[start:end]
    if start and (text[start - 1].isalnum() or text[start - 1] in "_-=+/.") or end < len(text) and (text[end].isalnum() or text[end] in "_=@/"):
        return False
    digits = _digits(said)
    if kind == "email":
        return bool(_ADDED_EMAIL.fullmatch(said))
    if kind == "ip":
        return _is_ip(said)
    if any(c.isalpha() for c in said):
        return False
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 9 < len(digits) <= 15 and any(c in " ().-/" for c in said) and not re.search(r"\d{9}", said) and not _NUMBERED.match(said)


def _parted(text: str, span: Span) -> list[Span]:
    """A phone span of more digits than a number has, which is two or more beside each other, as those: each the shortest that can be one."""
    kind, start, end = span
    if kind != "phone" or len(_digits(text[start:end])) <= 15:
        return [span]
    for m in re.finditer(r"[\s,;]+", text[start:end]):
        left = kind, start, start + m.start()
        if len(_digits(text[start : left[2]])) >= 10 and _plausible(text, left):
            return [left, *_parted(text, _trimmed(text, (kind, start + m.end(), end)))]
    return [span]


def all_spans(text: str | None, base: list[Span], tagged: list[Span]) -> list[Span]:
    """The base spans with the tagged ones that are plausible and touch none of them."""
    if not tagged:
        return base
    out, taken = list(base), bytearray(len(text))
    for _, start, end in base:
        taken[start:end] = b"\1" * (end - start)
    for span in sorted((p for s in tagged for p in _parted(text, _trimmed(text, s))), key=lambda s: (s[1], -s[2])):
        _, start, end = span
        if start < end and taken.find(1, start, end) < 0 and _plausible(text, span):
            out.append(span)
            taken[start:end] = b"\1" * (end - start)
    return in_order(out)


def find(docs: DataFrame, text_col: str = "text", model: tagger.Model | None = None) -> DataFrame:
    """``docs`` with the text replaced by ``base`` and ``spans``, arrays of (kind, start, end) in code points."""
    spark = docs.sparkSession
    for_python(spark)
    shared = spark.sparkContext.broadcast(model or trained())
    lean = docs.select(row_of(docs, text_col).alias("row"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            spans = [all_spans(t, b, more) for t, b, more in zip(texts, base, tag(shared.value, texts), strict=True)]
            arrays = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in rows], kind) for rows in (base, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", "base", "spans"])

    from pyspark.sql.types import StructType, _parse_datatype_string

    more = _parse_datatype_string("base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>")
    found = lean.mapInArrow(run, StructType([lean.schema["row"], *more.fields]))
    return beside(found, [c for c in docs.columns if c != text_col], ["base", "spans"])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    every = F.size("spans").cast("long")
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), every.alias("n_spans"), (every > 0).alias("personal"))
