"""Secrets: pattern spans, and tokens that pass a battery of randomness tests.

The patterns find assigned passwords and tokens, access key ids and long hex
runs. Every other token of ``SHORTEST`` or more characters of the usual
encodings is tested for randomness: its encoding is inferred (hex, base32,
alphanumeric, base64), then a chi-squared test of the alphabet's uniformity, a
runs test above and below the alphabet's middle, and a serial correlation test
are combined by Fisher's method. A real key's p-value is uniform, so a token is
no key below the cut ``CUT``, which is the share of real keys that this loses.

False discoveries. What passes the battery is reported only if it isn't likely
as text. Text is modelled as a chain of letters, digits and signs with the letter
pairs of natural words, words in a row as in names and slugs, in small letters, capitals or
with a capital in front, and digits that stay together. How much likelier this chain makes a
token than its random encoding does is a p-value of the hypothesis "text" (1 for tokens
that fail the battery): in text the inverse of this ratio has a mean of one, so by Markov's
inequality it is as large as x with a chance of 1 / x at most, however short the token. Short
tokens say less than long ones, so Benjamini and Hochberg's rule is applied in
each class of lengths over all tokens of the table: of the tokens reported in
a class a share of ``RATE`` is text at most, in expectation, as far as text is like the chain.
Numbers, tokens of digits alone, can't be told from keys and aren't tested.

At scale: one pass over the texts in Arrow batches; rows are independent. Counts
by class and p-value give the limits: some 400 sums a class, and one number
for each class comes to the driver. A native projection applies them.

Defined results
* null or empty text: no spans. Very long text: searched whole; a candidate token is tested whole.
* repeated rows: alike. Empty table: empty result. Null doc_id: passed through.
* extra columns: ``find`` keeps them; its own are base and spans (base_, spans_ where the input has such names).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import beside, count_of, for_python, joined, row_of, table, written

KINDS = ("assign", "access", "hex")
ADDED = "random"
SHORTEST = 20
CUT, RATE = 0.005, 0.05
#: Length classes: from so many characters on. P-values are counted in BINS steps of a tenth of a power of ten.
CLASSES = (20, 24, 32, 48, 64)
BINS = 400

Span = tuple[str, int, int]

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGNED = re.compile(r"[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)

_ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower32": "abcdefghijklmnopqrstuvwxyz234567",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "alphanumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {name: frozenset(chars) for name, chars in _ALPHABETS.items()}
_PLACES = {name: {c: k for k, c in enumerate(chars)} for name, chars in _ALPHABETS.items()}


def base_spans(text: str | None) -> list[Span]:
    """Spans of the patterns, by start and then kind."""
    if not text:
        return []
    out: list[Span] = []
    if _ASSIGNED.search(text):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    kinds = (*KINDS, ADDED)
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds all of a token's characters."""
    held = set(token)
    return next((name for name, chars in _SETS.items() if held <= chars), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of the chi-squared distribution, by the Wilson-Hilferty cube root."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Common words of four languages and of identifiers, for the pairs of letters in natural words.
_WORDS = """the and that have for not with you this but his from they say her she will one all would there their what out about who get which when make can like
time just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most
abstract singleton proxy factory bean service controller manager handler request response user name account document config default value string number file path index module function method class object interface
version release update download image picture content assets static public private admin session cookie token header footer button select option message error exception invalid missing required parameter argument
software license permission copyright notice warranty distribution documentation international organization application information development environment production resource template component container
der die und das nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an nach wie im aber wenn nur werden noch gesellschaft donau dampf schiff fahrt haben wird einer zeit zum sind schule durch kinder
le la les et des en un une du que est pour qui dans ce il pas sur plus par avec tout faire son mais comme nous vous bien sans peut cette entre aussi leur deux temps monde toujours encore
el los las que por con para una su al lo como mas pero sus este entre cuando muy sin sobre ser tiene tambien hasta hay donde quien desde todo nos durante todos uno contra otros ese eso ante ellos cada tiempo nuevo"""
# Small letters are symbols 0 to 25, capitals 26 to 51.
_DIGIT, _SIGN, _SYMBOLS = 52, 53, 54
#: Ways to write a word, each with its share.
_STYLES = ((0.5, str.lower), (0.35, str.capitalize), (0.15, str.upper))


def _symbol(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else ord(c) - 39 if "A" <= c <= "Z" else _DIGIT if "0" <= c <= "9" else _SIGN


def _text_chain(styles: tuple) -> np.ndarray:
    """Probabilities of the next symbol in text: letter pairs of words, words joined to names, digits that stay together."""
    counts = np.full((_SYMBOLS, _SYMBOLS), 0.3)
    counts[:_DIGIT, :_DIGIT] = 0.08
    words, starts = _WORDS.split(), np.zeros(_SYMBOLS)
    for share, written_so in styles:
        first, last = np.zeros(_SYMBOLS), np.zeros(_SYMBOLS)
        for word in words:
            at = [_symbol(c) for c in written_so(word)]
            np.add.at(counts, (at[:-1], at[1:]), share)
            first[at[0]] += share
            last[at[-1]] += share
        starts += first / len(words)
        # After a word: another one in the same style, a sign, or digits.
        counts += np.outer(last, 0.5 * first / first.sum())
        counts[:, _SIGN] += 0.4 * last
        counts[:, _DIGIT] += 0.1 * last
    counts[_DIGIT] += 0.3 * len(words) * (0.15 * starts + 0.75 * (np.arange(_SYMBOLS) == _DIGIT) + 0.1 * (np.arange(_SYMBOLS) == _SIGN))
    counts[_SIGN] += 0.4 * len(words) * (0.8 * starts + 0.18 * (np.arange(_SYMBOLS) == _DIGIT) + 0.02 * (np.arange(_SYMBOLS) == _SIGN))
    return counts / counts.sum(axis=1, keepdims=True)


def _against_text(chars: str) -> np.ndarray:
    """For an alphabet: log odds of each pair as random against text, which is written in the only case there is."""
    one_case = [style for style in (str.lower, str.upper) if style(chars) == chars]
    styles = tuple((1.0, style) for style in one_case) or _STYLES
    shares = np.bincount([_symbol(c) for c in chars], minlength=_SYMBOLS) / len(chars)
    there = shares > 0
    chain = _text_chain(styles) * there
    chain = np.where(there[:, None], chain, 0) / np.maximum(chain.sum(axis=1, keepdims=True), 1e-12)
    odds = np.zeros((_SYMBOLS, _SYMBOLS))
    at = np.ix_(there, there)
    odds[at] = np.log(shares[there][None, :] / chain[at])
    return odds


_AGAINST = {name: _against_text(chars) for name, chars in _ALPHABETS.items()}


def evidence(token: str) -> float:
    """A bound of the chance that text looks as random as ``token``; 1 for what fails the battery of tests."""
    token = token.rstrip("=")
    p = randomness(token)
    if p is None or p < CUT:
        return 1.0
    at = np.array([_symbol(c) for c in token])
    return math.exp(min(0.0, -float(_AGAINST[encoding(token)][at[:-1], at[1:]].sum())))


def uniformity(places: np.ndarray, size: int) -> float:
    """p-value of equal frequencies; alphabets larger than a quarter of the token are folded into fewer cells."""
    cells = max(2, min(size, len(places) // 4))
    counts = np.bincount(places * cells // size, minlength=cells)
    odds = np.bincount(np.arange(size) * cells // size, minlength=cells) / size * len(places)
    return _chi_tail(float(((counts - odds) ** 2 / odds).sum()), cells - 1)


def runs(places: np.ndarray, size: int) -> float:
    """p-value of the number of runs above and below the alphabet's middle."""
    high = places * 2 >= size
    n1, n2 = int(high.sum()), int((~high).sum())
    if not n1 or not n2:
        return 2.0 ** (1 - len(places))
    n = n1 + n2
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return _normal_tail((int((high[1:] != high[:-1]).sum()) + 1 - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial(places: np.ndarray) -> float:
    """p-value of the correlation between neighbours."""
    x = places - places.mean()
    total = float((x * x).sum())
    if total == 0:
        return 2.0 ** (1 - len(places))
    return _normal_tail(float((x[1:] * x[:-1]).sum()) / total * math.sqrt(len(x)))


def randomness(token: str) -> float | None:
    """Fisher's combination of the three tests; None for short tokens, numbers, and what no encoding holds."""
    token = token.rstrip("=")
    name = encoding(token)
    if name is None or len(token) < SHORTEST or all("0" <= c <= "9" for c in token):
        return None
    at = _PLACES[name]
    places, size = np.array([at[c] for c in token]), len(at)
    if len(set(token)) < min(size, len(token)) // 4:
        return 0.0
    log = sum(math.log(max(p, 1e-300)) for p in (uniformity(places, size), runs(places, size), serial(places)))
    half = -log
    return math.exp(-half) * (1 + half + half * half / 2)


def candidates(text: str | None, base: list[Span]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, bin of the p-value) of tokens that touch no base span and can be tested."""
    if not text:
        return []
    taken, out = None, []
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip("=")
        if len(token) < SHORTEST or encoding(token) is None or token.isdigit():
            continue
        if taken is None:
            taken = bytearray(len(text))
            for _, start, end in base:
                taken[start:end] = b"\1" * (end - start)
        if taken.find(1, *m.span()) < 0:
            group = sum(len(token) >= c for c in CLASSES) - 1
            out.append((*m.span(), group, min(BINS, int(-10 * math.log10(max(evidence(token), 1e-300))))))
    return out


def thresholds(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """``class`` and the least bin that Benjamini and Hochberg's rule reports in it, from rows (class, bin); none where nothing is."""
    counts = tested.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"))
    reported = F.sum("n").over(W.partitionBy("class").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("reported", reported).withColumn("every", F.sum("n").over(W.partitionBy("class")))
    good = F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("every") <= rate * F.col("reported")
    return ranked.where(good).groupBy("class").agg(F.min("bin").alias("least"))


def find(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with the text replaced by ``base`` and ``spans``, arrays of (kind, start, end) in code points."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    for_python(docs.sparkSession)
    lean = docs.select(row_of(docs, text_col).alias("row"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    token = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            found = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
            arrays = [
                pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in base], span),
                pa.array([[dict(zip(("start", "end", "class", "bin"), c, strict=True)) for c in row] for row in found], token),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", "base", "tested"])

    more = _parse_datatype_string("base array<struct<kind:string,start:long,end:long>>, tested array<struct<start:long,end:long,class:int,bin:int>>")
    found = written(lean.mapInArrow(run, StructType([lean.schema["row"], *more.fields])), "secrets-tested")
    least = {r["class"]: r["least"] for r in thresholds(found.select(F.explode("tested").alias("t")).select("t.class", "t.bin"), rate).collect()}
    limits = F.array(*[F.lit(least.get(k, BINS + 1)) for k in range(len(CLASSES))])
    kinds = F.array(*map(F.lit, (*KINDS, ADDED)))
    # Added spans touch no base span, so start, kind and end order them all.
    added = F.transform(F.filter("tested", lambda t: t["bin"] >= F.get(limits, t["class"])), lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("k"), t["end"].alias("end")))
    stated = F.transform("base", lambda s: F.struct(s["start"].alias("start"), (F.array_position(kinds, s["kind"]) - 1).cast("int").alias("k"), s["end"].alias("end")))
    spans = F.transform(F.array_sort(F.concat(stated, added)), lambda s: F.struct(F.get(kinds, s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return beside(found.withColumn("spans", spans), [c for c in docs.columns if c != text_col], ["base", "spans"])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[count_of("base", k).alias(f"n_{k}") for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
