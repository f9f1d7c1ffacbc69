"""Tags, captions and prompts as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character of a word, in both engines.
WORD = r"[\p{L}\p{N}_]"
#: A run of word characters or hyphens.
RUN = r"[\p{L}\p{N}_\-]+"

# Groups of which a picture of several people keeps at most one tag.
SEVERAL = (
    r"(long|short|medium) hair",
    r"(bob|hime) cut",
    rf"{RUN} eyes",
    rf"({RUN} sleeves|sleeveless)",
    rf"(ponytail|braid|ahoge|twintails|{RUN} bun|single hair bun|single side bun|two side up|two tails|{RUN} braid|sidelocks)",
)
HAIR_LENGTH = r"(long|short|medium) hair"
HAIR = rf"{RUN} hair"

# Caption rewrites (what, by what), applied in this order until nothing changes.
CAPTION_RULES = (
    ("anime anime", "anime"),
    ("young ", ""),
    ("anime girl", "girl"),
    ("cartoon female", "girl"),
    ("cartoon lady", "girl"),
    ("cartoon character", "girl"),
    ("cartoon woman", "girl"),
    ("cartoon women", "girls"),
    ("cartoon girl", "girl"),
    ("anime female", "girl"),
    ("anime lady", "girl"),
    ("anime character", "girl"),
    ("anime woman", "girl"),
    ("anime women", "girls"),
    ("lady", "girl"),
    ("female", "girl"),
    ("woman", "girl"),
    ("women", "girls"),
    ("people", "girls"),
    ("person", "girl"),
    ("a cartoon figure", "a figure"),
    ("a cartoon image", "an image"),
    ("a cartoon picture", "a picture"),
    ("an anime cartoon image", "an image"),
    ("a cartoon anime drawing", "a drawing"),
    ("a cartoon drawing", "a drawing"),
    ("girl girl", "girl"),
)
#: Rules that can apply to their own result: what they come to in one pass.
_AGAIN = {
    "anime anime": ("anime( anime)+", "anime"),
    "anime girl": ("(anime )+girl", "girl"),
    "cartoon girl": ("(cartoon )+girl", "girl"),
    "girl girl": ("girl( girl)+", "girl"),
}

def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _drop_if_many(tokens: Column, pattern: str) -> Column:
    full = f"^(?:{pattern})$"
    return _let(tokens, lambda ts: F.when(F.size(F.filter(ts, lambda t: t.rlike(full))) > 1, F.filter(ts, lambda t: ~t.rlike(full))).otherwise(ts))


def clean_tags(tags: Column) -> Column:
    """Underscores to spaces (``^_^`` stays), one tag per group if several people are shown, and no tag that another one ends with."""
    plain = F.replace(F.replace(F.replace(tags, F.lit("^_^"), F.lit("^@@@^")), F.lit("_"), F.lit(" ")), F.lit("^@@@^"), F.lit("^_^"))
    tokens = F.split(plain, ", ")
    thinned = reduce(_drop_if_many, SEVERAL, tokens)
    other_hair = lambda t: t.rlike(f"^{HAIR}$") & ~t.rlike(f"^{HAIR_LENGTH}$")
    thinned = _let(thinned, lambda ts: F.when(F.size(F.filter(ts, other_hair)) > 1, F.filter(ts, lambda t: ~other_hair(t))).otherwise(ts))
    several = F.when(plain.contains("girls") | plain.contains("boys"), thinned).otherwise(tokens)
    single = rf"^(?:{RUN}|hair ornament)$"
    # The words before it must be words without hyphens, each followed by one space.
    covered = lambda x, y: (F.length(y) > F.length(x) + 1) & y.endswith(F.concat(F.lit(" "), x)) & F.substring(y, F.lit(1), F.length(y) - F.length(x)).rlike(rf"^(?:{WORD}+ )+$")
    kept = _let(several, lambda ts: F.filter(ts, lambda x: ~(x.rlike(single) & F.exists(ts, lambda y: covered(x, y)))))
    return F.array_join(kept, ", ")


def _rewriting(what: str):
    """A rule of ``_AGAIN``: its pattern can only match where its shortest form stands, which is cheap to look for."""
    return lambda c: F.when(c.contains(what), F.regexp_replace(c, *_AGAIN[what])).otherwise(c)


def clean_caption(caption: Column) -> Column:
    """The caption after all rewrites."""
    for what, by in CAPTION_RULES:
        if what in _AGAIN:
            caption = _let(caption, _rewriting(what))
        else:
            caption = F.replace(caption, F.lit(what), F.lit(by))
            if not by:
                caption = _without(caption, what)
    return caption


def _without(text: Column, piece: str) -> Column:
    """``text`` without ``piece``, also where it comes to stand anew, until none is left.

    ``piece`` ends with its only space, so it can only be completed by a space:
    the text is put together anew a word at a time, and each word that completes
    the piece takes it away.
    """
    words = F.split(text, "(?<= )")
    put = lambda done, word: _let(F.concat(done, word), lambda x: F.when(x.endswith(piece), F.substring(x, F.lit(1), F.length(x) - len(piece))).otherwise(x))
    return F.when(text.contains(piece), F.aggregate(words, F.lit(""), put)).otherwise(text)


_BLANK = " \t\n\r\x0b\x0c"


def parse_tags(text: Column) -> Column:
    """Tags of a tag file: split at commas, trimmed, no blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.btrim(t, F.lit(_BLANK))), lambda t: t != "")


def raw_tags(text: Column) -> Column:
    """Tags split at commas and left as they are; null has none."""
    return F.coalesce(F.split(text, ","), F.array().cast("array<string>"))


def listed_tags(text: Column) -> Column:
    """Tags joined by comma and space; null has none."""
    return F.coalesce(F.split(text, ", "), F.array().cast("array<string>"))


def ordered_distinct(*lists: Column) -> Column:
    """Tags of several lists, first occurrences in order, no blank ones."""
    return F.array_distinct(F.filter(F.concat(*lists), lambda t: t != ""))


def prompt(caption: Column, tags: Column) -> Column:
    """Caption and tags, comma-joined; either may be empty."""
    return F.concat_ws(", ", F.nullif(F.coalesce(caption, F.lit("")), F.lit("")), F.nullif(F.array_join(tags, ", "), F.lit("")))
