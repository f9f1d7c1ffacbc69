"""Prompt augmentation: seeded dropout and shuffling of captions and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rng import digest, uniform
from ..functions.text import prompt


def drop_caption(caption: Column, key: Column, p: float, seed: int) -> Column:
    return F.coalesce(caption, F.lit("")) if p <= 0 else F.when(uniform(seed, "caption", key) < p, F.lit("")).otherwise(F.coalesce(caption, F.lit("")))


def drop_tags(tags: Column, key: Column, p_all: float, p_each: float, seed: int) -> Column:
    """No tags with probability ``p_all``; otherwise each goes with ``p_each``."""
    left = tags if p_each <= 0 else F.filter(tags, lambda t, i: uniform(seed, "tag", key, i) >= p_each)
    return left if p_all <= 0 else F.when(uniform(seed, "tags", key) < p_all, F.array().cast("array<string>")).otherwise(left)


def shuffle_tags(tags: Column, key: Column, seed: int) -> Column:
    """Tags in the order of their draws; the input's array is left alone."""
    drawn = F.transform(tags, lambda t, i: F.struct(digest(seed, "shuffle", key, i).alias("d"), i.alias("i"), t.alias("t")))
    return F.transform(F.sort_array(drawn), lambda s: s["t"])


def augmented(caption: Column, tags: Column, key: Column, *, caption_p: float, all_tags_p: float, tag_p: float, condition_p: float, shuffle: bool, seed: int) -> Column:
    """The prompt of one item after every dropout."""
    kept = drop_tags(tags, key, all_tags_p, tag_p, seed)
    text = prompt(drop_caption(caption, key, caption_p, seed), shuffle_tags(kept, key, seed) if shuffle else kept)
    return text if condition_p <= 0 else F.when(uniform(seed, "condition", key) < condition_p, F.lit("")).otherwise(text)


def paired(captions: Column, tags: Column) -> Column:
    """Captions and tags of a batch by position, as structs (caption, tags); lists of different lengths are an error."""
    broken = F.raise_error(F.concat(F.lit("captions and tags differ in number: "), F.size(captions).cast("string"), F.lit(" and "), F.size(tags).cast("string")))
    same = F.zip_with(captions, tags, lambda c, t: F.struct(c.alias("caption"), t.alias("tags")))
    return F.when(F.size(captions) == F.size(tags), same).otherwise(broken)
