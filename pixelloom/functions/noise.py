"""Noise on small grids held as row-major arrays: every value is a draw by keys, every resize an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import normal, uniform


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def gaussian(h: int, w: int, *keys) -> Column:
    """h x w standard normal draws."""
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda k: normal(*keys, k))


def upsample(grid: Column, h: int, w: int, to_h: int, to_w: int) -> Column:
    """Bilinear resize with half-pixel centres (published definition: pixel corners aren't aligned)."""
    if (h, w) == (to_h, to_w):
        return grid

    def along(i: Column, n: int, to_n: int) -> tuple[Column, Column, Column]:
        at = F.greatest(F.lit(0.0), (i + 0.5) * (n / to_n) - 0.5)
        low = F.floor(at).cast("int")
        return low, F.least(low + 1, F.lit(n - 1)), at - low

    def value(g: Column, k: Column) -> Column:
        y0, y1, fy = along(F.floor(k / to_w), h, to_h)
        x0, x1, fx = along(k % to_w, w, to_w)
        pixel = lambda y, x: F.get(g, (y * w + x).cast("int"))
        return (1 - fy) * ((1 - fx) * pixel(y0, x0) + fx * pixel(y0, x1)) + fy * ((1 - fx) * pixel(y1, x0) + fx * pixel(y1, x1))

    return _let(grid, lambda g: F.transform(F.sequence(F.lit(0), F.lit(to_h * to_w - 1)), lambda k: value(g, k)))


def _times(k: float):
    return lambda x: x * k


def weighted_sum(grids: list[Column], weights: list[float]) -> Column:
    if len(grids) != len(weights):
        raise ValueError("scales and weights must have the same length")
    total = F.transform(grids[0], _times(weights[0]))
    for g, k in zip(grids[1:], weights[1:], strict=True):
        total = F.zip_with(total, F.transform(g, _times(k)), lambda a, b: a + b)
    return total


def pyramid(h: int, w: int, levels: int, discount: float, *keys) -> Column:
    """Levels of halved size, each discounted once more."""
    sizes = [(max(1, h // 2**k), max(1, w // 2**k)) for k in range(levels)]
    return weighted_sum([upsample(gaussian(a, b, *keys, "level", n), a, b, h, w) for n, (a, b) in enumerate(sizes)], [discount**n for n in range(levels)])


def multi_resolution(h: int, w: int, scales, weights, *keys) -> Column:
    """Noise at several scales, equally weighted unless told otherwise."""
    weights = weights or [1.0 / len(scales)] * len(scales)
    sizes = [(max(1, int(h * s)), max(1, int(w * s))) for s in scales]
    return weighted_sum([upsample(gaussian(a, b, *keys, "scale", n), a, b, h, w) for n, (a, b) in enumerate(sizes)], list(weights))


def with_offset(grid: Column, strength: float, probability: float, *keys) -> Column:
    """The same draw added to a whole grid, with a probability."""
    return F.transform(grid, lambda x: x + F.when(uniform(*keys, "use") < probability, strength * normal(*keys, "offset")).otherwise(0.0))


def _running(values: Column, plus) -> Column:
    """What ``plus`` makes of each element and the result before it; the first stays."""
    following = lambda done, x: F.concat(done, F.array(F.when(F.size(done) == 0, x).otherwise(plus(F.get(done, F.size(done) - 1), x))))
    return F.aggregate(F.slice(values, 2, F.size(values)), F.slice(values, 1, 1), following)


def brownian(grid: Column, h: int, w: int, scale: float = 1.0) -> Column:
    """Running sums over rows, then columns; centred, divided by the sample deviation (0 counts as 1), scaled."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    lines = _let(grid, lambda g: F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: _running(F.slice(g, r * w + 1, w), lambda a, x: a + x)))
    walked = F.flatten(_running(lines, lambda above, line: F.zip_with(above, line, lambda a, x: a + x)))
    centred = _let(walked, lambda a: _let(total(a) / (h * w), lambda m: F.transform(a, lambda x: x - m)))
    deviation = lambda a: F.sqrt(total(F.transform(a, lambda x: x * x)) / (h * w - 1))
    return _let(centred, lambda a: _let(deviation(a), lambda s: F.transform(a, lambda x: x / F.when(s == 0, 1.0).otherwise(s) * scale)))


def drawn(h: int, w: int, *keys, brownian_scale: float | None = None, scales=None, weights=None, levels: int = 6, discount: float = 0.8, several: bool = True, offset: float = 0.0, offset_probability: float = 1.0) -> Column:
    """The noise that settings ask for: a Brownian walk before stated scales, these before a pyramid, and plain draws if none; then the offset."""
    if brownian_scale is not None:
        grid = brownian(gaussian(h, w, *keys, "base"), h, w, brownian_scale)
    elif several and scales is not None:
        grid = multi_resolution(h, w, scales, weights, *keys)
    elif several:
        grid = pyramid(h, w, levels, discount, *keys)
    else:
        grid = gaussian(h, w, *keys, "base")
    return with_offset(grid, offset, offset_probability, *keys) if offset > 0 else grid


def add_noise(latents: Column, noise: Column, alpha_bar: Column) -> Column:
    """Forward noising (published definition)."""
    return F.zip_with(latents, noise, lambda x, e: F.sqrt(alpha_bar) * x + F.sqrt(1 - alpha_bar) * e)


def velocity(latents: Column, noise: Column, alpha_bar: Column) -> Column:
    """Velocity target (published definition)."""
    return F.zip_with(latents, noise, lambda x, e: F.sqrt(alpha_bar) * e - F.sqrt(1 - alpha_bar) * x)


def target(prediction: str, latents: Column, noise: Column, alpha_bar: Column) -> Column:
    """What a model should predict: the noise, the velocity, or the latents themselves."""
    ways = {"epsilon": lambda: noise, "v_prediction": lambda: velocity(latents, noise, alpha_bar), "sample": lambda: latents}
    if prediction not in ways:
        raise ValueError(f"unknown prediction type: {prediction}")
    return ways[prediction]()


def prediction(kind: str, predicted: Column, noise: Column) -> Column:
    """What is held against ``target``: a model that predicts latents gives them with the noise, which is taken off."""
    return F.zip_with(predicted, noise, lambda p, e: p - e) if kind == "sample" else predicted


def to_pixels(values: Column) -> Column:
    """Decoded values as bytes: NaN becomes 128, infinities 255 and 0, the rest is limited and cut."""
    one = lambda x: F.when(F.isnan(x), 128.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)))
    return F.transform(values, lambda x: F.floor(one(x)).cast("int"))


def normalised(pixels: Column) -> Column:
    """Bytes as values from -1 to 1."""
    return F.transform(pixels, lambda x: (x / 255.0 - 0.5) / 0.5)


def clip_factor(values: Column, largest: float = 1.0) -> Column:
    """What a gradient is multiplied by so that its norm doesn't exceed ``largest``."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(largest), norm), F.lit(1.0)))
