"""Noise schedules, timestep weights, learning rates and loss weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rng import normal, uniform

STEPS, BETA_START, BETA_END = 1000, 0.00085, 0.012


def snr_table(spark: SparkSession, steps: int = STEPS, start: float = BETA_START, end: float = BETA_END) -> DataFrame:
    """t, beta, alpha_bar and snr of a linear beta schedule; one row per timestep."""
    beta = F.lit(start) + F.col("t") * ((end - start) / (steps - 1))
    table = spark.range(0, steps, 1, 1).select(F.col("id").alias("t")).withColumn("beta", beta)
    upto = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    table = table.withColumn("alpha_bar", F.exp(F.sum(F.log(1 - F.col("beta"))).over(upto)))
    return table.withColumn("snr", F.col("alpha_bar") / (1 - F.col("alpha_bar")))


def sigma(alpha_bar: Column) -> Column:
    """Noise level of a timestep; alpha_bar is kept off zero."""
    a = F.greatest(alpha_bar, F.lit(1e-12))
    return F.sqrt((1 - a) / a)


def logit_normal(t: Column, m: float = 0.0, s: float = 1.0) -> Column:
    """Density at t of a variable whose logit is normal; t outside (0, 1) is an error."""
    x = F.log(t / (1 - t))
    density = F.exp(-((x - m) * (x - m)) / (2 * s * s)) / (s * math.sqrt(2 * math.pi) * t * (1 - t))
    return F.when((t <= 0) | (t >= 1), F.raise_error(F.lit("t must be strictly between 0 and 1"))).otherwise(density)


def logit_weights(spark: SparkSession, steps: int = STEPS, m: float = 0.0, s: float = 1.0) -> DataFrame:
    """t, weight and cdf (rounded to 9 places) of logit-normal timestep sampling."""
    at = F.lit(1e-10) + F.col("t") * ((1 - 1e-10) / steps)
    rows = spark.range(0, steps, 1, 1).select(F.col("id").alias("t")).withColumn("density", logit_normal(at, m, s))
    weighted = rows.withColumn("weight", F.col("density") / F.sum("density").over(W.partitionBy()))
    cdf = F.round(F.sum("weight").over(W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)), 9)
    return weighted.select("t", "weight", cdf.alias("cdf"))


def uniform_weights(spark: SparkSession, steps: int = STEPS) -> DataFrame:
    """t and weight where all timesteps weigh the same."""
    return spark.range(0, steps, 1, 1).select(F.col("id").alias("t"), F.lit(1.0 / steps).alias("weight"))


CELLS = 1024


def _lookup(rows: DataFrame, table: DataFrame, value: str, cell, inside) -> DataFrame:
    """``rows`` with t: the first row of ``table`` (t, upper) whose ``upper`` admits the value, the last one if none does.

    A range join made an equal one: ``cell`` maps values to 0 .. CELLS - 1
    without changing their order; every t is listed in the cells that its range
    touches, and a value only compares with the few in its own cell.
    """
    order = W.orderBy("t")
    bounds = table.withColumn("lower", F.lag("upper").over(order)).withColumn("last", F.lead("t").over(order).isNull())
    span = F.sequence(F.when(F.col("lower").isNull(), F.lit(0)).otherwise(cell(F.col("lower"))), F.when(F.col("last"), F.lit(CELLS - 1)).otherwise(cell(F.col("upper"))))
    listed = bounds.select("t", F.when(~F.col("last"), F.col("upper")).alias("upper"), F.explode(span).alias("cell"))
    cells = listed.groupBy("cell").agg(F.collect_list(F.struct("t", "upper")).alias("near"))
    admits = lambda x: x["upper"].isNull() | inside(F.col(value), x["upper"])
    found = F.array_min(F.transform(F.filter("near", admits), lambda x: x["t"]))
    return rows.withColumn("cell", cell(F.col(value))).join(F.broadcast(cells), "cell").withColumn("t", found).drop("cell", "near")


def draw_by_cdf(draws: DataFrame, table: DataFrame, u: str = "u") -> DataFrame:
    """``draws`` with t: the first timestep whose cdf exceeds ``u``. The broadcast side has a few rows per cell."""
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    return _lookup(draws, table.select("t", F.col("cdf").alias("upper")), u, cell, lambda v, upper: v < upper)


def nearest_sigma(draws: DataFrame, table: DataFrame, value: str = "sigma") -> DataFrame:
    """``draws`` with t: the timestep whose noise level is nearest, the lower on ties; levels grow with t."""
    levels = table.select("t", sigma(F.col("alpha_bar")).alias("s"))
    mids = levels.select("t", ((F.col("s") + F.coalesce(F.lead("s").over(W.orderBy("t")), F.col("s"))) / 2).alias("upper"))
    cell = lambda x: F.greatest(F.lit(0), F.least(F.floor((F.log(x) + 4) * 128), F.lit(CELLS - 1))).cast("int")
    return _lookup(draws, mids, value, cell, lambda v, upper: v <= upper)


def sample_timesteps(draws: DataFrame, strategy: str, seed: str, key: str, mean: float = -0.5, spread: float = 1.2) -> DataFrame:
    """``draws`` with t, drawn by key: uniform, by logit-normal weights, or the nearest to a log-normal noise level."""
    spark = draws.sparkSession
    if strategy == "uniform":
        return draws.withColumn("t", F.floor(uniform(seed, F.col(key)) * STEPS).cast("long"))
    if strategy == "logit":
        return draw_by_cdf(draws.withColumn("__u", uniform(seed, F.col(key))), logit_weights(spark), "__u").drop("__u")
    if strategy == "lognormal":
        leveled = draws.withColumn("__sigma", F.exp(mean + spread * normal(seed, F.col(key))))
        return nearest_sigma(leveled, snr_table(spark), "__sigma").drop("__sigma")
    raise ValueError(f"unknown strategy: {strategy}")


def min_snr(snr: Column, gamma: float = 5.0, smoothing: float = 0.1, mode: str = "sigmoid") -> Column:
    """SNR limited at gamma, hard or with a smooth transition."""
    if mode == "clip":
        return F.least(snr, F.lit(gamma))
    x = (snr - gamma) / smoothing
    if mode == "sigmoid":
        part = 1 / (1 + F.exp(x))
    elif mode == "tanh":
        part = (1 - F.tanh(x)) / 2
    else:
        raise ValueError(f"unknown smoothing mode: {mode}")
    return snr * part + gamma * (1 - part)


def loss_weight(limited: Column, snr: Column, prediction: str) -> Column:
    """The limited SNR per SNR (epsilon), per SNR + 1 (velocity), or as it is (sample); null where it can't be divided."""
    if prediction == "epsilon":
        return F.try_divide(limited, snr)
    return F.try_divide(limited, snr + 1) if prediction == "v_prediction" else limited


def debias(snr: Column) -> Column:
    return 1 / F.sqrt(F.least(F.greatest(snr, F.lit(1e-8)), F.lit(1000.0)))


def noise_strength(t: Column, kind: str, strength: float = 1.0, steps: float = 1000.0) -> Column:
    """Factor on noise at a timestep: linear, cosine or exponential decay."""
    x = t.cast("double") / steps
    ways = {"linear": lambda: 1 - x, "cosine": lambda: 0.5 * (1 + F.cos(math.pi * x)), "exponential": lambda: F.exp(-2.0 * x)}
    if kind not in ways:
        raise ValueError(f"unknown schedule: {kind}")
    return ways[kind]() * strength


def perturbation(step: Column, k: float, decay_steps: int) -> Column:
    """Weight of the second noise: k, falling to 0 over ``decay_steps`` (0: constant)."""
    return F.lit(k) if decay_steps <= 0 else F.lit(k) * F.greatest(F.lit(0.0), 1 - step / float(decay_steps))


def cosine_restarts(step: Column, warmup: int, total: int, cycles: int, peak: float) -> Column:
    """Linear warm-up, then cosine decay from the peak in equal cycles (published definition)."""
    done = (step - warmup) / float(max(1, total - warmup))
    falling = F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(math.pi * F.pmod(cycles * done, F.lit(1.0)))))
    return peak * F.when(step < warmup, step / float(max(1, warmup))).when(done >= 1, 0.0).otherwise(falling)


def warmup_constant(step: Column, warmup: int, peak: float) -> Column:
    return peak * F.least(F.lit(1.0), step / float(max(1, warmup)))


def decayed_restarts(step: Column, cycle: int = 50, warmup: int = 5, start: float = 0.1, decay: float = 0.5, floor: float = 0.05) -> Column:
    """Cycles of a linear warm-up to a peak that falls by ``decay`` each time, then a cosine to the floor.

    The cosine's amplitude is that of the first peak, as the schedule is bound to the optimiser's initial rate.
    """
    nth, at = F.floor(step / cycle), step % cycle
    peak = start * F.pow(F.lit(decay), nth)
    rising = (peak - floor) * (at + 1) / warmup + floor
    falling = floor + (start - floor) * (1 + F.cos(math.pi * at / cycle)) / 2
    return F.when(at < warmup, rising).otherwise(falling)


def zero_terminal_snr(table: DataFrame) -> DataFrame:
    """The schedule rescaled so that the last timestep has no signal and the first is unchanged (published definition)."""
    every = W.orderBy("t").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    root = F.sqrt("alpha_bar")
    first, last = F.first(root).over(every), F.last(root).over(every)
    scaled = (root - last) * first / (first - last)
    out = table.withColumn("alpha_bar", scaled * scaled)
    return out.withColumn("snr", F.col("alpha_bar") / (1 - F.col("alpha_bar")))


def scheduler_settings(config: dict) -> dict:
    """A scheduler's settings: a prediction type asks for trailing timesteps, zero terminal SNR for rescaling too."""
    out = dict(config)
    if out.get("prediction_type"):
        out["timestep_spacing"] = "trailing"
    if out.pop("zero_terminal_snr", False):
        out["rescale_betas_zero_snr"] = True
        out.setdefault("timestep_spacing", "trailing")
    return out
