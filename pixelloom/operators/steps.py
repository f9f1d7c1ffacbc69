"""Training steps from a log of batches: accumulation, cadences, moving averages and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import numbered_in_order

#: Batches per block when a moving average is folded.
BLOCK = 4096


def accumulate(batches: DataFrame, process: str, order: list[str], loss: str, accumulation: int) -> DataFrame:
    """One row per process and global step: the mean loss of its ``accumulation`` batches, the last one short."""
    placed = numbered_in_order(batches, [process], order, "ordinal")
    steps = placed.withColumn("global_step", F.ceil(F.col("ordinal") / accumulation).cast("long"))
    return steps.groupBy(process, "global_step").agg(F.avg(loss).alias("train_loss"), F.count(F.lit(1)).alias("n_batches"))


def across_processes(steps: DataFrame, loss: str = "train_loss") -> DataFrame:
    """The mean loss of all processes at each global step."""
    return steps.groupBy("global_step").agg(F.avg(loss).alias("train_loss"), F.count(F.lit(1)).alias("n_processes"))


def cadence(steps: DataFrame, step: str = "global_step", *, save_every: int, checkpoint_every: int, preview_every: int, steps_per_epoch: int, epoch_every: int) -> DataFrame:
    """Which events fire after a step. 0 turns one off; saves skip step 0; epochs fire at their last step, never epoch 0."""
    every = lambda n: F.lit(False) if n <= 0 else F.col(step) % n == 0
    epoch = F.floor((F.col(step) - 1) / steps_per_epoch).cast("long")
    at_end = (F.col(step) % steps_per_epoch == 0) & (F.col("epoch") != 0) & (F.lit(False) if epoch_every <= 0 else F.col("epoch") % epoch_every == 0)
    return steps.withColumn("epoch", epoch).withColumns({"save": every(save_every) & (F.col(step) != 0), "checkpoint": every(checkpoint_every), "preview": every(preview_every), "save_epoch": at_end})


def moving_averages(batches: DataFrame, process: str, order: list[str], value: str, decays: dict[str, float], start: int = 0, block: int = BLOCK) -> DataFrame:
    """The last exponential moving averages of each process, one column per decay.

    The average starts as the first value and follows it from step ``start`` on.
    Steps are summed in blocks - a block of n multiplies the average by
    decay ** n and adds a weighted sum - so only one row per ``block`` steps is folded in order.
    """
    rows = numbered_in_order(batches.select(process, *order, F.col(value).alias("x")), [process], order, "at").withColumn("at", F.col("at") - 1)
    live = rows.withColumn("x0", F.when(F.col("at") == 0, F.col("x"))).withColumn("on", (F.col("at") > 0) & (F.col("at") >= start))
    blocked = live.withColumn("block", F.floor(F.col("at") / block)).withColumn("inside", F.col("at") % block)
    # Weights fall from the block's last step, whose place is known when the block is complete.
    ends = blocked.withColumn("end", F.max("inside").over(W.partitionBy(process, "block")))
    sums = []
    for name, d in decays.items():
        weight = F.when(F.col("on"), (1 - d) * F.pow(F.lit(d), F.col("end") - F.col("inside"))).otherwise(0.0)
        sums.append(F.sum(weight * F.col("x")).alias(f"s_{name}"))
    blocks = ends.groupBy(process, "block").agg(*sums, F.count(F.when(F.col("on"), 1)).alias("n_on"), F.max("x0").alias("x0"), F.count(F.lit(1)).alias("n"))
    folded = blocks.groupBy(process).agg(F.sort_array(F.collect_list(F.struct("block", "n_on", *[f"s_{n}" for n in decays]))).alias("b"), F.max("x0").alias("x0"), F.sum("n").alias("n_steps"))
    fold = lambda name, d: F.aggregate("b", F.col("x0"), lambda ema, b: ema * F.pow(F.lit(d), b["n_on"]) + b[f"s_{name}"])
    return folded.select(process, "n_steps", *[fold(name, d).alias(name) for name, d in decays.items()])


def guarded(loss: Column) -> Column:
    """The loss; NaN is an error."""
    return F.when(F.isnan(loss), F.raise_error(F.lit("loss is NaN"))).otherwise(loss)
