"""Schedules, weights, noise and steps against numpy."""

import math

import numpy as np
import pytest
from pixelloom.functions import noise, rng, schedule
from pixelloom.operators import steps
from pyspark.sql import functions as F


def test_snr_table(spark):
    table = schedule.snr_table(spark).orderBy("t").toPandas()
    bar = np.cumprod(1 - np.linspace(schedule.BETA_START, schedule.BETA_END, 1000))
    expected = (np.sqrt(bar) / np.sqrt(1 - bar)) ** 2
    assert len(table) == 1000 and (table.snr > 0).all() and (np.diff(table.snr) <= 0).all()
    assert np.allclose(table.snr, expected, atol=1e-5, rtol=1e-9) and table.snr.argmax() == 0 and table.snr.argmin() == 999


@pytest.mark.parametrize(("snr", "clip", "sigmoid", "tanh", "inverse"), [(0.5, 0.5, 0.5, 0.5, 1.414214), (4.9, 4.9, 4.933924, 4.920861, 0.451754), (5.0, 5, 5.0, 5.0, 0.447214), (5.1, 5, 5.033924, 5.020861, 0.442807), (50.0, 5, 5.0, 5.0, 0.141421)])
def test_snr_weights(spark, snr, clip, sigmoid, tanh, inverse):
    x = F.lit(snr)
    r = spark.range(1).select(*[F.round(schedule.min_snr(x, 5.0, 0.15, m), 6).alias(m) for m in ("clip", "sigmoid", "tanh")], F.round(schedule.debias(x), 6).alias("inverse")).first()
    assert (r["clip"], r["sigmoid"], r["tanh"], r["inverse"]) == (clip, sigmoid, tanh, inverse)


def test_snr_edges(spark):
    r = spark.range(1).select(schedule.loss_weight(F.lit(0.0), F.lit(0.0), "epsilon").alias("z"), schedule.debias(F.lit(1e-12)).alias("small"), schedule.debias(F.lit(1e9)).alias("large")).first()
    assert r.z is None and r.small == pytest.approx(1e4) and r.large == pytest.approx(1 / math.sqrt(1000))
    with pytest.raises(ValueError, match="unknown"):
        schedule.min_snr(F.lit(1.0), mode="x")


def test_logit_normal(spark):
    assert spark.range(1).select(schedule.logit_normal(F.lit(0.5)).alias("d")).first().d == pytest.approx(4 / math.sqrt(2 * math.pi))
    for bad in (0.0, 1.0):
        with pytest.raises(Exception, match="strictly between"):
            spark.range(1).select(schedule.logit_normal(F.lit(bad) + F.col("id")).alias("d")).collect()
    assert schedule.logit_weights(spark).agg(F.sum("weight")).first()[0] == pytest.approx(1)


def test_draws(spark):
    draws = spark.range(3000).withColumn("u", rng.uniform("x", F.col("id"))).withColumn("sigma", F.exp(rng.normal("y", F.col("id"))))
    table = schedule.logit_weights(spark)
    cdf = np.array([r.cdf for r in table.orderBy("t").collect()])
    for r in schedule.draw_by_cdf(draws, table).collect():
        assert r.t == min(np.searchsorted(cdf, r.u, side="right"), 999)
    levels = np.array([math.sqrt((1 - r.alpha_bar) / r.alpha_bar) for r in schedule.snr_table(spark).orderBy("t").collect()])
    for r in schedule.nearest_sigma(draws, schedule.snr_table(spark)).collect():
        assert r.t == np.abs(levels - r.sigma).argmin()


def test_uniform_is_uniform(spark):
    u = np.sort([r.u for r in spark.range(4000).select(rng.uniform("k", F.col("id")).alias("u")).collect()])
    assert np.abs(u - np.arange(4000) / 4000).max() < 1.95 / math.sqrt(4000)


def _bilinear(grid, to_h, to_w):
    h, w = grid.shape
    out = np.zeros((to_h, to_w))
    for y in range(to_h):
        for x in range(to_w):
            sy, sx = max(0, (y + 0.5) * h / to_h - 0.5), max(0, (x + 0.5) * w / to_w - 0.5)
            y0, x0 = int(sy), int(sx)
            y1, x1, fy, fx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), sy - y0, sx - x0
            out[y, x] = (1 - fy) * ((1 - fx) * grid[y0, x0] + fx * grid[y0, x1]) + fy * ((1 - fx) * grid[y1, x0] + fx * grid[y1, x1])
    return out


@pytest.mark.parametrize(("h", "w"), [(1, 1), (2, 2), (4, 4), (8, 8)])
def test_upsample(spark, h, w):
    grid = np.random.default_rng(h).standard_normal((h, w))
    got = spark.createDataFrame([(grid.ravel().tolist(),)], "g array<double>").select(noise.upsample(F.col("g"), h, w, 8, 8).alias("u")).first().u
    assert np.allclose(np.array(got).reshape(8, 8), _bilinear(grid, 8, 8))


def test_brownian(spark):
    grid = np.random.default_rng(0).standard_normal((8, 8))
    walk = grid.cumsum(axis=0).cumsum(axis=1)
    walk = (walk - walk.mean()) / walk.std(ddof=1)
    df = spark.createDataFrame([(grid.ravel().tolist(),), ([0.0] * 64,)], "g array<double>")
    got = [np.array(r.b).reshape(8, 8) for r in df.select(noise.brownian(F.col("g"), 8, 8).alias("b")).collect()]
    assert np.allclose(got[0], walk) and (got[1] == 0).all()


def test_grid_errors():
    with pytest.raises(ValueError, match="same length"):
        noise.multi_resolution(8, 8, (1.0, 0.5), [1.0], F.lit(1))
    with pytest.raises(ValueError, match="unknown prediction"):
        noise.target("x", F.lit(1), F.lit(1), F.lit(1))


def test_pixels(spark):
    values = [float("nan"), float("inf"), float("-inf"), -1.0, 0.0, 255.0, 300.0]
    assert spark.createDataFrame([(values,)], "v array<double>").select(noise.to_pixels(F.col("v")).alias("p")).first().p == [128, 255, 0, 0, 0, 255, 255]


def test_cadence(spark):
    df = spark.createDataFrame([(k,) for k in (0, 3, 6, 5, 10, 15)], "global_step long")
    got = {r.global_step: r for r in steps.cadence(df, save_every=3, checkpoint_every=3, preview_every=0, steps_per_epoch=5, epoch_every=1).collect()}
    assert not got[0].save and got[0].checkpoint and got[3].save and got[6].save and not got[5].save_epoch and got[10].save_epoch and not any(r.preview for r in got.values())


def test_moving_average_over_blocks(spark):
    values = np.random.default_rng(1).standard_normal(700)
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(values)] + [(2, 0, 5.0)], "p long, k long, v double")
    got = {r.p: r for r in steps.moving_averages(df, "p", ["k"], "v", {"a": 0.999, "b": 0.5}, start=10, block=256).collect()}
    for name, d in (("a", 0.999), ("b", 0.5)):
        ema = values[0]
        for k, v in enumerate(values):
            ema = d * ema + (1 - d) * v if k >= 10 else ema
        assert got[1][name] == pytest.approx(ema)
    assert got[2].a == 5.0 and got[1].n_steps == 700


def test_nan_loss_is_an_error(spark):
    with pytest.raises(Exception, match="loss is NaN"):
        spark.createDataFrame([(float("nan"),)], "v double").select(steps.guarded(F.col("v")).alias("v")).collect()


def test_zero_terminal_snr(spark):
    table = schedule.zero_terminal_snr(schedule.snr_table(spark)).orderBy("t").toPandas()
    assert table.snr.iloc[-1] == 0 and table.alpha_bar.iloc[0] == pytest.approx(1 - schedule.BETA_START) and (np.diff(table.snr) < 0).all()
    assert schedule.scheduler_settings({"prediction_type": "epsilon"})["timestep_spacing"] == "trailing"
    assert schedule.scheduler_settings({"zero_terminal_snr": True}) == {"rescale_betas_zero_snr": True, "timestep_spacing": "trailing"}


def test_options_fingerprint(spark):
    import hashlib

    from pixelloom.functions.naming import options_fingerprint

    rows = [("a cat", 3, True), ("it's", None, False), ('say "it\'s"', -1, None), ("two\nlines \\ tab\t", 0, True), (None, 1, True)]
    df = spark.createDataFrame(rows, "prompt string, steps long, on boolean")
    got = df.select(options_fingerprint({c: F.col(c) for c in df.columns}).alias("f")).collect()
    assert [r.f for r in got] == [hashlib.sha256(str(dict(zip(df.columns, r, strict=True))).encode()).hexdigest()[:8] for r in rows]


def test_pairs_of_different_lengths_are_an_error(spark):
    from pixelloom.operators.prompts import paired

    df = spark.createDataFrame([(["a", "b"], [["x"], ["y"]]), ([], [])], "c array<string>, t array<array<string>>")
    assert [[tuple(p) for p in r.p] for r in df.select(paired(F.col("c"), F.col("t")).alias("p")).collect()] == [[("a", ["x"]), ("b", ["y"])], []]
    with pytest.raises(Exception, match="differ in number"):
        df.select(paired(F.col("c"), F.slice("t", 1, 1)).alias("p")).collect()
