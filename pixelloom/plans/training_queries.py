"""Queries over schedules, noise, losses, steps and names, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import naming, noise, rng, schedule
from ..operators import prompts, states, steps
from .data_queries import CAPTIONS, _u, docs, query

# --- SQL pieces -----------------------------------------------------------------------------------------------------

SNR = f"""be AS (SELECT t, {schedule.BETA_START}::DOUBLE + t * ({schedule.BETA_END - schedule.BETA_START}::DOUBLE / 999) AS beta FROM range(1000) AS r(t)),
snr AS (SELECT t, beta, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alpha_bar FROM be),
s AS (SELECT t, beta, alpha_bar, alpha_bar / (1 - alpha_bar) AS snr FROM snr)"""
WEIGHTS = """de AS (SELECT t, 1e-10::DOUBLE + t * ((1 - 1e-10::DOUBLE) / 1000) AS x FROM range(1000) AS r(t)),
dn AS (SELECT t, exp(-(ln(x / (1 - x)) * ln(x / (1 - x))) / 2) / (sqrt(2 * pi()) * x * (1 - x)) AS d FROM de),
w AS (SELECT t, d / sum(d) OVER () AS weight FROM dn),
cd AS (SELECT t, weight, round(sum(weight) OVER (ORDER BY t), 9) AS cdf FROM w)"""


def _n(*parts: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_u(*parts, chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {_u(*parts, chr(39) + 'b' + chr(39))}))"


def _t(name: str) -> str:
    return f"'{name}'"


def ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id")


_EVENTS = f"e AS (SELECT event_id, user_id, value, floor({_u(_t('t'), 'event_id')} * 1000)::BIGINT AS t FROM events)"


def _drawn(spark, sf_dir):
    """Events with a timestep."""
    return docs(spark, sf_dir, "events").select("event_id", "user_id", "value", F.floor(rng.uniform("t", F.col("event_id")) * 1000).cast("long").alias("t"))


def _at_steps(spark, sf_dir, table):
    """Events with the row of ``table`` for their timestep: an equal join with its STEPS rows."""
    return _drawn(spark, sf_dir).join(F.broadcast(table), "t")


def _events(spark, sf_dir):
    """Events with a timestep and its SNR."""
    return _at_steps(spark, sf_dir, schedule.snr_table(spark).select("t", "snr"))


_ACC = """o AS (SELECT user_id, value, ceil(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / 4.0)::BIGINT AS global_step FROM events),
a AS (SELECT user_id, global_step, avg(value) AS train_loss, count(*) AS n_batches FROM o GROUP BY 1, 2)"""


def _accumulated(spark, sf_dir):
    return steps.accumulate(docs(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 4)


# --- schedules and weights ------------------------------------------------------------------------------------------


@query("snr_table", f"WITH {SNR}, {_EVENTS} SELECT event_id, t, round(beta, 9) AS beta, round(alpha_bar, 6) AS alpha_bar, round(snr, 6) AS snr FROM e JOIN s USING (t)")
def snr_table(spark, sf_dir):
    return _at_steps(spark, sf_dir, schedule.snr_table(spark)).select("event_id", "t", F.round("beta", 9).alias("beta"), F.round("alpha_bar", 6).alias("alpha_bar"), F.round("snr", 6).alias("snr"))


@query("logit_weights", f"WITH {WEIGHTS}, {_EVENTS} SELECT event_id, t, round(weight, 9) AS weight, cdf FROM e JOIN cd USING (t)")
def logit_weights(spark, sf_dir):
    return _at_steps(spark, sf_dir, schedule.logit_weights(spark)).select("event_id", "t", F.round("weight", 9).alias("weight"), "cdf")


@query("uniform_weights", f"WITH {_EVENTS} SELECT user_id, round(count(*) / 1000.0::DOUBLE, 6) AS weight, count(DISTINCT t) AS n_steps FROM e GROUP BY user_id")
def uniform_weights(spark, sf_dir):
    """The weight that each user's timesteps have together when all timesteps weigh the same."""
    found = _at_steps(spark, sf_dir, schedule.uniform_weights(spark))
    return found.groupBy("user_id").agg(F.round(F.sum("weight"), 6).alias("weight"), F.countDistinct("t").alias("n_steps"))


@query("lognormal_sigma_table", f"WITH {SNR}, {_EVENTS} SELECT event_id, t, round(sqrt((1 - greatest(alpha_bar, 1e-12::DOUBLE)) / greatest(alpha_bar, 1e-12::DOUBLE)), 6) AS sigma FROM e JOIN s USING (t)")
def lognormal_sigma_table(spark, sf_dir):
    return _at_steps(spark, sf_dir, schedule.snr_table(spark)).select("event_id", "t", F.round(schedule.sigma(F.col("alpha_bar")), 6).alias("sigma"))


@query("timestep_histogram_uniform", f"SELECT floor({_u(_t('uniform'), 'doc_id')} * 1000)::BIGINT AS t, count(*) AS n FROM documents GROUP BY 1")
def timestep_histogram_uniform(spark, sf_dir):
    return ids(spark, sf_dir).groupBy(F.floor(rng.uniform("uniform", F.col("doc_id")) * 1000).cast("long").alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "timestep_histogram_logit",
    f"""WITH {WEIGHTS}, u AS (SELECT doc_id, {_u(_t('logit'), 'doc_id')} AS u FROM documents), r AS (SELECT t, coalesce(lag(cdf) OVER (ORDER BY t), -1) AS lo, CASE WHEN t = 999 THEN 2 ELSE cdf END AS hi FROM cd)
SELECT t, count(*) AS n FROM u JOIN r ON u.u >= r.lo AND u.u < r.hi GROUP BY t""",
)
def timestep_histogram_logit(spark, sf_dir):
    draws = ids(spark, sf_dir).withColumn("u", rng.uniform("logit", F.col("doc_id")))
    return schedule.draw_by_cdf(draws, schedule.logit_weights(spark)).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


@query(
    "timestep_histogram_lognormal",
    f"""WITH {SNR}, l AS (SELECT t, sqrt((1 - alpha_bar) / alpha_bar) AS g FROM s), x AS (SELECT doc_id, exp(-0.5::DOUBLE + 1.2::DOUBLE * {_n(_t('sigma'), 'doc_id')}) AS v FROM documents),
p AS (SELECT doc_id, arg_min(t, {{'e': abs(g - v), 't': t}}) AS t FROM x, l GROUP BY doc_id)
SELECT t, count(*) AS n FROM p GROUP BY t""",
)
def timestep_histogram_lognormal(spark, sf_dir):
    draws = ids(spark, sf_dir).withColumn("sigma", F.exp(-0.5 + 1.2 * rng.normal("sigma", F.col("doc_id"))))
    return schedule.nearest_sigma(draws, schedule.snr_table(spark)).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


_CLIP = "least(snr, 5.0::DOUBLE)"
_SIG = "(snr * (1 / (1 + exp((snr - 5) / 0.15::DOUBLE))) + 5 * (1 - 1 / (1 + exp((snr - 5) / 0.15::DOUBLE))))"
_TANH = "(snr * ((1 - tanh((snr - 5) / 0.15::DOUBLE)) / 2) + 5 * (1 - (1 - tanh((snr - 5) / 0.15::DOUBLE)) / 2))"
_DEBIAS = "(1 / sqrt(least(greatest(snr, 1e-8::DOUBLE), 1000)))"


@query(
    "loss_weights",
    f"""WITH {SNR}, {_EVENTS} SELECT event_id, t, round({_CLIP}, 6) AS clip, round({_SIG}, 6) AS sigmoid, round({_TANH}, 6) AS tanh, round({_CLIP} / nullif(snr, 0), 6) AS epsilon, round({_CLIP} / (snr + 1), 6) AS v_prediction FROM e JOIN s USING (t)""",
)
def loss_weights(spark, sf_dir):
    snr = F.col("snr")
    clip = schedule.min_snr(snr, mode="clip")
    return _events(spark, sf_dir).select("event_id", "t", F.round(clip, 6).alias("clip"), *[F.round(schedule.min_snr(snr, 5.0, 0.15, m), 6).alias(m) for m in ("sigmoid", "tanh")], *[F.round(schedule.loss_weight(clip, snr, p), 6).alias(p) for p in ("epsilon", "v_prediction")])


@query("debias", f"WITH {SNR}, {_EVENTS} SELECT event_id, t, round({_DEBIAS}, 6) AS weight FROM e JOIN s USING (t)")
def debias(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "t", F.round(schedule.debias(F.col("snr")), 6).alias("weight"))


@query("weighted_loss", f"WITH {SNR}, {_EVENTS} SELECT user_id, round(avg(value * {_DEBIAS} * ({_CLIP} / nullif(snr, 0))), 6) AS loss, count(*) AS n FROM e JOIN s USING (t) GROUP BY user_id")
def weighted_loss(spark, sf_dir):
    weight = schedule.debias(F.col("snr")) * schedule.loss_weight(schedule.min_snr(F.col("snr"), mode="clip"), F.col("snr"), "epsilon")
    return _events(spark, sf_dir).groupBy("user_id").agg(F.round(F.avg(F.col("value") * weight), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("perturbation_decay", "SELECT event_id, round(value * (0.1::DOUBLE * greatest(0, 1 - (event_id % 1000) / 500.0::DOUBLE)), 6) AS decaying, round(value * 0.1::DOUBLE, 6) AS constant FROM events")
def perturbation_decay(spark, sf_dir):
    """Each event's value as second noise at step event_id % 1000."""
    step = F.col("event_id") % 1000
    return docs(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * schedule.perturbation(step, 0.1, 500), 6).alias("decaying"), F.round(F.col("value") * schedule.perturbation(step, 0.1, 0), 6).alias("constant"))


@query("adaptive_schedule", f"WITH {_EVENTS} SELECT event_id, t, round(1 - t / 1000.0::DOUBLE, 6) AS linear, round(0.5::DOUBLE * (1 + cos(pi() * t / 1000.0::DOUBLE)), 6) AS cosine, round(exp(-2.0::DOUBLE * t / 1000), 6) AS exponential FROM e")
def adaptive_schedule(spark, sf_dir):
    return _drawn(spark, sf_dir).select("event_id", "t", *[F.round(schedule.noise_strength(F.col("t"), k), 6).alias(k) for k in ("linear", "cosine", "exponential")])


@query(
    "lr_schedule",
    f"""WITH {_ACC}, x AS (SELECT user_id, global_step * 10 AS step FROM a)
SELECT user_id, step, round(0.001::DOUBLE * CASE WHEN step < 100 THEN step / 100.0::DOUBLE WHEN (step - 100) / 900.0::DOUBLE >= 1 THEN 0 ELSE greatest(0, 0.5::DOUBLE * (1 + cos(pi() * fmod(3 * ((step - 100) / 900.0::DOUBLE), 1.0::DOUBLE)))) END, 9) AS cosine,
round(0.001::DOUBLE * least(1, step / 100.0::DOUBLE), 9) AS constant FROM x""",
)
def lr_schedule(spark, sf_dir):
    """Learning rates at every tenth step of each user's run."""
    at = _accumulated(spark, sf_dir).select("user_id", (F.col("global_step") * 10).alias("step"))
    step = F.col("step").cast("double")
    return at.select("user_id", "step", F.round(schedule.cosine_restarts(step, 100, 1000, 3, 0.001), 9).alias("cosine"), F.round(schedule.warmup_constant(step, 100, 0.001), 9).alias("constant"))


@query(
    "lr_restarts",
    f"""WITH {_ACC}, x AS (SELECT user_id, global_step * 7 AS step FROM a)
SELECT user_id, step, round(CASE WHEN step % 50 < 5 THEN (0.1::DOUBLE * pow(0.5::DOUBLE, floor(step / 50)) - 0.05::DOUBLE) * (step % 50 + 1) / 5 + 0.05::DOUBLE
  ELSE 0.05::DOUBLE + (0.1::DOUBLE - 0.05::DOUBLE) * (1 + cos(pi() * (step % 50) / 50)) / 2 END, 9) AS lr FROM x""",
)
def lr_restarts(spark, sf_dir):
    """Learning rates at every seventh step of each user's run."""
    at = _accumulated(spark, sf_dir).select("user_id", (F.col("global_step") * 7).alias("step"))
    return at.withColumn("lr", F.round(schedule.decayed_restarts(F.col("step")), 9))


@query(
    "strategy_dispatch",
    f"""WITH {SNR}, {WEIGHTS}, x AS (SELECT doc_id, doc_id % 3 AS way FROM documents),
r AS (SELECT t, coalesce(lag(cdf) OVER (ORDER BY t), -1) AS lo, CASE WHEN t = 999 THEN 2 ELSE cdf END AS hi FROM cd),
l AS (SELECT t, sqrt((1 - alpha_bar) / alpha_bar) AS g FROM s),
v AS (SELECT doc_id, exp(-0.5::DOUBLE + 1.2::DOUBLE * {_n(_t('run'), 'doc_id')}) AS v FROM x WHERE way = 2)
SELECT doc_id, 'uniform' AS strategy, floor({_u(_t('run'), 'doc_id')} * 1000)::BIGINT AS t FROM x WHERE way = 0
UNION ALL SELECT doc_id, 'logit', t FROM x JOIN r ON {_u(_t('run'), 'doc_id')} >= lo AND {_u(_t('run'), 'doc_id')} < hi WHERE way = 1
UNION ALL SELECT doc_id, 'lognormal', arg_min(t, {{'e': abs(g - v), 't': t}}) FROM v, l GROUP BY doc_id""",
)
def strategy_dispatch(spark, sf_dir):
    """Timesteps of a third of the documents by each of the strategies that a run can name."""
    found = [schedule.sample_timesteps(ids(spark, sf_dir).where(F.col("doc_id") % 3 == k), name, "run", "doc_id").select("doc_id", F.lit(name).alias("strategy"), F.col("t").cast("long").alias("t")) for k, name in enumerate(("uniform", "logit", "lognormal"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


# --- noise on 8 x 8 latents -----------------------------------------------------------------------------------------


def _latents(spark, sf_dir):
    return docs(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _round(x):
    """To 6 places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def _long(df, values, name="value"):
    """One row per cell, rounded."""
    return df.select("vec_id", F.posexplode(values).alias("cell", "v")).select("vec_id", F.col("cell").cast("long").alias("cell"), _round(F.col("v")).alias(name))


def _grid_sql(h: int, w: int, *keys: str) -> str:
    return f"list_transform(range({h * w}), lambda k: {_n('vec_id', *keys, 'k')})"


def _up_sql(name: str, h: int, w: int) -> str:
    """``name`` (h x w) seen at 8 x 8, as an expression of the cell number c."""
    sy, sx = (f"greatest(0, ({i} + 0.5::DOUBLE) * {n / 8}::DOUBLE - 0.5::DOUBLE)" for i, n in (("floor(c / 8)", h), ("(c % 8)", w)))
    y0, x0 = f"floor({sy})", f"floor({sx})"
    y1, x1 = f"least({y0} + 1, {h - 1})", f"least({x0} + 1, {w - 1})"
    fy, fx = f"({sy} - {y0})", f"({sx} - {x0})"
    at = lambda y, x: f"{name}[({y} * {w} + {x} + 1)::BIGINT]"
    return f"((1 - {fy}) * ((1 - {fx}) * {at(y0, x0)} + {fx} * {at(y0, x1)}) + {fy} * ((1 - {fx}) * {at(y1, x0)} + {fx} * {at(y1, x1)}))"


_FLAT = "SELECT vec_id, c AS cell, round({0}, 6) + 0.0::DOUBLE AS value FROM g, range(64) AS r(c)"


@query("pyramid_noise", f"WITH g AS (SELECT vec_id, {_grid_sql(8, 8, _t('level'), _t('0'))} AS a, {_grid_sql(4, 4, _t('level'), _t('1'))} AS b, {_grid_sql(2, 2, _t('level'), _t('2'))} AS z FROM embeddings) " + _FLAT.format(f"a[c + 1] + 0.4::DOUBLE * {_up_sql('b', 4, 4)} + {0.4**2}::DOUBLE * {_up_sql('z', 2, 2)}"))
def pyramid_noise(spark, sf_dir):
    return _long(_latents(spark, sf_dir), noise.pyramid(8, 8, 3, 0.4, F.col("vec_id")))


@query("multires_noise", f"WITH g AS (SELECT vec_id, {_grid_sql(8, 8, _t('scale'), _t('0'))} AS a, {_grid_sql(4, 4, _t('scale'), _t('1'))} AS b, {_grid_sql(2, 2, _t('scale'), _t('2'))} AS z FROM embeddings) " + _FLAT.format(f"(1.0::DOUBLE / 3) * a[c + 1] + (1.0::DOUBLE / 3) * {_up_sql('b', 4, 4)} + (1.0::DOUBLE / 3) * {_up_sql('z', 2, 2)}"))
def multires_noise(spark, sf_dir):
    return _long(_latents(spark, sf_dir), noise.multi_resolution(8, 8, (1.0, 0.5, 0.25), None, F.col("vec_id")))


@query(
    "noise_offset",
    f"""WITH g AS (SELECT vec_id, {_grid_sql(8, 8, _t('base'))} AS a, CASE WHEN {_u('vec_id', _t('use'))} < 0.5::DOUBLE THEN 0.1::DOUBLE * {_n('vec_id', _t('offset'))} ELSE 0 END AS o FROM embeddings) """ + _FLAT.format("a[c + 1] + o"),
)
def noise_offset(spark, sf_dir):
    key = F.col("vec_id")
    return _long(_latents(spark, sf_dir), noise.with_offset(noise.gaussian(8, 8, key, "base"), 0.1, 0.5, key))


@query(
    "brownian_noise",
    """WITH x AS (SELECT vec_id, unnest(range(64)) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings),
a AS (SELECT vec_id, c, sum(v) OVER (PARTITION BY vec_id, c % 8 ORDER BY c) AS v FROM x),
b AS (SELECT vec_id, c, sum(v) OVER (PARTITION BY vec_id, floor(c / 8) ORDER BY c) AS v FROM a),
m AS (SELECT vec_id, c, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM b),
s AS (SELECT vec_id, c, v, stddev_samp(v) OVER (PARTITION BY vec_id) AS d FROM m)
SELECT vec_id, c AS cell, round(v / CASE WHEN d = 0 THEN 1 ELSE d END, 6) + 0.0::DOUBLE AS value FROM s""",
)
def brownian_noise(spark, sf_dir):
    return _long(_latents(spark, sf_dir), noise.brownian(F.col("x"), 8, 8))


@query(
    "noise_choice",
    f"""WITH g AS (SELECT vec_id, {_grid_sql(8, 8, _t('base'))} AS e, {_grid_sql(8, 8, _t('level'), _t('0'))} AS a, {_grid_sql(4, 4, _t('level'), _t('1'))} AS b, {_grid_sql(8, 8, _t('scale'), _t('0'))} AS p, {_grid_sql(2, 2, _t('scale'), _t('1'))} AS q FROM embeddings),
x AS (SELECT vec_id, c, e[c + 1] AS e, a[c + 1] + 0.8::DOUBLE * {_up_sql('b', 4, 4)} AS levels, 0.5::DOUBLE * p[c + 1] + 0.5::DOUBLE * {_up_sql('q', 2, 2)} AS scales FROM g, range(64) AS r(c)),
rows AS (SELECT *, sum(e) OVER (PARTITION BY vec_id, c % 8 ORDER BY c) AS v FROM x),
walk AS (SELECT *, sum(v) OVER (PARTITION BY vec_id, floor(c / 8) ORDER BY c) AS u FROM rows),
n AS (SELECT *, (u - avg(u) OVER w) / stddev_samp(u) OVER w * 2.0::DOUBLE AS brownian FROM walk WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, c AS cell, round(CASE vec_id % 4 WHEN 0 THEN brownian WHEN 1 THEN scales WHEN 2 THEN levels ELSE e END, 6) + 0.0::DOUBLE AS value FROM n""",
)
def noise_choice(spark, sf_dir):
    """Four settings, a quarter of the rows each; what comes first in precedence decides, whatever else is set."""
    key, all_set = F.col("vec_id"), {"levels": 2, "discount": 0.8}
    settings = (all_set | {"brownian_scale": 2.0, "scales": (1.0, 0.25)}, all_set | {"scales": (1.0, 0.25)}, all_set, all_set | {"scales": (1.0, 0.25), "several": False})
    choice = F.lit(None)
    for k, s in enumerate(settings):
        choice = F.when(key % 4 == k, noise.drawn(8, 8, key, **s)).otherwise(choice)
    return _long(docs(spark, sf_dir, "embeddings"), choice)


_AB = "(vec_id % 997 + 1) / 1000.0::DOUBLE"


def _noised(spark, sf_dir):
    return _latents(spark, sf_dir).withColumn("e", noise.gaussian(8, 8, F.col("vec_id"), "base")).withColumn("a", (F.col("vec_id") % 997 + 1) / 1000.0)


_LE = f"WITH g AS (SELECT vec_id, embedding AS x, {_grid_sql(8, 8, _t('base'))} AS e, {_AB} AS a FROM embeddings) "


@query("add_noise", _LE + _FLAT.format("sqrt(a) * x[c + 1]::DOUBLE + sqrt(1 - a) * e[c + 1]"))
def add_noise(spark, sf_dir):
    return _long(_noised(spark, sf_dir), noise.add_noise(F.col("x"), F.col("e"), F.col("a")))


@query("velocity_target", _LE + _FLAT.format("sqrt(a) * e[c + 1] - sqrt(1 - a) * x[c + 1]::DOUBLE"))
def velocity_target(spark, sf_dir):
    return _long(_noised(spark, sf_dir), noise.target("v_prediction", F.col("x"), F.col("e"), F.col("a")))


@query("sample_prediction", _LE + _FLAT.format("x[c + 1]::DOUBLE - e[c + 1]"))
def sample_prediction(spark, sf_dir):
    return _long(_noised(spark, sf_dir), noise.prediction("sample", F.col("x"), F.col("e")))


@query("latent_scale", "SELECT vec_id, c AS cell, round(embedding[c + 1]::DOUBLE * 0.18215::DOUBLE, 6) + 0.0::DOUBLE AS value, round(embedding[c + 1]::DOUBLE / 0.18215::DOUBLE, 6) + 0.0::DOUBLE AS inverse FROM embeddings, range(64) AS r(c)")
def latent_scale(spark, sf_dir):
    cells = _latents(spark, sf_dir).select("vec_id", F.posexplode("x").alias("cell", "v"))
    return cells.select("vec_id", F.col("cell").cast("long").alias("cell"), _round(F.col("v") * 0.18215).alias("value"), _round(F.col("v") / 0.18215).alias("inverse"))


_SPOILT = "CASE c WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE ELSE embedding[c + 1]::DOUBLE * 400 END"


@query("pixel_sanitise", f"WITH v AS (SELECT vec_id, c, {_SPOILT} AS v FROM embeddings, range(64) AS r(c)) SELECT vec_id, c AS cell, floor(CASE WHEN isnan(v) THEN 128 ELSE least(greatest(v, 0), 255) END)::INTEGER AS value FROM v")
def pixel_sanitise(spark, sf_dir):
    bad = F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf")))
    spoilt = F.transform("x", lambda v, i: F.when(i < 3, F.get(bad, i)).otherwise(v * 400))
    return _latents(spark, sf_dir).select("vec_id", F.posexplode(noise.to_pixels(spoilt)).alias("cell", "value")).withColumn("cell", F.col("cell").cast("long"))


@query("pixel_normalise", "SELECT vec_id, c AS cell, round((((vec_id * 31 + c * 7) % 256) / 255.0::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE, 6) + 0.0::DOUBLE AS value FROM embeddings, range(64) AS r(c)")
def pixel_normalise(spark, sf_dir):
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda c: (F.col("vec_id") * 31 + c * 7) % 256)
    return _long(_latents(spark, sf_dir), noise.normalised(pixels))


@query("grad_clip", "WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings) SELECT vec_id, round(least(1, coalesce(0.5::DOUBLE / nullif(norm, 0), 1)), 6) AS factor FROM n")
def grad_clip(spark, sf_dir):
    return _latents(spark, sf_dir).select("vec_id", F.round(noise.clip_factor(F.col("x"), 0.5), 6).alias("factor"))


@query("per_sample_then_batch_mean", "WITH p AS (SELECT label, list_avg(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS l FROM embeddings) SELECT label, round(avg(l), 6) AS loss, count(*) AS n FROM p GROUP BY label")
def per_sample_then_batch_mean(spark, sf_dir):
    each = docs(spark, sf_dir, "embeddings").select("label", (F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size("embedding")).alias("l"))
    return each.groupBy("label").agg(F.round(F.avg("l"), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("parameter_count", "SELECT 'layer' || label AS name, sum(len(embedding) * (vec_id % 7 + 1))::BIGINT AS n_params FROM embeddings GROUP BY 1")
def parameter_count(spark, sf_dir):
    shape = F.array(F.size("embedding").cast("long"), F.col("vec_id") % 7 + 1)
    numel = F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)
    return docs(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("layer"), F.col("label").cast("string")).alias("name")).agg(F.sum(numel).alias("n_params"))


# --- steps ----------------------------------------------------------------------------------------------------------

@query("grad_accumulation", f"WITH {_ACC} SELECT user_id, global_step, round(train_loss, 6) AS train_loss, n_batches FROM a")
def grad_accumulation(spark, sf_dir):
    return _accumulated(spark, sf_dir).withColumn("train_loss", F.round("train_loss", 6))


@query("training_log", f"WITH {_ACC} SELECT global_step, round(avg(train_loss), 6) AS train_loss, count(*) AS n_processes FROM a GROUP BY global_step")
def training_log(spark, sf_dir):
    return steps.across_processes(_accumulated(spark, sf_dir)).withColumn("train_loss", F.round("train_loss", 6))


@query(
    "cadence_events",
    f"""WITH {_ACC}, e AS (SELECT user_id, global_step, floor((global_step - 1) / 5)::BIGINT AS epoch FROM a)
SELECT user_id, global_step, epoch, global_step % 3 = 0 AND global_step <> 0 AS save, global_step % 4 = 0 AS checkpoint, false AS preview, global_step % 5 = 0 AND epoch <> 0 AND epoch % 2 = 0 AS save_epoch FROM e""",
)
def cadence_events(spark, sf_dir):
    fired = steps.cadence(_accumulated(spark, sf_dir).select("user_id", "global_step"), save_every=3, checkpoint_every=4, preview_every=0, steps_per_epoch=5, epoch_every=2)
    return fired.select("user_id", "global_step", "epoch", "save", "checkpoint", "preview", "save_epoch")


def _ema(d: float) -> str:
    return f"list_reduce(v, lambda a, x, i: CASE WHEN i >= 4 THEN {d}::DOUBLE * a + {round(1 - d, 12)}::DOUBLE * x ELSE a END)"


@query("ema_dual", f"WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, len(v)::BIGINT AS n_steps, round({_ema(0.99)}, 6) AS long_ema, round({_ema(0.9)}, 6) AS short_ema FROM l")
def ema_dual(spark, sf_dir):
    found = steps.moving_averages(docs(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", {"long_ema": 0.99, "short_ema": 0.9}, start=EMA_START)
    return found.withColumns({c: F.round(c, 6) for c in ("long_ema", "short_ema")})


EMA_START = 3


@query("steps_and_batches", "SELECT event_type, count(*) AS n_batches, ceil(count(*) / 4.0)::BIGINT AS steps_per_epoch, (ceil(count(*) / 4.0) * 10)::BIGINT AS total_steps, count(*) * 8 AS samples FROM events GROUP BY event_type")
def steps_and_batches(spark, sf_dir):
    counts = docs(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_batches"))
    per = F.ceil(F.col("n_batches") / 4).cast("long")
    return counts.select("event_type", "n_batches", per.alias("steps_per_epoch"), (per * 10).alias("total_steps"), (F.col("n_batches") * 8).alias("samples"))


@query("nan_guard", "SELECT user_id, round(sum(value), 4) AS total FROM events WHERE NOT isnan(value) GROUP BY user_id")
def nan_guard(spark, sf_dir):
    return docs(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(steps.guarded(F.col("value"))), 4).alias("total"))


# --- names ----------------------------------------------------------------------------------------------------------


@query(
    "human_size",
    """WITH x AS (SELECT p_partkey, (p_partkey * p_partkey * p_partkey * 7 + p_partkey)::BIGINT AS n FROM part)
SELECT p_partkey, n, CASE WHEN n >= 1000000000 THEN ((n + 50000000) // 1000000000) || '.' || ((n + 50000000) // 100000000 % 10) || 'B' WHEN n >= 1000000 THEN ((n + 50000) // 1000000) || '.' || ((n + 50000) // 100000 % 10) || 'M'
  WHEN n >= 1000 THEN ((n + 50) // 1000) || '.' || ((n + 50) // 100 % 10) || 'K' ELSE n::VARCHAR END AS size FROM x""",
)
def human_size(spark, sf_dir):
    """Sizes of numbers that grow with the cube of a key; from keys of 1,096,303 on they need more than 64 bits, and ``n`` is a decimal if the table has such keys."""
    part, key = docs(spark, sf_dir, "part"), F.col("p_partkey").cast("decimal(12,0)")
    most = part.agg(F.max("p_partkey").alias("k")).first().k or 0
    n = (key * key * key * 7 + key).cast("long" if 7 * most**3 + most < 1 << 63 else "decimal(38,0)")
    return part.select("p_partkey", n.alias("n")).withColumn("size", naming.human_size(F.col("n")))


_NAMES = [n for names in naming.DTYPES.values() for n in names]
_CASES = " ".join(f"WHEN '{n}' THEN '{d}'" for d, names in naming.DTYPES.items() for n in names)


@query("dtype_names", f"WITH x AS (SELECT p_partkey, [{', '.join(map(repr, _NAMES))}][p_partkey % {len(_NAMES)} + 1] AS asked FROM part) SELECT p_partkey, asked, CASE asked {_CASES} END AS dtype FROM x")
def dtype_names(spark, sf_dir):
    asked = F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    return docs(spark, sf_dir, "part").select("p_partkey", asked.alias("asked")).withColumn("dtype", naming.dtype_name(F.col("asked")))


@query(
    "adapter_metadata",
    """WITH x AS (SELECT p_partkey, ['lora', 'lokr', 'loha'][p_partkey % 3 + 1] AS mode, CASE WHEN p_partkey % 2 = 0 THEN 'models/SD15/' ELSE 'models/xl/' END || p_partkey AS path FROM part),
k AS (SELECT p_partkey, unnest([{'k': 'ss_network_dim', 'v': (p_partkey % 64)::VARCHAR}, {'k': 'ss_network_alpha', 'v': '1'}, {'k': 'ss_network_module', 'v': 'lycoris.kohya'}, {'k': 'ss_network_args', 'v': '{"algo": "' || mode || '"}'},
  {'k': 'format', 'v': 'pt'}, {'k': 'ss_base_model_version', 'v': CASE WHEN contains(lower(path), 'sd15') THEN 'sd_v1' ELSE 'sdxl_v1' END}, {'k': 'ss_training_comment', 'v': 'LyCORIS ' || upper(mode) || ' training'},
  {'k': 'ss_resolution', 'v': CASE WHEN contains(lower(path), 'sd15') THEN '512,512' ELSE '1024,1024' END}, {'k': 'ss_lokr_factor', 'v': CASE WHEN mode = 'lokr' THEN '16' END}]) AS e FROM x)
SELECT p_partkey, e.k AS name, e.v AS value FROM k WHERE e.v IS NOT NULL""",
)
def adapter_metadata(spark, sf_dir):
    mode = F.get(F.array(F.lit("lora"), F.lit("lokr"), F.lit("loha")), (F.col("p_partkey") % 3).cast("int"))
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, "models/SD15/").otherwise("models/xl/"), F.col("p_partkey").cast("string"))
    made = naming.adapter_metadata(path, mode, F.col("p_partkey") % 64, F.lit(1), F.lit(16))
    return docs(spark, sf_dir, "part").select("p_partkey", F.explode(made).alias("name", "value"))


@query(
    "attention_stats",
    """WITH m AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'down.attn1' WHEN 1 THEN 'mid.Attention' WHEN 2 THEN 'resnet' ELSE 'up.attn2' END AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'XFormersAttnProcessor' WHEN 1 THEN 'AttnProcessor2_0' END AS processor FROM customer),
a AS (SELECT * FROM m WHERE contains(lower(name), 'attn') OR contains(lower(name), 'attention'))
SELECT coalesce(processor, 'none') AS processor, count(*) AS n, (SELECT count(*) FROM a) AS total, round(100.0::DOUBLE * (SELECT count(*) FROM a WHERE contains(lower(processor), 'xformers')) / (SELECT count(*) FROM a), 1) AS coverage FROM a GROUP BY 1""",
)
def attention_stats(spark, sf_dir):
    key = F.col("c_custkey")
    modules = docs(spark, sf_dir, "customer").select(
        F.when(key % 4 == 0, "down.attn1").when(key % 4 == 1, "mid.Attention").when(key % 4 == 2, "resnet").otherwise("up.attn2").alias("name"),
        F.when(key % 3 == 0, "XFormersAttnProcessor").when(key % 3 == 1, "AttnProcessor2_0").alias("processor"),
    )
    return attention_table(modules)


def attention_table(modules):
    """Attention modules by processor, with the total and the share of memory-efficient ones (name, processor)."""
    from pyspark.sql import Window as W

    low = F.lower("name")
    counts = modules.where(low.contains("attn") | low.contains("attention")).groupBy(F.coalesce("processor", F.lit("none")).alias("processor")).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(0))
    fast = F.sum(F.when(F.lower("processor").contains("xformers"), F.col("n")).otherwise(0)).over(every)
    return counts.withColumn("total", F.sum("n").over(every)).withColumn("coverage", F.round(100.0 * fast / F.col("total"), 1))


_UNET = ("time_embedding.linear_1.weight", "conv_in.bias", "down_blocks.1.resnets.0.norm1.weight", "down_blocks.2.attentions.1.proj_in.weight", "up_blocks.0.resnets.2.conv_shortcut.weight", "up_blocks.2.upsamplers.0.conv.weight", "up_blocks.0.upsamplers.0.conv.bias", "mid_block.resnets.1.time_emb_proj.bias", "mid_block.attentions.0.norm.weight", "down_blocks.0.downsamplers.0.conv.weight", "up_blocks.1.attentions.2.to_q.weight")
_VAE = ("encoder.down_blocks.0.resnets.1.conv_shortcut.weight", "encoder.mid_block.attentions.0.to_q.weight", "decoder.up_blocks.1.resnets.2.norm1.bias", "decoder.up_blocks.2.upsamplers.0.conv.weight", "decoder.mid_block.resnets.0.conv1.weight", "decoder.conv_norm_out.weight", "encoder.mid_block.attentions.0.group_norm.bias", "decoder.mid_block.attentions.0.to_out.0.weight")
_TEXT = ("text_model.encoder.layers.3.layer_norm1.weight", "text_model.encoder.layers.0.mlp.fc1.bias", "text_model.embeddings.token_embedding.weight", "text_model.embeddings.position_embedding.weight", "text_model.encoder.layers.5.self_attn.out_proj.weight", "text_model.final_layer_norm.bias")
_ADAPTER = ("lycoris_unet_down_blocks_0_attentions_1_transformer_blocks_0_attn1", "lycoris_te_a_b", "other_lycoris_name", "lycoris_a_b_c_d_e_f_g_h_i")


def _named(names: tuple[str, ...]) -> str:
    return f"x AS (SELECT p_partkey, [{', '.join(repr(n) for n in names)}][p_partkey % {len(names)} + 1] || CASE WHEN p_partkey % 5 = 0 THEN '.' || p_partkey ELSE '' END AS name FROM part)"


def _parts(spark, sf_dir, names):
    name = F.concat(F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int")), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("."), F.col("p_partkey").cast("string"))).otherwise(""))
    return docs(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


def _expected(names: tuple[str, ...], renamed: tuple[str, ...], longer: dict[str, str] | None = None) -> str:
    """SQL of names with what each becomes, written out by hand; ``longer`` says what becomes of names with something behind them where that differs."""
    behind = [(longer or {}).get(n, r) for n, r in zip(names, renamed, strict=True)]
    pick = lambda words: f"[{', '.join(map(repr, words))}][p_partkey % {len(words)} + 1]"
    return f"WITH {_named(names)} SELECT p_partkey, name, CASE WHEN p_partkey % 5 = 0 THEN {pick(behind)} || '.' || p_partkey ELSE {pick(renamed)} END AS renamed FROM x"


_UNET_RENAMED = (
    "time_embed.0.weight", "input_blocks.0.0.bias", "input_blocks.4.0.in_layers.0.weight", "input_blocks.8.1.proj_in.weight", "output_blocks.2.0.skip_connection.weight", "output_blocks.8.2.conv.weight",
    "output_blocks.2.2.conv.bias", "middle_block.2.emb_layers.1.bias", "middle_block.1.norm.weight", "input_blocks.3.0.op.weight", "output_blocks.5.1.to_q.weight",
)
_VAE_RENAMED = (
    "encoder.down.0.block.1.nin_shortcut.weight", "encoder.mid.attn_1.q.weight", "decoder.up.2.block.2.norm1.bias", "decoder.up.1.upsample.conv.weight", "decoder.mid.block_1.conv1.weight", "decoder.norm_out.weight",
    "encoder.mid.attn_1.norm.bias", "decoder.mid.attn_1.proj_out.weight",
)
_TEXT_RENAMED = ("transformer.resblocks.3.ln_1.weight", "transformer.resblocks.0.mlp.c_fc.bias", "token_embedding.weight", "positional_embedding", "transformer.resblocks.5.attn.out_proj.weight", "ln_final.bias")


@query("key_rename_unet", _expected(_UNET, _UNET_RENAMED, {n: n for n in _UNET[:2]}))
def key_rename_unet(spark, sf_dir):
    return _parts(spark, sf_dir, _UNET).withColumn("renamed", naming.unet_key(F.col("name")))


@query("key_rename_vae", f"SELECT *, CASE WHEN p_partkey % {len(_VAE)} IN (1, 7) THEN 4 ELSE 2 END AS n_dims FROM ({_expected(_VAE, _VAE_RENAMED)})")
def key_rename_vae(spark, sf_dir):
    renamed = _parts(spark, sf_dir, _VAE).withColumn("renamed", naming.vae_key(F.col("name")))
    return renamed.withColumn("n_dims", F.size(naming.vae_shape(F.col("renamed"), F.array(F.lit(512), F.lit(512)))))


@query("key_rename_text", _expected(_TEXT, _TEXT_RENAMED))
def key_rename_text(spark, sf_dir):
    return _parts(spark, sf_dir, _TEXT).withColumn("renamed", naming.text_encoder_key(F.col("name")))


@query(
    "fuse_attention",
    """SELECT 'transformer.resblocks.' || p_partkey || '.attn.in_proj_weight' AS name, array_to_string([p_size, 1] || [p_size + 1] || [p_partkey % 7, p_size], '|') AS values FROM part""",
)
def fuse_attention(spark, sf_dir):
    """Query, key and value weights of every layer, one behind the other."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.array(*v).alias("values")) for p, v in (("v", (key % 7, size)), ("q", (size, F.lit(1).cast("long"))), ("k", (size + 1,)))])
    rows = docs(spark, sf_dir, "part").select(F.concat(F.lit("transformer.resblocks."), key.cast("string"), F.lit(".attn.in_proj_weight")).alias("layer"), F.explode(parts).alias("p")).select("layer", "p.*")
    return states.fuse_attention(rows).select(F.col("layer").alias("name"), F.array_join("values", "|").alias("values"))


@query(
    "single_file_merge",
    """WITH x AS (SELECT p_partkey % 4 AS c, CASE WHEN p_partkey = 7 THEN 'text_projection.weight' ELSE 'w' || (p_partkey // 8) END AS name, p_size AS a, p_partkey AS b FROM part)
SELECT CASE WHEN c = 3 AND name = 'text_projection.weight' THEN 'conditioner.embedders.1.model.text_projection'
  ELSE ['model.diffusion_model.', 'first_stage_model.', 'conditioner.embedders.0.transformer.', 'conditioner.embedders.1.model.'][c + 1] || name END AS name,
  CASE WHEN name = 'text_projection.weight' THEN max(b) || 'x' || max(a) ELSE arg_max(a, b) || 'x' || max(b) END AS shape FROM x GROUP BY c, x.name""",
)
def single_file_merge(spark, sf_dir):
    """The state tables of four components as one, as a single file has them."""
    key = F.col("p_partkey")
    name = F.when(key == 7, F.lit("text_projection.weight")).otherwise(F.concat(F.lit("w"), F.floor(key / 8).cast("string")))
    tables = docs(spark, sf_dir, "part").groupBy((key % 4).alias("c"), name.alias("name")).agg(F.max_by(F.array(F.col("p_size").cast("long"), key), key).alias("shape"))
    prefixes = ("model.diffusion_model.", "first_stage_model.", "conditioner.embedders.0.transformer.", "conditioner.embedders.1.model.")
    merged = states.merge_components({p: tables.where(F.col("c") == k) for k, p in enumerate(prefixes)}, {"conditioner.embedders.1.model.text_projection.weight": "conditioner.embedders.1.model.text_projection"})
    return merged.select("name", F.array_join("shape", "x").alias("shape"))


@query("key_rename_adapter", f"WITH {_named(_ADAPTER)}, s AS (SELECT *, string_split(replace(name, 'lycoris_', ''), '_') AS p FROM x) SELECT p_partkey, name, CASE WHEN starts_with(name, 'lycoris_') THEN array_to_string(p[1:6], '.') || CASE WHEN len(p) > 6 THEN '.' || array_to_string(p[7:], '_') ELSE '' END ELSE name END AS renamed, starts_with(name, 'text_encoder') AS is_text FROM s")
def key_rename_adapter(spark, sf_dir):
    return _parts(spark, sf_dir, _ADAPTER).withColumn("renamed", naming.adapter_key(F.col("name"))).withColumn("is_text", F.col("name").startswith("text_encoder"))


@query("null_defaults", "SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN event_type END, '') AS caption, greatest(1, trunc((event_id % 21 - 1) * 0.5::DOUBLE)::INTEGER) AS factor, coalesce(CASE WHEN event_id % 2 = 0 THEN 8 END, 16) AS conv_dim FROM events")
def null_defaults(spark, sf_dir):
    key = F.col("event_id")
    return docs(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(key % 3 > 0, F.col("event_type")), F.lit("")).alias("caption"), naming.feed_forward_factor(key % 21 - 1, F.lit(0.5)).alias("factor"), F.coalesce(F.when(key % 2 == 0, 8), F.lit(16)).alias("conv_dim"))


_PATH = "['a/b.JPG', '.hid/c.png', 'ab/_e.png', 't.txt', 'x/.y.gif', 'n.avif'][page_id % 6 + 1]"


@query(
    "url_and_path_predicates",
    rf"""WITH x AS (SELECT page_id, url, {_PATH} AS path, regexp_replace(url, '[?#].*$', '') || CASE WHEN page_id % 2 = 0 THEN '/blob/main/v' || page_id || '.safetensors?x=1' ELSE '/blob/' END AS model FROM pages)
SELECT page_id, path, regexp_matches(lower(path), '\.(jpg|jpeg|png|gif|bmp|tiff|webp|avif)$') AS is_image, len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.'))) > 0 AS is_hidden,
  regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*):', 1) IN ('http', 'https') AS is_remote, replace(model, '/blob/', '/resolve/') AS direct,
  CASE WHEN page_id % 2 = 0 THEN 'v' || page_id || '.safetensors' ELSE 'vae_model.safetensors' END AS cached, regexp_replace(path, '\.[^./]*$', '') AS key FROM x""",
)
def url_and_path_predicates(spark, sf_dir):
    paths = F.array(*map(F.lit, ("a/b.JPG", ".hid/c.png", "ab/_e.png", "t.txt", "x/.y.gif", "n.avif")))
    x = docs(spark, sf_dir, "pages").select("page_id", "url", F.get(paths, (F.col("page_id") % 6).cast("int")).alias("path"), F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/blob/main/v"), F.col("page_id").cast("string"), F.lit(".safetensors?x=1"))).otherwise("/blob/")).alias("model"))
    path, url, model = F.col("path"), F.col("url"), F.col("model")
    return x.select("page_id", "path", naming.is_image(path).alias("is_image"), naming.is_hidden(path).alias("is_hidden"), naming.is_remote(url).alias("is_remote"), naming.direct_url(model, "://").alias("direct"), naming.cached_name(model).alias("cached"), F.regexp_replace("path", r"\.[^./]*$", "").alias("key"))


@query("relative_keys", rf"SELECT page_id, regexp_replace(path, '([^/])\.[^./]*$', '\1') AS key FROM (SELECT page_id, {_PATH} AS path FROM pages)")
def relative_keys(spark, sf_dir):
    paths = F.array(*map(F.lit, ("a/b.JPG", ".hid/c.png", "ab/_e.png", "t.txt", "x/.y.gif", "n.avif")))
    whole = F.concat(F.lit("/data/set/"), F.get(paths, (F.col("page_id") % 6).cast("int")))
    return docs(spark, sf_dir, "pages").select("page_id", naming.relative_key(whole, F.lit("/data/set")).alias("key"))


@query("clip_skip_index", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE greatest(-(event_id % 5 + 1), -(user_id % 12 + 1)) END AS idx FROM events")
def clip_skip_index(spark, sf_dir):
    """The hidden layer that each event takes of an encoder with 1 to 12 layers."""
    return docs(spark, sf_dir, "events").select("event_id", naming.clip_skip_index(F.col("event_id") % 5, F.col("user_id") % 12 + 1).cast("long").alias("idx"))


@query(
    "options_hash",
    f"""SELECT doc_id, sha256('{{''prompt'': ''' || c || ''', ''negative_prompt'': '''', ''steps'': ' || (20 + doc_id % 30) || ', ''seed'': ' || doc_id || ', ''width'': None, ''height'': None, ''clip_skip'': 2}}')[1:8] AS fingerprint
FROM (SELECT doc_id, [{', '.join(f"'{c}'" for c in CAPTIONS)}][doc_id % {len(CAPTIONS)} + 1] AS c FROM documents)""",
)
def options_hash(spark, sf_dir):
    """First digits of the digest of preview options, written as a dictionary of plain values."""
    prompt = F.get(F.array(*map(F.lit, CAPTIONS)), (F.col("doc_id") % len(CAPTIONS)).cast("int"))
    options = {"prompt": prompt, "negative_prompt": F.lit(""), "steps": 20 + F.col("doc_id") % 30, "seed": F.col("doc_id"), "width": F.lit(None), "height": F.lit(None), "clip_skip": F.lit(2)}
    return ids(spark, sf_dir).select("doc_id", naming.options_fingerprint(options).alias("fingerprint"))


@query(
    "caption_tag_pairs",
    """WITH b AS (SELECT event_id // 16 AS batch, list(event_type ORDER BY event_id) AS c, list(user_id % 7 ORDER BY event_id) AS t FROM events GROUP BY 1)
SELECT batch, unnest(range(len(c))) AS place, unnest(c) AS caption, unnest(t) AS tag FROM b""",
)
def caption_tag_pairs(spark, sf_dir):
    """Captions and tags of each batch, paired by position."""
    lists = F.sort_array(F.collect_list(F.struct("event_id", "event_type", (F.col("user_id") % 7).alias("tag"))))
    batches = docs(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 16).alias("batch")).agg(lists.alias("l"))
    pairs = batches.select("batch", F.posexplode(prompts.paired(F.col("l.event_type"), F.col("l.tag"))).alias("place", "p"))
    return pairs.select("batch", F.col("place").cast("long").alias("place"), F.col("p.caption").alias("caption"), F.col("p.tags").alias("tag"))


@query(
    "zero_terminal_snr",
    f"""WITH {SNR}, {_EVENTS}, r AS (SELECT t, sqrt(alpha_bar) AS x, first(sqrt(alpha_bar)) OVER o AS a, last(sqrt(alpha_bar)) OVER o AS z FROM s WINDOW o AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
n AS (SELECT t, ((x - z) * a / (a - z)) * ((x - z) * a / (a - z)) AS b FROM r) SELECT event_id, t, round(b, 6) AS alpha_bar, round(b / (1 - b), 6) AS snr FROM e JOIN n USING (t)""",
)
def zero_terminal_snr(spark, sf_dir):
    table = schedule.zero_terminal_snr(schedule.snr_table(spark))
    return _at_steps(spark, sf_dir, table).select("event_id", "t", F.round("alpha_bar", 6).alias("alpha_bar"), F.round("snr", 6).alias("snr"))


@query(
    "state_union",
    """WITH a AS (SELECT 'w' || p_partkey AS name, p_size AS n, 0 AS side FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'w' || p_partkey, p_size + 100, 1 FROM part WHERE p_partkey % 2 = 0)
SELECT name, arg_max(n, side) AS n FROM a GROUP BY name""",
)
def state_union(spark, sf_dir):
    """Two state tables as one; where both have a name, the right one's entry stays."""
    name = F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("name")
    left = docs(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(name, F.col("p_size").alias("n"), F.lit(0).alias("side"))
    right = docs(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(name, (F.col("p_size") + 100).alias("n"), F.lit(1).alias("side"))
    return left.unionByName(right).groupBy("name").agg(F.max_by("n", "side").alias("n"))


@query("models_to_freeze", "SELECT DISTINCT p_brand || '/' || p_size AS model FROM part EXCEPT SELECT p_brand || '/' || p_size FROM part WHERE p_partkey % 3 = 0")
def models_to_freeze(spark, sf_dir):
    """Models that aren't trained: all but those in the training set."""
    models = docs(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("model"), "p_partkey")
    return models.select("model").distinct().join(models.where("p_partkey % 3 = 0").select("model").distinct(), "model", "left_anti")
