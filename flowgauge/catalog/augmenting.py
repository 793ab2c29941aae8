"""Settings, perturbed rows, candidate scores, transitions and policy evaluation."""

from pyspark.sql import functions as F

from ..operators.clean import fit_scaler
from ..operators.episodes import bellman_target, fitted_q, next_rows, policy_value, policy_values, rollout_summary, transitions
from ..operators.perturb import SETTINGS, map_actions, perturb
from ..operators.sampling import random_configs
from ..operators.scores import feature_stats
from ..plans.augment import base_scores, best_batches, candidate_scores, first_reaching, running_observations, score_candidates
from ..plans.sweeps import select_by_splits
from . import query
from .sampling import unit_sql
from .sources import _RANGES
from .views import ASSIGNED_SQL, EPISODES_SQL, LATENT_SQL, cell_model, episodes, latent, rounded, table


def _draws(spark, sf):
    keys = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("draw_id"), F.col("c_nationkey").alias("episode"), F.col("c_custkey").alias("step")
    )
    return map_actions(random_configs(spark, 0, 0, requests=keys))


_CONFIGS = "configs AS (SELECT c_custkey AS draw_id, " + ", ".join(
    f"{lo} + {unit_sql('42', 'c_nationkey', 'c_custkey', str(i))} * ({hi} - {lo}) AS {n}"
    for i, (n, (lo, hi)) in enumerate(zip(SETTINGS, _RANGES, strict=True))
) + " FROM customer)"


@query("a1_config_table", "WITH " + _CONFIGS + " SELECT draw_id, " + ", ".join(f"round({n}, 6)::DOUBLE AS {n}" for n in SETTINGS) + " FROM configs")
def a1(spark, sf):
    return rounded(_draws(spark, sf).select("draw_id", "config.*"), *SETTINGS)


def _normal(*parts: str) -> str:
    return f"(sqrt(-2 * ln({unit_sql(*parts, chr(39) + 'u' + chr(39))})) * cos(2 * pi() * {unit_sql(*parts, chr(39) + 'v' + chr(39))}))"


_PERTURB = LATENT_SQL + ", " + _CONFIGS + f""", numbered AS (
  SELECT row_id, z, row_number() OVER (ORDER BY md5('42:' || row_id)) AS i, count(*) OVER () AS n FROM latent),
picked AS (SELECT c.*, floor({unit_sql("'42'", "'draw'", "draw_id")} * (SELECT count(*) FROM latent))::BIGINT + 1 AS pick FROM configs c),
stats AS (SELECT i, stddev_pop(z[i + 1]) AS sd, avg(z[i + 1]) AS mu FROM latent, range(64) t(i) GROUP BY i),
cells AS (
  SELECT p.*, b.row_id, s.i, s.sd, s.mu, b.z[s.i + 1] AS x, {_normal("'42'", "'noise'", "draw_id", "s.i")} AS own,
         {_normal("'42'", "'shared'", "draw_id")} AS shared FROM picked p JOIN numbered b ON b.i = p.pick, stats s),
moved AS (
  SELECT draw_id, row_id, i, sd, mu, greatest(0, x + sd * CASE WHEN i < 20 THEN (loss + duplication) * own WHEN i < 40 THEN corruption * own
    WHEN i < 60 THEN (jitter + delay + reordering) * own ELSE correlation * shared + (1 - correlation) * own END) AS v FROM cells)"""


def _base(spark, sf):
    rows = latent(spark, sf).select("row_id", F.col("z").alias("features"))
    names = [f"f{i}" for i in range(64)]
    wide = rows.select(*[F.col("features")[i].alias(n) for i, n in enumerate(names)])
    return rows, feature_stats(wide, names), fit_scaler(wide, names)


def _round_vector(df, col, digits=5, nudge=0.0):
    return df.withColumn(col, F.transform(col, lambda v: F.round(v + F.lit(nudge), digits) + F.lit(0.0)))


@query(
    "a2_perturbed_rows",
    _PERTURB + " SELECT draw_id, row_id AS base_row, 0 AS y, list(round(v, 5) ORDER BY i) AS features FROM moved GROUP BY draw_id, row_id",
)
def a2(spark, sf):
    rows, stats, _ = _base(spark, sf)
    out = perturb(rows, _draws(spark, sf).select("draw_id", "config"), stats)
    return _round_vector(out.select("draw_id", "base_row", "y", "features"), "features")


@query(
    "a3_scaled_generated_rows",
    _PERTURB + " SELECT draw_id, 3 AS y, list(round((v - mu) / sd, 4) ORDER BY i) AS features FROM moved GROUP BY draw_id",
)
def a3(spark, sf):
    rows, stats, scaler = _base(spark, sf)
    out = perturb(rows, _draws(spark, sf).select("draw_id", "config"), stats, label=3, scaler=scaler)
    return _round_vector(out.select("draw_id", "y", "features"), "features", 4)


_A4 = ASSIGNED_SQL + """, vals AS (
  SELECT l.row_id, l.y, ('0x' || substr(md5(l.row_id::VARCHAR), 1, 4))::INT % 4 AS batch, {'d': list_distance(l.z, c.centroid), 'id': c.cluster_id} AS s,
         c.majority_y = l.y AS same FROM latent l, clusters c WHERE l.side = 'val'),
vb AS (SELECT row_id, batch, coalesce(min(s) FILTER (same), min(s)) AS p, min(s) FILTER (NOT same) AS g FROM vals GROUP BY ALL),
b AS (SELECT batch FROM range(4) t(batch)),
pool AS (
  SELECT b.batch, side, pos, neg, neg_dist FROM assigned, b
  UNION ALL SELECT batch, 'test', p.id, coalesce(g, p).id, coalesce(g, p).d FROM vb),
cnt AS (SELECT batch, pos, neg_dist AS v, count(*) FILTER (side = 'test') AS t, count(*) FILTER (side = 'train') AS r FROM pool GROUP BY ALL),
cur AS (SELECT batch, pos, sum(t) OVER w AS ct, sum(r) OVER w AS cr, sum(t) OVER k AS nt, sum(r) OVER k AS nr FROM cnt
  WINDOW w AS (PARTITION BY batch, pos ORDER BY v), k AS (PARTITION BY batch, pos)),
px AS (SELECT batch, greatest(0, max(CASE WHEN nt > 0 AND nr > 0 THEN ct / nt - cr / nr ELSE 0 END)) AS proximity FROM cur GROUP BY batch),
gr AS (SELECT b.batch, a.cluster_id AS pos, o.cluster_id AS neg, count(p.pos) AS n FROM b JOIN clusters a ON true JOIN clusters o ON a.majority_y <> o.majority_y
  LEFT JOIN (SELECT * FROM pool WHERE side = 'test') p ON p.batch = b.batch AND p.pos = a.cluster_id AND p.neg = o.cluster_id GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY batch, pos ORDER BY n, neg) AS i, count(*) OVER (PARTITION BY batch, pos) AS m,
  sum(n) OVER (PARTITION BY batch, pos) AS total FROM gr),
sc AS (SELECT batch, pos, CASE WHEN total = 0 THEN 0 ELSE 1 - greatest(0, least(1, (m + 1 - 2 * sum((m - i + 1) * n) / total) / m
  * CASE WHEN m > 1 THEN m / (m - 1) ELSE 1 END)) END AS s FROM pl GROUP BY batch, pos, m, total),
sx AS (SELECT batch, sum(s) / (SELECT count(*) FROM clusters) AS scarcity FROM sc GROUP BY batch)"""


def _candidates(spark, sf):
    rows = latent(spark, sf)
    model, _ = cell_model(rows)
    h = F.conv(F.substring(F.md5(F.col("row_id").cast("string")), 1, 4), 16, 10).cast("int")
    return base_scores(rows.filter("side <> 'val'"), model, m=128), rows.filter("side = 'val'").withColumn("batch", h % 4)


@query("a4_candidate_scores", _A4 + " SELECT batch::INT AS batch, round(proximity, 6) AS proximity, round(scarcity, 6) AS scarcity FROM px JOIN sx USING (batch)")
def a4(spark, sf):
    base, batches = _candidates(spark, sf)
    return rounded(candidate_scores(base, batches).select("batch", "proximity", "scarcity"), "proximity", "scarcity")


@query("a4b_best_batches")
def a4b(spark, sf):
    base, batches = _candidates(spark, sf)
    return rounded(best_batches(score_candidates(base, batches)), "diversity", "proximity", "scarcity", "reward")


@query(
    "a4c_stop_step",
    EPISODES_SQL + ", hit AS (SELECT episode, min(step) FILTER (reward >= 100 AND step <= 40) AS h, max(step) FILTER (step <= 40) AS last FROM episodes GROUP BY episode)"
    " SELECT episode, coalesce(h, last) AS stop_step, h IS NOT NULL AS terminated, h IS NULL AND last >= 40 AS truncated FROM hit",
)
def a4c(spark, sf):
    return first_reaching(episodes(spark, sf), 100.0, "step", 40, ["episode"])


_OBS = """, o AS (SELECT *, [avg(reward) OVER w, avg(step) OVER w, min(reward) OVER w, min(step) OVER w, max(reward) OVER w, max(step) OVER w,
    var_pop(reward) OVER w, var_pop(step) OVER w, stddev_pop(reward) OVER w, stddev_pop(step) OVER w] AS obs
  FROM episodes WINDOW w AS (PARTITION BY episode ORDER BY step))"""


def _log(spark, sf):
    rows = episodes(spark, sf).withColumn("z", F.array(F.col("reward"), F.col("step").cast("double")))
    return running_observations(rows, 2)


# Means of cents often end in an exact half digit, so both sides round after a tiny nudge.
@query(
    "a5_transitions",
    EPISODES_SQL + _OBS + """ SELECT episode, step, round(reward, 4) AS reward, terminal, NOT terminal AND step >= 49 AS timeout,
  list_transform(obs, lambda v: round(v + 1e-6, 3)) AS obs,
  list_transform(coalesce(lead(obs) OVER (PARTITION BY episode ORDER BY step), obs), lambda v: round(v + 1e-6, 3)) AS next_obs FROM o""",
)
def a5(spark, sf):
    log = _log(spark, sf).withColumn("action", F.array(F.lit(0.0)))
    out = transitions(log, max_steps=50).drop("action").withColumn("reward", F.round("reward", 4))
    return _round_vector(_round_vector(out, "obs", 3, 1e-6), "next_obs", 3, 1e-6)


@query(
    "a6_rollout_summary",
    EPISODES_SQL + ", t AS (SELECT episode, sum(reward) AS r, count(*) AS n, arg_max(reward, step) AS f FROM episodes GROUP BY episode)"
    " SELECT count(*) AS n_episodes, round(avg(r), 4) AS mean_reward, round(avg(n), 4) AS mean_length, round(avg(f), 4) AS mean_value FROM t",
)
def a6(spark, sf):
    rows = episodes(spark, sf).withColumn("value", F.col("reward"))
    return rounded(rollout_summary(rows, ["value"]), "mean_reward", "mean_length", "mean_value", digits=4)


@query(
    "a7_bellman_target",
    EPISODES_SQL + "SELECT episode, step, round(reward + 0.99 * 2 * coalesce(lead(reward) OVER (PARTITION BY episode ORDER BY step), reward)"
    " * CASE WHEN terminal THEN 0 ELSE 1 END, 6) AS target FROM episodes",
)
def a7(spark, sf):
    rows = next_rows(episodes(spark, sf), "reward", "next_reward")
    target = bellman_target(F.col("reward"), 2 * F.col("next_reward"), F.col("terminal"))
    return rows.select("episode", "step", F.round(target, 6).alias("target"))


def _logged(spark, sf):
    scaled = F.array(F.log1p(F.col("reward")), F.col("step") / 100.0)
    log = episodes(spark, sf).withColumn("obs", scaled).withColumn(
        "action", F.array((F.crc32("event_type") % 4) / 4.0)
    )
    return transitions(log)


def _constant(value):
    return lambda obs: F.array(F.lit(value))


@query("a8_fitted_q_value")
def a8(spark, sf):
    steps = _logged(spark, sf)
    policy = _constant(0.5)
    q = fitted_q(steps, policy, gamma=0.9, iterations=50)
    return rounded(policy_value(steps, policy, q), "value", digits=4)


@query("a8b_policy_selection")
def a8b(spark, sf):
    """Six policies on the held-out halves of twenty splits, all solved from one pass, and the one that is best on average."""
    policies = {f"constant-{k}": _constant(k / 5) for k in range(6)}
    values = policy_values(_logged(spark, sf), policies, 20, gamma=0.9, iterations=50)
    scores = values.select(F.col("policy").alias("config"), "split", "value").withColumn("position", F.col("config"))
    return rounded(select_by_splits(scores), "mean_value", "std_value", digits=4)
