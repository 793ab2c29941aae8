"""Diversity, proximity, scarcity and other scores."""

from pyspark.sql import functions as F

from ..operators.diversity import covariance_partials, diversity, order_two_diversity
from ..operators.proximity import ks, proximity
from ..operators.scarcity import gini, scarcity
from ..operators.scores import (
    balanced_weights, classification_metrics, contrastive_loss, correlations, feature_stats, improvement, latent_summary,
    mean_std, reward, reward_weights, with_p_values,
)
from ..plans.assess import assess
from . import query
from .sampling import PAIRS_SQL, order_pairs
from .views import (
    ASSIGNED_SQL, CLUSTERS_SQL, CODED_SQL, FLOW_SCORES_SQL, FLOWS_SQL, SCORES_SQL, SPLIT_SQL, assessed, cell_model,
    coded_flows, flow_latent, flows, latent, preds_sql, predictions, rounded, table, split_flows,
)


def _test(rows):
    return rows.filter("side = 'test'")


@query("m1_diversity_exact")
def m1(spark, sf):
    """The eigenvalues of each cluster's whole kernel, by themselves and not by a quadrature."""
    rows, _ = assessed(latent(spark, sf))
    return rounded(diversity(_test(rows), ["pos"], method="exact"), "diversity")


_HASHED = "((('0x' || substr(md5('42:' || i || ':' || j || ':{0}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


@query("m1d_diversity_matrix", ASSIGNED_SQL + f""", omega AS (
  SELECT j, list(sqrt(2.0) * sqrt(-2 * ln({_HASHED.format("u")})) * cos(2 * pi() * {_HASHED.format("v")}) ORDER BY i) AS w
  FROM range(64) a(i), range(2) b(j) GROUP BY j),
angles AS (
  SELECT a.pos, a.row_id, list(list_dot_product(l.z, o.w) ORDER BY o.j) AS t
  FROM assigned a JOIN latent l USING (row_id), omega o WHERE a.side = 'test' GROUP BY a.pos, a.row_id),
phi AS (SELECT pos, [cos(t[1]), cos(t[2]), sin(t[1]), sin(t[2])] AS p FROM angles)
SELECT pos, r::INT AS i, c::INT AS j, round(sum(p[r + 1] * p[c + 1] / 2), 6) AS total
FROM phi, range(4) x(r), range(4) y(c) GROUP BY pos, r, c""")
def m1d(spark, sf):
    """What the feature form rests on: the summed outer products, here of two frequencies."""
    rows, _ = assessed(latent(spark, sf))
    sums = covariance_partials(_test(rows), ["pos"], m=2)
    cells = sums.select("pos", F.posexplode("total").alias("k", "total"))
    return rounded(cells.select("pos", F.floor(F.col("k") / 4).cast("int").alias("i"), (F.col("k") % 4).alias("j"), "total"), "total")


_PAIRS = """WITH e AS (SELECT vec_id, vec_id // 2 AS pair, embedding::DOUBLE[] AS z FROM embeddings),
k AS (SELECT a.pair, exp(-0.5 * list_distance(a.z, b.z) ** 2) AS k FROM e a LEFT JOIN e b ON a.pair = b.pair AND a.vec_id < b.vec_id
  WHERE a.vec_id % 2 = 0)
SELECT pair, CASE WHEN k IS NULL THEN 1 ELSE 2 END::BIGINT AS n, CASE WHEN k IS NULL THEN 0.0 ELSE
  round(exp(-((1 + k) / 2 * ln((1 + k) / 2) + (1 - k) / 2 * ln((1 - k) / 2))) - 1, 6) END::DOUBLE AS diversity FROM k"""


@query("m1e_diversity_of_pairs", _PAIRS)
def m1e(spark, sf):
    """Two points have the eigenvalues (1 + k) / 2 and (1 - k) / 2."""
    rows = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 2).alias("pair"), F.col("embedding").cast("array<double>").alias("z"))
    return rounded(diversity(rows, ["pair"], gamma=0.5, method="exact").select("pair", "n", "diversity"), "diversity")


@query("m1f_diversity_of_pairs_by_lanczos", _PAIRS)
def m1f(spark, sf):
    """Keys of two points have their unit vectors as probes, so the quadrature is exact."""
    rows = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 2).alias("pair"), F.col("embedding").cast("array<double>").alias("z"))
    return rounded(diversity(rows, ["pair"], gamma=0.5, method="lanczos").select("pair", "n", "diversity"), "diversity")


@query("m1b_diversity_features")
def m1b(spark, sf):
    rows, _ = assessed(flow_latent(spark, sf))
    return rounded(diversity(_test(rows), ["pos"], method="rff", m=512), "diversity")


@query(
    "m1c_diversity_order_two",
    ASSIGNED_SQL + ", t AS (SELECT a.pos, l.z FROM assigned a JOIN latent l USING (row_id) WHERE a.side = 'test'),"
    " k AS (SELECT a.pos, sum(exp(-2 * list_distance(a.z, b.z) ** 2)) AS s FROM t a JOIN t b ON a.pos = b.pos GROUP BY a.pos)"
    " SELECT pos, count(*) AS n, round(count(*) * count(*) / any_value(s), 5) AS vendi2 FROM t JOIN k USING (pos) GROUP BY pos",
)
def m1c(spark, sf):
    rows, _ = assessed(latent(spark, sf))
    return rounded(order_two_diversity(_test(rows), ["pos"]), "vendi2", digits=5)


def _ks_sql(stat: str) -> str:
    return SPLIT_SQL + f""", counted AS (
  SELECT y, extendedprice AS v, count(*) FILTER (side = 'test') AS t, count(*) FILTER (side = 'train') AS r
  FROM split_flows WHERE side <> 'val' GROUP BY ALL),
curves AS (
  SELECT y, sum(t) OVER w AS ct, sum(r) OVER w AS cr, sum(t) OVER k AS nt, sum(r) OVER k AS nr FROM counted
  WINDOW w AS (PARTITION BY y ORDER BY v), k AS (PARTITION BY y))
SELECT y, round(greatest(0, max({stat})), 6)::DOUBLE AS ks, max(nt)::BIGINT AS n_test, max(nr)::BIGINT AS n_train FROM curves GROUP BY y"""


def _ks(spark, sf, alternative):
    rows = split_flows(spark, sf).filter("split <> 'val'").withColumnRenamed("split", "side")
    # Small buckets run the distributed form.
    return rounded(ks(rows, "extendedprice", "side", ["y"], alternative, rows_per_bucket=5000), "ks")


@query("m2_ks_greater", _ks_sql("ct / nt - cr / nr"))
def m2(spark, sf):
    return _ks(spark, sf, "greater")


@query("m2b_ks_less", _ks_sql("cr / nr - ct / nt"))
def m2b(spark, sf):
    return _ks(spark, sf, "less")


@query("m2c_ks_two_sided", _ks_sql("abs(ct / nt - cr / nr)"))
def m2c(spark, sf):
    return _ks(spark, sf, "two-sided")


_PROX = "SELECT pos, round(proximity, 6) AS proximity, n_test, n_train FROM ks"


@query("m3_proximity", SCORES_SQL + _PROX)
def m3(spark, sf):
    rows, _ = assessed(latent(spark, sf))
    return rounded(proximity(rows), "proximity")


@query("m3b_proximity_flows", FLOW_SCORES_SQL + _PROX)
def m3b(spark, sf):
    rows, _ = assessed(flow_latent(spark, sf))
    return rounded(proximity(rows), "proximity")


_GINI_SQL = """WITH c AS (SELECT l_suppkey, l_partkey % 10 AS g, count(*) AS x FROM lineitem GROUP BY ALL),
p AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x, l_suppkey) AS i, count(*) OVER (PARTITION BY g) AS n,
             sum(x) OVER (PARTITION BY g) AS total FROM c)
SELECT g, round(greatest(0, least(1, (n + 1 - 2 * sum((n - i + 1) * x) / total) / n{fix})), 6)::DOUBLE AS gini FROM p GROUP BY g, n, total"""


def _supplier_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 10).alias("g")).agg(
        F.count(F.lit(1)).alias("x")
    )


@query("m4_gini", _GINI_SQL.format(fix=" * n / (n - 1)"))
def m4(spark, sf):
    return rounded(gini(_supplier_counts(spark, sf), "x", ["g"]), "gini")


@query("m4b_gini_uncorrected", _GINI_SQL.format(fix=""))
def m4b(spark, sf):
    return rounded(gini(_supplier_counts(spark, sf), "x", ["g"], corrected=False), "gini")


_SCARCE = "SELECT pos, round(scarcity, 6) AS scarcity FROM scarcities WHERE pos IN (SELECT pos FROM grid WHERE n > 0)"


@query("m5_scarcity", SCORES_SQL + _SCARCE)
def m5(spark, sf):
    rows, model = assessed(latent(spark, sf))
    return rounded(scarcity(_test(rows), model), "scarcity")


@query("m5b_scarcity_flows", FLOW_SCORES_SQL + _SCARCE)
def m5b(spark, sf):
    rows, model = assessed(flow_latent(spark, sf))
    return rounded(scarcity(_test(rows), model), "scarcity")


_CLUSTER_ROWS = (
    "SELECT cluster_id, majority_y, n_train, n_test, n_train_assigned, round(proximity, 6) AS proximity,"
    " round(scarcity, 6) AS scarcity FROM cluster_scores"
)


@query("m6_assessment", SCORES_SQL + _CLUSTER_ROWS)
def m6(spark, sf):
    rows = latent(spark, sf)
    model, _ = cell_model(rows)
    found = assess(rows.filter("side <> 'val'"), model, metrics=("proximity", "scarcity"))
    return rounded(found.cluster_scores, "proximity", "scarcity")


@query("m6b_assessment_flows", FLOW_SCORES_SQL + _CLUSTER_ROWS)
def m6b(spark, sf):
    rows = flow_latent(spark, sf)
    model, _ = cell_model(rows)
    found = assess(rows.filter("side <> 'val'"), model, metrics=("proximity", "scarcity"))
    return rounded(found.cluster_scores, "proximity", "scarcity")


@query(
    "m6c_global_scores",
    SCORES_SQL + "SELECT round(max(proximity), 6) AS proximity, round(avg(scarcity), 6) AS scarcity, count(*) AS n_clusters,"
    " sum(n_test)::BIGINT AS n_test FROM cluster_scores",
)
def m6c(spark, sf):
    rows = latent(spark, sf)
    model, _ = cell_model(rows)
    found = assess(rows.filter("side <> 'val'"), model, metrics=("proximity", "scarcity"))
    return rounded(found.global_scores, "proximity", "scarcity")


@query("m6d_full_assessment_with_diversity")
def m6d(spark, sf):
    rows = latent(spark, sf)
    model, _ = cell_model(rows)
    found = assess(rows.filter("side <> 'val'"), model)
    return rounded(found.cluster_scores, "diversity", "proximity", "scarcity")


@query(
    "m7_reward",
    SCORES_SQL + ", w(reward_config, w_d, w_p, w_s) AS (VALUES ('full', 1, 1, 1), ('diversity_only', 1, 0, 0), ('proximity_only', 0, 1, 0),"
    " ('scarcity_only', 0, 0, 1), ('dp', 1, 1, 0), ('ps', 0, 1, 1), ('ds', 1, 0, 1))"
    " SELECT cluster_id, reward_config, round(w_d * 0.25 + w_p * proximity + w_s * scarcity, 6) AS reward FROM cluster_scores, w",
)
def m7(spark, sf):
    rows = latent(spark, sf)
    model, _ = cell_model(rows)
    scores = assess(rows.filter("side <> 'val'"), model, metrics=("proximity", "scarcity")).cluster_scores
    valued = reward(scores.withColumn("diversity", F.lit(0.25)), reward_weights(spark))
    return rounded(valued.select("cluster_id", "reward_config", "reward"), "reward")


@query(
    "m8_latent_summary",
    CLUSTERS_SQL + """, flat AS (SELECT list(v ORDER BY cluster_id, i) AS c FROM (
    SELECT cluster_id, unnest(centroid) AS v, generate_subscripts(centroid, 1) AS i FROM clusters)),
per AS (SELECT l.side, i, avg(z[i]) AS m, min(z[i]) AS lo, max(z[i]) AS hi, var_pop(z[i]) AS v, count(*) AS n FROM latent l, range(1, 65) t(i) GROUP BY ALL),
per_side AS (SELECT side, max(n) AS n_rows, list(m ORDER BY i) AS m, list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi,
  list(v ORDER BY i) AS v, list(sqrt(v) ORDER BY i) AS s FROM per GROUP BY side)
SELECT side, n_rows, list_transform(c || m || lo || hi || v || s, lambda x: round(x, 6)) AS obs FROM per_side, flat""",
)
def m8(spark, sf):
    rows = latent(spark, sf)
    model, _ = cell_model(rows)
    return latent_summary(rows, model, ["side"]).withColumn("obs", F.transform("obs", lambda v: F.round(v, 6)))


_METRICS_SQL = """labels_seen AS (SELECT model, y AS label FROM scored UNION SELECT model, pred FROM scored),
per AS (SELECT l.model, label, count(*) FILTER (s.y = label AND s.pred = label) AS tp, count(*) FILTER (s.y = label) AS actual,
               count(*) FILTER (s.pred = label) AS predicted FROM labels_seen l JOIN scored s ON s.model = l.model GROUP BY ALL),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN actual > 0 THEN tp / actual ELSE 0 END AS r FROM per)
SELECT model, round(sum(tp) / sum(actual), 6) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM pr GROUP BY model"""


@query(
    "m9_macro_metrics",
    CODED_SQL + ", " + preds_sql(7, "coded") + ", scored AS (SELECT 'p0' AS model, y, p0 AS pred FROM preds UNION ALL SELECT 'p1', y, p1 FROM preds), "
    + _METRICS_SQL,
)
def m9(spark, sf):
    rows = predictions(coded_flows(spark, sf), 7)
    long = rows.select("y", F.explode(F.array(*[
        F.struct(F.lit(c).alias("model"), F.col(c).alias("pred")) for c in ("p0", "p1")
    ])).alias("m")).select("y", "m.*")
    return rounded(classification_metrics(long, keys=["model"]), "accuracy", "precision", "recall", "f1")


@query("m10_pearson", CODED_SQL + "SELECT y, count(*) AS n, round(corr(quantity, extendedprice), 6) AS pearson_r FROM coded GROUP BY y")
def m10(spark, sf):
    found = correlations(coded_flows(spark, sf), "quantity", "extendedprice", ["y"], p_values=False)
    return rounded(found.select("y", "n", "pearson_r"), "pearson_r")


@query(
    "m11_spearman",
    CODED_SQL + """, r AS (
  SELECT y, rank() OVER (PARTITION BY y ORDER BY quantity) + (count(*) OVER (PARTITION BY y, quantity) - 1) / 2 AS a,
         rank() OVER (PARTITION BY y ORDER BY discount) + (count(*) OVER (PARTITION BY y, discount) - 1) / 2 AS b FROM coded)
SELECT y, round(corr(a, b), 6) AS spearman_r FROM r GROUP BY y""",
)
def m11(spark, sf):
    found = correlations(coded_flows(spark, sf), "quantity", "discount", ["y"], p_values=False)
    return rounded(found.select("y", "spearman_r"), "spearman_r")


@query(
    "m12_correlation_guard",
    CODED_SQL + "SELECT y, count(*) AS n, NULL::DOUBLE AS pearson_r, NULL::DOUBLE AS spearman_r FROM coded GROUP BY y",
)
def m12(spark, sf):
    rows = coded_flows(spark, sf).withColumn("flat", F.lit(1.5))
    return correlations(rows, "quantity", "flat", ["y"], p_values=False)


# A t value with v degrees of freedom is sqrt(v) tan(phi), under which its density is proportional to cos(phi)^(v - 1):
# the p-value is the share of that integral beyond phi, here by Simpson's rule.
_P_VALUES = """WITH e AS (SELECT label AS y, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY y ORDER BY a) + (count(*) OVER (PARTITION BY y, a) - 1) / 2 AS ra,
         rank() OVER (PARTITION BY y ORDER BY b) + (count(*) OVER (PARTITION BY y, b) - 1) / 2 AS rb FROM e),
c AS (SELECT y, count(*) AS n, corr(a, b) AS pearson_r, corr(ra, rb) AS spearman_r FROM ranked GROUP BY y),
each AS (SELECT y, n, 'p' AS kind, pearson_r AS r FROM c UNION ALL SELECT y, n, 's', spearman_r FROM c),
bent AS (SELECT *, atan(abs(r) / sqrt(1 - r * r)) AS phi, n - 2 AS v FROM each),
parts AS (
  SELECT y, kind, sum(w * cos(phi + (pi() / 2 - phi) * i / 400) ** (v - 1)) * (pi() / 2 - any_value(phi)) AS beyond,
         sum(w * cos(pi() / 2 * i / 400) ** (v - 1)) * pi() / 2 AS whole
  FROM bent, (SELECT i, CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(401) t(i)) GROUP BY y, kind),
p AS (SELECT y, max(beyond / whole) FILTER (kind = 'p') AS pp, max(beyond / whole) FILTER (kind = 's') AS ps FROM parts GROUP BY y)
SELECT c.y, n, round(pearson_r, 6) AS pearson_r, round(spearman_r, 6) AS spearman_r, round(pp, 6) AS pearson_p,
  round(ps, 6) AS spearman_p, round(pp, 6) AS again FROM c JOIN p USING (y)"""


@query("m12b_correlation_p_values", _P_VALUES)
def m12b(spark, sf):
    small = table(spark, sf, "embeddings").select(
        F.col("label").alias("y"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b")
    )
    found = correlations(small, "a", "b", ["y"])
    return rounded(with_p_values(found, {"pearson_r": "again"}), "pearson_r", "spearman_r", "pearson_p", "spearman_p", "again")


@query(
    "m13_mean_std",
    CODED_SQL + "SELECT y, round(avg(tax), 6) AS tax_mean, round(stddev_pop(tax), 6) AS tax_std, round(avg(discount), 6) AS discount_mean,"
    " round(stddev_pop(discount), 6) AS discount_std, count(*) AS n FROM coded GROUP BY y",
)
def m13(spark, sf):
    return rounded(
        mean_std(coded_flows(spark, sf), ["tax", "discount"], ["y"]), "tax_mean", "tax_std", "discount_mean", "discount_std"
    )


@query(
    "m14_contrastive_loss",
    PAIRS_SQL + ", d AS (SELECT p.different, list_distance(a.z, b.z) AS d FROM pairs p JOIN latent a ON a.row_id = p.row_i JOIN latent b ON b.row_id = p.row_j)"
    " SELECT round(avg(CASE WHEN different = 1 THEN 0.5 * greatest(0, 10 - d) ** 2 ELSE 0.5 * d * d END), 6) AS contrastive, count(*) AS n_pairs,"
    " round(0.25 + 0.1 * avg(CASE WHEN different = 1 THEN 0.5 * greatest(0, 10 - d) ** 2 ELSE 0.5 * d * d END), 6) AS total FROM d",
)
def m14(spark, sf):
    rows = latent(spark, sf)
    return rounded(contrastive_loss(order_pairs(spark, sf, rows), rows, reconstruction=0.25), "contrastive", "total")


# Digits at which no mean of so many cents or hundredths lies near a half.
_DIGITS = {"quantity": 6, "extendedprice": 4, "discount": 8, "tax": 8}


@query("m15_feature_stats", FLOWS_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), {d})::DOUBLE AS mean, round(stddev_pop({c}), {d})::DOUBLE AS std FROM flows"
    for c, d in _DIGITS.items()) + " UNION ALL SELECT 'fixed', 7.0::DOUBLE, 1.0::DOUBLE")
def m15(spark, sf):
    rows = flows(spark, sf).withColumn("fixed", F.lit(7.0))
    names = [*_DIGITS, "fixed"]
    stats = feature_stats(rows, names)
    each = stats.select(F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), "means", "stds")).alias("s"))
    digits = F.coalesce(F.create_map(*[F.lit(x) for pair in _DIGITS.items() for x in pair])[F.col("s.feature")], F.lit(6))
    scale = F.pow(F.lit(10.0), digits)
    return each.select("s.feature", (F.round(F.col("s.means") * scale) / scale).alias("mean"),
                       (F.round(F.col("s.stds") * scale) / scale).alias("std"))


@query(
    "m16_balanced_weights",
    CODED_SQL + "SELECT y, count(*) AS n, round((SELECT count(*) FROM coded) / ((SELECT count(DISTINCT y) FROM coded) * count(*)), 6) AS weight"
    " FROM coded GROUP BY y",
)
def m16(spark, sf):
    return balanced_weights(coded_flows(spark, sf)).groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight")
    )


@query(
    "j6_improvement",
    SPLIT_SQL + ", s AS (SELECT side, avg(tax) AS tax, avg(discount) AS discount FROM split_flows GROUP BY side)"
    " SELECT s.side, round(s.tax - b.tax, 8) AS tax_gain, round(s.discount - b.discount, 8) AS discount_gain FROM s, s b WHERE b.side = 'train'",
)
def j6(spark, sf):
    scores = split_flows(spark, sf).groupBy(F.col("split").alias("side")).agg(F.avg("tax").alias("tax"), F.avg("discount").alias("discount"))
    gained = improvement(scores, scores.filter("side = 'train'"), ["tax", "discount"])
    return rounded(gained.select("side", "tax_gain", "discount_gain"), "tax_gain", "discount_gain", digits=8)
