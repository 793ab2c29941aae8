"""Parameter sweeps and whole experiments."""

from functools import partial

from pyspark.sql import functions as F

from ..functions.bounded import spread
from ..operators.clean import apply_labels, fit_labels
from ..operators.clustering import seed_cells
from ..operators.perturb import SETTINGS
from ..operators.sampling import half_splits
from ..operators.scores import improvement, mean_std
from ..plans.assess import ALL_METRICS
from ..plans.augment import augmentation_comparison, base_scores, three_arm_retrain
from ..plans.generate import generated_comparison, prepare, random_settings, transfer_comparison
from ..plans.report import embedded, end_to_end
from ..plans.sweeps import (
    compare_datasets, compare_encoders, dispersion_scores, dispersion_sweep, embed_per_seed, encoder_means, kmeans_clusters,
    label_subset_scores, label_subset_sweep, ranked_subset_scores, ranked_subset_sweep, select_by_splits,
)
from . import query
from .models import FOREST
from .sampling import unit_sql
from .views import (
    _ASSIGNED, _CODED, _DIRTY, _FLOW_LATENT, _GRID, _KS, _SCORES, _SPLIT_FLOWS, _cells_sql, ASSIGNED_SQL, EPISODES_SQL, FEATURES,
    FLOW_ASSIGNED_SQL, assessed, cell_model, coded_flows, dirty_flows, episodes, flow_latent, latent, preds_sql, predictions,
    rounded, table, with_,
)


@query("x1_label_subset_scores")
def x1(spark, sf):
    rows, model = assessed(latent(spark, sf))
    return rounded(label_subset_scores(rows.filter("side = 'test'"), model), "diversity")


@query("x1b_label_subset_curve")
def x1b(spark, sf):
    rows, model = assessed(latent(spark, sf))
    by_size, found = label_subset_sweep(rows.filter("side = 'test'"), model)
    one = found.first()
    return rounded(by_size, "mean_diversity", "std_diversity").withColumn("pearson_r", F.lit(one.pearson_r))


def _ranked_sql(n_classes: int) -> str:
    return f""", {preds_sql(n_classes, "assigned")},
ranks AS (
  SELECT *, row_number() OVER (ORDER BY neg_dist DESC, md5('0:' || row_id)) AS rank, count(*) OVER () AS total
  FROM preds WHERE side = 'test'),
bins AS (SELECT *, CASE WHEN rank = 1 THEN 1 ELSE (rank * 100 + total - 1) // total END AS bin FROM ranks),
steps AS (SELECT p FROM range(1, 101) t(p)),
subset AS (SELECT p, b.* FROM bins b, steps WHERE bin <= p),
pooled AS (
  SELECT p, pos, neg_dist AS v, count(*) AS t, 0 AS r FROM subset GROUP BY ALL
  UNION ALL SELECT p, pos, neg_dist, 0, count(*) FROM assigned, steps WHERE side = 'train' GROUP BY ALL),
merged AS (SELECT p, pos, v, sum(t) AS t, sum(r) AS r FROM pooled GROUP BY ALL),
curves AS (
  SELECT p, pos, sum(t) OVER w AS ct, sum(r) OVER w AS cr, sum(t) OVER k AS nt, sum(r) OVER k AS nr FROM merged
  WINDOW w AS (PARTITION BY p, pos ORDER BY v), k AS (PARTITION BY p, pos)),
prox AS (SELECT p, greatest(0, max(CASE WHEN nt > 0 AND nr > 0 THEN ct / nt - cr / nr ELSE 0 END)) AS proximity FROM curves GROUP BY p),
scored AS (SELECT p, 'p0' AS model, y, p0 AS pred FROM subset UNION ALL SELECT p, 'p1', y, p1 FROM subset),
hits AS (
  SELECT p, model, label, sum(tp) AS tp, sum(a) AS a, sum(d) AS d FROM (
    SELECT p, model, y AS label, count(*) FILTER (y = pred) AS tp, count(*) AS a, 0 AS d FROM scored GROUP BY ALL
    UNION ALL SELECT p, model, pred, 0, 0, count(*) FROM scored GROUP BY ALL) GROUP BY ALL),
f1s AS (SELECT p, model, avg(CASE WHEN tp > 0 THEN 2 * (tp / d) * (tp / a) / (tp / d + tp / a) ELSE 0 END) AS f1 FROM hits GROUP BY ALL)"""


_X2 = " SELECT p::INT AS bin, model, round(proximity, 6) AS proximity, round(f1, 6) AS f1 FROM f1s JOIN prox USING (p)"


def _ranked(spark, sf, rows, n_classes):
    assigned, _ = assessed(rows)
    scored = predictions(assigned, n_classes)
    test = scored.filter("side = 'test'")
    return test, scored.filter("side = 'train'")


@query("x2_ranked_subsets", ASSIGNED_SQL + _ranked_sql(10) + _X2)
def x2(spark, sf):
    test, train = _ranked(spark, sf, latent(spark, sf), 10)
    return rounded(ranked_subset_scores(test, train, ["p0", "p1"]), "proximity", "f1")


@query("x2b_ranked_subsets_flows", FLOW_ASSIGNED_SQL + _ranked_sql(6) + _X2)
def x2b(spark, sf):
    test, train = _ranked(spark, sf, flow_latent(spark, sf), 6)
    return rounded(ranked_subset_scores(test, train, ["p0", "p1"]), "proximity", "f1")


@query(
    "x2c_ranked_subset_correlation",
    FLOW_ASSIGNED_SQL + _ranked_sql(6) + " SELECT model, count(*) AS n, round(corr(proximity, f1), 5) AS pearson_r FROM f1s JOIN prox USING (p) GROUP BY model",
)
def x2c(spark, sf):
    test, train = _ranked(spark, sf, flow_latent(spark, sf), 6)
    _, found = ranked_subset_sweep(test, train, ["p0", "p1"])
    return rounded(found.select("model", "n", "pearson_r"), "pearson_r", digits=5)


_X3 = ASSIGNED_SQL + ", " + preds_sql(10) + """,
t AS (SELECT * FROM preds WHERE side = 'test'),
wrong AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_id)) AS i FROM t WHERE p0 <> y OR p1 <> y),
avail AS (
  SELECT w.row_id, w.y, w.z, w.i, list(c.cluster_id ORDER BY c.cluster_id) AS ids, list(c.centroid ORDER BY c.cluster_id) AS cs
  FROM wrong w JOIN clusters c ON c.majority_y <> w.y GROUP BY ALL),
drawn AS (SELECT a.*, s.step, s.step / 9 AS frac, len(ids) AS n, """ + unit_sql("'42'", "'target'", "s.step", "row_id") + """ AS u
  FROM avail a, range(10) s(step)),
picked AS (
  SELECT *, CASE WHEN step = 0 THEN 0 WHEN step = 9 THEN (i - 1) % n WHEN u < 1 - frac THEN 0
                 ELSE least(floor((u - (1 - frac)) / frac * n)::BIGINT, n - 1) END AS pick FROM drawn),
moved AS (
  SELECT step, row_id, y, list_transform(range(1, 65), lambda k: z[k] * (1 - 0.3 * frac) + cs[pick + 1][k] * (0.3 * frac)) AS z FROM picked
  UNION ALL SELECT step, row_id, y, z FROM t, range(10) s(step) WHERE p0 = y AND p1 = y),
mc AS (
  SELECT step, m.row_id, {'d': list_distance(m.z, c.centroid), 'id': c.cluster_id} AS s, c.majority_y = m.y AS same FROM moved m, clusters c),
mb AS (SELECT step, row_id, coalesce(min(s) FILTER (same), min(s)) AS p, min(s) FILTER (NOT same) AS g FROM mc GROUP BY ALL),
ma AS (SELECT step, p.id AS pos, coalesce(g, p).id AS neg FROM mb),
cells2 AS (
  SELECT st.step, a.cluster_id AS pos, b.cluster_id AS neg, count(m.step) AS n FROM range(10) st(step) JOIN clusters a ON true
  JOIN clusters b ON a.majority_y <> b.majority_y LEFT JOIN ma m ON m.step = st.step AND m.pos = a.cluster_id AND m.neg = b.cluster_id GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY step, pos ORDER BY n, neg) AS i, count(*) OVER (PARTITION BY step, pos) AS m,
  sum(n) OVER (PARTITION BY step, pos) AS total FROM cells2),
sc AS (SELECT step, pos, CASE WHEN total = 0 THEN 0 ELSE 1 - greatest(0, least(1, (m + 1 - 2 * sum((m - i + 1) * n) / total) / m *
  CASE WHEN m > 1 THEN m / (m - 1) ELSE 1 END)) END AS scarcity FROM pl GROUP BY step, pos, m, total)
SELECT step::INT AS step, round(sum(scarcity) / (SELECT count(*) FROM clusters), 6) AS scarcity FROM sc GROUP BY step"""


@query("x3_dispersion", _X3)
def x3(spark, sf):
    rows = latent(spark, sf)
    model, _ = cell_model(rows)
    test = predictions(rows.filter("side = 'test'"), 10)
    return rounded(dispersion_scores(test, model, ["p0", "p1"]), "scarcity")


@query("x3b_dispersion_sweep")
def x3b(spark, sf):
    rows = flow_latent(spark, sf)
    model, _ = cell_model(rows)
    scores, found = dispersion_sweep(predictions(rows.filter("side = 'test'"), 6), model, ["p0", "p1"])
    return rounded(scores.join(found.select("model", "pearson_r"), "model"), "scarcity", "f1")


@query("x4_encoder_comparison")
def x4(spark, sf):
    """Ten seeds, both encoders, all default k: scores per seed beside their means over the seeds."""
    scores = compare_encoders(*_embedding_set(spark, sf), restarts=3, m=64).persist()
    means = encoder_means(scores)
    columns = [c for c in (*scores.columns, *means.columns) if c not in ("seed", "encoder", "best_k", "n")]
    return rounded(scores.join(means.drop("n"), "encoder"), *columns)


# The same comparison in SQL: label means as clusters, ten seeds.
def _compare_sql(name: str, source: str, features: list[str]) -> str:
    zs = ", ".join(f"({f} - avg({f}) FILTER (side = 'train') OVER w) / stddev_pop({f}) FILTER (side = 'train') OVER w" for f in features)
    p = name
    return f"""{p}_coded AS ({source}),
{p}_ranks AS (SELECT s.seed, c.*, row_number() OVER (PARTITION BY s.seed, y ORDER BY md5(s.seed || ':' || row_id)) AS rk,
  count(*) OVER (PARTITION BY s.seed, y) AS n FROM {p}_coded c, range(42, 52) s(seed)),
{p}_split AS (SELECT *, CASE WHEN rk <= floor(n * 0.6 + 1e-9) THEN 'train' WHEN rk <= floor(n * 0.8 + 1e-9) THEN 'val' ELSE 'test' END AS side FROM {p}_ranks),
{p}_latent AS (SELECT seed, row_id, y, side, [{zs}] AS z FROM {p}_split WINDOW w AS (PARTITION BY seed)),
{p}_clusters AS (SELECT seed, y AS id, list(m ORDER BY i) AS c FROM (
  SELECT seed, y, i, avg(z[i]) AS m FROM {p}_latent, range(1, {len(features) + 1}) t(i) WHERE side = 'train' GROUP BY ALL) GROUP BY ALL),
{p}_best AS (SELECT l.seed, l.row_id, l.y, l.side, min({{'d': list_distance(z, c), 'id': id}}) FILTER (id <> l.y) AS g
  FROM {p}_latent l JOIN {p}_clusters c USING (seed) WHERE side <> 'val' GROUP BY ALL),
{p}_counted AS (SELECT seed, y AS pos, g.d AS v, count(*) FILTER (side = 'test') AS t, count(*) FILTER (side = 'train') AS r FROM {p}_best GROUP BY ALL),
{p}_curves AS (SELECT seed, pos, sum(t) OVER w AS ct, sum(r) OVER w AS cr, sum(t) OVER k AS nt, sum(r) OVER k AS nr FROM {p}_counted
  WINDOW w AS (PARTITION BY seed, pos ORDER BY v), k AS (PARTITION BY seed, pos)),
{p}_prox AS (SELECT seed, greatest(0, max(ct / nt - cr / nr)) AS proximity FROM {p}_curves GROUP BY seed),
{p}_grid AS (SELECT a.seed, a.id AS pos, b.id AS neg, (SELECT count(*) FROM {p}_best s WHERE s.side = 'test' AND s.seed = a.seed AND s.y = a.id AND s.g.id = b.id) AS n
  FROM {p}_clusters a JOIN {p}_clusters b ON a.seed = b.seed AND a.id <> b.id),
{p}_placed AS (SELECT *, row_number() OVER (PARTITION BY seed, pos ORDER BY n, neg) AS i, count(*) OVER (PARTITION BY seed, pos) AS m,
  sum(n) OVER (PARTITION BY seed, pos) AS total FROM {p}_grid),
{p}_scarce AS (SELECT seed, pos, CASE WHEN total = 0 THEN 0 ELSE 1 - greatest(0, least(1, (m + 1 - 2 * sum((m - i + 1) * n) / total) / m
  * CASE WHEN m > 1 THEN m / (m - 1) ELSE 1 END)) END AS s FROM {p}_placed GROUP BY seed, pos, m, total),
{p}_seed AS (SELECT seed, proximity, scarcity FROM {p}_prox JOIN (SELECT seed, avg(s) AS scarcity FROM {p}_scarce GROUP BY seed) USING (seed)),
{p}_row AS (SELECT '{name}' AS dataset, round(avg(proximity), 6) AS proximity_mean, round(stddev_pop(proximity), 6) AS proximity_std,
  round(avg(scarcity), 6) AS scarcity_mean, round(stddev_pop(scarcity), 6) AS scarcity_std, count(*) AS n_splits,
  (SELECT count(*) FROM {p}_coded) AS n_samples, {len(features)}::BIGINT AS n_features, (SELECT count(DISTINCT y) FROM {p}_coded) AS n_classes FROM {p}_seed)"""


_LINES = (
    "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, l_quantity AS quantity, l_extendedprice AS extendedprice,"
    " l_discount AS discount, l_tax AS tax, (dense_rank() OVER (ORDER BY l_returnflag || l_linestatus) - 1)::INT AS y FROM lineitem"
)
_ORDERS = (
    "SELECT o_orderkey AS row_id, o_totalprice AS price, o_custkey::DOUBLE AS customer,"
    " (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS y FROM orders"
)


@query(
    "x5_dataset_comparison",
    with_(_compare_sql("lines", _LINES, FEATURES), _compare_sql("orders_set", _ORDERS, ["price", "customer"]))
    + "SELECT * FROM lines_row UNION ALL SELECT * FROM orders_set_row",
)
def x5(spark, sf):
    found = compare_datasets(
        {
            "lines": lambda: (coded_flows(spark, sf).drop("label"), FEATURES),
            "orders_set": lambda: _orders_set(spark, sf),
            "absent": lambda: (spark.read.parquet(f"{sf}/absent.parquet"), FEATURES),
        },
        metrics=("proximity", "scarcity"),
    )
    return rounded(found, "proximity_mean", "proximity_std", "scarcity_mean", "scarcity_std")


def _orders_set(spark, sf):
    rows = spread(table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"),
        F.col("o_custkey").cast("double").alias("customer"), F.col("o_orderpriority").alias("label"),
    ))
    return apply_labels(rows, fit_labels(rows)).drop("label"), ["price", "customer"]


def _embedding_set(spark, sf):
    names = [f"e{i}" for i in range(64)]
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").alias("y"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return spread(rows), names


@query("x5b_dataset_comparison_embedded")
def x5b(spark, sf):
    """Two datasets over ten seeds with encoder, the default k with two restarts and all three scores."""
    found = compare_datasets(
        {"embeddings": lambda: _embedding_set(spark, sf), "orders_set": lambda: _orders_set(spark, sf)}, encoder=embed_per_seed,
        clusterer=partial(kmeans_clusters, restarts=2), m=64)
    return rounded(found, *[f"{s}_{f}" for s in ("diversity", "proximity", "scarcity") for f in ("mean", "std")])


def _batches(spark, rows):
    """Validation rows as candidate batches, four by hash."""
    h = F.conv(F.substring(F.md5(F.col("row_id").cast("string")), 1, 4), 16, 10).cast("int")
    return rows.filter("side = 'val'").withColumn("batch", h % 4).withColumn("features", F.col("z"))


@query("x6_augmentation_comparison")
def x6(spark, sf):
    rows = latent(spark, sf)
    model, _ = cell_model(rows)
    base = base_scores(rows.filter("side <> 'val'"), model)
    vectors = rows.withColumn("features", F.col("z"))
    found = augmentation_comparison(
        base, _batches(spark, rows), vectors.filter("side = 'train'"), vectors.filter("side = 'test'"),
        kinds={"random_forest": FOREST},
    )
    return rounded(found, "diversity", "proximity", "scarcity", "reward", "accuracy", "precision", "recall", "f1")


_SCORED = ("diversity", "proximity", "scarcity", "accuracy", "precision", "recall", "f1")


@query("x6b_generated_batches")
def x6b(spark, sf):
    """Forty drawn settings on the embeddings, the best batch of each weighting, and forests retrained with it."""
    bench = prepare(*_embedding_set(spark, sf), restarts=3)
    found = generated_comparison(bench, random_settings(spark, 40), kinds={"random_forest": FOREST})
    return rounded(found, "reward", *_SCORED)


@query("x7_transfer_settings")
def x7(spark, sf):
    """Settings rewarded on the orders; the best ones perturb, assess and retrain the embeddings."""
    a = prepare(*_orders_set(spark, sf), restarts=3)
    b = prepare(*_embedding_set(spark, sf), restarts=3)
    found = transfer_comparison(a, b, random_settings(spark, 40), kinds={"random_forest": FOREST})
    return rounded(found.select("reward_config", "batch", "config.*", "reward_a", *_SCORED[:3], "model", *_SCORED[3:]),
                   *SETTINGS, "reward_a", *_SCORED)


@query("x8_three_arm_retrain")
def x8(spark, sf):
    rows = latent(spark, sf).select("row_id", "y", F.col("z").alias("features"))
    model, _ = seed_cells(rows.select("row_id", "y", F.col("features").alias("z")), 1)

    def most_borderline(pool):
        from ..operators.assign import assign
        from ..operators.sampling import rank_bins

        near = assign(pool, model, z="features").withColumn("_near", -F.col("neg_dist"))
        return rank_bins(near, "_near", 2).filter("bin = 1")

    found = three_arm_retrain(rows, most_borderline, F.expr("_n div 2"), {"random_forest": FOREST})
    return rounded(found, "accuracy", "precision", "recall", "f1")


@query(
    "x9_select_by_splits",
    EPISODES_SQL + """, ranks AS (
  SELECT f.fold, event_type, reward, row_number() OVER (PARTITION BY f.fold ORDER BY md5((f.fold + 42) || ':' || event_id)) AS rk,
         count(*) OVER (PARTITION BY f.fold) AS n FROM episodes, range(20) f(fold)),
s AS (SELECT event_type AS config, fold, avg(reward) AS value FROM ranks WHERE rk > n // 2 GROUP BY ALL),
m AS (SELECT config, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value, count(*) AS n_splits FROM s GROUP BY config)
SELECT *, mean_value = (SELECT max(mean_value) FROM m) AS is_best FROM m""",
)
def x9(spark, sf):
    halves = half_splits(episodes(spark, sf), 20, 42, "event_id").filter("part = 'val'")
    scores = halves.groupBy(F.col("event_type").alias("config"), "fold").agg(F.avg("reward").alias("value"))
    return rounded(select_by_splits(scores.withColumn("position", F.col("config"))), "mean_value", "std_value")


@query(
    "x10_mean_improvement",
    "WITH s AS (SELECT l_suppkey, avg(l_tax) AS tax, avg(l_discount) AS discount FROM lineitem GROUP BY l_suppkey),"
    " b AS (SELECT avg(l_tax) AS tax, avg(l_discount) AS discount FROM lineitem)"
    " SELECT round(avg(s.tax - b.tax), 8) AS tax_gain_mean, round(stddev_pop(s.tax - b.tax), 8) AS tax_gain_std,"
    " round(avg(s.discount - b.discount), 8) AS discount_gain_mean, round(stddev_pop(s.discount - b.discount), 8) AS discount_gain_std,"
    " count(*) AS n FROM s, b",
)
def x10(spark, sf):
    lines = table(spark, sf, "lineitem")
    aggs = [F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("discount")]
    gains = improvement(lines.groupBy("l_suppkey").agg(*aggs), lines.agg(*aggs), ["tax", "discount"])
    found = mean_std(gains, ["tax_gain", "discount_gain"])
    return rounded(found, "tax_gain_mean", "tax_gain_std", "discount_gain_mean", "discount_gain_std", digits=8)


_UNIQUE = "flows AS (SELECT min(row_id) AS row_id, quantity, extendedprice, discount, tax, label FROM valid GROUP BY quantity, extendedprice, discount, tax, label)"


@query(
    "x11_end_to_end",
    with_(_DIRTY, _UNIQUE, _CODED, _SPLIT_FLOWS, _FLOW_LATENT, _cells_sql(4), _ASSIGNED, _KS, _GRID, _SCORES)
    + "SELECT cluster_id, majority_y, n_train, n_test, round(proximity, 6) AS proximity, round(scarcity, 6) AS scarcity FROM cluster_scores",
)
def x11(spark, sf):
    report = end_to_end(
        dirty_flows(spark, sf), FEATURES, dedup=True, clusterer=lambda train: seed_cells(train, 2, 7)[0],
        metrics=("proximity", "scarcity"),
    )
    return rounded(
        report.assessment.cluster_scores.select("cluster_id", "majority_y", "n_train", "n_test", "proximity", "scarcity"),
        "proximity", "scarcity",
    )


@query("x11b_end_to_end_embedded")
def x11b(spark, sf):
    """Cleaning, encoder, the default k-means sweep and all three scores."""
    report = end_to_end(dirty_flows(spark, sf), FEATURES, dedup=True, encoder=embedded, m=64)
    scores = report.assessment.cluster_scores
    return rounded(scores.select("cluster_id", "majority_y", "n_train", "n_test", *ALL_METRICS), *ALL_METRICS)
