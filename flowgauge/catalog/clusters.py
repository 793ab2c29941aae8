"""Clustering, its quality, and centroid assignment."""

from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..operators.assign import assign, nearest, negative_grid
from ..operators.clustering import (
    best_k, cluster, cluster_accuracy, cluster_table, kmeans_fits, kmeans_sweep, majority_labels, mean_vectors, silhouette,
)
from ..operators.lloyd import nearest_of
from . import query
from .views import (
    ASSIGNED_SQL, CLUSTERS_SQL, FLOW_ASSIGNED_SQL, FLOW_SCORES_SQL, LATENT_SQL, SCORES_SQL, assessed, cell_model, flow_latent, latent,
    rounded,
)


@query("c1_kmeans_sweep")
def c1(spark, sf):
    """All default k with ten restarts each."""
    scores, _ = kmeans_sweep(latent(spark, sf).select("row_id", "y", "z"))
    return scores


@query("c1b_kmeans_members", LATENT_SQL + "SELECT k, row_id, true AS nearest, true AS centred FROM latent, (VALUES (2), (5), (12)) v(k)")
def c1b(spark, sf):
    """Of every row and fit: its cluster's centre is the nearest one, and the mean of all rows in that cluster."""
    rows = latent(spark, sf).select("row_id", "y", "z")
    fits = kmeans_fits(rows, [2, 5, 12], restarts=3, max_iter=300)
    every = rows.withColumn("k", F.explode(F.array(*map(F.lit, fits))))
    members = nearest_of(every, {k: fit.centres for k, fit in fits.items()}, "k")
    means = mean_vectors(members, ["k", "cluster_id"], out="mean").groupBy("k").agg(
        F.map_from_entries(F.collect_list(F.struct("cluster_id", "mean"))).alias("means"))
    centres = F.create_map(*[x for k, fit in fits.items() for x in (F.lit(k), F.lit(fit.centres.tolist()))])
    own, mean = F.get("centres", F.col("cluster_id")), F.element_at("means", F.col("cluster_id"))
    least = F.array_min(F.transform("centres", lambda c: distance(F.col("z"), c)))
    return members.join(F.broadcast(means), "k").withColumn("centres", centres[F.col("k")]).select(
        "k", "row_id", (distance(F.col("z"), own) <= least + 1e-9).alias("nearest"), (distance(own, mean) < 1e-2).alias("centred"))


@query(
    "c2_silhouette_exact",
    CLUSTERS_SQL + """, sums AS (
  SELECT a.row_id, a.cluster_id AS own, b.cluster_id AS other, sum(list_distance(a.z, b.z)) AS total, count(*) AS size
  FROM cells a, cells b GROUP BY ALL),
scored AS (
  SELECT row_id, max(CASE WHEN own = other THEN size END) AS own_size, max(CASE WHEN own = other THEN total / nullif(size - 1, 0) END) AS a,
         min(CASE WHEN own <> other THEN total / size END) AS b FROM sums GROUP BY row_id)
SELECT round(avg(CASE WHEN own_size > 1 AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette,
       'exact' AS mode FROM scored""",
)
def c2(spark, sf):
    _, members = cell_model(latent(spark, sf))
    return rounded(silhouette(members, "exact"), "silhouette")


@query(
    "c2b_silhouette_squared",
    FLOW_ASSIGNED_SQL + """, parts AS (
  SELECT cluster_id, count(*) AS n, sum(z[1]) AS s1, sum(z[2]) AS s2, sum(z[3]) AS s3, sum(z[4]) AS s4,
         sum(z[1]**2 + z[2]**2 + z[3]**2 + z[4]**2) AS q FROM cells GROUP BY cluster_id),
means AS (
  SELECT c.row_id, c.cluster_id AS own, p.cluster_id AS other, p.n,
         (z[1]**2 + z[2]**2 + z[3]**2 + z[4]**2) + p.q / p.n - 2 * (z[1]*s1 + z[2]*s2 + z[3]*s3 + z[4]*s4) / p.n AS d FROM cells c, parts p),
scored AS (
  SELECT row_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other THEN d * n / nullif(n - 1, 0) END) AS a,
         min(CASE WHEN own <> other THEN d END) AS b FROM means GROUP BY row_id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette, 'fast' AS mode FROM scored""",
)
def c2b(spark, sf):
    _, members = cell_model(flow_latent(spark, sf))
    return rounded(silhouette(members, "fast"), "silhouette")


@query(
    "c3_best_k",
    CLUSTERS_SQL + ", s AS (SELECT majority_y AS k, round(avg(centroid[1]), 6) AS silhouette FROM clusters GROUP BY 1)"
    " SELECT k AS best_k, silhouette FROM s ORDER BY silhouette DESC, k LIMIT 1",
)
def c3(spark, sf):
    # Any score per k will do: here a centroid statistic per majority label.
    model, _ = cell_model(latent(spark, sf))
    scores = model.table(spark).groupBy(F.col("majority_y").alias("k")).agg(
        F.round(F.avg(F.col("centroid")[0]), 6).alias("silhouette")
    )
    return best_k(scores)


@query("c4_majority_labels", CLUSTERS_SQL + "SELECT cluster_id, majority_y, n_majority, n_train FROM majority")
def c4(spark, sf):
    _, members = cell_model(latent(spark, sf))
    return majority_labels(members)


@query("c5_cluster_accuracy", FLOW_ASSIGNED_SQL + "SELECT round(sum(n_majority) / sum(n_train), 6) AS km_accuracy FROM majority")
def c5(spark, sf):
    _, members = cell_model(flow_latent(spark, sf))
    return rounded(cluster_accuracy(members), "km_accuracy")


@query(
    "c6_cluster_table",
    CLUSTERS_SQL + "SELECT cluster_id, majority_y, n_train, list_transform(centroid, lambda v: round(v, 6)) AS centroid FROM clusters",
)
def c6(spark, sf):
    _, members = cell_model(latent(spark, sf))
    return cluster_table(members).withColumn("centroid", F.transform("centroid", lambda v: F.round(v, 6)))


@query("c7_choose_and_label")
def c7(spark, sf):
    clusters, _, summary = cluster(latent(spark, sf).select("row_id", "y", "z"))
    best = summary.first()
    return clusters.withColumns({
        "best_k": F.lit(best.best_k), "silhouette": F.lit(best.silhouette), "km_accuracy": F.lit(best.km_accuracy)
    })


@query(
    "c8_nearest_centroid",
    FLOW_ASSIGNED_SQL + "SELECT l.row_id, min({'d': list_distance(l.z, c.centroid), 'id': c.cluster_id}).id AS cluster_id"
    " FROM latent l, clusters c GROUP BY l.row_id",
)
def c8(spark, sf):
    rows = flow_latent(spark, sf)
    model, _ = cell_model(rows)
    return nearest(rows, model).select("row_id", "cluster_id")


_ASSIGN_COLS = "SELECT row_id, side, pos, neg, round(pos_dist, 6) AS pos_dist, round(neg_dist, 6) AS neg_dist FROM assigned"


@query("j1_assign_vectors", ASSIGNED_SQL + _ASSIGN_COLS)
def j1(spark, sf):
    rows, _ = assessed(latent(spark, sf))
    return rounded(rows.select("row_id", "side", "pos", "neg", "pos_dist", "neg_dist"), "pos_dist", "neg_dist")


@query("j1b_assign_flows", FLOW_ASSIGNED_SQL + _ASSIGN_COLS)
def j1b(spark, sf):
    rows, _ = assessed(flow_latent(spark, sf))
    return rounded(rows.select("row_id", "side", "pos", "neg", "pos_dist", "neg_dist"), "pos_dist", "neg_dist")


@query(
    "j1c_assign_per_variant",
    ASSIGNED_SQL + ", v AS (SELECT * FROM (VALUES (1), (2)) t(variant)),"
    " vc AS (SELECT variant, cluster_id, list_transform(centroid, lambda x: x * variant) AS centroid, majority_y FROM clusters, v),"
    " vp AS (SELECT variant, l.row_id, {'d': list_distance(l.z, c.centroid), 'id': c.cluster_id} AS s, c.majority_y = l.y AS same"
    "        FROM latent l, vc c WHERE l.side = 'test'),"
    " vb AS (SELECT variant, row_id, coalesce(min(s) FILTER (same), min(s)) AS p, min(s) FILTER (NOT same) AS g FROM vp GROUP BY ALL)"
    " SELECT variant, row_id, p.id AS pos, coalesce(g, p).id AS neg FROM vb",
)
def j1c(spark, sf):
    rows = latent(spark, sf)
    model, _ = cell_model(rows)
    variants = F.explode(F.array(F.lit(1), F.lit(2)))
    scaled = model.table(spark).withColumn("variant", variants).withColumn(
        "centroid", F.transform("centroid", lambda v: v * F.col("variant"))
    )
    test = rows.filter("side = 'test'").withColumn("variant", variants)
    return assign(test, scaled, ["variant"]).select("variant", "row_id", "pos", "neg")


@query(
    "j2_negative_distances",
    FLOW_ASSIGNED_SQL + "SELECT pos, side, count(*) AS n, round(avg(neg_dist), 6) AS mean_dist, round(min(neg_dist), 6) AS min_dist,"
    " round(max(neg_dist), 6) AS max_dist FROM assigned GROUP BY pos, side",
)
def j2(spark, sf):
    rows, _ = assessed(flow_latent(spark, sf))
    d = F.col("neg_dist")
    return rows.groupBy("pos", "side").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 6).alias("mean_dist"), F.round(F.min(d), 6).alias("min_dist"),
        F.round(F.max(d), 6).alias("max_dist"),
    )


@query("j3_negative_grid", SCORES_SQL + "SELECT pos, majority_y, neg, n FROM grid")
def j3(spark, sf):
    rows, model = assessed(latent(spark, sf))
    return negative_grid(rows.filter("side = 'test'"), model)


@query("j3b_negative_grid_flows", FLOW_SCORES_SQL + "SELECT pos, majority_y, neg, n FROM grid")
def j3b(spark, sf):
    rows, model = assessed(flow_latent(spark, sf))
    return negative_grid(rows.filter("side = 'test'"), model)
