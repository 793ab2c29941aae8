"""Ranks, running sums, top-n and set operations."""

from pyspark.sql import functions as F

from ..functions.ordering import ranked, running_sum
from ..operators.assign import nearest
from ..operators.episodes import best_of, episode_totals, initial_rows, next_rows
from ..operators.sampling import sample_n
from ..operators.scores import misclassified
from . import query
from .views import (
    CLUSTERS_SQL, CODED_SQL, EPISODES_SQL, FLOWS_SQL, LATENT_SQL, cell_model, coded_flows, episodes, flows, latent,
    preds_sql, predictions, rounded,
)

# Small buckets make the distributed form run even on small tables.
BUCKET = 5000

_RANK_SQL = CODED_SQL + (
    "SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY extendedprice DESC, md5('0:' || row_id)) AS rank FROM coded"
)


@query("r1_keyed_rank", _RANK_SQL)
def r1(spark, sf):
    return ranked(coded_flows(spark, sf), ["y"], "extendedprice", "row_id", rows_per_bucket=BUCKET).select("row_id", "y", "rank")


@query(
    "r1b_global_rank_hot_values",
    FLOWS_SQL + "SELECT row_id, row_number() OVER (ORDER BY quantity DESC, md5('0:' || row_id)) AS rank FROM flows",
)
def r1b(spark, sf):
    rows = flows(spark, sf).withColumn("_all", F.lit(0))
    return ranked(rows, ["_all"], "quantity", "row_id", rows_per_bucket=BUCKET).select("row_id", "rank")


@query(
    "r2_running_sum",
    CODED_SQL + ", d AS (SELECT y, extendedprice AS v, count(*) AS n FROM coded GROUP BY ALL)"
    " SELECT y, v, sum(n) OVER (PARTITION BY y ORDER BY v)::BIGINT AS upto FROM d",
)
def r2(spark, sf):
    counts = coded_flows(spark, sf).groupBy("y", F.col("extendedprice").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(counts, ["y"], "v", {"upto": "n"}, rows_per_bucket=BUCKET).select("y", "v", "upto")


@query(
    "r3_next_in_episode",
    EPISODES_SQL + "SELECT episode, step, reward, coalesce(lead(reward) OVER (PARTITION BY episode ORDER BY step), reward)"
    " AS next_reward FROM episodes",
)
def r3(spark, sf):
    return next_rows(episodes(spark, sf), "reward", "next_reward").select("episode", "step", "reward", "next_reward")


@query("r4_episode_starts", EPISODES_SQL + "SELECT episode, event_id, reward FROM episodes WHERE step = 0")
def r4(spark, sf):
    return initial_rows(episodes(spark, sf)).select("episode", "event_id", "reward")


@query(
    "r5_episode_totals",
    EPISODES_SQL + "SELECT episode, round(sum(reward), 4) AS total_reward, count(*) AS length,"
    " arg_max(event_type, step) AS final_event_type FROM episodes GROUP BY episode",
)
def r5(spark, sf):
    return rounded(episode_totals(episodes(spark, sf), ["event_type"]), "total_reward", digits=4)


@query(
    "r6_best_episode",
    EPISODES_SQL + ", t AS (SELECT episode, round(sum(reward), 4) AS total_reward, count(*) AS length FROM episodes GROUP BY 1)"
    " SELECT episode, total_reward, length FROM t ORDER BY total_reward DESC, episode LIMIT 1",
)
def r6(spark, sf):
    totals = rounded(episode_totals(episodes(spark, sf)), "total_reward", digits=4)
    return best_of(totals, "total_reward", "episode").select("episode", "total_reward", "length")


@query("l1_sorted_distinct", FLOWS_SQL + "SELECT DISTINCT quantity FROM flows ORDER BY quantity")
def l1(spark, sf):
    return flows(spark, sf).select("quantity").distinct().orderBy("quantity")


@query(
    "l2_top_by_distance",
    FLOWS_SQL + "SELECT row_id, extendedprice FROM flows ORDER BY extendedprice DESC, md5('0:' || row_id) LIMIT 100",
)
def l2(spark, sf):
    rows = flows(spark, sf)
    return rows.orderBy(F.desc("extendedprice"), F.md5(F.concat(F.lit("0:"), "row_id"))).limit(100).select("row_id", "extendedprice")


@query(
    "l3_argmin_centroid",
    CLUSTERS_SQL + "SELECT l.row_id, min({'d': list_distance(l.z, c.centroid), 'id': c.cluster_id}).id AS cluster_id,"
    " round(min(list_distance(l.z, c.centroid)), 6) AS cluster_id_dist FROM latent l, clusters c GROUP BY l.row_id",
)
def l3(spark, sf):
    rows = latent(spark, sf)
    model, _ = cell_model(rows)
    return rounded(nearest(rows, model).select("row_id", "cluster_id", "cluster_id_dist"), "cluster_id_dist")


@query(
    "u2_select_by_ids",
    CODED_SQL + ", chosen AS (SELECT row_id FROM coded ORDER BY md5('5:' || row_id) LIMIT (SELECT count(*) // 3 FROM coded))"
    " SELECT y, count(*) AS n, round(sum(tax), 6) AS tax FROM coded WHERE row_id IN (SELECT row_id FROM chosen) GROUP BY y",
)
def u2(spark, sf):
    rows = coded_flows(spark, sf)
    chosen = sample_n(rows, F.expr("_n div 3"), 5).select("row_id")
    return rows.join(chosen, "row_id", "left_semi").groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("tax"), 6).alias("tax")
    )


@query(
    "u3_other_label_clusters",
    CLUSTERS_SQL + "SELECT a.cluster_id, b.cluster_id AS other FROM clusters a JOIN clusters b ON a.majority_y <> b.majority_y",
)
def u3(spark, sf):
    model, _ = cell_model(latent(spark, sf))
    rows = [(i, model.others(m)) for i, m in zip(model.ids, model.majority, strict=True)]
    return spark.createDataFrame(rows, "cluster_id int, others array<int>").select("cluster_id", F.explode("others").alias("other"))


@query("u4_any_model_wrong", LATENT_SQL + ", " + preds_sql(10) + " SELECT row_id, y FROM preds WHERE p0 <> y OR p1 <> y")
def u4(spark, sf):
    return misclassified(predictions(latent(spark, sf), 10), ["p0", "p1"]).select("row_id", "y")


@query("j4_misclassified", CODED_SQL + ", " + preds_sql(6, "coded") + " SELECT row_id, y, p0::INT AS p0, p1::INT AS p1 FROM preds WHERE p0 <> y OR p1 <> y")
def j4(spark, sf):
    return misclassified(predictions(coded_flows(spark, sf), 6), ["p0", "p1"]).select("row_id", "y", "p0", "p1")


@query(
    "j5_members_by_split",
    EPISODES_SQL + ", starts AS (SELECT episode FROM episodes WHERE step = 0 AND event_type = 'click')"
    " SELECT episode, step, reward FROM episodes WHERE episode IN (SELECT episode FROM starts)",
)
def j5(spark, sf):
    rows = episodes(spark, sf)
    starts = initial_rows(rows).filter("event_type = 'click'").select("episode")
    return rows.join(starts, "episode", "left_semi").select("episode", "step", "reward")
