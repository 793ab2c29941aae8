"""Derived tables in both engines: labelled flows, latent rows, clusters, predictions, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import bounded_side, spread
from ..functions.ordering import ranked
from ..functions.vectors import pack
from ..operators.assign import ClusterModel, assign
from ..operators.clean import apply_scaler, fit_labels, fit_scaler, apply_labels
from ..operators.clustering import seed_cells
from ..operators.sampling import stratified_split

FEATURES = ["quantity", "extendedprice", "discount", "tax"]
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]
RATIOS = {"train": 0.6, "val": 0.2, "test": 0.2}
DIM = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def row_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def flows(spark: SparkSession, sf: str) -> DataFrame:
    lines = spread(table(spark, sf, "lineitem").select(*LINE_COLUMNS))
    return lines.select(
        row_key().alias("row_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.concat("l_returnflag", "l_linestatus").alias("label"),
    )


def dirty_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows with missing, infinite and repeated rows, a text and a constant column."""
    inf = float("inf")
    lines = spread(table(spark, sf, "lineitem").select(*LINE_COLUMNS))
    raw = lines.select(
        row_key().alias("row_id"),
        F.when(F.col("l_partkey") % 97 == 0, float("nan")).otherwise(F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.when(F.col("l_partkey") % 83 != 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_suppkey") % 89 == 0, inf).when(F.col("l_suppkey") % 89 == 1, -inf)
        .otherwise(F.col("l_tax")).alias("tax"),
        F.lit(5.0).alias("constant"),
        F.col("l_linestatus").alias("note"),
        F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.when(F.col("l_partkey") % 50 == 0, 2).otherwise(1).alias("_copies"),
    )
    return (
        raw.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .withColumn("row_id", F.concat_ws("-", "row_id", "_copy"))
        .drop("_copies", "_copy")
    )


def coded_flows(spark: SparkSession, sf: str) -> DataFrame:
    rows = flows(spark, sf)
    return apply_labels(rows, fit_labels(rows))


def split_flows(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(coded_flows(spark, sf), RATIOS, [42], "y", "row_id", keep_hashes=True)


def flow_latent(spark: SparkSession, sf: str) -> DataFrame:
    """Flows scaled by their train rows; the scaled features are the latent vector."""
    rows = split_flows(spark, sf)
    scaler = fit_scaler(rows.filter(F.col("split") == "train"), FEATURES)
    scaled = apply_scaler(rows, scaler, FEATURES)
    return scaled.select("row_id", "y", F.col("split").alias("side"), pack(FEATURES).alias("z")).persist()


def latent(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("z")
    )
    split = stratified_split(spread(rows), RATIOS, [42], "y", "row_id")
    return split.select("row_id", "y", "z", F.col("split").alias("side")).persist()


def cell_model(rows: DataFrame) -> tuple[ClusterModel, DataFrame]:
    """Cluster model from the train rows, and the train rows with their cluster."""
    return seed_cells(rows.filter(F.col("side") == "train"), 2, 7)


def assessed(rows: DataFrame) -> tuple[DataFrame, ClusterModel]:
    """Train and test rows with their assignments."""
    model, _ = cell_model(rows)
    return assign(rows.filter(F.col("side") != "val"), model).persist(), model


def predictions(rows: DataFrame, n_classes: int) -> DataFrame:
    """Two fixed prediction columns that err on known rows."""
    h = F.conv(F.substring(F.md5(F.col("row_id").cast("string")), 1, 4), 16, 10).cast("int")
    return rows.withColumns({
        "p0": ((F.col("y") + F.when(h % 4 == 0, 1).otherwise(0)) % n_classes).cast("int"),
        "p1": ((F.col("y") + F.when(h % 3 == 0, 3).otherwise(0)) % n_classes).cast("int"),
    })


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as logged episodes: one per user, ordered by time."""
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("_t")
    )
    numbered = ranked(rows, ["user_id"], "_t", "event_id", descending=False, out="_step")
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        numbered.join(bounded_side(sizes), "user_id")
        .select(
            F.col("user_id").alias("episode"), (F.col("_step") - 1).alias("step"), F.col("value").alias("reward"),
            (F.col("_step") == F.col("_n")).alias("terminal"), "event_type", "event_id",
        )
    )


# --- the same tables in SQL -------------------------------------------------

_FLOWS = """flows AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, l_quantity AS quantity,
         l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax, l_returnflag || l_linestatus AS label
  FROM lineitem)"""

_DIRTY = """dirty AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, c) AS row_id,
         CASE WHEN l_partkey % 97 = 0 THEN 'nan'::DOUBLE ELSE l_quantity END AS quantity,
         l_extendedprice AS extendedprice,
         CASE WHEN l_partkey % 83 <> 0 THEN l_discount END AS discount,
         CASE WHEN l_suppkey % 89 = 0 THEN 'inf'::DOUBLE WHEN l_suppkey % 89 = 1 THEN '-inf'::DOUBLE ELSE l_tax END AS tax,
         5.0::DOUBLE AS "constant", l_linestatus AS note, l_returnflag || l_linestatus AS label
  FROM lineitem, range(1, 3) t(c) WHERE c = 1 OR l_partkey % 50 = 0),
valid AS (
  SELECT * FROM dirty WHERE NOT isnan(quantity) AND discount IS NOT NULL AND NOT isinf(tax))"""

_CODED = """coded AS (
  SELECT f.*, (dense_rank() OVER (ORDER BY label) - 1)::INT AS y FROM flows f)"""

_SPLIT_FLOWS = """split_flows AS (
  SELECT * EXCLUDE (rk, n), CASE WHEN rk <= floor(n * 0.6 + 1e-9) THEN 'train'
         WHEN rk <= floor(n * 0.8 + 1e-9) THEN 'val' ELSE 'test' END AS side
  FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS rk,
               count(*) OVER (PARTITION BY y) AS n FROM coded))"""

_FLOW_LATENT = """stats AS (
  SELECT avg(quantity) AS m0, stddev_pop(quantity) AS s0, avg(extendedprice) AS m1, stddev_pop(extendedprice) AS s1,
         avg(discount) AS m2, stddev_pop(discount) AS s2, avg(tax) AS m3, stddev_pop(tax) AS s3
  FROM split_flows WHERE side = 'train'),
latent AS (
  SELECT row_id, y, side, [(quantity - m0) / s0, (extendedprice - m1) / s1, (discount - m2) / s2, (tax - m3) / s3] AS z
  FROM split_flows, stats)"""

_LATENT = """latent AS (
  SELECT row_id, y, z, CASE WHEN rk <= floor(n * 0.6 + 1e-9) THEN 'train'
         WHEN rk <= floor(n * 0.8 + 1e-9) THEN 'val' ELSE 'test' END AS side
  FROM (SELECT vec_id AS row_id, label AS y, embedding::DOUBLE[] AS z,
               row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id)) AS rk,
               count(*) OVER (PARTITION BY label) AS n FROM embeddings))"""


def _cells_sql(dim: int) -> str:
    return f"""starts AS (
  SELECT (row_number() OVER (ORDER BY y, rn) - 1)::INT AS cid, z FROM (
    SELECT y, z, row_number() OVER (PARTITION BY y ORDER BY md5('7:' || row_id)) AS rn
    FROM latent WHERE side = 'train') WHERE rn <= 2),
cells AS (
  SELECT l.row_id, l.y, any_value(l.z) AS z, min({{'d': list_distance(l.z, s.z), 'id': s.cid}}).id AS cluster_id
  FROM latent l, starts s WHERE l.side = 'train' GROUP BY l.row_id, l.y),
votes AS (SELECT cluster_id, y, count(*) AS n FROM cells GROUP BY ALL),
majority AS (
  SELECT cluster_id, (-max({{'n': n, 'y': -y}}).y)::INT AS majority_y, sum(n)::BIGINT AS n_train, max(n) AS n_majority
  FROM votes GROUP BY cluster_id),
centres AS (
  SELECT cluster_id, list(m ORDER BY i) AS centroid FROM (
    SELECT cluster_id, i, avg(z[i]) AS m FROM cells, range(1, {dim + 1}) t(i) GROUP BY cluster_id, i)
  GROUP BY cluster_id),
clusters AS (SELECT cluster_id, centroid, majority_y, n_train FROM centres JOIN majority USING (cluster_id))"""


_ASSIGNED = """candidates AS (
  SELECT l.row_id, l.y, l.side, {'d': list_distance(l.z, c.centroid), 'id': c.cluster_id} AS s,
         c.majority_y = l.y AS same FROM latent l, clusters c WHERE l.side <> 'val'),
best AS (
  SELECT row_id, y, side, coalesce(min(s) FILTER (same), min(s)) AS p, min(s) FILTER (NOT same) AS g
  FROM candidates GROUP BY ALL),
assigned AS (
  SELECT row_id, y, side, p.id AS pos, coalesce(g, p).id AS neg, p.d AS pos_dist, coalesce(g, p).d AS neg_dist FROM best)"""

_KS = """counted AS (
  SELECT pos, neg_dist AS v, count(*) FILTER (side = 'test') AS t, count(*) FILTER (side = 'train') AS r
  FROM assigned GROUP BY ALL),
curves AS (
  SELECT pos, sum(t) OVER w AS ct, sum(r) OVER w AS cr, sum(t) OVER k AS nt, sum(r) OVER k AS nr FROM counted
  WINDOW w AS (PARTITION BY pos ORDER BY v), k AS (PARTITION BY pos)),
ks AS (
  SELECT pos, greatest(0, coalesce(max(CASE WHEN nt > 0 AND nr > 0 THEN ct / nt - cr / nr END), 0))::DOUBLE AS proximity,
         max(nt)::BIGINT AS n_test, max(nr)::BIGINT AS n_train FROM curves GROUP BY pos)"""

_GRID = """grid AS (
  SELECT a.cluster_id AS pos, a.majority_y, b.cluster_id AS neg, count(s.row_id) AS n
  FROM clusters a JOIN clusters b ON a.majority_y <> b.majority_y
  LEFT JOIN (SELECT * FROM assigned WHERE side = 'test') s ON s.pos = a.cluster_id AND s.neg = b.cluster_id
  GROUP BY ALL),
placed AS (
  SELECT pos, n, row_number() OVER (PARTITION BY pos ORDER BY n, neg) AS i, count(*) OVER (PARTITION BY pos) AS m,
         sum(n) OVER (PARTITION BY pos) AS total FROM grid),
ginis AS (
  SELECT pos, CASE WHEN total = 0 THEN 0 ELSE greatest(0, least(1,
           (m + 1 - 2 * sum((m - i + 1) * n) / total) / m * CASE WHEN m > 1 THEN m / (m - 1) ELSE 1 END)) END AS gini,
         total FROM placed GROUP BY pos, m, total),
scarcities AS (SELECT pos, CASE WHEN total = 0 THEN 0 ELSE 1 - gini END AS scarcity FROM ginis)"""

_SCORES = """cluster_scores AS (
  SELECT c.cluster_id, c.majority_y, c.n_train, coalesce(k.n_test, 0) AS n_test, coalesce(k.n_train, 0) AS n_train_assigned,
         coalesce(k.proximity, 0) AS proximity, coalesce(s.scarcity, 0) AS scarcity
  FROM clusters c LEFT JOIN ks k ON k.pos = c.cluster_id LEFT JOIN scarcities s ON s.pos = c.cluster_id)"""

_EPISODES = """episodes AS (
  SELECT user_id AS episode, row_number() OVER w - 1 AS step, value AS reward,
         row_number() OVER w = count(*) OVER (PARTITION BY user_id) AS terminal, event_type, event_id
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, md5('0:' || event_id)))"""


def _preds_sql(source: str, n: int) -> str:
    return f"""preds AS (
  SELECT *, (y + CASE WHEN h % 4 = 0 THEN 1 ELSE 0 END) % {n} AS p0, (y + CASE WHEN h % 3 = 0 THEN 3 ELSE 0 END) % {n} AS p1
  FROM (SELECT *, ('0x' || substr(md5(row_id::VARCHAR), 1, 4))::INT AS h FROM {source}))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


FLOWS_SQL = with_(_FLOWS)
DIRTY_SQL = with_(_DIRTY)
CODED_SQL = with_(_FLOWS, _CODED)
SPLIT_SQL = with_(_FLOWS, _CODED, _SPLIT_FLOWS)
FLOW_LATENT_SQL = with_(_FLOWS, _CODED, _SPLIT_FLOWS, _FLOW_LATENT)
FLOW_ASSIGNED_SQL = with_(_FLOWS, _CODED, _SPLIT_FLOWS, _FLOW_LATENT, _cells_sql(4), _ASSIGNED)
FLOW_SCORES_SQL = with_(
    _FLOWS, _CODED, _SPLIT_FLOWS, _FLOW_LATENT, _cells_sql(4), _ASSIGNED, _KS, _GRID, _SCORES
)
LATENT_SQL = with_(_LATENT)
CLUSTERS_SQL = with_(_LATENT, _cells_sql(DIM))
ASSIGNED_SQL = with_(_LATENT, _cells_sql(DIM), _ASSIGNED)
SCORES_SQL = with_(_LATENT, _cells_sql(DIM), _ASSIGNED, _KS, _GRID, _SCORES)
EPISODES_SQL = with_(_EPISODES)


def preds_sql(n: int, source: str = "latent") -> str:
    return _preds_sql(source, n)
