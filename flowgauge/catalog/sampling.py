"""Splits, folds, samples, pairs, subsets and random settings."""

from pyspark.sql import functions as F

from ..functions.hashing import hash_hex
from ..operators.sampling import (
    DEFAULT_SEEDS, draw_with_replacement, half_splits, label_subsets, random_configs, rank_bins, sample_n, sample_pairs,
    shuffled, stratified_folds, stratified_split, train_pool_holdout,
)
from . import query
from .views import (
    CODED_SQL, EPISODES_SQL, FLOWS_SQL, LATENT_SQL, RATIOS, SPLIT_SQL, coded_flows, episodes, flows, latent,
    split_flows, table,
)


def unit_sql(*parts: str) -> str:
    key = " || ':' || ".join(parts)
    return f"((('0x' || substr(md5({key}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


@query("t1_stratified_split", SPLIT_SQL + "SELECT row_id, y, side AS split FROM split_flows")
def t1(spark, sf):
    return split_flows(spark, sf).select("row_id", "y", "split")


_SKEW = FLOWS_SQL + """, skewed AS (
  SELECT row_id, quantity, CASE WHEN ('0x' || substr(md5(row_id), 1, 4))::INT % 20 = 0 THEN label ELSE 'benign' END AS y FROM flows),
ranks AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS rk, count(*) OVER (PARTITION BY y) AS n FROM skewed)
SELECT y, CASE WHEN rk <= floor(n * 0.6 + 1e-9) THEN 'train' WHEN rk <= floor(n * 0.8 + 1e-9) THEN 'val' ELSE 'test' END AS split,
       count(*) AS n, round(sum(quantity), 6) AS quantity FROM ranks GROUP BY ALL"""


@query("t1b_split_one_hot_class", _SKEW)
def t1b(spark, sf):
    h = F.conv(F.substring(F.md5("row_id"), 1, 4), 16, 10).cast("int")
    rows = flows(spark, sf).withColumn("y", F.when(h % 20 == 0, F.col("label")).otherwise("benign"))
    return stratified_split(rows, RATIOS, [42]).groupBy("y", "split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 6).alias("quantity")
    )


@query(
    "t1c_threshold_split",
    CODED_SQL + f", u AS (SELECT y, {unit_sql('42', 'row_id')} AS u FROM coded)"
    " SELECT y, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM u GROUP BY ALL",
)
def t1c(spark, sf):
    return stratified_split(coded_flows(spark, sf), RATIOS, [42], exact=False).groupBy("y", "split").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "t2_ten_seed_splits",
    CODED_SQL + """, ranks AS (
  SELECT s.seed, c.y, c.quantity, c.extendedprice, row_number() OVER (PARTITION BY s.seed, c.y ORDER BY md5(s.seed || ':' || row_id)) AS rk,
         count(*) OVER (PARTITION BY s.seed, c.y) AS n FROM coded c, range(42, 52) s(seed))
SELECT seed::INT AS seed, y, CASE WHEN rk <= floor(n * 0.6 + 1e-9) THEN 'train' WHEN rk <= floor(n * 0.8 + 1e-9) THEN 'val' ELSE 'test' END AS split,
       count(*) AS n, round(sum(quantity), 4) AS quantity, round(sum(extendedprice), 2) AS price FROM ranks GROUP BY ALL""",
)
def t2(spark, sf):
    rows = stratified_split(coded_flows(spark, sf), RATIOS, DEFAULT_SEEDS)
    return rows.groupBy("seed", "y", "split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"),
        F.round(F.sum("extendedprice"), 2).alias("price"),
    )


@query(
    "t3_train_pool_holdout",
    CODED_SQL + """, ranks AS (
  SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS rk, count(*) OVER (PARTITION BY y) AS n FROM coded)
SELECT row_id, CASE WHEN rk <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN rk <= floor(n * 0.85 + 1e-9) THEN 'pool' ELSE 'holdout' END AS split FROM ranks""",
)
def t3(spark, sf):
    return train_pool_holdout(coded_flows(spark, sf)).select("row_id", "split")


@query(
    "t4_half_splits",
    EPISODES_SQL + """, ranks AS (
  SELECT f.fold, reward, row_number() OVER (PARTITION BY f.fold ORDER BY md5((f.fold + 42) || ':' || event_id)) AS rk,
         count(*) OVER (PARTITION BY f.fold) AS n FROM episodes, range(20) f(fold))
SELECT fold::INT AS fold, CASE WHEN rk <= n // 2 THEN 'train' ELSE 'val' END AS part, count(*) AS n, round(sum(reward), 4) AS reward
FROM ranks GROUP BY ALL""",
)
def t4(spark, sf):
    return half_splits(episodes(spark, sf), 20, 42, "event_id").groupBy("fold", "part").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("reward"), 4).alias("reward")
    )


@query(
    "t5_stratified_folds",
    CODED_SQL + "SELECT row_id, ((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) - 1) % 5)::INT AS fold FROM coded",
)
def t5(spark, sf):
    return stratified_folds(coded_flows(spark, sf)).select("row_id", "fold")


@query("t6_sample_n", FLOWS_SQL + "SELECT row_id FROM flows ORDER BY md5('42:' || row_id) LIMIT 1000")
def t6(spark, sf):
    return sample_n(flows(spark, sf), 1000).select("row_id")


@query(
    "t6b_sample_n_per_class",
    CODED_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS rk FROM coded)"
    " SELECT row_id, y FROM r WHERE rk <= 250",
)
def t6b(spark, sf):
    return sample_n(coded_flows(spark, sf), 250, keys=["y"]).select("row_id", "y")


@query(
    "t7_draw_with_replacement",
    FLOWS_SQL + f""", numbered AS (SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id)) AS i, count(*) OVER () AS n FROM flows),
draws AS (SELECT o_orderkey AS draw_id, floor({unit_sql("'42'", "'draw'", 'o_orderkey')} * (SELECT count(*) FROM flows))::BIGINT + 1 AS pick FROM orders)
SELECT draw_id, row_id FROM draws JOIN numbered ON pick = i""",
)
def t7(spark, sf):
    draws = table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw_id"))
    return draw_with_replacement(flows(spark, sf), draws).select("draw_id", "row_id")


_PAIRS_SQL = """members AS (
  SELECT y, row_id, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) - 1 AS i FROM latent),
classes AS (SELECT y, count(*) AS members, row_number() OVER (ORDER BY y) - 1 AS c, count(*) OVER () AS k FROM latent GROUP BY y),
sizes AS (SELECT max(k) AS k FROM classes),
raw AS (
  SELECT o_orderkey AS pair_id, k, {coin} > 0.5 AS different, floor({a} * k)::BIGINT AS a, floor({b} * (k - 1))::BIGINT AS b0
  FROM orders, sizes),
picked AS (
  SELECT r.*, ca.y AS ya, ca.members AS ma, CASE WHEN b0 >= a THEN b0 + 1 ELSE b0 END AS b FROM raw r JOIN classes ca ON ca.c = r.a),
drawn AS (
  SELECT p.pair_id, p.different, p.ya, CASE WHEN different THEN cb.y ELSE p.ya END AS yb, p.ma, floor({i} * p.ma)::BIGINT AS i,
         floor({j} * CASE WHEN different THEN cb.members ELSE greatest(p.ma - 1, 1) END)::BIGINT AS j0
  FROM picked p JOIN classes cb ON cb.c = p.b),
pairs AS (
  SELECT d.pair_id, l.row_id AS row_i, r.row_id AS row_j, d.different::INT AS different FROM (
    SELECT *, CASE WHEN different THEN j0 WHEN ma = 1 THEN i WHEN j0 >= i THEN j0 + 1 ELSE j0 END AS j FROM drawn) d
  JOIN members l ON l.y = d.ya AND l.i = d.i JOIN members r ON r.y = d.yb AND r.i = d.j)""".format(
    coin=unit_sql("'42'", "'coin'", "o_orderkey"), a=unit_sql("'42'", "'class_a'", "o_orderkey"),
    b=unit_sql("'42'", "'class_b'", "o_orderkey"), i=unit_sql("'42'", "'member_a'", "pair_id"),
    j=unit_sql("'42'", "'member_b'", "pair_id"),
)
PAIRS_SQL = LATENT_SQL + ", " + _PAIRS_SQL + " "


def order_pairs(spark, sf, rows):
    """As many pairs as there are orders, over the latent rows."""
    requests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair_id"))
    return sample_pairs(rows, requests=requests)


@query("t8_contrastive_pairs", PAIRS_SQL + "SELECT pair_id, row_i, row_j, different FROM pairs")
def t8(spark, sf):
    return order_pairs(spark, sf, latent(spark, sf))


@query(
    "t9_rank_bins",
    FLOWS_SQL + ", r AS (SELECT row_id, row_number() OVER (ORDER BY extendedprice DESC, md5('0:' || row_id)) AS rank, count(*) OVER () AS n FROM flows)"
    " SELECT row_id, rank, CASE WHEN rank = 1 THEN 1 ELSE ((rank * 100 + n - 1) // n) END::INT AS bin FROM r",
)
def t9(spark, sf):
    return rank_bins(flows(spark, sf), "extendedprice").select("row_id", "rank", "bin")


@query(
    "t10_label_subsets",
    """WITH l AS (SELECT label AS y, row_number() OVER (ORDER BY label) - 1 AS i FROM (SELECT DISTINCT label FROM embeddings)),
masks AS (SELECT m FROM range(1, (SELECT (2 ** count(*))::BIGINT FROM l)) t(m))
SELECT m AS subset_id, bit_count(m)::INT AS size, y FROM masks JOIN l ON (m >> i) & 1 = 1""",
)
def t10(spark, sf):
    return label_subsets(latent(spark, sf))


@query("t11_hash_order", FLOWS_SQL + "SELECT row_id, md5('42:' || row_id) AS h FROM flows ORDER BY h")
def t11(spark, sf):
    return shuffled(flows(spark, sf)).select("row_id", hash_hex(42, F.col("row_id")).alias("h"))


_ACTIONS = ", ".join(f"round({unit_sql('42', 'episode', 'step', str(d))}, 6) AS a{d}" for d in range(7))


@query("t12_random_actions", EPISODES_SQL + f"SELECT episode, step, {_ACTIONS} FROM episodes")
def t12(spark, sf):
    keys = episodes(spark, sf).select("episode", "step")
    drawn = random_configs(spark, 0, 0, requests=keys)
    return drawn.select("episode", "step", *[F.round(F.col("action")[d], 6).alias(f"a{d}") for d in range(7)])
