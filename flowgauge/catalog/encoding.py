"""Label codes, scalers, preprocessing, small networks."""

import numpy as np
from pyspark.sql import functions as F

from ..functions.bounded import work_dir
from ..operators.clean import apply_labels, apply_scaler, fit_labels, fit_scaler, preprocess
from ..operators.mlp import Layer, Network, activations, encode, mlp_columns, reconstruction_error
from ..operators.sampling import stratified_split
from ..sources.artifacts import load_table, save_table
from . import query
from .views import (
    CODED_SQL, DIRTY_SQL, FEATURES, FLOW_LATENT_SQL, RATIOS, SPLIT_SQL, dirty_flows, flow_latent, flows, rounded,
    split_flows, table,
)


@query("e1_label_codes", CODED_SQL + "SELECT row_id, label, y FROM coded")
def e1(spark, sf):
    rows = flows(spark, sf)
    return apply_labels(rows, fit_labels(rows)).select("row_id", "label", "y")


@query(
    "e1b_label_codes_text",
    "SELECT doc_id, source AS label, (dense_rank() OVER (ORDER BY source) - 1)::INT AS y FROM documents",
)
def e1b(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("label"))
    return apply_labels(rows, fit_labels(rows))


_STD = ", ".join(
    f"round(({c} - avg({c}) FILTER (side = 'train') OVER ()) / stddev_pop({c}) FILTER (side = 'train') OVER (), 6) AS {c}"
    for c in FEATURES
)
_MINMAX = ", ".join(
    f"round(({c} - min({c}) FILTER (side = 'train') OVER ()) / (max({c}) FILTER (side = 'train') OVER () - min({c})"
    f" FILTER (side = 'train') OVER ()), 6) AS {c}"
    for c in FEATURES
)


def _scaled(spark, sf, kind):
    rows = split_flows(spark, sf).withColumn("fixed", F.lit(3.5))
    names = [*FEATURES, "fixed"]
    scaler = fit_scaler(rows.filter("split = 'train'"), names, kind)
    return rounded(apply_scaler(rows, scaler, names).select("row_id", *names), *names)


@query("e2_standard_scale", SPLIT_SQL + f"SELECT row_id, {_STD}, 0.0::DOUBLE AS fixed FROM split_flows")
def e2(spark, sf):
    return _scaled(spark, sf, "standard")


@query("e3_minmax_scale", SPLIT_SQL + f"SELECT row_id, {_MINMAX}, 0.0::DOUBLE AS fixed FROM split_flows")
def e3(spark, sf):
    return _scaled(spark, sf, "minmax")


_PREP_SQL = DIRTY_SQL + """, parts AS (
  SELECT *, (dense_rank() OVER (ORDER BY label) - 1)::INT AS y0 FROM dirty),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY y0 ORDER BY md5('42:' || row_id)) AS rk, count(*) OVER (PARTITION BY y0) AS n FROM parts),
split_rows AS (
  SELECT *, CASE WHEN rk <= floor(n * 0.6 + 1e-9) THEN 'train' WHEN rk <= floor(n * 0.8 + 1e-9) THEN 'val' ELSE 'test' END AS split
  FROM numbered),
kept AS (
  SELECT split, min(row_id) AS row_id, quantity, extendedprice, discount, tax, label FROM split_rows
  WHERE NOT isnan(quantity) AND discount IS NOT NULL AND NOT isinf(tax)
  GROUP BY split, quantity, extendedprice, discount, tax, label)
SELECT split, row_id, (dense_rank() OVER (ORDER BY label) - 1)::INT AS y, """ + _STD.replace("side = 'train'", "split = 'train'") + " FROM kept"


@query("e4_preprocess", _PREP_SQL)
def e4(spark, sf):
    raw = dirty_flows(spark, sf)
    coded = apply_labels(raw, fit_labels(raw))
    split = stratified_split(coded, RATIOS, [42], "y", "row_id").drop("y", "seed", "note", "constant")
    prepared, _, _ = preprocess(split, FEATURES)
    return rounded(prepared.select("split", "row_id", "y", *FEATURES), *FEATURES)


# A fixed little network: 4 inputs, 3 hidden, 2 latent, and back.
def _weights(a: int, b: int, k: int) -> list[list[float]]:
    return [[((7 * i + 3 * j + k) % 5 - 2) / 4 for j in range(b)] for i in range(a)]


def small_network() -> Network:
    def layer(a, b, k, act):
        return Layer(np.array(_weights(a, b, k)), np.array([(j + k) % 3 / 10 for j in range(b)]), act)

    return Network({
        "encoder": [layer(4, 3, 0, "relu"), layer(3, 2, 1, "identity")],
        "decoder": [layer(2, 3, 2, "relu"), layer(3, 4, 3, "identity")],
    })


def _layer_sql(x: str, a: int, b: int, k: int, relu: bool) -> str:
    units = []
    for j in range(b):
        total = " + ".join(f"{x}[{i + 1}] * {w[j]}::DOUBLE" for i, w in enumerate(_weights(a, b, k)))
        unit = f"({total} + {(j + k) % 3 / 10}::DOUBLE)"
        units.append(f"greatest({unit}, 0)" if relu else unit)
    return "[" + ", ".join(units) + "]"


_NET_SQL = FLOW_LATENT_SQL + (
    f", h1 AS (SELECT row_id, y, z AS x, {_layer_sql('z', 4, 3, 0, True)} AS h FROM latent),"
    f" h2 AS (SELECT row_id, y, x, h, {_layer_sql('h', 3, 2, 1, False)} AS e FROM h1),"
    f" h3 AS (SELECT *, {_layer_sql('e', 2, 3, 2, True)} AS g FROM h2),"
    f" h4 AS (SELECT *, {_layer_sql('g', 3, 4, 3, False)} AS r FROM h3) "
)


def _net_input(spark, sf):
    return flow_latent(spark, sf).select("row_id", "y", F.col("z").alias("features"))


@query("e5_encode", _NET_SQL + "SELECT row_id, round(e[1], 6) AS e1, round(e[2], 6) AS e2 FROM h4")
def e5(spark, sf):
    z = encode(_net_input(spark, sf), small_network())
    return z.select("row_id", F.round(F.col("z")[0], 6).alias("e1"), F.round(F.col("z")[1], 6).alias("e2"))


@query("e5b_encode_columns", _NET_SQL + "SELECT row_id, round(e[1], 6) AS e1, round(e[2], 6) AS e2 FROM h4")
def e5b(spark, sf):
    z = mlp_columns(F.col("features"), small_network().parts["encoder"])
    return _net_input(spark, sf).withColumn("z", z).select(
        "row_id", F.round(F.col("z")[0], 6).alias("e1"), F.round(F.col("z")[1], 6).alias("e2")
    )


@query(
    "e6_reconstruction_error",
    _NET_SQL + "SELECT y, count(*) AS n, round(avg(((r[1]-x[1])**2 + (r[2]-x[2])**2 + (r[3]-x[3])**2 + (r[4]-x[4])**2) / 4), 6)"
    " AS mse FROM h4 GROUP BY y",
)
def e6(spark, sf):
    scored = reconstruction_error(_net_input(spark, sf), small_network())
    return scored.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mse"), 6).alias("mse"))


@query("e7_activations", _NET_SQL + "SELECT row_id, round(h[1], 6) AS a1, round(h[2], 6) AS a2, round(h[3], 6) AS a3 FROM h4")
def e7(spark, sf):
    hidden = activations(_net_input(spark, sf), small_network(), part="encoder")
    return hidden.select("row_id", *[F.round(F.col("activation")[i], 6).alias(f"a{i + 1}") for i in range(3)])


@query("e8_stored_weights", _NET_SQL + "SELECT y, round(avg(e[1]), 6) AS e1, round(avg(e[2]), 6) AS e2 FROM h4 GROUP BY y")
def e8(spark, sf):
    root = work_dir(spark, "weights")
    save_table(small_network().to_table(spark), root, "encoder")
    z = encode(_net_input(spark, sf), load_table(spark, root, "encoder"))
    return z.groupBy("y").agg(F.round(F.avg(F.col("z")[0]), 6).alias("e1"), F.round(F.avg(F.col("z")[1]), 6).alias("e2"))
