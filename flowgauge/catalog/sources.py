"""Readers, sinks, cleaning."""

from pyspark.sql import functions as F

from ..functions.bounded import work_dir
from ..functions.hashing import hash_unit
from ..operators.clean import (
    clean, clean_report, drop_invalid, drop_non_features, filter_labels, first_per_group, numeric_features, profile,
    deduplicate,
)
from ..operators.perturb import SETTINGS, map_actions
from ..sources.artifacts import load_splits, load_table, require_tables, save_csv, save_json, save_splits, save_table
from ..sources.artifacts import MissingArtifacts
from ..sources.readers import as_flows, read_csv_directory, read_csv_file, read_positional
from ..sources.registry import DatasetSpec, Registry
from . import query
from .views import (
    CLUSTERS_SQL, CODED_SQL, DIRTY_SQL, EPISODES_SQL, FEATURES, FLOW_LATENT_SQL, FLOWS_SQL, SPLIT_SQL, cell_model,
    coded_flows, dirty_flows, episodes, flow_latent, flows, latent, rounded, split_flows, table,
)

FLOW_COLS = ", ".join(FEATURES)


@query("s1_csv_directory", FLOWS_SQL + f"SELECT {FLOW_COLS}, label FROM flows")
def s1(spark, sf):
    # Two exports of the same flows whose columns are in different order.
    path = work_dir(spark, "csv")
    rows = flows(spark, sf).drop("row_id")
    rows.filter("label < 'N'").write.csv(f"{path}/part=a", header=True)
    rows.filter("label >= 'N'").select("label", *reversed(FEATURES)).write.csv(f"{path}/part=b", header=True)
    return as_flows(read_csv_directory(spark, path).drop("part"), "label")


@query("s2_csv_file", FLOWS_SQL + f"SELECT row_id, {FLOW_COLS}, label FROM flows")
def s2(spark, sf):
    path = work_dir(spark, "csv-file")
    rows = flows(spark, sf)
    rows.write.csv(path, header=False)
    return read_csv_file(spark, path, header=False, names=rows.columns)


@query(
    "s3_positional_csv",
    FLOWS_SQL + "SELECT label, count(*) AS n, round(sum(quantity), 6) AS f0, round(sum(quantity + 40), 6) AS f40,"
    " 42::BIGINT AS n_columns FROM flows GROUP BY label",
)
def s3(spark, sf):
    path = work_dir(spark, "positional")
    flows(spark, sf).select(
        *[F.col("quantity") + i for i in range(41)], "label", F.lit(21)
    ).write.csv(path, header=False)
    df = read_positional(spark, path)
    return df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("f0"), 6).alias("f0"), F.round(F.sum("f40"), 6).alias("f40"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
    )


@query(
    "s4_registry_load",
    "SELECT l_orderkey::DOUBLE AS l_orderkey, l_quantity, l_extendedprice, l_returnflag AS label,"
    " (dense_rank() OVER (ORDER BY l_returnflag) - 1)::INT AS y FROM lineitem",
)
def s4(spark, sf):
    registry = Registry()
    registry.register(DatasetSpec("Lines", "parquet", "l_returnflag", path=f"{sf}/lineitem.parquet"))
    return registry.load(spark, " lines ").select("l_orderkey", "l_quantity", "l_extendedprice", "label", "y")


@query(
    "s5_split_store",
    SPLIT_SQL + "SELECT 42 AS seed, side AS split, label, count(*) AS n, round(sum(extendedprice), 2) AS price"
    " FROM split_flows WHERE side <> 'val' GROUP BY side, label",
)
def s5(spark, sf):
    path = work_dir(spark, "splits")
    save_splits(split_flows(spark, sf), path)
    return (
        load_splits(spark, path, seed=42).filter("split <> 'val'").groupBy("seed", "split", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("extendedprice"), 2).alias("price"))
    )


@query(
    "s6_scaled_split_store",
    FLOW_LATENT_SQL + "SELECT side, y, count(*) AS n, round(avg(z[1]), 6) AS z1, round(avg(z[4]), 6) AS z4"
    " FROM latent GROUP BY side, y",
)
def s6(spark, sf):
    root = work_dir(spark, "scaled")
    save_table(flow_latent(spark, sf), root, "flows_scaled")
    stored = load_table(spark, root, "flows_scaled")
    return stored.groupBy("side", "y").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("z")[0]), 6).alias("z1"), F.round(F.avg(F.col("z")[3]), 6).alias("z4")
    )


@query(
    "s7_cluster_store",
    CLUSTERS_SQL + "SELECT cluster_id, majority_y, n_train, round(centroid[1], 6) AS c1, round(centroid[64], 6) AS c64 FROM clusters",
)
def s7(spark, sf):
    root = work_dir(spark, "clusters")
    model, _ = cell_model(latent(spark, sf))
    save_table(model.table(spark), root, "clusters")
    return load_table(spark, root, "clusters").select(
        "cluster_id", "majority_y", "n_train", F.round(F.col("centroid")[0], 6).alias("c1"),
        F.round(F.col("centroid")[63], 6).alias("c64"),
    )


@query("s8_result_sinks", FLOWS_SQL + "SELECT label, count(*) AS n, round(avg(tax), 6) AS mean_tax, s AS sink"
       " FROM flows, (VALUES ('csv'), ('json')) t(s) GROUP BY label, s")
def s8(spark, sf):
    root = work_dir(spark, "results")
    scores = rounded(
        flows(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("tax").alias("mean_tax")), "mean_tax"
    )
    save_json(scores, f"{root}/json")
    save_csv(scores, f"{root}/csv")
    schema = "label string, n bigint, mean_tax double"
    return spark.read.schema(schema).json(f"{root}/json").withColumn("sink", F.lit("json")).unionByName(
        spark.read.schema(schema).csv(f"{root}/csv", header=True).withColumn("sink", F.lit("csv"))
    )


@query("s9_transition_store", EPISODES_SQL + "SELECT episode, count(*) AS n, round(sum(reward), 4) AS total,"
       " count(*) FILTER (terminal) AS n_terminal FROM episodes GROUP BY episode")
def s9(spark, sf):
    root = work_dir(spark, "transitions")
    save_table(episodes(spark, sf), root, "transitions")
    return load_table(spark, root, "transitions").groupBy("episode").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("reward"), 4).alias("total"), F.count_if("terminal").alias("n_terminal")
    )


@query(
    "s10_artifact_check",
    "SELECT 'clusters, weights' AS missing, count(*) AS n_orders FROM orders",
)
def s10(spark, sf):
    root = work_dir(spark, "artifacts")
    save_table(table(spark, sf, "orders"), root, "orders")
    try:
        require_tables(spark, root, ["orders", "clusters", "weights"])
        missing = ""
    except MissingArtifacts as err:
        missing = str(err).split(": ")[-1]
    return load_table(spark, root, "orders").agg(F.count(F.lit(1)).alias("n_orders")).withColumn("missing", F.lit(missing))


@query("p1_drop_invalid", DIRTY_SQL + "SELECT row_id, quantity, discount, tax, label FROM valid")
def p1(spark, sf):
    return drop_invalid(dirty_flows(spark, sf)).select("row_id", "quantity", "discount", "tax", "label")


@query(
    "p2_numeric_columns",
    DIRTY_SQL + "SELECT 'constant,discount,extendedprice,quantity,tax' AS features, count(*) AS n FROM dirty",
)
def p2(spark, sf):
    rows = dirty_flows(spark, sf)
    names = numeric_features(rows, "label", ["row_id"])
    return rows.select(*names).agg(F.count(F.lit(1)).alias("n")).withColumn("features", F.lit(",".join(sorted(names))))


@query(
    "p3_deduplicate",
    DIRTY_SQL + f"SELECT min(row_id) AS row_id, {FLOW_COLS}, label FROM valid GROUP BY {FLOW_COLS}, label",
)
def p3(spark, sf):
    rows = drop_invalid(dirty_flows(spark, sf)).select("row_id", *FEATURES, "label")
    return deduplicate(rows, [*FEATURES, "label"])


@query(
    "p4_clean_report",
    DIRTY_SQL + f"""SELECT *, rows_before - rows_after AS rows_dropped FROM (SELECT (SELECT count(*) FROM dirty) AS rows_before,
  (SELECT count(*) FROM dirty WHERE isnan(quantity) OR discount IS NULL) AS rows_missing,
  (SELECT count(*) FROM dirty WHERE isinf(tax) AND NOT (isnan(quantity) OR discount IS NULL)) AS rows_infinite,
  (SELECT count(*) FROM valid) AS rows_valid,
  (SELECT count(*) FROM (SELECT DISTINCT {FLOW_COLS}, label FROM valid)) AS rows_after)""",
)
def p4(spark, sf):
    return clean_report(dirty_flows(spark, sf), FEATURES)


@query("p5_drop_non_features", FLOWS_SQL + "SELECT quantity, tax FROM flows")
def p5(spark, sf):
    export = flows(spark, sf).select(
        F.col("row_id").alias("Flow ID"), F.lit("10.0.0.1").alias("Src IP"), F.lit("10.0.0.2").alias("Dst IP"),
        F.lit(0).alias("Timestamp"), "quantity", "tax", F.col("label").alias("Label"),
    )
    return drop_non_features(export)


@query(
    "p6_first_per_capture",
    "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value"
    " FROM events GROUP BY user_id",
)
def p6(spark, sf):
    return first_per_group(
        table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"]
    ).select("user_id", "event_id", "value")


@query(
    "p7_filter_labels",
    CODED_SQL + ", s(subset_id, y) AS (VALUES (0, 0), (0, 2), (1, 1), (1, 2), (1, 3))"
    " SELECT subset_id, c.y, count(*) AS n, round(sum(quantity), 6) AS quantity FROM coded c JOIN s USING (y) GROUP BY ALL",
)
def p7(spark, sf):
    subsets = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 2), (1, 3)], "subset_id int, y int")
    return filter_labels(coded_flows(spark, sf), subsets).groupBy("subset_id", "y").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 6).alias("quantity")
    )


@query(
    "p8_profile",
    FLOWS_SQL + "SELECT count(*) AS n_samples, 4::BIGINT AS n_features, count(DISTINCT label) AS n_classes FROM flows",
)
def p8(spark, sf):
    return profile(flows(spark, sf), FEATURES)


def _action(part):
    """Seven draws per order in about [-0.1, 1.1], so clipping shows."""
    return F.array(*[hash_unit("a", F.col("o_orderkey"), i) * 1.2 - 0.1 for i in range(len(SETTINGS))])


def _draw_sql(i):
    return f"(((('0x' || substr(md5('a:' || o_orderkey || ':{i}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0) * 1.2 - 0.1)"


_RANGES = [(0.05, 0.10), (4, 10), (10, 40), (0.001, 0.05), (0.001, 0.10), (0.001, 0.50), (0.5, 1.0)]
_CLIPS = [(10, 5, 10), (10, 4, 10), (40, 10, 40), (5, 0.1, 5), (10, 0.1, 10), (50, 0.1, 50), (100, 50, 100)]


def _unit(i):
    return f"least(greatest({_draw_sql(i)}, 0), 1)"


_LINEAR_SQL = ", ".join(
    f"round({lo} + {_unit(i)} * ({hi} - {lo}), 6)::DOUBLE AS {n}" for i, (n, (lo, hi)) in enumerate(zip(SETTINGS, _RANGES, strict=True))
)
_CLIP_SQL = ", ".join(
    f"round(least(greatest({_unit(i)} * {f}, {lo}), {hi}), 6)::DOUBLE AS {n}"
    for i, (n, (f, lo, hi)) in enumerate(zip(SETTINGS, _CLIPS, strict=True))
)


def _mapped(spark, sf, mode):
    orders = table(spark, sf, "orders").select("o_orderkey", _action("o_orderkey").alias("action"))
    return rounded(map_actions(orders, mode).select("o_orderkey", "config.*"), *SETTINGS)


@query("p9_map_actions_linear", f"SELECT o_orderkey, {_LINEAR_SQL} FROM orders")
def p9(spark, sf):
    return _mapped(spark, sf, "linear")


@query("p10_map_actions_clip", f"SELECT o_orderkey, {_CLIP_SQL} FROM orders")
def p10(spark, sf):
    return _mapped(spark, sf, "clip")


@query("u1_union_by_name", FLOWS_SQL + "SELECT row_id, quantity, tax FROM flows")
def u1(spark, sf):
    rows = flows(spark, sf)
    a = rows.filter("label < 'N'").select("row_id", "quantity", "tax")
    return a.unionByName(rows.filter("label >= 'N'").select("tax", "row_id", "quantity"))


@query("e4_clean_rows", DIRTY_SQL + f"SELECT label, count(*) AS n FROM (SELECT DISTINCT {FLOW_COLS}, label FROM valid) GROUP BY label")
def e4_clean(spark, sf):
    return clean(dirty_flows(spark, sf), FEATURES, dedup=True).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
