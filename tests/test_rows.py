"""Sources, cleaning, sampling, ranks and other scores."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowgauge.functions import ordering
from flowgauge.functions.hashing import hash_hex
from flowgauge.functions.ordering import hash_cutoffs, hash_rank, ranked, running_sum
from flowgauge.functions.special import correlation_p_value
from flowgauge.operators.clean import CleaningError, apply_labels, apply_scaler, fit_labels, fit_scaler, numeric_features
from flowgauge.operators.episodes import next_rows
from flowgauge.operators.mlp import Network, fit_encoder, gradient
from flowgauge.operators.sampling import SplitError, sample_n, sample_pairs, stratified_folds, stratified_split
from flowgauge.operators.scores import correlations, metrics_from_confusion, reward_value
from flowgauge.sources.artifacts import MissingArtifacts, require_tables
from flowgauge.sources.readers import SourceError, as_flows, read_csv_directory
from flowgauge.sources.registry import Registry


@pytest.fixture(scope="module")
def skewed(spark):
    """One class and one value hold most rows."""
    i = F.col("id")
    return spark.range(20_000).select(
        i.alias("row_id"), F.when(i % 20 == 0, (i % 3).cast("int")).otherwise(9).alias("y"),
        F.when(i % 3 != 0, 7.0).otherwise((i % 501).cast("double")).alias("v"),
    )


def test_source_errors(spark, tmp_path):
    with pytest.raises(SourceError):
        read_csv_directory(spark, str(tmp_path / "absent"))
    with pytest.raises(SourceError):
        Registry().load(spark, "no-such-set")
    df = spark.createDataFrame([("a", "b")], "label string, t string")
    with pytest.raises(SourceError):
        as_flows(df, "Label")
    with pytest.raises(CleaningError):
        numeric_features(df, "label")
    with pytest.raises(MissingArtifacts, match="clusters, scaler"):
        require_tables(spark, str(tmp_path), ["clusters", "scaler"])


def test_csv_columns_match_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,label\n1,2,u\n")
    (tmp_path / "b.csv").write_text("label,y,x\nv,20,10\n")
    rows = {r.label: (r.x, r.y) for r in as_flows(read_csv_directory(spark, str(tmp_path)), "label").collect()}
    assert rows == {"u": (1.0, 2.0), "v": (10.0, 20.0)}


def test_labels_and_scalers(spark):
    train = spark.createDataFrame([("b", 1.0, 5.0), ("a", 3.0, 5.0)], "label string, x double, k double")
    labels = fit_labels(train)
    assert {r.label: r.y for r in labels.collect()} == {"a": 0, "b": 1}
    with pytest.raises(Exception, match="unseen label"):
        apply_labels(train.withColumn("label", F.lit("zz")), labels).collect()
    for kind, expected in (("standard", [-1.0, 1.0]), ("minmax", [0.0, 1.0])):
        out = apply_scaler(train, fit_scaler(train, ["x", "k"], kind), ["x", "k"]).orderBy("x").collect()
        assert [r.x for r in out] == expected and [r.k for r in out] == [0.0, 0.0]


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_split_is_exact_and_partition_free(spark, skewed, partitions):
    out = stratified_split(skewed.repartition(partitions), {"train": 0.6, "val": 0.2, "test": 0.2}, [42, 43])
    w = W.partitionBy("seed", "y").orderBy("h")
    check = out.withColumn("h", hash_hex(F.col("seed"), F.col("row_id"))).withColumns({
        "rk": F.row_number().over(w), "n": F.count(F.lit(1)).over(W.partitionBy("seed", "y")),
    })
    expected = F.when(F.col("rk") <= F.floor(F.col("n") * 0.6 + 1e-9), "train").when(
        F.col("rk") <= F.floor(F.col("n") * 0.8 + 1e-9), "val"
    ).otherwise("test")
    assert check.count() == 40_000 and check.filter(F.col("split") != expected).count() == 0


def test_split_guards(skewed):
    with pytest.raises(SplitError):
        stratified_split(skewed, {"train": 0.5, "test": 0.2})
    only = stratified_split(skewed, {"train": 0.75, "val": 0.0, "test": 0.25})
    assert {r.split for r in only.select("split").distinct().collect()} == {"train", "test"}


def test_split_reads_but_never_shuffles_the_table(skewed):
    out = stratified_split(skewed, {"train": 0.6, "val": 0.2, "test": 0.2})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_distributed_orders_equal_windows(spark, skewed):
    plain = skewed.withColumn("h", hash_hex(0, F.col("row_id"))).withColumn(
        "want", F.row_number().over(W.partitionBy("y").orderBy(F.desc("v"), "h"))
    )
    got = ranked(skewed, ["y"], "v", "row_id", rows_per_bucket=500)
    assert plain.join(got, "row_id").filter("want <> rank").count() == 0
    counts = skewed.groupBy("y", "v").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("y").orderBy("v")
    run = running_sum(counts, ["y"], "v", {"s": "n"}, rows_per_bucket=40)
    assert run.withColumn("want", F.sum("n").over(w)).filter("want <> s").count() == 0
    hashed = skewed.withColumn("h", hash_hex(1, F.col("row_id")))
    by_hash = hash_rank(hashed, ["y"], "h", "r").withColumn("want", F.row_number().over(W.partitionBy("y").orderBy("h")))
    assert by_hash.filter("want <> r").count() == 0


def test_samples_and_folds(skewed):
    assert sample_n(skewed, 777).count() == 777
    assert sample_n(skewed, 10**9).count() == 20_000
    sizes = stratified_folds(skewed, 5).groupBy("y", "fold").count().groupBy("y").agg(
        (F.max("count") - F.min("count")).alias("gap")
    )
    assert sizes.filter("gap > 1").count() == 0


def test_pairs(spark):
    one = spark.createDataFrame([(i, 0) for i in range(5)], "row_id int, y int")
    rows = sample_pairs(one, 50).collect()
    assert len(rows) == 50 and all(r.different == 0 and r.row_i != r.row_j for r in rows)
    mixed = spark.createDataFrame([(0, 0)] + [(i, 1) for i in range(1, 9)], "row_id int, y int")
    y = {0: 0, **{i: 1 for i in range(1, 9)}}
    rows = sample_pairs(mixed, 200).collect()
    assert len(rows) == 200
    assert all((y[r.row_i] != y[r.row_j]) == bool(r.different) for r in rows)
    assert any(r.row_i == 0 and r.row_j == 0 for r in rows)


def test_next_row_stays_at_terminal(spark):
    df = spark.createDataFrame(
        [(0, 0, 1.0, False), (0, 1, 2.0, True), (1, 0, 5.0, False)], "episode int, step int, obs double, terminal boolean"
    )
    got = {(r.episode, r.step): r.next_obs for r in next_rows(df).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 2.0, (1, 0): 5.0}


def test_scores(spark):
    counts = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 2), (2, 0, 2)], "y int, pred int, n bigint")
    m = metrics_from_confusion(counts).first()
    assert m.accuracy == pytest.approx(5 / 8)
    assert m.precision == pytest.approx((3 / 5 + 2 / 3 + 0) / 3) and m.recall == pytest.approx((3 / 4 + 1 + 0) / 3)
    row = spark.createDataFrame([(0.1, 0.2, 0.4)], "diversity double, proximity double, scarcity double")
    assert row.select(reward_value({"diversity": 2.0}).alias("r")).first().r == pytest.approx(0.8)
    x = [1.0, 2.0, 2.0, 3.0, 5.0, 8.0]
    y = [2.0, 1.0, 4.0, 4.0, 7.0, 6.0]
    df = spark.createDataFrame(list(zip(x, y, strict=True)), "x double, y double")
    got = correlations(df, "x", "y").first()
    def rk(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    assert got.pearson_r == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert got.spearman_r == pytest.approx(np.corrcoef(rk(x), rk(y))[0, 1])
    assert got.pearson_p == pytest.approx(0.0676729, abs=1e-6)
    assert correlations(df.limit(2), "x", "y").first().pearson_r is None


def test_p_values_against_numeric_integration():
    # Tail of Student's t by a fine trapezoid, independent of the beta function.
    for r, n in ((0.5, 10), (-0.3, 25), (0.9, 5)):
        df = n - 2
        t = abs(r) * np.sqrt(df / (1 - r * r))
        grid = np.linspace(0, t, 200_001)
        dens = (1 + grid**2 / df) ** (-(df + 1) / 2)
        from math import gamma, pi, sqrt

        const = gamma((df + 1) / 2) / (sqrt(df * pi) * gamma(df / 2))
        assert correlation_p_value(r, n) == pytest.approx(1 - 2 * const * np.trapezoid(dens, grid), abs=1e-8)


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    net = Network.autoencoder(4, [3], 2, 1)
    x, a, b = rng.normal(size=(5, 4)), rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    diff = np.array([0, 1, 0, 1, 1, 0])
    g, *_ = gradient(net, x, a, b, diff, 2.0, 0.5)
    theta = net.flat()
    shape_e = sum(w.weight.size + w.bias.size for w in net.parts["encoder"])
    full = g[: theta.size].copy()
    full[:shape_e] += g[theta.size :]

    def loss(t):
        _, r, p = gradient(net.with_flat(t), x, a, b, diff, 2.0, 0.5)
        return r + 0.5 * p

    for i in range(0, theta.size, 5):
        e = np.zeros_like(theta)
        e[i] = 1e-6
        assert full[i] == pytest.approx((loss(theta + e) - loss(theta - e)) / 2e-6, abs=1e-4)


def test_encoder_training_lowers_the_loss(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, (rng.normal(size=4) + 3 * (i % 2)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, y int, features array<double>")
    _, history = fit_encoder(df, [8], 2, epochs=4, batches=1, lr=0.02)
    assert history[-1]["loss"] < history[0]["loss"]


@pytest.mark.parametrize("rows_per_cell", [4, 1_000_000])
def test_ranks_and_cuts_by_as_many_digits_as_it_takes(spark, rows_per_cell):
    """Hashes that share their first digits, and one that many rows share."""
    rows = [(k % 2, f"abc{k:04x}{k * 7919 % 65536:04x}") for k in range(600)] + [(0, "abc00000000f")] * 30
    df = spark.createDataFrame(rows, "key int, h string")
    found = hash_rank(df, ["key"], "h", "rank", rows_per_cell=rows_per_cell).collect()
    for key in (0, 1):
        mine = sorted(h for k, h in rows if k == key)
        assert [r.h for r in sorted((r for r in found if r.key == key), key=lambda r: r["rank"])] == mine
        assert sorted(r["rank"] for r in found if r.key == key) == list(range(1, len(mine) + 1))
    cuts = hash_cutoffs(df, ["key"], "h", {"a": F.floor(F.col("_n") * 0.3), "b": F.floor(F.col("_n") * 0.8), "none": F.lit(0)},
                        rows_per_cell=rows_per_cell)
    for r in cuts.collect():
        mine = sorted(h for k, h in rows if k == r.key)
        assert (r["_n"], r.a, r.b, r.none) == (len(mine), mine[int(len(mine) * 0.3) - 1], mine[int(len(mine) * 0.8) - 1], "")


def test_bounds_are_cut_again_where_one_pass_is_too_coarse(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MAX_BUCKETS", 4)
    df = spark.range(5000).select(F.lit(0).alias("k"), (F.col("id") * F.col("id") % 4999).cast("double").alias("v"))
    distinct = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {r.v: r.upto for r in ordering.running_sum(distinct, ["k"], "v", {"upto": "n"}, rows_per_bucket=50).collect()}
    total = 0
    for r in sorted(distinct.collect(), key=lambda r: r.v):
        total += r.n
        assert got[r.v] == total
