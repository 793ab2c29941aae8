"""Networks trained side by side are those trained one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.operators.mlp import Arm, encode, encode_many, fit_encoder, fit_encoders, training_batches
from flowgauge.operators.sampling import sample_pairs
from flowgauge.plans.sweeps import compare_encoders, encoder_means


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    data = [(seed, f"r{i}", i % 3, [float(v) for v in rng.normal(i % 3, 1, size=6)]) for seed in (42, 43) for i in range(90 + seed)]
    return spark.createDataFrame(data, "seed int, row_id string, y int, features array<double>").persist()


def test_side_by_side_is_one_by_one(rows):
    arms = {"a": Arm(lam=0.2, hidden=(5,), latent=2), "b": Arm(lam=0.0, lr=1e-2, weight_decay=1e-3, hidden=(4, 3), latent=3)}
    fits = fit_encoders(rows, arms, "seed", epochs=3, batches=2)
    assert set(fits) == {(s, a) for s in (42, 43) for a in "ab"}
    for (seed, name), (net, history) in fits.items():
        arm = arms[name]
        alone, told = fit_encoder(rows.filter(F.col("seed") == seed), list(arm.hidden), arm.latent, 3, 2, arm.lr, arm.margin, arm.lam,
                                  seed, arm.weight_decay)
        assert np.allclose(net.flat(), alone.flat(), atol=1e-9)
        assert [h["loss"] for h in history] == pytest.approx([h["loss"] for h in told])
    assert fits[42, "b"][1][-1]["reconstruction"] < fits[42, "b"][1][0]["reconstruction"]
    nets = {s: fits[s, "a"][0] for s in (42, 43)}
    found = {(r.seed, r.row_id): r.z for r in encode_many(rows, nets, "seed").collect()}
    for s, net in nets.items():
        for r in encode(rows.filter(F.col("seed") == s), net).collect():
            assert found[s, r.row_id] == pytest.approx(r.z)


def test_encoders_over_seeds(spark):
    rng = np.random.default_rng(3)
    data = [(i, i % 3, *(float(v) for v in rng.normal(3 * (i % 3), 1, size=4))) for i in range(200)]
    df = spark.createDataFrame(data, "row_id long, y int, a double, b double, c double, d double")
    scores = compare_encoders(df, ["a", "b", "c", "d"], [1, 2, 3], [2, 3, 4], 2, arm=Arm(hidden=(4,), latent=2), m=32, epochs=2,
                              batches=2).persist()
    got = scores.collect()
    assert sorted((r.seed, r.encoder) for r in got) == [(s, e) for s in (1, 2, 3) for e in ("contrastive", "plain")]
    assert all(0 <= r[c] <= 1 for r in got for c in ("diversity", "proximity", "scarcity", "km_accuracy"))
    means = {r.encoder: r for r in encoder_means(scores).collect()}
    for e, r in means.items():
        mine = [x.proximity for x in got if x.encoder == e]
        assert r.proximity_mean == pytest.approx(np.mean(mine)) and r.proximity_std == pytest.approx(np.std(mine)) and r.n == 3


def test_pairs_of_all_sets_are_those_of_each(spark):
    rows = spark.createDataFrame([(f"r{i}", i % 2 + 42, i % (2 + i % 2), [float(i)]) for i in range(400)],
                                 "row_id string, seed int, y int, features array<double>")
    asks = spark.range(100).selectExpr("cast(id as string) pair_id").crossJoin(rows.select("seed").distinct())
    found = sample_pairs(rows, requests=asks, group="seed", n_groups=2)
    for s in (42, 43):
        alone = sample_pairs(rows.filter(F.col("seed") == s), seed=s, requests=asks.filter(F.col("seed") == s).select("pair_id"))
        assert sorted(found.filter(F.col("seed") == s).drop("seed").collect()) == sorted(alone.collect())
    table = training_batches(rows, 3, 1, "y", "row_id", "features", "seed", [42, 43])
    for s in (42, 43):
        alone = training_batches(rows.filter(F.col("seed") == s), 3, s, "y", "row_id", "features").withColumn("set", F.lit(s))
        assert sorted(map(repr, table.filter(F.col("set") == s).collect())) == sorted(map(repr, alone.select(*table.columns).collect()))
