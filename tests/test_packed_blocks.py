"""Steps on packed blocks, draws made once a row, and plans that do not grow with what was done before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.functions import blocks, ordering
from flowgauge.operators.lloyd import kmeans_many
from flowgauge.operators.mlp import Arm, fit_encoders
from flowgauge.operators.sampling import sample_pairs
from flowgauge.plans import generate


def jobs_of(spark, name, run):
    """How many jobs ``run`` takes."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    run()
    context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(name))


def test_blocks_hold_the_rows(spark, monkeypatch):
    rows = [(i % 3, -1 if i % 2 else 1, [float(i), i / 7], None if i % 2 else [float(-i)]) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, kind int, x array<double>, x2 array<double>").repartition(3)
    got = []
    found = blocks.packed(df, ["g", "kind"], ["x", "x2"]).collect()
    for r in found:
        x, x2 = blocks.matrix(r, "x"), blocks.matrix(r, "x2")
        assert len(x) == r.n and (len(x2) == r.n if r.kind == 1 else r.x2 is None and not len(x2))
        got += [(r.g, r.kind, x[i].tolist(), x2[i].tolist() if len(x2) else None) for i in range(r.n)]
    assert sorted(got, key=lambda r: r[2]) == sorted(rows, key=lambda r: r[2])
    assert blocks.packed(df.filter("g > 9"), ["g"], ["x"]).count() == 0


@pytest.mark.parametrize("direct", [0, 1 << 18])
def test_sums_by_name(spark, monkeypatch, direct):
    monkeypatch.setattr(blocks, "DIRECT_NUMBERS", direct)
    df = spark.range(0, 90, 1, 3).select((F.col("id") % 4).cast("int").alias("g"), F.array(F.col("id").cast("double")).alias("x"))
    rows = blocks.packed(df, ["g"], ["x"]).rdd
    got = blocks.added_up(rows, lambda some: ((r.g, blocks.matrix(r, "x").sum(axis=0)) for r in some), 4, 4)
    assert {g: v.tolist() for g, v in got.items()} == {g: [float(sum(range(g, 90, 4)))] for g in range(4)}


def test_a_training_step_is_one_job(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(f"r{i}", i % 2, rng.normal(size=3).tolist()) for i in range(60)],
                                 "row_id string, y int, features array<double>").persist()
    rows.count()
    few, many = (jobs_of(spark, f"epochs-{n}", lambda n=n: fit_encoders(rows, {"": Arm(hidden=(4,), latent=2)}, epochs=n, batches=2))
                 for n in (1, 4))
    assert many - few == 3 * 2


def test_a_pass_of_kmeans_is_one_job(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(f"r{i}", rng.normal(size=2).tolist()) for i in range(400)], "row_id string, z array<double>").persist()
    rows.count()
    few, many = (jobs_of(spark, f"passes-{n}", lambda n=n: kmeans_many(rows, [7], 1, tol=-1.0, max_iter=n)) for n in (2, 7))
    assert many - few == 5


def test_draws_of_pairs_are_made_once(spark):
    """Conditions of the joins repeat no hashes."""
    rows = spark.range(200).selectExpr("cast(id as string) row_id", "cast(id % 3 as int) y")
    pairs = sample_pairs(rows, requests=rows.selectExpr("row_id pair_id"))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("md5(") for line in plan.splitlines()) == 7


def test_many_buckets_take_one_pass(spark):
    df = spark.range(6000).select(F.col("id").cast("double").alias("v")).persist()
    df.count()
    few, many = (jobs_of(spark, f"bounds-{n}", lambda n=n: ordering.value_bounds(df, F.col("v"), n)) for n in (600, 15))
    assert few == many
    bounds = ordering.value_bounds(df, F.col("v"), 15)
    assert 380 <= len(bounds) <= 400 and max(np.diff([0, *bounds, 6000])) <= 45


def test_classifiers_do_not_plan_the_batches_again(spark, monkeypatch):
    base = spark.range(40).select((F.col("id") % 4).alias("batch"), F.lit(1).alias("y"), F.array(F.rand(1)).alias("features"))
    settings = spark.createDataFrame([(i, i / 2) for i in range(4)], "batch long, config double")
    seen = []

    def retrained(bench, batches, chosen, kinds, seed):
        seen.append(batches._jdf.queryExecution().optimizedPlan().toString())
        return spark.createDataFrame([(b, "m", 0.5) for b in chosen], "batch long, model string, accuracy double")

    class Bench:
        base = None

    monkeypatch.setattr(generate, "generate", lambda bench, some, *_: base.join(some.select("batch"), "batch"))
    monkeypatch.setattr(generate, "score_candidates", lambda *_: None)
    monkeypatch.setattr(generate, "best_batches", lambda _: spark.createDataFrame(
        [("a", 1, 0.5), ("b", 3, 0.7)], "reward_config string, batch long, reward double"))
    monkeypatch.setattr(generate, "candidate_scores", lambda _, some: some.groupBy("batch").agg(F.count("*").alias("n")))
    monkeypatch.setattr(generate, "_retrained", retrained)
    got = generate.transfer_comparison(Bench(), Bench(), settings).collect()
    assert sorted((r.reward_config, r.batch, r.n, r.accuracy) for r in got) == [("a", 1, 10, 0.5), ("b", 3, 10, 0.5)]
    (plan,) = seen
    assert "Join" not in plan
