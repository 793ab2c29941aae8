"""Generated batches: what is scored and chosen is what a whole assessment of test set plus batch says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.operators.mlp import encode
from flowgauge.operators.scores import REWARD_WEIGHTS
from flowgauge.plans.assess import assess
from flowgauge.plans.augment import score_candidates
from flowgauge.plans.generate import generate, generated_comparison, prepare, random_settings, transfer_comparison

NAMES = ["a", "b", "c"]
FOREST = {"random_forest": {"n_estimators": 3, "max_depth": 4}}


def _bench(spark, seed, shift):
    rng = np.random.default_rng(seed)
    data = [(i, i % 3, *(float(v) for v in np.abs(rng.normal(shift * (i % 3) + 2, 1, size=3)))) for i in range(240)]
    df = spark.createDataFrame(data, "row_id long, y int, a double, b double, c double")
    return prepare(df, NAMES, ks=[3, 4], restarts=2, m=32, hidden=[4], latent=2, epochs=2, batches=1)


def test_generated_and_transferred(spark):
    a, b = _bench(spark, 1, 3.0), _bench(spark, 2, 2.0)
    settings = random_settings(spark, 5).persist()
    rows = generate(a, settings, 20).persist()
    assert {r["batch"]: r["count"] for r in rows.groupBy("batch").count().collect()} == dict.fromkeys(range(5), 20)
    assert rows.count() == generate(a, settings, 20).intersect(rows).count()  # draws are repeatable
    latent = encode(a.scaled, a.net).filter(F.col("side") != "val").select("y", "side", "z")
    want = {}
    for k in range(5):
        more = rows.filter(F.col("batch") == k).select("y", F.lit("test").alias("side"), "z")
        got = assess(latent.unionByName(more), a.clusters, m=32).global_scores.first()
        for name, (d, p, s) in REWARD_WEIGHTS.items():
            want[k, name] = d * got.diversity + p * got.proximity + s * got.scarcity
    scored = {(r.batch, r.reward_config): r.reward for r in score_candidates(a.base, rows).collect()}
    assert scored == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    best = {n: max(range(5), key=lambda k: (round(want[k, n], 9), -k)) for n in REWARD_WEIGHTS}

    found = generated_comparison(a, settings, draws=20, kinds=FOREST).collect()
    assert {r.reward_config: r.batch for r in found} == best and all(0 <= r.f1 <= 1 for r in found)

    moved = transfer_comparison(a, b, settings, draws=20, kinds=FOREST).collect()
    assert {r.reward_config: r.batch for r in moved} == best
    for r in moved:
        assert r.reward_a == pytest.approx(want[r.batch, r.reward_config], abs=1e-9) and 0 <= r.f1 <= 1
    assert len({(r.batch, r.f1) for r in moved}) == len(set(best.values()))
    a.release()
    b.release()
