"""Candidate proximity from the curve summary, against the statistic computed anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.operators.curves import curve_summary, ks_with_batches
from flowgauge.operators.proximity import value_counts


def brute_ks(test, train):
    if not len(test) or not len(train):
        return 0.0
    test, train = np.sort(test), np.sort(train)
    at = np.concatenate([test, train])
    gap = np.searchsorted(test, at, side="right") / len(test) - np.searchsorted(train, at, side="right") / len(train)
    return float(max(0.0, gap.max()))


@pytest.mark.parametrize("fan", [3, 8, 512])
def test_batches_against_the_whole_statistic(spark, fan):
    """Clusters without a side, values below, between, above and equal to the fixed ones, many rows of one value."""
    rng = np.random.default_rng(fan)
    fixed = {}
    for pos in range(5):
        test = rng.integers(0, 60, size=0 if pos == 1 else 70) / 4
        train = rng.integers(5, 50, size=0 if pos == 2 else 50) / 4
        fixed[pos] = test, train
    fixed[3] = np.full(40, 7.0), rng.normal(7, 1, size=30)
    rows = [(p, float(v), s) for p, sides in fixed.items() for s, values in zip(("test", "train"), sides, strict=True) for v in values]
    batches = []
    for b in range(6):
        for pos in rng.choice(6, size=4, replace=False):  # cluster 5 has no fixed row at all
            values = rng.choice([-3.0, 99.0, 7.0, *rng.normal(8, 4, size=20), *(rng.integers(0, 60, size=20) / 4)], size=rng.integers(1, 30))
            batches += [(b, int(pos), float(v)) for v in values]
    base = curve_summary(value_counts(spark.createDataFrame(rows, "pos int, value double, side string"), "value", "side", ["pos"]), fan)
    assert (len(base.inner) > 2) == (fan == 3)
    added = spark.createDataFrame(batches, "batch int, pos int, value double").groupBy("batch", "pos", "value").agg(F.count("*").alias("n"))
    got = {(r.batch, r.pos): r.ks for r in ks_with_batches(base, added).collect()}
    want = {}
    for b, pos in {(b, p) for b, p, _ in batches}:
        extra = [v for x, p, v in batches if (x, p) == (b, pos)]
        test, train = fixed.get(pos, (np.empty(0), np.empty(0)))
        want[b, pos] = brute_ks(np.concatenate([test, extra]), train)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    base.release()
