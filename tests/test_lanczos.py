"""Diversity by Lanczos quadrature against the eigenvalues of the whole kernel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.operators.diversity import diversity
from flowgauge.functions.bounded import written
from flowgauge.operators import lanczos
from flowgauge.operators.lanczos import entropy_rule, vendi_lanczos


def test_rule_of_a_full_space():
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0.2, 0.4, size=6), rng.uniform(0.01, 0.1, size=5)
    t = np.diag(a) + np.diag(b, 1) + np.diag(b, -1)
    values, vectors = np.linalg.eigh(t)
    want = (vectors @ np.diag(-values * np.log(values)) @ vectors.T)[0, 0]
    assert entropy_rule(a, b) == pytest.approx(want)


@pytest.mark.parametrize("normalize", [True, False])
def test_within_its_bound(spark, normalize):
    rng = np.random.default_rng(3)
    rows = []
    for key, n in ((1, 1), (2, 2), (3, 12), (4, 90), (5, 700)):
        centres = rng.normal(0, 2, size=(4, 3))
        rows += [(key, [float(v) for v in centres[i % 4] + rng.normal(0, 0.4, size=3)]) for i in range(n)]
    rows += [(3, rows[5][1])] * 40 + [(None, [0.0, 0.0, 0.0])] * 3
    df = spark.createDataFrame(rows, "key int, z array<double>")
    distinct = df.groupBy("key", "z").agg(F.count("*").alias("weight"))
    exact = {r.key: r for r in diversity(df, ["key"], 0.5, normalize, "exact").collect()}
    got = {r.key: r for r in vendi_lanczos(distinct, ["key"], 0.5, normalize, block_rows=128).collect()}
    assert got.keys() == exact.keys()
    for key, r in got.items():
        assert r.n == exact[key].n
        assert abs(r.diversity - exact[key].diversity) <= r.error + 1e-9
        # the bound says something: a few per cent of the score
        assert r.error <= 0.15 * max(1.0 if not normalize else 0.0, exact[key].diversity) + 1e-6
    assert got[1].error == 0 and got[2].error < 1e-6


def test_no_points(spark):
    empty = spark.createDataFrame([], "key int, z array<double>, weight long")
    assert vendi_lanczos(empty, ["key"]).count() == 0


def test_vectors_are_not_broadcast(spark, monkeypatch):
    """What grows with the points goes from executor to executor, not through the driver."""
    steps = []

    def kept(df, name):
        if name == "lanczos-step":
            steps.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(lanczos, "written", kept)
    points = np.random.default_rng(5).normal(size=(120, 3))
    df = spark.createDataFrame([(0, p.tolist(), 1) for p in points], "k int, z array<double>, weight long")
    lanczos.vendi_lanczos(df, ["k"], probes=4, steps=2, block_rows=40).collect()
    assert steps
    for plan in steps:
        joins = [x for x in plan.splitlines() if "Join Inner" in x]
        assert len(joins) == 3
        assert all("strategy=merge" in x for x in joins)
