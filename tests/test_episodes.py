"""Many policies on many splits from one pass, against one fit each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.operators.episodes import fitted_q, policy_value, policy_values, split_sides, transitions


def test_policies_on_splits(spark):
    rng = np.random.default_rng(5)
    rows = [(e, s, [float(v) for v in rng.normal(size=2)], [float(rng.random())], float(rng.normal()), s == 7)
            for e in range(31) for s in range(8)]
    steps = transitions(spark.createDataFrame(
        rows, "episode long, step long, obs array<double>, action array<double>, reward double, terminal boolean")).persist()
    policies = {"low": lambda obs: F.array(F.lit(0.1)), "state": lambda obs: F.array(F.abs(obs[0]))}
    got = {(r.split, r.policy): r.value for r in policy_values(steps, policies, 4, 0.8, 30).collect()}
    assert len(got) == 8
    sided = split_sides(steps, 4).persist()
    for k in range(4):
        held = sided.filter(F.col("held")[k])
        assert held.select("episode").distinct().count() == 16  # the larger half of 31
        for name, policy in policies.items():
            q = fitted_q(held, policy, 0.8, 30)
            assert got[k, name] == pytest.approx(policy_value(held, policy, q).first().value, abs=1e-9)
