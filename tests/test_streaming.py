"""The running state: exact, bounded by the train values, and safe against replays and failed batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.operators.assign import ClusterModel
from flowgauge.plans.assess import assess
from flowgauge.streaming.continuous import ContinuousAssessment

COLUMNS = ["cluster_id", "diversity", "proximity", "scarcity", "n_test"]


def _rows(spark, rng, n, start=0):
    data = [(start + i, int(rng.integers(0, 3)), [float(v) for v in rng.normal(size=2) * 2]) for i in range(n)]
    return spark.createDataFrame(data, "row_id long, y int, z array<double>")


def _table(df):
    return {r.cluster_id: tuple(r[c] for c in COLUMNS[1:]) for r in df.select(*COLUMNS).collect()}


def test_state_of_batches(spark, tmp_path):
    rng = np.random.default_rng(6)
    model = ClusterModel([0, 1, 2, 3], [[0.0, 0.0], [2.0, 0.0], [0.0, 2.0], [-2.0, 1.0]], [0, 1, 2, 0], [5, 5, 5, 5])
    train = _rows(spark, rng, 60)
    batches = [_rows(spark, rng, n, 1000 * (i + 1)) for i, n in enumerate((40, 1, 200, 30, 500))]
    state = str(tmp_path / "state")
    running = ContinuousAssessment(spark, model, train, state, m=16)
    assert set(_table(running.cluster_scores()).values()) == {(0.0, 0.0, 0.0, 0)}
    seen = None
    for i, batch in enumerate(batches):
        seen = batch if seen is None else seen.unionByName(batch)
        if i == 2:
            # a batch that fails after it has written a part leaves what readers see
            before = _table(running.cluster_scores())
            broken = ContinuousAssessment(spark, model, train, state, m=16)
            broken._merged = lambda kind, part, last: part if kind == "counts" else 1 / 0
            with pytest.raises(ZeroDivisionError):
                broken.update(batch, i)
            assert _table(running.cluster_scores()) == before
        running.update(batch, i)
        running.update(batch, i)  # a replay
        both = train.withColumn("side", F.lit("train")).unionByName(seen.withColumn("side", F.lit("test")))
        want = _table(assess(both, model, m=16).cluster_scores)
        got = _table(running.cluster_scores())
        assert got.keys() == want.keys()
        for k, row in got.items():
            assert row == pytest.approx(want[k], abs=1e-9)
    # the state goes on in another process, and an earlier batch changes nothing there either
    again = ContinuousAssessment(spark, model, train, state, m=16)
    again.update(batches[0], 0)
    assert _table(again.cluster_scores()) == _table(running.cluster_scores())
    slots = again._read("slots", again._pointer()[1])
    assert slots.count() <= 2 * 60 + len(model.ids)
    assert sum(1 for p in (tmp_path / "state").iterdir() if p.name.startswith("version=")) <= 3
