"""Many k-means models at once, against plain Lloyd steps and the definition of the silhouette."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowgauge.operators.assign import ClusterError, from_matrix
from flowgauge.operators.clustering import cluster_many
from flowgauge.operators.lloyd import _partials, _Stack, kmeans_many, nearest_of


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, centres in ((0, [(0, 0), (9, 0), (0, 9)]), (7, [(1, 1), (30, 1)])):
        for i in range(240):
            x, y = rng.normal(centres[i % len(centres)], 0.7)
            rows.append((f"{g}-{i}", g, i % len(centres), [float(x), float(y)]))
    rows += [(f"hot-{i}", 7, 0, [1.0, 1.0]) for i in range(300)]
    return spark.createDataFrame(rows, "row_id string, g int, y int, z array<double>"), rows


def test_models_of_several_groups(blobs):
    df, rows = blobs
    fits = kmeans_many(df, [2, 3, 5], 4, group="g", tol=0.0, max_iter=100)
    assert set(fits) == {(g, k) for g in (0, 7) for k in (2, 3, 5)}
    for (g, k), fit in fits.items():
        x = np.array([r[3] for r in rows if r[1] == g])
        d = ((x[:, None, :] - fit.centres[None, :, :]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        assert fit.cost == pytest.approx(d.min(axis=1).sum(), rel=1e-9) and fit.sizes.sum() == len(x)
        for c in range(k):
            assert np.allclose(fit.centres[c], x[own == c].mean(axis=0), atol=1e-6)
        # the mean squared distances to all clusters, point by point
        pair = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
        score = []
        for i in range(len(x)):
            mine = own == own[i]
            a = pair[i, mine].sum() / max(1, mine.sum() - 1)
            b = min(pair[i, own == c].mean() for c in range(k) if c != own[i] and (own == c).any())
            score.append(0.0 if mine.sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
        assert fit.silhouette == pytest.approx(np.mean(score), abs=1e-6)
    assert fits[0, 3].cost < 0.2 * fits[0, 2].cost
    near = nearest_of(df, {0: fits[0, 3].centres}, "g")
    assert near.where("g = 7 and cluster_id is not null").count() == 0 and near.where("g = 0").agg(F.countDistinct("cluster_id")).first()[0] == 3


def test_clusters_of_several_groups(blobs):
    df, _ = blobs
    table, summary = cluster_many(df, "g", [2, 3, 4], 3)
    by_group = {r.g: r for r in summary.collect()}
    assert (by_group[0].best_k, by_group[7].best_k) == (3, 2) and by_group[0].km_accuracy == 1.0 == by_group[7].km_accuracy
    assert sorted((r.g, r.n_train) for r in table.collect()) == [(0, 80), (0, 80), (0, 80), (7, 120), (7, 420)]


def test_no_k_below_the_rows(spark):
    with pytest.raises(ClusterError):
        kmeans_many(spark.createDataFrame([("a", [1.0])], "row_id string, z array<double>"), [2, 3], 1)
    with pytest.raises(ClusterError):
        kmeans_many(spark.createDataFrame([], "row_id string, z array<double>"), [2], 1)


def test_partials_hold_no_membership_matrix():
    """A task hands on one row per model, and its memory does not follow rows times centres."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 3))
    models = {i: x[rng.integers(len(x), size=64)] for i in range(40)}
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), dtype=np.int32)), from_matrix(x)], names=["g", "z"])
    tracemalloc.start()
    (out,) = list(_partials({0: _Stack(models)})(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == len(models) and peak < 8 << 20
    for name, vec in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
        d = ((x[:, None, :] - models[name][None, :, :]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        assert vec[0] == pytest.approx(d.min(axis=1).sum())
        assert vec[1:65] == np.bincount(own, minlength=64).tolist()
        assert np.allclose(np.reshape(vec[129:], (64, 3)), [x[own == c].sum(axis=0) for c in range(64)])
