"""m1_diversity_exact against the eigenvalues of every cluster's whole kernel."""

import numpy as np
import pytest

from flowgauge.catalog import QUERIES, load_all
from flowgauge.catalog.views import assessed, latent
from flowgauge.operators.diversity import gaussian_kernel, weighted_vendi

load_all()


def test_all_eigenvalues_count(spark, tmp_path):
    """A quadrature misses the score by more than rounding; every eigenvalue is wanted."""
    rng = np.random.default_rng(11)
    points = rng.normal(0, 0.2, size=(900, 8))
    rows = [(i, i % 2, [float(v) for v in p]) for i, p in enumerate(points)]
    rows += [(900 + i, r[1], r[2]) for i, r in enumerate(rows[:30])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.pos: r for r in QUERIES["m1_diversity_exact"](spark, str(tmp_path)).collect()}
    test = assessed(latent(spark, str(tmp_path)))[0].filter("side = 'test'").select("pos", "z").collect()
    by_key = {}
    for r in test:
        by_key.setdefault(r.pos, []).append(r.z)
    assert got.keys() == by_key.keys()
    assert max(map(len, by_key.values())) > 40
    for key, z in by_key.items():
        z = np.array(z)
        lam = np.linalg.eigvalsh(np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2)) / len(z))
        lam = lam[lam > 1e-12]
        want = (np.exp(-(lam * np.log(lam)).sum()) - 1) / (len(z) - 1)
        assert got[key].n == len(z)
        assert got[key].method == "exact"
        assert got[key].diversity == pytest.approx(want, abs=2e-6)


def test_kernel_in_pieces(monkeypatch):
    from flowgauge.operators import diversity

    points = np.random.default_rng(2).normal(size=(23, 3))
    whole = np.exp(-0.7 * ((points[:, None] - points[None]) ** 2).sum(axis=2))
    monkeypatch.setattr(diversity, "KERNEL_ROWS", 5)
    assert np.allclose(gaussian_kernel(0.7)(points), whole, atol=1e-13)
    kept = whole.copy()
    weighted_vendi(points, np.ones(23), lambda _: whole)
    assert (whole == kept).all()
