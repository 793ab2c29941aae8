"""Sums over pairs of row blocks."""

from collections import Counter

import numpy as np

from flowgauge.operators.clustering import _meetings, block_sums
from flowgauge.operators.scores import contrastive_loss


def test_two_blocks_meet_once(spark):
    blocks = spark.createDataFrame([(k, n) for n in range(1, 7) for k in range(n)], "_block int, _blocks int")
    met = Counter((r._blocks, frozenset((r._block, r._meet))) for r in _meetings(blocks).collect())
    assert met == {(n, frozenset((i, j))): 1 for n in range(1, 7) for i in range(n) for j in range(i + 1)}


def test_sums_agree_with_all_pairs(spark):
    """Far from the origin, with equal points; a point without a place has no sums, nor has its group, whatever the blocks."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(130, 3)) + 1e6
    points[60:90] = points[:30]
    groups = rng.integers(4, size=130)
    points[129], groups[129] = np.nan, 4
    rows = [(i, int(g), p.tolist()) for i, (g, p) in enumerate(zip(groups, points, strict=True))]
    df = spark.createDataFrame(rows, "row_id int, cluster_id int, z array<double>")
    found = {(int(r.row), r.own, r.other): r.total for r in block_sums(df, [], "cluster_id", block_rows=20).collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for i in range(130):
        for g in range(5):
            total = found.pop((i, int(groups[i]), g))
            if i == 129 or g == 4:
                assert total is None
            else:
                np.testing.assert_allclose(total, d[i, groups == g].sum(), rtol=1e-9)
    assert not found


def test_contrastive_loss_joins_alike_at_all_sizes(spark):
    """Vectors are joined by the same plan whatever their number, and pairs with a vector are not sorted."""
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])], "row_id int, z array<double>")
    pairs = spark.createDataFrame([(1, 1, 3, 0), (2, 1, 2, 1), (3, 3, 9, 1), (4, None, 1, 0)],
                                  "pair_id int, row_i int, row_j int, different int")
    found = contrastive_loss(pairs, rows)
    row = found.first()
    # one pair of the same class at 1, one of two classes at 5, twice
    assert (row.n_pairs, round(row.contrastive, 9)) == (3, round((0.5 + 2 * 12.5) / 3, 9))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
