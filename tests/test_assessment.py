"""The fixed small slice, centroid assignment and the three scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.operators.assign import ClusterModel, assign, negative_grid
from flowgauge.operators.clustering import cluster_table, majority_labels, mean_vectors, silhouette
from flowgauge.operators.diversity import (
    covariance_partials, diversity, normalised, order_two_diversity, spectral_score, unpacked,
)
from flowgauge.operators.proximity import ks
from flowgauge.operators.scarcity import gini, scarcity, scarcity_from_grid
from flowgauge.plans.assess import assess
from flowgauge.plans.sweeps import label_mean_clusters, subset_scores


def vendi(points, gamma=1.0):
    n = len(points)
    k = np.exp(-gamma * ((points[:, None] - points[None]) ** 2).sum(-1)) / n
    lam = np.linalg.eigvalsh(k)
    lam = lam[lam > 1e-12]
    return (np.exp(-(lam * np.log(lam)).sum()) - 1) / (n - 1)


@pytest.fixture(scope="module")
def slice8(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    side = F.when(F.col("vec_id") % 5 < 3, "train").when(F.col("vec_id") % 5 == 3, "val").otherwise("test")
    rows = e.select(
        "vec_id", F.col("label").alias("y"), F.slice("embedding", 1, 8).cast("array<double>").alias("z"), side.alias("side")
    ).filter("side <> 'val'")
    train = rows.filter("side = 'train' and y <> 9").withColumn(
        "cluster_id", (F.col("y") * 2 + F.floor(F.col("vec_id") / 5) % 2).cast("int")
    )
    means = mean_vectors(train, ["cluster_id", "y"]).select(
        "cluster_id", "centroid", F.col("y").alias("majority_y"), F.col("n_rows").alias("n_train")
    )
    empty = spark.createDataFrame([(99, [100.0] * 8, 0, 0)], means.schema)
    return rows, means.unionByName(empty)


def test_fixed_values(slice8):
    found = assess(*slice8)
    g = found.global_scores.first()
    assert g.n_clusters == 19 and g.n_test == 100
    assert g.proximity == pytest.approx(0.7333333333, abs=1e-9)
    assert g.scarcity == pytest.approx(0.1658625731, abs=1e-9)
    assert found.assignments.filter("side = 'test' and pos = neg").count() == 11
    rows = {r.cluster_id: r for r in found.cluster_scores.collect()}
    expected = {
        0: (0.0455, 0.2000, 4), 1: (0.3810, 0.2222, 7), 2: (0.3333, 0.1250, 3), 3: (0.5000, 0.2500, 6),
        4: (0.7333, 0.1875, 4), 5: (0.1863, 0.2083, 6), 99: (0, 0, 0),
    }
    for c, (p, s, n) in expected.items():
        assert (round(rows[c].proximity, 4), round(rows[c].scarcity, 4), rows[c].n_test) == (p, s, n)


def test_diversity_matches_eigenvalues(slice8):
    found = assess(*slice8, method="exact")
    test = found.assignments.filter("side = 'test'").select("pos", "z").toPandas()
    scores = {r.cluster_id: r.diversity for r in found.cluster_scores.collect()}
    for pos, part in test.groupby("pos"):
        points = np.stack(part["z"].to_numpy())
        assert scores[pos] == pytest.approx(vendi(points) if len(points) > 1 else 0.0, abs=1e-9)


def test_random_feature_diversity_is_close_and_additive(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(p.tolist(),) for p in pts], "z array<double>")
    exact = diversity(df, method="exact").first().diversity
    one = diversity(df.coalesce(1), method="rff", m=512).first()
    many = diversity(df.repartition(7), method="rff", m=512).first()
    assert one.method == "rff512" and one.n == 200
    assert one.diversity == pytest.approx(many.diversity, abs=1e-9)
    assert one.diversity == pytest.approx(exact, rel=0.1)
    # The method never depends on the number of rows, and no row is lost.
    for n in (2, 50, 200):
        some = diversity(df.limit(n), m=64).first()
        assert (some.method, some.n) == ("rff64", n)


def test_diversity_edge_cases(spark):
    rows = [(1, [0.0, 0.0])] + [(2, [1.0, 1.0])] * 5 + [(3, [100.0 * i, 0.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "g int, z array<double>")
    got = {r.g: r.diversity for r in diversity(df, ["g"], method="exact").collect()}
    assert got[1] == 0.0 and got[2] == pytest.approx(0.0, abs=1e-12) and got[3] == pytest.approx(1.0, abs=1e-9)
    raw = {r.g: r.diversity for r in diversity(df, ["g"], normalize=False, method="exact").collect()}
    assert raw[1] == 1.0 and raw[3] == pytest.approx(6.0, abs=1e-6)


def test_order_two_by_blocks(spark):
    pts = np.random.default_rng(1).normal(size=(60, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "row_id int, z array<double>")
    k = np.exp(-((pts[:, None] - pts[None]) ** 2).sum(-1))
    assert order_two_diversity(df).first().vendi2 == pytest.approx(60**2 / (k**2).sum(), rel=1e-9)


def test_assignment_ties_and_fallbacks(spark):
    model = ClusterModel([0, 1, 2], [[0.0], [2.0], [2.0]], [0, 1, 1], [1, 1, 1])
    df = spark.createDataFrame([(0, 0, [1.0]), (1, 1, [1.0]), (2, 7, [0.4])], "row_id int, y int, z array<double>")
    got = {r.row_id: (r.pos, r.neg) for r in assign(df, model).collect()}
    assert got == {0: (0, 1), 1: (1, 0), 2: (0, 0)}
    single = ClusterModel([4, 5], [[0.0], [3.0]], [1, 1], [1, 1])
    assert [(r.pos, r.neg) for r in assign(df.filter("y = 1"), single).collect()] == [(4, 4)]
    # Clusters per variant agree with the shared form.
    keyed = model.table(spark).withColumn("v", F.lit(3))
    again = assign(df.withColumn("v", F.lit(3)), keyed, ["v"])
    assert {r.row_id: (r.pos, r.neg) for r in again.collect()} == got


def test_centroids_in_pieces_agree(spark, slice8, monkeypatch):
    rows, clusters = slice8
    whole = {r.vec_id: (r.pos, r.neg) for r in assign(rows, clusters).collect()}
    monkeypatch.setattr("flowgauge.operators.assign.MAX_CENTROID_VALUES", 40)
    assert len(list(ClusterModel.pieces(clusters))) > 1
    assert {r.vec_id: (r.pos, r.neg) for r in assign(rows, clusters).collect()} == whole
    keyed = clusters.withColumn("v", F.lit(1))
    past = assign(rows.withColumn("v", F.lit(1)), keyed, ["v"])
    assert {r.vec_id: (r.pos, r.neg) for r in past.collect()} == whole


def test_assignment_does_not_shuffle(slice8):
    rows, clusters = slice8
    plan = assign(rows, ClusterModel.load(clusters))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_scarcity_agrees_with_grid_and_edges(spark, slice8):
    rows, clusters = slice8
    test = assign(rows, clusters).filter("side = 'test'")
    a = {r.pos: r.scarcity for r in scarcity(test, clusters).collect()}
    b = {r.pos: r.scarcity for r in scarcity_from_grid(negative_grid(test, clusters)).collect() if r.scarcity > 0}
    assert {k: v for k, v in a.items() if v > 0} == pytest.approx(b)
    two = ClusterModel([0, 1], [[0.0], [5.0]], [0, 1], [1, 1])
    one_row = spark.createDataFrame([(0, [0.1])], "y int, z array<double>")
    assert scarcity(assign(one_row, two), two).first().scarcity == 1.0
    same = ClusterModel([0, 1], [[0.0], [5.0]], [0, 0], [1, 1])
    assert scarcity(assign(one_row, same), same).count() == 0


def test_gini_and_ks_cases(spark):
    counts = spark.createDataFrame([("a", 0), ("a", 0), ("a", 10), ("b", 3), ("b", 3), ("z", 0)], "g string, n int")
    got = {r.g: r.gini for r in gini(counts, "n", ["g"]).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 0.0, "z": 0.0})
    assert gini(counts.filter("g = 'a'"), "n", corrected=False).first().gini == pytest.approx(2 / 3)
    rows = [(0, "test", v) for v in (1.0, 2.0)] + [(0, "train", v) for v in (1.0, 2.0)]
    rows += [(1, "test", v) for v in (1.0, 2.0)] + [(1, "train", v) for v in (3.0, 4.0)] + [(2, "test", 1.0)]
    df = spark.createDataFrame(rows, "g int, side string, v double")
    assert {r.g: r.ks for r in ks(df, "v", "side", ["g"]).collect()} == {0: 0.0, 1: 1.0, 2: 0.0}
    assert {r.g: r.ks for r in ks(df, "v", "side", ["g"], "less").collect()} == {0: 0.0, 1: 0.0, 2: 0.0}


def test_majority_and_silhouette(spark):
    df = spark.createDataFrame(
        [(0, 0, 3, [0.0]), (1, 0, 1, [1.0]), (2, 1, 2, [9.0]), (3, 1, 2, [10.0])],
        "row_id int, cluster_id int, y int, z array<double>",
    )
    assert {r.cluster_id: r.majority_y for r in majority_labels(df).collect()} == {0: 1, 1: 2}
    model = ClusterModel([0, 1, 2], [[0.5], [9.5], [50.0]], [-1] * 3, [0] * 3)
    table = {r.cluster_id: (r.majority_y, r.n_train) for r in cluster_table(df, model).collect()}
    assert table == {0: (1, 2), 1: (2, 2), 2: (-1, 0)}
    x = np.array([0.0, 1.0, 9.0, 10.0])
    g = np.array([0, 0, 1, 1])
    for mode, power in (("exact", 1), ("fast", 2)):
        d = np.abs(x[:, None] - x[None]) ** power
        s = []
        for i in range(4):
            a = d[i][(g == g[i])].sum() / 1
            b = d[i][g != g[i]].mean()
            s.append((b - a) / max(a, b))
        assert silhouette(df, mode).first().silhouette == pytest.approx(np.mean(s))
    assert math.isclose(silhouette(df.filter("cluster_id = 0"), "fast").first().silhouette, 0.0)


def test_label_subsets_gather_no_cluster_in_one_task(spark, monkeypatch):
    from flowgauge.catalog import sweeps as registered
    from flowgauge.plans import sweeps

    def gathered(*_):
        raise AssertionError("points of a cluster meet in one task")

    monkeypatch.setattr(sweeps, "exact_vendi", gathered)
    found = registered.x1(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 1023 and all(0 <= r.diversity <= 1 for r in found)


@pytest.mark.parametrize("low_bits", [1, 3, 8])
def test_segments_of_label_subsets(spark, low_bits):
    """However a cluster's subsets are cut into tasks, their scores are those of the summed matrices."""
    rng = np.random.default_rng(7)
    rows = [(pos, 1 << (2 * k), [float(v) for v in rng.normal(size=3)])
            for pos, held in ((1, range(5)), (2, [3]), (3, [0, 4])) for k in held for _ in range(6)]
    points = spark.createDataFrame(rows, "pos int, bit long, z array<double>")
    sums = covariance_partials(points, ["pos", "bit"], m=4).persist()
    by_label = {(p, b): unpacked(part, 4) for (p, b), part in sums.toPandas().groupby(["pos", "bit"])}
    found = {(r.pos, r["sub"]): r.diversity for r in subset_scores(sums, 4, low_bits).collect()}
    want = {}
    for pos, held in ((1, range(5)), (2, [3]), (3, [0, 4])):
        bits = [1 << (2 * k) for k in held]
        for mask in range(1, 1 << len(bits)):
            mine = [b for i, b in enumerate(bits) if mask >> i & 1]
            n = 6 * len(mine)
            score = spectral_score(np.linalg.eigvalsh(sum(by_label[pos, b] for b in mine) / n))
            want[pos, sum(mine)] = normalised(score, n, True)
    assert found == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_scores_alone_keep_narrow_rows(spark):
    """What is kept per seed has no vectors and ids where no score reads them; the scores are the same."""
    rows = spark.range(400).selectExpr(
        "cast(id as string) row_id", "cast(42 + id % 2 as int) seed", "cast(id % 3 as int) y", "array(cast(id % 17 as double), cast(id % 5 as double)) z",
        "if(id % 4 = 0, 'test', 'train') side")
    clusters = label_mean_clusters(rows, ["seed"])
    two = ("proximity", "scarcity")
    whole = assess(rows, clusters, ["seed"], two, keyed_clusters=True)
    slim = assess(rows, clusters, ["seed"], two, keyed_clusters=True, scores_only=True)
    assert sorted(slim.assignments.columns) == ["neg", "neg_dist", "pos", "seed", "side", "y"]
    assert sorted(slim.global_scores.collect()) == sorted(whole.global_scores.collect())
    assert "z" in assess(rows, clusters, ["seed"], keyed_clusters=True, scores_only=True).assignments.columns
