"""k-means, its quality measures and the cluster table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_hex, hex_int
from ..functions.ordering import same_key
from ..functions.bounded import bounded_rows, bounded_side, local_table, written
from .assign import CLUSTER_SCHEMA, ClusterError, ClusterModel, as_matrix, nearest
from .lloyd import Fit, kmeans_many, nearest_of

# The default candidate list and number of restarts.
DEFAULT_KS = [2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20]
DEFAULT_RESTARTS = 10

BLOCK_ROWS = 2048
# Numbers that a task holds beside its blocks.
HELD_NUMBERS = 1 << 22
# Share of the squared lengths up to which a squared distance is computed from differences.
NEAR = 1e-6
# Stands for a null group; beyond int.
NO_GROUP = 1 << 40


def mean_vectors(df: DataFrame, keys: list[str], z: str = "z", out: str = "centroid") -> DataFrame:
    """Element-wise mean per key with map-side partial sums, plus the row count."""
    return df.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(z)))).alias(out),
        F.count(F.lit(1)).alias("n_rows"),
    )


def majority_labels(
    df: DataFrame, keys: list[str] | None = None, cluster: str = "cluster_id", y: str = "y"
) -> DataFrame:
    """Most frequent label per cluster; the smallest label wins a tie."""
    keys = keys or []
    return (
        df.groupBy(*keys, cluster, y)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys, cluster)
        .agg(
            F.max_by(y, F.struct(F.col("_n"), -F.col(y))).cast("int").alias("majority_y"),
            F.max("_n").alias("n_majority"),
            F.sum("_n").alias("n_train"),
        )
    )


def cluster_accuracy(df: DataFrame, keys: list[str] | None = None, cluster: str = "cluster_id", y: str = "y") -> DataFrame:
    """Share of rows that carry their cluster's majority label."""
    return (
        majority_labels(df, keys, cluster, y)
        .groupBy(*(keys or []))
        .agg((F.sum("n_majority") / F.sum("n_train")).alias("km_accuracy"))
    )


def cluster_table(
    df: DataFrame, model: ClusterModel | None = None, keys: list[str] | None = None, z: str = "z", y: str = "y"
) -> DataFrame:
    """``cluster_id, centroid, majority_y, n_train`` of rows with a ``cluster_id``.

    With ``model`` its centroids are used, and clusters without rows stay in the
    table with majority -1 and no members; otherwise centroids are the means.
    """
    keys = keys or []
    if model is None:
        # One pass: counts and vector sums per (cluster, label) give label votes and means.
        votes = df.groupBy(*keys, "cluster_id", F.col(y).alias("_y")).agg(
            F.count(F.lit(1)).alias("_n"), Summarizer.sum(array_to_vector(F.col(z))).alias("_s")
        )
        merged = votes.groupBy(*keys, "cluster_id").agg(
            vector_to_array(Summarizer.sum(F.col("_s"))).alias("_s"),
            F.max_by("_y", F.struct(F.col("_n"), -F.col("_y"))).cast("int").alias("majority_y"),
            F.sum("_n").cast("bigint").alias("n_train"),
        )
        centre = F.transform("_s", lambda v: v / F.col("n_train"))
        return merged.select(*keys, "cluster_id", centre.alias("centroid"), "majority_y", "n_train")
    stats = majority_labels(df, keys, "cluster_id", y)
    base = local_table(df.sparkSession, list(zip(model.ids, model.centroids, strict=True)), "cluster_id int, centroid array<double>"
    )
    return (
        base.alias("l")
        .join(stats.alias("r"), F.col("l.cluster_id") == F.col("r.cluster_id"), "left")
        .select(
            "l.cluster_id", "l.centroid",
            F.coalesce("r.majority_y", F.lit(-1)).alias("majority_y"),
            F.coalesce("r.n_train", F.lit(0)).cast("bigint").alias("n_train"),
        )
    )


def seed_cells(
    df: DataFrame, per_label: int = 2, seed: int = 7, z: str = "z", y: str = "y", row_id: str = "row_id"
) -> tuple[ClusterModel, DataFrame]:
    """One assign-and-average pass from hash-chosen start rows (``per_label`` of each class).

    A cheap, repeatable clustering that any SQL engine can recompute.  Returns
    the cluster model and the rows with their ``cluster_id``.
    """
    w = W.partitionBy(y).orderBy("_hash")
    starts = (
        df.select(y, z, hash_hex(seed, F.col(row_id)).alias("_hash"))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= per_label)
        .select(
            F.col(y).alias("_y"), F.col("_rn"), F.col(z).alias("centroid"),
        )
    )
    # per_label rows of every class: as small as the class list.
    rows = sorted(starts.toLocalIterator(), key=lambda r: (r._y, r._rn))
    start = ClusterModel(
        list(range(len(rows))), [list(map(float, r.centroid)) for r in rows], [r._y for r in rows], [0] * len(rows)
    )
    members = nearest(df, start, z).drop("cluster_id_dist")
    return ClusterModel.load(cluster_table(members, z=z, y=y)), members


def kmeans_fits(
    df: DataFrame, ks: list[int], seed: int = 42, restarts: int = DEFAULT_RESTARTS, z: str = "z", max_iter: int = 50,
    row_id: str = "row_id",
) -> dict[int, Fit]:
    """Lowest-cost fit per k over ``restarts`` seeds; all models advance in the same passes."""
    return {k: fit for (_, k), fit in kmeans_many(df, ks, restarts, seed, z, row_id, max_iter=max_iter).items()}


def silhouette(
    df: DataFrame, mode: str = "exact", cluster: str = "cluster_id", z: str = "z", row_id: str = "row_id"
) -> DataFrame:
    """Mean silhouette as one row ``silhouette, mode``.

    ``exact`` is the Euclidean measure; every pair of row blocks is visited
    once with only sums of rows leaving a task.  ``fast`` is the squared
    Euclidean measure in one pass over the rows, which decomposes into
    cluster sums and is the choice for large tables.
    """
    spark = df.sparkSession
    if mode == "fast":
        return squared_silhouette(df, cluster, z).withColumn("mode", F.lit(mode))
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    sums = block_sums(df, [], cluster, z, row_id)
    points = sums.alias("s").join(
        bounded_side(sizes).alias("c"), F.col(f"s.other") == F.col(f"c.{cluster}")
    ).select("s.*", "c.size")
    per_row = points.groupBy("row", "own").agg(
        F.max(F.when(F.col("other") == F.col("own"), F.col("total"))).alias("inner_total"),
        F.max(F.when(F.col("other") == F.col("own"), F.col("size"))).alias("own_size"),
        F.min(F.when(F.col("other") != F.col("own"), F.col("total") / F.col("size"))).alias("b"),
    )
    a = F.col("inner_total") / (F.col("own_size") - 1)
    widest = F.greatest(a, F.col("b"))
    score = F.when(
        (F.col("own_size") > 1) & F.col("b").isNotNull(), F.when(widest > 0, (F.col("b") - a) / widest).otherwise(0.0)
    ).otherwise(0.0)
    return per_row.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("silhouette")).withColumn("mode", F.lit(mode))


def squared_silhouette(df: DataFrame, cluster: str = "cluster_id", z: str = "z") -> DataFrame:
    """Mean silhouette under squared Euclidean distance, exact, in two passes.

    The mean squared distance from x to a cluster is |x|^2 + Q/n - 2 x.S/n with
    the cluster's count n, vector sum S and sum of squared norms Q.
    """
    norm = F.aggregate(F.transform(z, lambda v: v * v), F.lit(0.0), lambda s, v: s + v)
    stats = bounded_rows(
        df.groupBy(cluster).agg(
            F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"),
            vector_to_array(Summarizer.sum(array_to_vector(F.col(z)))).alias("s"),
        ).orderBy(cluster),
        10_000,
    )
    if stats is None:
        raise ClusterError("Too many clusters for a silhouette")
    if len(stats) < 2:
        return local_table(df.sparkSession, [(0.0,)], "silhouette double")
    ids = np.array([r[0] for r in stats])
    n = np.array([float(r.n) for r in stats])
    means, q = np.array([list(r.s) for r in stats]) / n[:, None], np.array([r.q for r in stats]) / n

    @F.arrow_udf("double")
    def score(points: pa.Array, own: pa.Array) -> pa.Array:
        if not len(points):
            return pa.array([], pa.float64())
        x = as_matrix(points)
        d = (x * x).sum(axis=1)[None, :] + q[:, None] - 2.0 * means @ x.T
        mine = ids[:, None] == own.to_numpy(zero_copy_only=False)[None, :]
        size = (mine * n[:, None]).sum(axis=0)
        a = np.where(mine, d, 0.0).sum(axis=0) * size / np.maximum(size - 1.0, 1.0)
        b = np.where(mine, np.inf, d).min(axis=0)
        top = np.maximum(a, b)
        value = np.where((size > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
        return pa.array(value)

    return df.agg(F.avg(score(F.col(z), F.col(cluster))).alias("silhouette"))


def _packed_blocks(df: DataFrame, keys: list[str], group: str, z: str, row_id: str, block_rows: int) -> DataFrame:
    """Rows packed into dense blocks of about ``block_rows`` points, per key."""
    keyed = df.select(
        *keys, F.col(group).cast("int").alias("_g"), F.col(row_id).cast("string").alias("_row"), F.col(z).alias("_z")
    ).withColumn("_unit", F.lit(0))
    counts = bounded_side(keyed.groupBy(*keys, "_unit").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_blocks")
    ))
    blocked = (
        keyed.alias("l")
        .join(counts.alias("r"), same_key("l", "r", [*keys, "_unit"]))
        .select("l.*", "r._blocks")
        .withColumn("_block", F.pmod(hex_int(hash_hex("block", F.col("_row"))), F.col("_blocks")).cast("int"))
    )
    # A block holds about block_rows points, whatever the size of its key.
    packed = blocked.groupBy(*keys, "_block", "_blocks").agg(F.collect_list(F.struct("_row", "_g", "_z")).alias("_p"))
    return packed.select(
        *keys, "_block", "_blocks", F.col("_p._row").alias("rows"), F.col("_p._g").alias("groups"),
        F.flatten("_p._z").alias("flat"),
    )


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b; pairs at which the short form cancels or overflows by their differences."""
    with np.errstate(invalid="ignore", over="ignore"):
        scale = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
        out = scale - 2.0 * (a @ b.T)
        i, j = np.nonzero(~(out > NEAR * scale))
        step = max(1, HELD_NUMBERS // max(1, a.shape[1]))
        for at in range(0, len(i), step):
            some = i[at : at + step], j[at : at + step]
            out[some] = ((a[some[0]] - b[some[1]]) ** 2).sum(axis=1)
    return out


def _met_totals(
    a: np.ndarray, own: np.ndarray, b: np.ndarray, theirs: np.ndarray, kernel: float | None
) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """By group of b the sums of each row of a, and by group of a those of each row of b."""
    order, turn = np.argsort(own, kind="stable"), np.argsort(theirs, kind="stable")
    a, b, mine = a[order], b[turn], own[order]
    found, begins = np.unique(theirs[turn], return_index=True)
    rows, columns = np.empty((len(a), len(found))), {int(g): np.zeros(len(b)) for g in np.unique(mine)}
    step = max(1, HELD_NUMBERS // 8 // max(1, len(b)))
    for at in range(0, len(a), step):
        sq = _squares(a[at : at + step], b)
        v = np.sqrt(sq) if kernel is None else np.exp(-2.0 * kernel * sq)
        rows[at : at + step] = np.add.reduceat(v, begins, axis=1)
        here, firsts = np.unique(mine[at : at + step], return_index=True)
        for g, part in zip(here.tolist(), np.add.reduceat(v, firsts, axis=0), strict=True):
            columns[g][turn] += part
    back = np.argsort(order, kind="stable")
    return {int(g): rows[back, k] for k, g in enumerate(found)}, columns


def _meetings(blocks: DataFrame) -> DataFrame:
    """Each block with ``_meet``, the number of one it meets: itself and half of the others, so that every pair is there once."""
    ahead = blocks.withColumn("_ahead", F.explode(F.expr("sequence(0, _blocks div 2)")))
    once = ahead.where("2 * _ahead < _blocks or 2 * _block < _blocks")
    return once.withColumn("_meet", F.expr("pmod(_block + _ahead, _blocks)")).drop("_ahead")


def block_sums(
    df: DataFrame,
    keys: list[str],
    group: str,
    z: str = "z",
    row_id: str = "row_id",
    kernel: float | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per row, the summed distance to the members of every group of its key.

    With ``kernel`` (gamma) the squared Gaussian kernel is summed instead.  Every two blocks of a key meet once, which gives
    the sums of the rows of both; each block meets as many others.  A task holds two blocks and sums of blocks by group, which
    add up, and emits those, never pairs.
    """
    blocks = written(_packed_blocks(df, keys, group, z, row_id, block_rows), "blocks")
    met = (
        _meetings(blocks).alias("l")
        .join(blocks.alias("r"), same_key("l", "r", keys) & (F.col("l._meet") == F.col("r._block")))
        .select(
            *[f"l.{k}" for k in keys], "l._block", "l.groups", "l.flat", F.col("r._block").alias("_other"),
            F.col("r.groups").alias("other_groups"), F.col("r.flat").alias("other_flat"),
        )
    )
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key_fields = "".join(f"`{k}` {types[k]}, " for k in keys)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        size, kinds = 0, []

        def summed() -> pa.RecordBatch:
            *names, met = zip(*totals, strict=True)
            names.append([None if g == NO_GROUP else g for g in met])
            columns = [pa.array(x, type=t) for x, t in zip(names, [*kinds, pa.int32(), pa.int32()], strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(totals.values()), type=pa.list_(pa.float64()))],
                                              names=[*keys, "_block", "other", "totals"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in range(len(keys))]
            names = zip(*[batch.column(k).to_pylist() for k in range(len(keys))], strict=True) if keys else [()] * batch.num_rows
            block, other = batch.column("_block").to_pylist(), batch.column("_other").to_pylist()
            for i, name in enumerate(names):
                own, theirs = (
                    batch.column(c)[i].values.cast(pa.int64()).fill_null(NO_GROUP).to_numpy() for c in ("groups", "other_groups"))
                flat, other_flat = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("flat", "other_flat"))
                a, b = flat.reshape(len(own), -1), other_flat.reshape(len(theirs), -1)
                rows, columns = _met_totals(a, own, b, theirs, kernel)
                # a block that meets itself has all pairs in the sums of its rows
                sides = [(block[i], rows)] if block[i] == other[i] else [(block[i], rows), (other[i], columns)]
                for at, found in sides:
                    for g, total in found.items():
                        if (*name, at, g) in totals:
                            totals[(*name, at, g)] += total
                        else:
                            totals[(*name, at, g)] = total
                            size += total.size
                if size > HELD_NUMBERS:
                    yield summed()
                    totals, size = {}, 0
        if totals:
            yield summed()

    sums = met.mapInArrow(visit, key_fields + "_block int, other int, totals array<double>").groupBy(*keys, "_block", "other").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("totals")))).alias("totals"))
    named = sums.alias("l").join(
        blocks.select(*keys, "_block", "rows", "groups").alias("r"), same_key("l", "r", [*keys, "_block"]))
    each = named.select(*[f"l.{k}" for k in keys], "l.other", F.explode(F.arrays_zip("r.rows", "r.groups", "l.totals")).alias("_x"))
    return (
        each.select(*keys, F.col("_x.rows").alias("row"), F.col("_x.groups").alias("own"), "other",
                    F.nanvl("_x.totals", F.lit(None).cast("double")).alias("total"))
        .groupBy(*keys, "row", "own", "other")
        .agg(F.sum("total").alias("total"))
    )


def kmeans_sweep(
    df: DataFrame,
    ks: list[int] | None = None,
    restarts: int = DEFAULT_RESTARTS,
    seed: int = 42,
    mode: str = "fast",
    z: str = "z",
    row_id: str = "row_id",
) -> tuple[DataFrame, dict[int, Fit]]:
    """Fit every k below the row count; scores ``k, cost, silhouette, mode`` and the fits."""
    fits = kmeans_fits(df, DEFAULT_KS if ks is None else ks, seed, restarts, z, row_id=row_id)
    rows = []
    for k, fit in sorted(fits.items()):
        score = fit.silhouette
        if mode != "fast":
            score = float(silhouette(predict(df, fit, z), mode, z=z, row_id=row_id).first().silhouette)
        rows.append((k, fit.cost, score, mode))
    return local_table(df.sparkSession, rows, "k int, cost double, silhouette double, mode string"), fits


def model_centroids(fit: Fit) -> ClusterModel:
    return ClusterModel(list(range(len(fit.centres))), fit.centres.tolist(), [-1] * len(fit.centres), [0] * len(fit.centres))


def predict(df: DataFrame, fit: Fit, z: str = "z") -> DataFrame:
    """Nearest centre of a fitted k-means as ``cluster_id``."""
    return nearest(df, model_centroids(fit), z).drop("cluster_id_dist")


def cluster_many(
    df: DataFrame, group: str, ks: list[int] | None = None, restarts: int = DEFAULT_RESTARTS, seed: int = 42,
    z: str = "z", y: str = "y", row_id: str = "row_id",
) -> tuple[DataFrame, DataFrame]:
    """``cluster`` for every value of an int column at once.

    Returns the cluster table and a summary ``best_k, silhouette, km_accuracy``, both keyed by ``group``.
    """
    fits = kmeans_many(df, DEFAULT_KS if ks is None else ks, restarts, seed, z, row_id, group)
    chosen: dict[int, tuple[int, Fit]] = {}
    for (g, k), fit in sorted(fits.items()):
        if g not in chosen or fit.silhouette > chosen[g][1].silhouette:
            chosen[g] = k, fit
    spark = df.sparkSession
    members = nearest_of(df, {g: fit.centres for g, (_, fit) in chosen.items()}, group, z)
    labels = majority_labels(members, [group], y=y)
    base = local_table(spark, [(g, i, list(map(float, c))) for g, (_, fit) in chosen.items() for i, c in enumerate(fit.centres)],
                       f"{group} int, cluster_id int, centroid array<double>")
    table = base.join(labels, [group, "cluster_id"], "left").select(
        group, "cluster_id", "centroid", F.coalesce("majority_y", F.lit(-1)).alias("majority_y"),
        F.coalesce("n_train", F.lit(0)).cast("bigint").alias("n_train"))
    rated = local_table(spark, [(g, k, float(fit.silhouette)) for g, (k, fit) in chosen.items()],
                        f"{group} int, best_k int, silhouette double")
    accuracy = labels.groupBy(group).agg((F.sum("n_majority") / F.sum("n_train")).alias("km_accuracy"))
    return table, rated.join(accuracy, group)


def best_k(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Highest silhouette; the smallest such k."""
    return scores.groupBy(*(keys or [])).agg(
        F.max_by("k", F.struct(F.col("silhouette"), -F.col("k"))).alias("best_k"),
        F.max("silhouette").alias("silhouette"),
    )


def cluster(
    df: DataFrame,
    ks: list[int] | None = None,
    restarts: int = DEFAULT_RESTARTS,
    seed: int = 42,
    mode: str = "fast",
    z: str = "z",
    y: str = "y",
    row_id: str = "row_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sweep, choose k, label the clusters: (cluster table, members, one-row summary)."""
    scores, fits = kmeans_sweep(df, ks, restarts, seed, mode, z, row_id)
    chosen = best_k(scores).first()
    model = fits[chosen.best_k]
    members = predict(df, model, z)
    table = cluster_table(members, model_centroids(model), z=z, y=y)
    accuracy = cluster_accuracy(members, y=y).first().km_accuracy
    summary = local_table(df.sparkSession, [(chosen.best_k, float(chosen.silhouette), float(accuracy), mode)],
        "best_k int, silhouette double, km_accuracy double, mode string",
    )
    return table, members, summary


__all__ = [
    "CLUSTER_SCHEMA", "DEFAULT_KS", "best_k", "block_sums", "cluster", "cluster_accuracy", "cluster_many", "cluster_table",
    "kmeans_fits", "kmeans_sweep", "majority_labels", "mean_vectors", "predict", "seed_cells", "silhouette",
]
