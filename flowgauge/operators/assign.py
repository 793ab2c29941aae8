"""Centroid tables and the nearest same-label / other-label centroid of every row.

The centroid table is model state: it is collected under a size bound and shipped
with a vectorised function on Arrow batches, so assignment is one map-only stage with
no join at all.  (Unrolled SQL arithmetic was measured too: from a few dozen terms on the
generated method is too long for the JIT and an order of magnitude slower.)  A centroid table past the bound is worked off in bounded pieces,
each piece improving the best candidates found so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bounded import bounded_rows, bounded_side, local_table
from ..functions.ordering import same_key
from ..functions.vectors import distance

MAX_CENTROID_VALUES = 1 << 20  # doubles per piece (8 MB)

CLUSTER_SCHEMA = "cluster_id int, centroid array<double>, majority_y int, n_train bigint"
CANDIDATE = "struct<d:double,id:int>"


class ClusterError(ValueError):
    """A cluster table that cannot be used."""


@dataclass
class ClusterModel:
    """Centroids with their majority labels, ordered by cluster id."""

    ids: list[int]
    centroids: list[list[float]]
    majority: list[int]
    n_train: list[int] = field(default_factory=list)

    @staticmethod
    def pieces(clusters: "DataFrame | ClusterModel") -> Iterator["ClusterModel"]:
        """The model in pieces of bounded size (one piece in practice)."""
        if isinstance(clusters, ClusterModel):
            yield clusters
            return
        cols = ["cluster_id", "centroid", "majority_y", "n_train"]
        part: list = []
        values = 0
        for row in clusters.select(*cols).orderBy("cluster_id").toLocalIterator():
            part.append(row)
            values += len(row.centroid or [])
            if values >= MAX_CENTROID_VALUES:
                yield ClusterModel._of(part)
                part, values = [], 0
        if part:
            yield ClusterModel._of(part)

    @staticmethod
    def _of(rows: list) -> "ClusterModel":
        return ClusterModel(
            [r.cluster_id for r in rows],
            [[float(v) for v in r.centroid] for r in rows],
            [r.majority_y for r in rows],
            [r.n_train for r in rows],
        )

    @staticmethod
    def load(clusters: "DataFrame | ClusterModel") -> "ClusterModel":
        """The whole model; an error for a table past the bound."""
        parts = list(ClusterModel.pieces(clusters)) if isinstance(clusters, ClusterModel) else []
        if not parts:
            walk = ClusterModel.pieces(clusters)
            first = next(walk, None)
            if first is None:
                raise ClusterError("The cluster table is empty")
            if next(walk, None) is not None:
                raise ClusterError("The cluster table is past the size bound of a model")
            parts = [first]
        return parts[0]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.ids, self.centroids, self.majority, self.n_train, strict=True))
        return local_table(spark, rows, CLUSTER_SCHEMA)

    def others(self, majority: int) -> list[int]:
        """Ids of the clusters whose majority label differs."""
        return [i for i, m in zip(self.ids, self.majority, strict=True) if m != majority]

    @property
    def dim(self) -> int:
        return len(self.centroids[0])


def as_matrix(v: pa.Array) -> np.ndarray:
    """An Arrow list column as a dense matrix (rows x dimensions), without copying rows."""
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(v), -1) if len(v) else np.empty((0, 0))


def from_matrix(m: np.ndarray) -> pa.Array:
    """A dense matrix as an Arrow list column."""
    offsets = np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)[: len(m) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances, centroids x rows; each dimension is one vector operation."""
    columns = np.ascontiguousarray(points.T)
    out = np.zeros((len(centres), len(points)))
    for total, centre in zip(out, centres, strict=True):
        for x, c in zip(columns, centre, strict=True):
            d = x - c
            total += d * d
    return np.sqrt(out)


def closest(d: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lowest distance per row and its position (first on ties); inf where nothing is allowed."""
    masked = d if allowed is None else np.where(allowed, d, np.inf)
    at = masked.argmin(axis=0)
    return masked[at, np.arange(d.shape[1])], at


def _nullable(dist: np.ndarray, ids: np.ndarray) -> pa.StructArray:
    empty = ~np.isfinite(dist)
    return pa.StructArray.from_arrays(
        [pa.array(dist), pa.array(ids.astype(np.int32))], names=["d", "id"], mask=pa.array(empty)
    )


def _candidates(piece: ClusterModel):
    """Best of any / same / other label among one piece of the centroids."""
    ids, centres, majority = np.array(piece.ids), np.array(piece.centroids), np.array(piece.majority)

    @F.arrow_udf(f"struct<any:{CANDIDATE},same:{CANDIDATE},other:{CANDIDATE}>")
    def best(z: pa.Array, y: pa.Array) -> pa.Array:
        if not len(z):
            parts = [_nullable(np.empty(0), np.empty(0, int))] * 3
        else:
            d = distances(as_matrix(z), centres)
            same = majority[:, None] == y.to_numpy(zero_copy_only=False)[None, :]
            parts = []
            for allowed in (None, same, ~same):
                value, at = closest(d, allowed)
                parts.append(_nullable(value, ids[at]))
        return pa.StructArray.from_arrays(parts, names=["any", "same", "other"])

    return best


def _improve(df: DataFrame, piece: ClusterModel, z: str, y: str, first: bool) -> DataFrame:
    df = df.withColumn("_found", _candidates(piece)(F.col(f"`{z}`"), F.col(f"`{y}`").cast("int")))
    new = {n: F.col(f"_found.{n[1:]}") for n in ("_any", "_same", "_other")}
    if not first:
        new = {n: F.least(F.col(n), c) for n, c in new.items()}
    return df.withColumns(new).drop("_found")


def _finish(df: DataFrame, keep: list[str]) -> DataFrame:
    """Fallbacks: no same-label cluster -> nearest of all (for both roles, as then
    all clusters are of another label); no other-label cluster -> the positive one."""
    positive = F.coalesce(F.col("_same"), F.col("_any"))
    negative = F.coalesce(F.col("_other"), positive)
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        positive.getField("id").alias("pos"),
        negative.getField("id").alias("neg"),
        positive.getField("d").alias("pos_dist"),
        negative.getField("d").alias("neg_dist"),
    )


def assign(
    df: DataFrame, clusters: "DataFrame | ClusterModel", keys: list[str] | None = None, z: str = "z", y: str = "y"
) -> DataFrame:
    """Add ``pos, neg, pos_dist, neg_dist``; ties go to the lowest cluster id.

    With ``keys`` the cluster table holds one set of clusters per variant.
    """
    keep = [c for c in df.columns if c not in ("pos", "neg", "pos_dist", "neg_dist")]
    if keys:
        return _assign_keyed(df, clusters, keys, z, y, keep)
    first = True
    for piece in ClusterModel.pieces(clusters):
        df = _improve(df, piece, z, y, first)
        first = False
    if first:
        raise ClusterError("The cluster table is empty")
    return _finish(df, keep)


def _assign_keyed(df: DataFrame, clusters: DataFrame, keys: list[str], z: str, y: str, keep: list[str]) -> DataFrame:
    """Variants differ in their centroids.

    While all variants together stay within the size bound of a model, each
    row only carries the number of its variant and stays map-side.  Past the bound every row meets
    the packed centroids of its variant in a join.
    """
    models = _variant_models(clusters, keys)
    if models is not None:
        table, by_variant = models
        numbered = (
            df.alias("l").join(bounded_side(table).alias("r"), same_key("l", "r", keys)).select("l.*", "r._variant")
        )
        found = _variant_candidates(by_variant)(F.col(f"`{z}`"), F.col(f"`{y}`").cast("int"), F.col("_variant"))
        return _finish(
            numbered.withColumn("_found", found)
            .withColumns({n: F.col(f"_found.{n[1:]}") for n in ("_any", "_same", "_other")}),
            keep,
        )
    packed = clusters.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("cluster_id", "majority_y", "centroid"))).alias("_cs")
    )
    joined = (
        df.alias("l").join(bounded_side(packed, 10_000).alias("r"), same_key("l", "r", keys)).select("l.*", "r._cs")
    )
    found = F.transform("_cs", lambda c: F.struct(
        distance(F.col(f"`{z}`"), c["centroid"]).alias("d"),
        c["cluster_id"].alias("id"),
        c["majority_y"].alias("majority"),
    ))
    label = F.col(f"`{y}`")

    def least(allowed=None):
        of = F.col("_all") if allowed is None else F.filter("_all", allowed)
        best = F.array_min(of)
        return F.when(best.isNotNull(), F.struct(best["d"].alias("d"), best["id"].alias("id")))

    return _finish(
        joined.withColumn("_all", found).withColumns({
            "_any": least(), "_same": least(lambda c: c["majority"] == label), "_other": least(lambda c: c["majority"] != label),
        }),
        keep,
    )


def _variant_models(clusters: DataFrame, keys: list[str]) -> tuple[DataFrame, dict[int, ClusterModel]] | None:
    """Numbered variants and their models, or None past the size bound."""
    rows = bounded_rows(clusters.select(*keys, "cluster_id", "centroid", "majority_y", "n_train"))
    if rows is None or sum(len(r.centroid) for r in rows) > MAX_CENTROID_VALUES:
        return None
    grouped: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: r.cluster_id):
        grouped.setdefault(tuple(r[k] for k in keys), []).append(r)
    schema = T.StructType([clusters.schema[k] for k in keys] + [T.StructField("_variant", T.IntegerType())])
    table = clusters.sparkSession.createDataFrame([(*key, i) for i, key in enumerate(grouped)], schema)
    return table, {i: ClusterModel._of(part) for i, part in enumerate(grouped.values())}


def _variant_candidates(models: dict[int, ClusterModel]):
    state = {
        i: (np.array(m.ids), np.array(m.centroids), np.array(m.majority)) for i, m in models.items()
    }

    @F.arrow_udf(f"struct<any:{CANDIDATE},same:{CANDIDATE},other:{CANDIDATE}>")
    def best(z: pa.Array, y: pa.Array, variant: pa.Array) -> pa.Array:
        n = len(z)
        value, ids = np.full((3, n), np.inf), np.zeros((3, n), int)
        labels, which, points = y.to_numpy(zero_copy_only=False), variant.to_numpy(zero_copy_only=False), as_matrix(z)
        for v in np.unique(which):
            rows = np.flatnonzero(which == v)
            own, centres, majority = state[int(v)]
            d = distances(points[rows], centres)
            same = majority[:, None] == labels[rows][None, :]
            for i, allowed in enumerate((None, same, ~same)):
                value[i, rows], at = closest(d, allowed)
                ids[i, rows] = own[at]
        return pa.StructArray.from_arrays([_nullable(value[i], ids[i]) for i in range(3)], names=["any", "same", "other"])

    return best


def nearest(df: DataFrame, clusters: "DataFrame | ClusterModel", z: str = "z", out: str = "cluster_id") -> DataFrame:
    """Nearest centroid regardless of labels."""
    keep = [c for c in df.columns if c not in (out, f"{out}_dist")]
    first = True
    work = df
    for piece in ClusterModel.pieces(clusters):
        new = _nearest_of(piece)(F.col(f"`{z}`"))
        work = work.withColumn("_new", new)
        work = work.withColumn("_any", F.col("_new") if first else F.least("_any", "_new")).drop("_new")
        first = False
    if first:
        raise ClusterError("The cluster table is empty")
    return work.select(
        *[F.col(f"`{c}`") for c in keep], F.col("_any.id").alias(out), F.col("_any.d").alias(f"{out}_dist")
    )


def _nearest_of(piece: ClusterModel):
    ids, centres = np.array(piece.ids), np.array(piece.centroids)

    @F.arrow_udf(CANDIDATE)
    def best(z: pa.Array) -> pa.Array:
        if not len(z):
            return _nullable(np.empty(0), np.empty(0, int))
        value, at = closest(distances(as_matrix(z), centres))
        return _nullable(value, ids[at])

    return best


def negative_counts(assigned: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Test rows per (positive, negative) cluster; only pairs that occur."""
    return assigned.groupBy(*(keys or []), "pos", "neg").agg(F.count(F.lit(1)).alias("n"))


def negative_grid(
    assigned: DataFrame, clusters: "DataFrame | ClusterModel", keys: list[str] | None = None
) -> DataFrame:
    """Zero-filled counts for every cluster and every other-label cluster.

    The grid is expanded from the model on each variant row, not joined from
    two tables.
    """
    keys = keys or []
    model = ClusterModel.load(clusters)
    spark = assigned.sparkSession
    cells = local_table(spark, [(i, m, model.others(m)) for i, m in zip(model.ids, model.majority, strict=True)],
        "pos int, majority_y int, negs array<int>",
    ).select("pos", "majority_y", F.explode("negs").alias("neg"))
    counts = negative_counts(assigned, keys)
    if keys:
        packed = [r.asDict() for r in cells.collect()]
        whole = F.array(*[
            F.struct(*[F.lit(r[c]).alias(c) for c in ("pos", "majority_y", "neg")]) for r in packed
        ])
        cells = counts.select(*keys).distinct().select(*keys, F.explode(whole).alias("_c")).select(*keys, "_c.*")
    return (
        cells.alias("l")
        .join(counts.alias("r"), same_key("l", "r", [*keys, "pos", "neg"]), "left")
        .select("l.*", F.coalesce(F.col("r.n"), F.lit(0)).cast("bigint").alias("n"))
    )
