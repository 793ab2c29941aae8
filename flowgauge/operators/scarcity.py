"""Gini coefficient and scarcity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bounded import bounded_side
from ..functions.ordering import running_sum
from .assign import ClusterModel, negative_counts


def _gini_value(n: Column, total: Column, weighted: Column, corrected: bool) -> Column:
    """``weighted`` is the sum over ascending positions i of (n - i + 1) * x_i."""
    raw = (n + 1 - 2 * weighted / total) / n
    fixed = F.when(n > 1, raw * n / (n - 1)).otherwise(raw) if corrected else raw
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fixed))
    return F.when((n > 0) & (total > 0), clipped).otherwise(F.lit(0.0))


def gini(
    df: DataFrame, count_col: str, keys: list[str] | None = None, corrected: bool = True
) -> DataFrame:
    """Gini coefficient of a count column per key; zeros must be present.

    Equal counts form one group of m values, so the ordering runs over distinct
    counts only.
    """
    keys = keys or []
    distinct = (
        df.groupBy(*keys, F.col(count_col).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("_one", F.lit(0))
    )
    run = running_sum(distinct, [*keys, "_one"], "x", {"upto": "m"})
    # Positions upto-m+1 .. upto hold x: sum of (n-i+1) = m*(n+1) - m*(2*upto-m+1)/2.
    half = F.col("m") * (2 * F.col("upto") - F.col("m") + 1) / 2
    sums = run.groupBy(*keys).agg(
        F.sum("m").alias("n"),
        F.sum(F.col("x") * F.col("m")).alias("total"),
        F.sum(F.col("x") * F.col("m")).alias("xm"),
        F.sum(F.col("x") * half).alias("xi"),
    )
    weighted = F.col("xm") * (F.col("n") + 1) - F.col("xi")
    return sums.select(
        *keys, _gini_value(F.col("n"), F.col("total"), weighted, corrected).alias("gini")
    )


def scarcity_from_grid(grid: DataFrame, keys: list[str] | None = None, corrected: bool = True) -> DataFrame:
    """1 - Gini over the zero-filled grid; 0 for a cluster without any counted row."""
    keys = [*(keys or []), "pos"]
    totals = grid.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return (
        gini(grid, "n", keys, corrected)
        .join(totals, keys)
        .select(*keys, F.when(F.col("_t") > 0, 1 - F.col("gini")).otherwise(F.lit(0.0)).alias("scarcity"))
    )


def scarcity(
    assigned: DataFrame, clusters: "DataFrame | ClusterModel", keys: list[str] | None = None,
    corrected: bool = True, keyed_clusters: bool = False,
) -> DataFrame:
    """Scarcity per positive cluster of test rows (see ``scarcity_from_counts``)."""
    return scarcity_from_counts(negative_counts(assigned, keys), clusters, keys, corrected, keyed_clusters)


def scarcity_from_counts(
    counts: DataFrame, clusters: "DataFrame | ClusterModel", keys: list[str] | None = None,
    corrected: bool = True, keyed_clusters: bool = False,
) -> DataFrame:
    """Scarcity per positive cluster straight from the counts that occur.

    Absent cells only shift positions: with ``width`` other-label clusters and r
    counted ones, the zeros take the first width - r places.  So the zero-filled
    grid is never built, and the work follows the rows, not clusters squared.
    Clusters without test rows do not appear (they score 0).
    """
    keys = keys or []
    if isinstance(clusters, ClusterModel):
        clusters = clusters.table(counts.sparkSession)
    own_keys = keys if keyed_clusters else []
    everything = W.partitionBy(*own_keys) if own_keys else W.partitionBy(F.lit(0))
    info = bounded_side(
        clusters.withColumn("_size", F.count(F.lit(1)).over(everything))
        .withColumn("width", F.col("_size") - F.count(F.lit(1)).over(W.partitionBy(*own_keys, "majority_y")))
        .select(*own_keys, F.col("cluster_id").alias("pos"), "majority_y", "width")
    )
    own = counts.join(info, [*own_keys, "pos"])
    theirs = info.select(*own_keys, F.col("pos").alias("neg"), F.col("majority_y").alias("_neg_y"))
    counted = own.join(theirs, [*own_keys, "neg"]).filter(F.col("_neg_y") != F.col("majority_y"))
    # At most one row per pair of clusters and variant reaches this window.
    w = W.partitionBy(*keys, "pos").orderBy("n", "neg")
    r = F.count(F.lit(1)).over(W.partitionBy(*keys, "pos"))
    place = F.col("width") - r + F.row_number().over(w)
    sums = (
        counted.withColumn("_place", place)
        .groupBy(*keys, "pos")
        .agg(
            F.max("width").alias("width"),
            F.sum("n").cast("double").alias("total"),
            F.sum((F.col("width") - F.col("_place") + 1) * F.col("n")).cast("double").alias("weighted"),
        )
    )
    g = _gini_value(F.col("width"), F.col("total"), F.col("weighted"), corrected)
    return sums.select(*keys, "pos", (1 - g).alias("scarcity"))
