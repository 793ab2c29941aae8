"""One-sided Kolmogorov-Smirnov statistics, keyed and distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import ROWS_PER_BUCKET, running, running_sum

TEST, TRAIN = "test", "train"


def value_counts(
    df: DataFrame, value: str, side: str, keys: list[str], bins: float | None = None
) -> DataFrame:
    """Test and train counts per distinct value: a mergeable partial.

    ``bins`` rounds the values up to a grid of that width, which bounds the number of
    distinct values; the statistic then errs by at most the mass of one grid cell.
    """
    v = F.col(value) + F.lit(0.0)
    if bins:
        v = F.ceil(v / F.lit(bins)) * F.lit(bins)
    return df.groupBy(*keys, v.cast("double").alias("value")).agg(
        F.count_if(F.col(side) == TEST).alias("n_test"),
        F.count_if(F.col(side) == TRAIN).alias("n_train"),
    )


def merge_counts(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Add up partial value counts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys, "value").agg(F.sum("n_test").alias("n_test"), F.sum("n_train").alias("n_train"))


def _gap(alternative: str, test: Column, train: Column) -> Column:
    gaps = {"greater": test - train, "less": train - test, "two-sided": F.abs(test - train)}
    if alternative not in gaps:
        raise ValueError(f"Unknown alternative: {alternative}")
    return gaps[alternative]


def ks_from_counts(
    counts: DataFrame, keys: list[str], alternative: str = "greater", rows_per_bucket: int = ROWS_PER_BUCKET,
    n_rows: int | None = None,
) -> DataFrame:
    """``ks`` per key from distinct-value counts; 0 where a side is empty."""
    # The ordering reads the counts more than once (quantiles, bucket totals, curves).
    one = counts.withColumn("_one", F.lit(0)).persist()
    joined = running(
        one, [*keys, "_one"], "value", {"_ct": ("sum", "n_test"), "_cr": ("sum", "n_train")}, rows_per_bucket, n_rows,
        totals={"_nt": "n_test", "_nr": "n_train"},
    )
    both = (F.col("_nt") > 0) & (F.col("_nr") > 0)
    gap = _gap(alternative, F.col("_ct") / F.col("_nt"), F.col("_cr") / F.col("_nr"))
    stat = F.max(F.when(both, gap))
    return joined.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(stat, F.lit(0.0)))).alias("ks"),
        F.max("_nt").alias("n_test"),
        F.max("_nr").alias("n_train"),
    )


def ks(
    df: DataFrame,
    value: str,
    side: str = "side",
    keys: list[str] | None = None,
    alternative: str = "greater",
    bins: float | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """KS statistic between the test and train values of every key.

    Equal values collapse before anything is ordered, so a value shared by many
    rows costs one row from there on.
    """
    keys = keys or []
    return ks_from_counts(value_counts(df, value, side, keys, bins), keys, alternative, rows_per_bucket)


def proximity(assigned: DataFrame, keys: list[str] | None = None, alternative: str = "greater",
              bins: float | None = None) -> DataFrame:
    """KS of negative-cluster distances per positive cluster of rows with a ``side``."""
    keys = keys or []
    return ks(assigned, "neg_dist", "side", [*keys, "pos"], alternative, bins).withColumnRenamed("ks", "proximity")


def hull(test: np.ndarray, train: np.ndarray) -> list[int]:
    """Places of the points of a curve that some a * test - b * train with a, b > 0 is largest at."""
    kept: list[int] = []
    for i in np.lexsort((-test, train)).tolist():
        if kept and test[i] <= test[kept[-1]]:
            continue
        while len(kept) > 1:
            (x0, y0), (x1, y1) = ((int(train[k]), int(test[k])) for k in kept[-2:])
            if (y1 - y0) * (int(train[i]) - x0) > (int(test[i]) - y0) * (x1 - x0):
                break
            kept.pop()
        kept.append(i)
    return kept


def corners(points: DataFrame) -> DataFrame:
    """``pos, bin, _ct, _cr`` reduced, batch by batch, to what a maximum over a (cluster, bin) can be taken at.

    The curve of a subset is a * _ct - b * _cr + c with its own a, b > 0, so its maximum lies on the convex hull, and the
    hull of all rows is within the hulls of any parts of them.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            keep = [places[k] for places in rows.groupby(["pos", "bin"]).indices.values()
                    for k in hull(rows["_ct"].to_numpy()[places], rows["_cr"].to_numpy()[places])]
            yield batch.take(pa.array(keep, type=pa.int64()))

    return points.mapInArrow(fold, points.schema)


def ks_by_bin(binned: DataFrame, train: DataFrame, n_bins: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Proximity of every cumulative subset: ``bin, pos, ks``.

    ``binned`` holds test rows ``pos, neg_dist, bin`` where subset p is all rows
    with ``bin <= p`` and bins grow with falling distance; ``train`` holds
    ``pos, neg_dist``.  Rows outside subset p of a cluster lie below all of its
    members, so the test curve of subset p is the full curve minus a constant,
    rescaled.  One running sum therefore serves all subsets; rows at which no
    subset can have its maximum go, and the maxima are taken side by side.
    """
    test = binned.groupBy("pos", F.col("neg_dist").alias("value")).agg(
        F.count(F.lit(1)).alias("n_test"), F.min("bin").alias("bin")
    ).withColumn("n_train", F.lit(0).cast("bigint"))
    base = train.groupBy("pos", F.col("neg_dist").alias("value")).agg(
        F.count(F.lit(1)).alias("n_train")
    ).select("pos", "value", F.lit(0).cast("bigint").alias("n_test"), F.lit(None).cast("int").alias("bin"), "n_train")
    counts = test.unionByName(base).groupBy("pos", "value").agg(
        F.sum("n_test").alias("n_test"), F.sum("n_train").alias("n_train"), F.min("bin").alias("bin")
    ).persist()
    run = running_sum(counts, ["pos"], "value", {"_ct": "n_test", "_cr": "n_train"}, rows_per_bucket)
    # Members of every (cluster, bin), accumulated into one array per cluster:
    # a table of clusters x bins whatever the number of rows.
    per_bin = binned.groupBy("pos", "bin").agg(F.count(F.lit(1)).alias("n"))
    grown = W.partitionBy("pos").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    sizes = per_bin.withColumn("n_in", F.sum("n").over(grown)).groupBy("pos").agg(
        F.collect_list(F.struct("bin", "n_in")).alias("_e"), F.sum("n").alias("_nt")
    )
    n_train = train.groupBy("pos").agg(F.count(F.lit(1)).alias("_nr"))
    inside = F.transform(
        F.sequence(F.lit(1), F.lit(n_bins)),
        lambda p: F.coalesce(
            F.array_max(F.transform(F.filter("_e", lambda e: e["bin"] <= p), lambda e: e["n_in"])), F.lit(0)
        ),
    )
    filled = sizes.join(n_train, "pos", "left").select(
        "pos", "_nt", F.coalesce("_nr", F.lit(0)).alias("_nr"), inside.alias("_in")
    )
    points = (
        corners(run.filter(F.col("n_test") > 0).select("pos", "bin", "_ct", "_cr")).alias("l")
        .join(filled.alias("r"), "pos")
        .select("pos", "l.bin", "l._ct", "l._cr", "r._nt", "r._nr", "r._in")
    )
    members = [F.col("_in")[p - 1] for p in range(1, n_bins + 1)]
    peaks = [
        F.max(F.when(
            (F.col("bin") <= p) & (F.col("_nr") > 0),
            (F.col("_ct") - (F.col("_nt") - members[p - 1])) / members[p - 1] - F.col("_cr") / F.col("_nr"),
        )).alias(f"_p{p}")
        for p in range(1, n_bins + 1)
    ]
    wide = points.groupBy("pos").agg(*peaks)
    return wide.select(
        F.col("pos").alias("_cluster"),
        F.posexplode(F.array(*[F.coalesce(F.col(f"_p{p}"), F.lit(0.0)) for p in range(1, n_bins + 1)])).alias("_i", "_ks"),
    ).select(
        (F.col("_i") + 1).alias("bin"), F.col("_cluster").alias("pos"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_ks"))).alias("ks"),
    )
