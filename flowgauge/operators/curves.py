"""Proximity of a fixed test set plus a batch, from a summary of the fixed curves.

The statistic of a cluster is the largest gap of the test curve over the train curve.  A batch adds test rows, so between
two of its values the gap is a * test - b * train + c with a, b > 0 of its own, and is largest at a corner of the convex
hull of the fixed (train, test) counts there.  The summary of a cluster is a tree over its distinct values: a leaf holds
``fan`` values with the counts up to each of them, a node above holds for each of ``fan`` children its first value and its
hull.  Hulls merge: that of a node is the hull of its children's.

A batch goes down to the leaves its values fall into.  A node answers for the children it does not touch by their hulls and
hands on how many batch rows lie before each child it does; a leaf answers by its values.  What is shuffled are rows of
batches and, per batch, the nodes it touches; the fixed values stay where they are partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import written
from ..functions.ordering import running
from .proximity import hull

FAN = 512
_POINTS = "array<struct<t:bigint,r:bigint>>"
_ANSWER = "struct<peak:double,down:array<struct<slot:int,before:bigint>>>"


@dataclass
class CurveSummary:
    """Levels of ``pos, node, lows, ...``, leaves first, and the rows of both sides per cluster."""

    leaves: DataFrame  # pos, node, lows, points (t, r up to each value), t0, r0 (before the first)
    inner: list[DataFrame]  # pos, node, lows, hulls of the children
    totals: DataFrame  # pos, n_test, n_train
    fan: int

    def release(self) -> None:
        """Give up the memory that holds the summary."""
        for level in [self.leaves, *self.inner, self.totals]:
            level.unpersist()


def _hulls(points: pa.Array) -> pa.Array:
    out = []
    for some in points.to_pylist():
        tests, trains = (np.array([p[c] for p in some], dtype=np.int64) for c in ("t", "r"))
        out.append([{"t": int(tests[k]), "r": int(trains[k])} for k in hull(tests, trains)])
    return pa.array(out, type=pa.list_(pa.struct([("t", pa.int64()), ("r", pa.int64())])))


def curve_summary(values: DataFrame, fan: int = FAN) -> CurveSummary:
    """The summary of ``pos, value, n_test, n_train`` (values are distinct within a cluster)."""
    sums = {"t": ("sum", "n_test"), "r": ("sum", "n_train"), "rank": ("sum", "_one")}
    points = running(values.withColumn("_one", F.lit(1)), ["pos"], "value", sums)
    packed = (points.withColumn("node", F.floor((F.col("rank") - 1) / fan)).groupBy("pos", "node")
              .agg(F.array_sort(F.collect_list(F.struct("value", "t", "r", "n_test", "n_train"))).alias("p")))
    first = F.col("p")[0]
    # partitioned by what batches are joined on, so that only batches move
    leaves = packed.select(
        "pos", "node", F.col("p.value").alias("lows"),
        F.transform("p", lambda x: F.struct(x["t"].alias("t"), x["r"].alias("r"))).alias("points"),
        (first["t"] - first["n_test"]).alias("t0"), (first["r"] - first["n_train"]).alias("r0")).persist()
    hulled = F.arrow_udf(_hulls, _POINTS)
    level, inner = leaves.select("pos", "node", F.col("lows")[0].alias("low"), hulled("points").alias("hull")), []
    while True:
        above = (level.groupBy("pos", F.floor(F.col("node") / fan).alias("node"))
                 .agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("child"), "low", "hull"))).alias("c"))
                 .select("pos", "node", F.col("c.low").alias("lows"), F.col("c.hull").alias("hulls")).persist())
        inner.append(above)
        if not (above.agg(F.max("node")).first()[0] or 0):
            break
        level = above.select("pos", "node", F.col("lows")[0].alias("low"), hulled(F.flatten("hulls")).alias("hull"))
    totals = values.groupBy("pos").agg(F.sum("n_test").alias("n_test"), F.sum("n_train").alias("n_train")).persist()
    return CurveSummary(leaves, inner, totals, fan)


def _upto(value: Column) -> Column:
    """How many of a node's ``lows`` are at most the value."""
    return F.aggregate("lows", F.lit(0), lambda n, low: n + F.when(low <= value, 1).otherwise(0))


def _inner(a: pa.Array, b: pa.Array, before: pa.Array, slots: pa.Array, hulls: pa.Array) -> pa.Array:
    """The largest gap in the untouched children of a node, and the batch rows before each touched one."""
    out = []
    for alpha, beta, start, own, children in zip(*(c.to_pylist() for c in (a, b, before, slots, hulls)), strict=True):
        added = np.zeros(len(children), dtype=np.int64)
        for x in own:
            added[x["slot"]] = x["n"]
        ahead = start + np.cumsum(added) - added
        peaks = [alpha * (p["t"] + int(ahead[k])) - beta * p["r"]
                 for k, points in enumerate(children) if not added[k] for p in points]
        out.append({"peak": max(peaks, default=None),
                    "down": [{"slot": int(k), "before": int(ahead[k])} for k in np.flatnonzero(added)]})
    down = pa.list_(pa.struct([("slot", pa.int32()), ("before", pa.int64())]))
    return pa.array(out, type=pa.struct([("peak", pa.float64()), ("down", down)]))


def _leaf(a: pa.Array, b: pa.Array, before: pa.Array, slots: pa.Array, points: pa.Array, t0: pa.Array, r0: pa.Array) -> pa.Array:
    """The largest gap in a leaf; slot 2i + 1 is value i, slot 2i + 2 what follows it, slot 0 what comes before all."""
    out = []
    for alpha, beta, start, own, some, t, r in zip(
            *(c.to_pylist() for c in (a, b, before, slots, points, t0, r0)), strict=True):
        tests = np.repeat([t, *(p["t"] for p in some)], 2)[1:]
        trains = np.repeat([r, *(p["r"] for p in some)], 2)[1:]
        added = np.zeros(len(tests), dtype=np.int64)
        for x in own:
            added[x["slot"]] = x["n"]
        out.append(float((alpha * (tests + start + np.cumsum(added)) - beta * trains).max()))
    return pa.array(out, type=pa.float64())


def slot_counts(base: CurveSummary, added: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pos, node, slot, n``: where the rows of ``keys, pos, value, n`` fall among the fixed values.

    Within a slot only the number of added rows matters, so counts of disjoint rows add up, and there are at most two
    slots per fixed value and one before them all.  Rows of clusters without fixed values fall nowhere.
    """
    rows = added.withColumn("node", F.lit(0).cast("bigint"))
    for level in reversed(base.inner):
        child = F.greatest(_upto(F.col("value")) - 1, F.lit(0))
        rows = (rows.join(level.select("pos", "node", "lows"), ["pos", "node"])
                .select(*keys, "pos", "value", "n", (F.col("node") * base.fan + child).alias("node")))
    upto = _upto(F.col("value"))
    placed = rows.join(base.leaves.select("pos", "node", "lows"), ["pos", "node"]).select(
        *keys, "pos", "node", "n", (2 * upto - F.when(F.get("lows", upto - 1) == F.col("value"), 1).otherwise(0)).alias("slot"))
    return placed.groupBy(*keys, "pos", "node", "slot").agg(F.sum("n").alias("n"))


def ks_from_slots(base: CurveSummary, counts: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pos, ks``: fixed test rows plus the rows counted by slot; ``sizes`` (keys, pos, n) has how many those are."""
    by = [*keys, "pos"]
    scale = (sizes.join(base.totals, "pos", "left")
             .select(*by, (1 / (F.coalesce("n_test", F.lit(0)) + F.col("n"))).alias("a"),
                     F.when(F.col("n_train") > 0, 1 / F.col("n_train")).alias("b")))
    touched = [counts]
    for _ in base.inner:
        below = touched[-1].groupBy(*by, "node").agg(F.sum("n").alias("n"))
        touched.append(below.select(*by, F.floor(F.col("node") / base.fan).alias("node"), "n",
                                    F.pmod("node", F.lit(base.fan)).cast("int").alias("slot")))
    # a node has at most ``fan`` children, a leaf twice as many slots
    slots = [t.groupBy(*by, "node").agg(F.collect_list(F.struct("slot", "n")).alias("slots")) for t in touched]

    front = slots[-1].join(scale, by).withColumn("before", F.lit(0).cast("bigint"))
    inner, leaf = F.arrow_udf(_inner, _ANSWER), F.arrow_udf(_leaf, "double")
    peaks = []
    for level, below in zip(reversed(base.inner), reversed(slots[:-1]), strict=True):
        met = front.where("b is not null").join(level.select("pos", "node", "hulls"), ["pos", "node"])
        told = written(met.select(*by, "node", "a", "b", inner("a", "b", "before", "slots", "hulls").alias("x")), "batch-nodes")
        peaks.append(told.select(*by, F.col("x.peak").alias("peak")))
        down = told.select(*by, "node", "a", "b", F.inline("x.down")).select(
            *by, (F.col("node") * base.fan + F.col("slot")).alias("node"), "a", "b", "before")
        front = below.join(down, [*by, "node"])
    met = front.join(base.leaves.select("pos", "node", "points", "t0", "r0"), ["pos", "node"])
    peaks.append(met.select(*by, leaf("a", "b", "before", "slots", "points", "t0", "r0").alias("peak")))
    best = reduce(DataFrame.unionByName, peaks).groupBy(*by).agg(F.max("peak").alias("peak"))
    ks = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("peak", F.lit(0.0))))
    return scale.select(*by).join(best, by, "left").select(*by, ks.alias("ks"))


def ks_with_batches(base: CurveSummary, added: DataFrame, batch: str = "batch") -> DataFrame:
    """``batch, pos, ks`` of the fixed test rows plus a batch, for every cluster that a batch touches.

    ``added`` holds ``batch, pos, value, n``: the test rows of each batch.
    """
    added = written(added, "batch-values")
    sizes = added.groupBy(batch, "pos").agg(F.sum("n").alias("n"))
    return ks_from_slots(base, written(slot_counts(base, added, [batch]), "batch-leaves"), sizes, [batch])
