"""Distributed ranks, running sums and order statistics.

The keys of this library (cluster, class, seed) are few and skewed, so a plain
``Window.partitionBy(key).orderBy(value)`` would sort most of a table in one
task.  Here the value axis is cut into buckets that are a fixed function of the
value (quantile bounds found once), windows run inside (key, bucket), and the
bucket totals - a small table - supply the offsets.  Values so frequent that
they would fill a bucket by themselves get a bucket of their own, which for
ranks is split again by the tie-break hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bounded import MAX_BROADCAST_ROWS, bounded_side
from .hashing import hash_hex

ROWS_PER_BUCKET = 1_000_000
#: Bounds that one pass of quantiles gives; past it every interval is cut again.
MAX_BUCKETS = 8192
#: Bounds that the pass that counts the rows gives; only more buckets than these take a pass of their own.
COARSE_BOUNDS = 2048
#: Leading hex digits of a hash that cells are cut by, and the most of them (a repeated hash is never cut apart).
FIRST_DIGITS, MOST_DIGITS = 3, 15


def cut_by_digits(
    cells: Callable[[int], DataFrame], digits: int = FIRST_DIGITS, rows_per_cell: int = ROWS_PER_BUCKET, count: str = "_n",
) -> tuple[DataFrame, int]:
    """The table of cells, as a join side, with as many digits as it takes for no cell to pass ``rows_per_cell``.

    ``cells`` makes the table for a number of digits; its ``count`` column is looked at where the table is collected for
    the join anyway, and by an aggregate where it is too large for that.
    """
    while True:
        table = cells(digits)
        found = table.limit(MAX_BROADCAST_ROWS + 1).toArrow()
        small = found.num_rows <= MAX_BROADCAST_ROWS
        most = max(found.column(count).to_pylist(), default=0) if small else table.agg(F.max(count)).first()[0]
        if (most or 0) <= rows_per_cell or digits >= MOST_DIGITS:
            side = F.broadcast(table.sparkSession.createDataFrame(found, table.schema)) if small else table
            return side, digits
        # a hash is uniform, so so many more digits are enough
        digits = min(MOST_DIGITS, digits + max(1, math.ceil(math.log(most / rows_per_cell, 16))))


def same_key(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality on all keys between two aliased sides."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return cond


def value_bounds(
    df: DataFrame, value: Column, rows_per_bucket: int = ROWS_PER_BUCKET, n_rows: int | None = None
) -> list[float]:
    """Ascending quantile bounds that cut ``value`` into buckets of bounded size.

    Empty for inputs that fit one bucket.  The bounds only steer balance; any
    bounds give the same result.  One pass counts the rows and takes a first set of quantiles;
    only a table past their resolution is read once more.
    """
    if n_rows is not None and n_rows <= rows_per_bucket:
        return []
    def quantiles(count: int) -> Column:
        return F.percentile_approx(value, [i / count for i in range(1, count)], max(10_000, 4 * count))

    coarse = COARSE_BOUNDS
    first = df.agg(F.count(F.lit(1)).alias("n"), quantiles(coarse).alias("q")).first()
    buckets = min(MAX_BUCKETS, math.ceil(first.n / rows_per_bucket))
    if buckets <= 1:
        return []
    found = first.q
    if first.n > MAX_BUCKETS * rows_per_bucket:
        found = _fine_bounds(df, value, df.agg(quantiles(MAX_BUCKETS).alias("q")).first().q, rows_per_bucket)
    elif buckets > coarse:
        found = df.agg(quantiles(buckets).alias("q")).first().q
    elif buckets < coarse:
        found = [found[round(i * coarse / buckets) - 1] for i in range(1, buckets)] if found else []
    return sorted({float(v) for v in found or [] if v is not None and math.isfinite(v)})


def _fine_bounds(df: DataFrame, value: Column, bounds: list[float], rows_per_bucket: int) -> list[float]:
    """More bounds inside the intervals of ``bounds`` that hold too many rows: quantiles by interval, in one pass."""
    cuts = sorted({float(v) for v in bounds if v is not None and math.isfinite(v)})
    inside = with_bucket(df.select(value.cast("double").alias("_v")), "_v", cuts, "_b").filter(F.col("_b") % 2 == 1)
    parts = 64
    fine = (inside.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
        "_v", [i / parts for i in range(1, parts)], 10_000).alias("q")).filter(F.col("n") > rows_per_bucket))
    # at most as many rows as there are bounds
    return [*cuts, *[v for r in fine.select("q").collect() for v in r.q]]


def with_bucket(df: DataFrame, value: str, bounds: list[float], out: str) -> DataFrame:
    """Bucket number, ascending with ``value``; a bound itself has its own bucket.

    Interval i between two bounds gets 2i+1, the bound that opens it gets 2i.
    """
    if not bounds:
        return df.withColumn(out, F.lit(1))
    splits = [-math.inf, *bounds, math.inf]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep")
    opened = F.get(F.lit([float("-inf"), *bounds]), F.col(out).cast("int"))
    return cut.transform(df).withColumn(
        out, (2 * F.col(out) + F.when(F.col(value) == opened, 0).otherwise(1)).cast("int")
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    aggregates: dict[str, tuple[str, str]],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    n_rows: int | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running aggregates in ascending order of ``order``.

    ``aggregates`` maps an output name to (``sum`` | ``min`` | ``max``, column).
    ``totals`` maps further names to columns whose sum over the whole key is
    wanted on every row.  ``order`` must be distinct within a key (aggregate
    equal values first).
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    totals = totals or {}
    bounds = value_bounds(df, F.col(order).cast("double"), rows_per_bucket, n_rows)
    whole = W.partitionBy(*keys)
    if not bounds:
        w = whole.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        everything = whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return df.withColumns({
            **{o: fold[f](c).over(w) for o, (f, c) in aggregates.items()},
            **{o: F.sum(c).over(everything) for o, c in totals.items()},
        })
    tagged = with_bucket(df.withColumn("_axis", F.col(order).cast("double")), "_axis", bounds, "_bucket")
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_bucket")
        .agg(
            *[fold[f](c).alias(f"_t_{o}") for o, (f, c) in aggregates.items()],
            *[F.sum(c).alias(f"_t_{o}") for o, c in totals.items()],
        )
        .withColumns({
            **{f"_o_{o}": fold[f](f"_t_{o}").over(before) for o, (f, _) in aggregates.items()},
            **{o: F.sum(f"_t_{o}").over(whole) for o in totals},
        })
        .drop(*[f"_t_{o}" for o in [*aggregates, *totals]])
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = (
        tagged.alias("l")
        .join(bounded_side(offsets).alias("r"), same_key("l", "r", [*keys, "_bucket"]))
        .select("l.*", *[f"r._o_{o}" for o in aggregates], *[f"r.{o}" for o in totals])
    )

    def combined(out: str, name: str, col: str) -> Column:
        local, earlier = fold[name](col).over(inside), F.col(f"_o_{out}")
        if name == "sum":
            return local + F.coalesce(earlier, F.lit(0))
        return (F.least if name == "min" else F.greatest)(local, earlier)

    return joined.withColumns({o: combined(o, f, c) for o, (f, c) in aggregates.items()}).drop(
        "_axis", "_bucket", *[f"_o_{o}" for o in aggregates]
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    n_rows: int | None = None,
) -> DataFrame:
    """Inclusive running sums; ``sums`` maps output name to input column."""
    return running(df, keys, order, {o: ("sum", c) for o, c in sums.items()}, rows_per_bucket, n_rows)


def ranked(
    df: DataFrame,
    keys: list[str],
    value: str,
    row_id: str,
    descending: bool = True,
    out: str = "rank",
    seed: int = 0,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    n_rows: int | None = None,
) -> DataFrame:
    """Dense 1-based position by ``value``; equal values are ordered by id hash."""
    sign = -1.0 if descending else 1.0
    base = df.withColumns(
        {"_v": F.col(value) * F.lit(sign), "_h": hash_hex(seed, F.col(row_id))}
    )
    bounds = value_bounds(base, F.col("_v"), rows_per_bucket, n_rows)
    if not bounds:
        w = W.partitionBy(*keys).orderBy("_v", "_h")
        return base.withColumn(out, F.row_number().over(w).cast("bigint")).drop("_v", "_h")
    cell = [*keys, "_bucket", "_sub"]
    before = W.partitionBy(*keys).orderBy("_bucket", "_sub").rowsBetween(W.unboundedPreceding, -1)
    bucketed = with_bucket(base, "_v", bounds, "_bucket")

    def tag(digits: int) -> DataFrame:
        return bucketed.withColumn("_sub", F.when(F.col("_bucket") % 2 == 0, F.substring("_h", 1, digits)).otherwise(""))

    def cells(digits: int) -> DataFrame:
        counts = tag(digits).groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
        # only a value's own bucket is cut by digits
        return counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
                                   "_cut": F.when(F.col("_sub") != "", F.col("_n")).otherwise(0)}).drop("_n")

    offsets, digits = cut_by_digits(cells, rows_per_cell=max(rows_per_bucket, 1000), count="_cut")
    joined = (
        tag(digits).alias("l")
        .join(offsets.alias("r"), same_key("l", "r", cell))
        .select("l.*", "r._before")
    )
    inside = W.partitionBy(*cell).orderBy("_v", "_h")
    return joined.withColumn(
        out, (F.row_number().over(inside) + F.col("_before")).cast("bigint")
    ).drop("_v", "_h", "_bucket", "_sub", "_before")


def hash_rank(df: DataFrame, keys: list[str], hash_col: str, out: str, digits: int = FIRST_DIGITS,
              rows_per_cell: int = ROWS_PER_BUCKET) -> DataFrame:
    """1-based position by hash inside each key.

    A hash is uniform, so its leading digits are balanced buckets and no quantile pass is needed.
    """
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)

    def tag(digits: int) -> DataFrame:
        return df.withColumn("_p", F.substring(hash_col, 1, digits))

    def cells(digits: int) -> DataFrame:
        counts = tag(digits).groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
        return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))

    offsets, digits = cut_by_digits(cells, digits, rows_per_cell)
    joined = (
        tag(digits).alias("l")
        .join(offsets.alias("r"), same_key("l", "r", [*keys, "_p"]))
        .select("l.*", "r._before")
    )
    inside = W.partitionBy(*keys, "_p").orderBy(hash_col)
    return joined.withColumn(
        out, (F.row_number().over(inside) + F.col("_before")).cast("bigint")
    ).drop("_p", "_before")


def hash_cutoffs(
    df: DataFrame, keys: list[str], hash_col: str, wanted: dict[str, Column], digits: int = FIRST_DIGITS,
    rows_per_cell: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact order statistics of a hash: one row per key, one cut-off per name.

    ``wanted`` maps a cut name to the wanted rank, an expression over ``_n``,
    the number of rows of the key.  The result holds ``_n`` and, per name, the
    hash at that rank ('' for rank 0), so ``hash <= cutoff`` selects exactly that
    many rows.  Only a histogram of hash prefixes and the rows of the prefixes
    that straddle a cut are shuffled; the table itself never is.
    """
    names = list(wanted)
    per_key = W.partitionBy(*keys)
    before = per_key.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)

    def tag(digits: int) -> DataFrame:
        return df.select(*keys, F.col(hash_col).alias("_h")).withColumn("_p", F.substring("_h", 1, digits))

    def straddled(digits: int) -> DataFrame:
        """The prefixes that hold a cut (and the first of each key), with the cut's rank inside."""
        histogram = (
            tag(digits).groupBy(*keys, "_p")
            .agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
            .withColumn("_n", F.sum("_c").over(per_key))
        )
        asked = histogram.withColumns({f"_w_{n}": wanted[n].cast("bigint") for n in names})
        holds = {
            n: (F.col("_before") < F.col(f"_w_{n}"))
            & (F.col(f"_w_{n}") <= F.col("_before") + F.col("_c"))
            for n in names
        }
        any_hold = F.lit(False)
        for n in names:
            any_hold = any_hold | holds[n]
        return asked.filter(any_hold | (F.col("_before") == 0)).select(
            *keys, "_p", "_n", "_c", *[
                F.when(holds[n], F.col(f"_w_{n}") - F.col("_before")).alias(f"_k_{n}") for n in names
            ]
        )

    cells, digits = cut_by_digits(straddled, digits, rows_per_cell, "_c")
    straddling = (
        tag(digits).alias("l")
        .join(cells.alias("r"), same_key("l", "r", [*keys, "_p"]))
        .select("l.*", "r._n", *[f"r._k_{n}" for n in names])
    )
    at = W.partitionBy(*keys, "_p").orderBy("_h")
    return (
        straddling.withColumn("_rn", F.row_number().over(at))
        .groupBy(*keys)
        .agg(
            F.max("_n").alias("_n"),
            *[
                F.coalesce(
                    F.max(F.when(F.col("_rn") == F.col(f"_k_{n}"), F.col("_h"))), F.lit("")
                ).alias(n)
                for n in names
            ],
        )
    )

