"""Cleaning, label encoding and scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bounded import bounded_rows, bounded_side, local_table
from ..functions.ordering import same_key

FRACTIONAL = (T.DoubleType, T.FloatType)

# Flow-meter columns that describe a record rather than measure it.
NON_FEATURES = ["Flow ID", "Src IP", "Dst IP", "Timestamp", "Label"]


class CleaningError(ValueError):
    """Input that cannot be cleaned into labelled numeric features."""


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def is_infinite(name: str) -> Column:
    return F.coalesce(F.abs(_c(name)) == F.lit(float("inf")), F.lit(False))


def is_missing(field: T.StructField) -> Column:
    missing = _c(field.name).isNull()
    return missing | F.isnan(_c(field.name)) if isinstance(field.dataType, FRACTIONAL) else missing


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def invalid_row(df: DataFrame, drop_inf: bool = True, drop_na: bool = True) -> Column:
    """True for a row with a missing or infinite value in any column."""
    conds = []
    for f in df.schema.fields:
        if drop_na:
            conds.append(is_missing(f))
        if drop_inf and isinstance(f.dataType, FRACTIONAL):
            conds.append(is_infinite(f.name))
    return _any(conds)


def drop_invalid(df: DataFrame, drop_inf: bool = True, drop_na: bool = True) -> DataFrame:
    return df.filter(~invalid_row(df, drop_inf, drop_na))


def numeric_features(df: DataFrame, label_col: str, exclude: list[str] | None = None) -> list[str]:
    """Names of the numeric columns; the label and ``exclude`` are left out."""
    skip = {label_col, *(exclude or [])}
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
    if not names:
        raise CleaningError(f"No numeric feature column beside {label_col!r}")
    return names


def deduplicate(df: DataFrame, subset: list[str], row_id: str = "row_id") -> DataFrame:
    """One row per distinct ``subset``: the one with the lowest id."""
    others = [c for c in df.columns if c not in (*subset, row_id)]
    if not others:
        return df.groupBy(*subset).agg(F.min(row_id).alias(row_id)).select(*df.columns)
    kept = F.min_by(F.struct(*[_c(c) for c in others]), row_id).alias("_kept")
    return (
        df.groupBy(*subset)
        .agg(F.min(row_id).alias(row_id), kept)
        .select(*[_c(c) if c in (*subset, row_id) else F.col(f"_kept.`{c}`") for c in df.columns])
    )


def clean(
    df: DataFrame,
    features: list[str],
    label_col: str = "label",
    drop_inf: bool = True,
    drop_na: bool = True,
    dedup: bool = False,
    keys: list[str] | None = None,
    row_id: str = "row_id",
) -> DataFrame:
    """Drop invalid rows, then (optionally) exact copies within each variant."""
    out = drop_invalid(df, drop_inf, drop_na)
    if dedup:
        out = deduplicate(out, [*(keys or []), *features, label_col], row_id)
    return out


def clean_report(df: DataFrame, features: list[str], label_col: str = "label") -> DataFrame:
    """Row counts before and after cleaning, by reason, in one aggregate.

    Copies are counted through a distinct count of a row fingerprint over valid
    rows, so the table is scanned once.
    """
    missing = _any([is_missing(f) for f in df.schema.fields])
    infinite = _any([is_infinite(f.name) for f in df.schema.fields if isinstance(f.dataType, FRACTIONAL)])
    valid = ~(missing | infinite)
    copy_key = F.struct(*[_c(c) for c in features], _c(label_col))
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(missing).alias("rows_missing"),
        F.count_if(infinite & ~missing).alias("rows_infinite"),
        F.count_if(valid).alias("rows_valid"),
        F.count_distinct(F.when(valid, copy_key)).alias("rows_after"),
    ).withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def drop_non_features(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.drop(*(NON_FEATURES if cols is None else cols))


def first_per_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first record of every group (a map-side reducible aggregate, no sort)."""
    rest = [c for c in df.columns if c not in group]
    first = F.min_by(F.struct(*[_c(c) for c in rest]), F.struct(*[_c(c) for c in order]))
    return df.groupBy(*group).agg(first.alias("_r")).select(
        *group, *[F.col(f"_r.`{c}`") for c in rest]
    )


def filter_labels(df: DataFrame, subsets: DataFrame, label_col: str = "y") -> DataFrame:
    """Rows of each label subset: ``subsets`` has ``subset_id`` and the label."""
    return (
        df.alias("l")
        .join(bounded_side(subsets).alias("r"), F.col(f"l.`{label_col}`") == F.col(f"r.`{label_col}`"))
        .select("r.subset_id", "l.*")
    )


def profile(df: DataFrame, features: list[str], label_col: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Samples, features and classes per variant."""
    return df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.lit(len(features)).cast("bigint").alias("n_features"),
        F.count_distinct(_c(label_col)).alias("n_classes"),
    )


def fit_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``label -> y`` with codes 0.. in text order.

    Class labels are few, so they are numbered from a bounded list; a label set
    past the bound is sorted and numbered in parallel.
    """
    # a NULL label has no code: applying the codes to its rows is an error by name
    labels = df.select(_c(label_col).cast("string").alias("label")).where("label is not null").distinct()
    schema = "label string, y int"
    rows = bounded_rows(labels)
    if rows is not None:
        names = sorted((r.label for r in rows), key=lambda t: t.encode())
        return local_table(df.sparkSession, [(t, i) for i, t in enumerate(names)], schema)
    numbered = labels.orderBy("label").rdd.zipWithIndex().map(lambda p: (p[0].label, p[1]))
    return df.sparkSession.createDataFrame(numbered, schema)


def apply_labels(df: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Add ``y``; a label without a code is an error when the row is read."""
    code = F.when(F.col("r.y").isNotNull(), F.col("r.y")).otherwise(
        F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(F.col(f"l.`{label_col}`"), F.lit("NULL"))))
    )
    small = bounded_side(labels.withColumnRenamed("label", "_label"))
    return (
        df.alias("l")
        .join(small.alias("r"), F.col(f"l.`{label_col}`") == F.col("r._label"), "left")
        .select("l.*", code.cast("int").alias("y"))
    )


def fit_scaler(df: DataFrame, features: list[str], kind: str = "standard", keys: list[str] | None = None) -> DataFrame:
    """``center`` and ``scale`` arrays per variant; a constant column scales by 1.

    One aggregate over the rows.  The values are population statistics.
    """
    if kind not in ("standard", "minmax"):
        raise CleaningError(f"Unknown scaler: {kind}")

    def center(c: str) -> Column:
        return (F.avg(_c(c)) if kind == "standard" else F.min(_c(c))).cast("double")

    def spread(c: str) -> Column:
        s = F.stddev_pop(_c(c)) if kind == "standard" else F.max(_c(c)) - F.min(_c(c))
        # A column whose values all agree has spread 0 whatever rounding says.
        return F.when(F.min(_c(c)) == F.max(_c(c)), 1.0).otherwise(s).cast("double")

    return df.groupBy(*(keys or [])).agg(
        F.array(*[center(c) for c in features]).alias("center"),
        F.array(*[spread(c) for c in features]).alias("scale"),
    )


def apply_scaler(
    df: DataFrame, scaler: DataFrame, features: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Replace the feature columns by their scaled values (map-only)."""
    keys = keys or []
    if not keys:
        rows = bounded_rows(scaler, 1)
        if not rows:
            raise CleaningError("A scaler without keys must have exactly one row")
        center, scale = rows[0].center, rows[0].scale
        return df.withColumns(
            {c: (_c(c) - F.lit(center[i])) / F.lit(scale[i]) for i, c in enumerate(features)}
        )
    joined = df.alias("l").join(bounded_side(scaler).alias("r"), same_key("l", "r", keys))
    scaled = {
        c: ((F.col(f"l.`{c}`") - F.col("r.center")[i]) / F.col("r.scale")[i]).alias(c)
        for i, c in enumerate(features)
    }
    return joined.select(*[scaled.get(c, F.col(f"l.`{c}`")) for c in df.columns])


def preprocess(
    df: DataFrame,
    features: list[str],
    label_col: str = "label",
    kind: str = "standard",
    dedup: bool = True,
    keys: list[str] | None = None,
    row_id: str = "row_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean every split by itself, then encode and scale with the train rows.

    ``df`` has a ``split`` column (and optional variant ``keys``).  Returns the
    prepared table, the label codes and the scaler.
    """
    keys = keys or []
    cleaned = clean(df, features, label_col, dedup=dedup, keys=[*keys, "split"], row_id=row_id)
    train = cleaned.filter(F.col("split") == "train")
    labels = fit_labels(train, label_col)
    scaler = fit_scaler(train, features, kind, keys)
    return apply_scaler(apply_labels(cleaned, labels, label_col), scaler, features, keys), labels, scaler
