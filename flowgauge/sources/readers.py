"""CSV sources with the header rules of labelled flow exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import drop_invalid, numeric_features


class SourceError(ValueError):
    """A dataset that cannot be read as labelled flows."""


def list_files(spark: SparkSession, directory: str, pattern: str = "*.csv") -> list[str]:
    """Sorted paths below ``directory`` that match ``pattern`` (no file content is read)."""
    try:
        found = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .load(directory)
            .select("path")
            .orderBy("path")
        )
        paths = [r.path for r in found.toLocalIterator()]
    except Exception as err:
        raise SourceError(f"Directory not readable: {directory}") from err
    if not paths:
        raise SourceError(f"No file matches {pattern} in {directory}")
    return paths


def read_csv_directory(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """All matching files, columns matched by name (absent columns are NULL).

    Spark maps the columns of a multi-file CSV read by position, so files are
    grouped by header line and each group is one scan.
    """
    paths = list_files(spark, directory, pattern)
    groups: dict[str, list[str]] = {}
    for path in paths:
        head = spark.read.text(path).first()
        groups.setdefault(head.value if head else "", []).append(path)
    out: DataFrame | None = None
    for same_header in groups.values():
        part = spark.read.csv(same_header, header=True, inferSchema=True)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_csv_file(
    spark: SparkSession,
    path: str,
    header: bool = True,
    names: list[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """One CSV file (or a set with the same layout); ``names`` renames the columns."""
    reader = spark.read.option("header", header)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.toDF(*names) if names else df


def positional_schema(n_features: int, label_col: str = "label") -> list[str]:
    """f0 .. f(n-1), the label and the difficulty grade."""
    return [f"f{i}" for i in range(n_features)] + [label_col, "difficulty"]


def read_positional(
    spark: SparkSession, path: str, n_features: int = 41, label_col: str = "label", header: bool = False
) -> DataFrame:
    """Header-less scan with positional names; the difficulty grade is dropped."""
    names = None if header else positional_schema(n_features, label_col)
    return read_csv_file(spark, path, header=header, names=names).drop("difficulty")


def as_flows(df: DataFrame, label_col: str) -> DataFrame:
    """Cleaned numeric features plus a text ``label`` column."""
    if label_col not in df.columns:
        raise SourceError(f"Label column {label_col!r} not found in {df.columns}")
    clean = drop_invalid(df)
    features = numeric_features(clean, label_col)
    return clean.select(
        *[F.col(f"`{c}`").cast("double").alias(c) for c in features],
        F.col(f"`{label_col}`").cast("string").alias("label"),
    )
