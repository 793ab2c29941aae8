"""Stored tables: splits, scalers, clusters, results, transitions and weights."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class MissingArtifacts(FileNotFoundError):
    """One error that names every missing input."""


def save_splits(df: DataFrame, path: str) -> None:
    """One folder per seed and split, so a reader prunes to what it needs."""
    df.write.mode("overwrite").partitionBy("seed", "split").parquet(path)


def load_splits(
    spark: SparkSession, path: str, seed: int | None = None, split: str | None = None
) -> DataFrame:
    df = spark.read.parquet(path)
    if seed is not None:
        df = df.filter(df.seed == seed)
    if split is not None:
        df = df.filter(df.split == split)
    return df


def save_table(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def require_tables(spark: SparkSession, root: str, names: list[str]) -> None:
    """Raise one error listing all stored tables that cannot be read."""
    missing = []
    for name in names:
        try:
            load_table(spark, root, name).schema
        except AnalysisException:
            missing.append(name)
    if missing:
        raise MissingArtifacts(f"Missing under {root}: {', '.join(missing)}")
