"""Named datasets."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .readers import SourceError, as_flows, read_csv_directory, read_csv_file, read_positional


@dataclass(frozen=True)
class DatasetSpec:
    """Where a dataset lies and how to read it."""

    name: str
    layout: str  # directory | file | positional | parquet | table
    label_col: str = "label"
    path: str | None = None
    file: str | None = None


# Dataset names, layouts, label columns and file names that users
# of these public datasets already have on disk.
BUILTIN = {
    s.name: s
    for s in [
        DatasetSpec("ids2017", "directory", "Label"),
        DatasetSpec("ids2018", "directory", "Label"),
        DatasetSpec("nsl-kdd", "positional", "label", file="KDDTrain+.csv"),
        DatasetSpec("unsw-nb15", "file", "label", file="UNSW_NB15_training-set.csv"),
        DatasetSpec("bot-iot", "directory", "label"),
        DatasetSpec("ton-iot", "directory", "label"),
        DatasetSpec("cic-ddos2019", "directory", " Label"),
        DatasetSpec("ctu-13", "directory", "Label"),
        DatasetSpec("iscx-ids2012", "directory", "label"),
        DatasetSpec("iscx-tor", "directory", "label"),
        DatasetSpec("vpn-nonvpn", "directory", "label"),
        DatasetSpec("cic-unsw", "directory", "label"),
    ]
}


class Registry:
    """Dataset lookup; any table or Parquet path can be registered beside the built-ins."""

    def __init__(self, data_dir: str = "data"):
        self.data_dir = data_dir.rstrip("/")
        self.specs = dict(BUILTIN)

    def register(self, spec: DatasetSpec) -> None:
        self.specs[spec.name.lower().strip()] = spec

    def spec(self, name: str, label_col: str | None = None) -> DatasetSpec:
        key = name.lower().strip()
        if key not in self.specs:
            raise SourceError(f"Unknown dataset: {key}. Known: {sorted(self.specs)}")
        spec = self.specs[key]
        if label_col is not None:
            spec = replace(spec, label_col=label_col)
        if spec.path is None:
            spec = replace(spec, path=f"{self.data_dir}/{key.replace('-', '_')}")
        return spec

    def raw(self, spark: SparkSession, name: str, label_col: str | None = None) -> DataFrame:
        spec = self.spec(name, label_col)
        full = f"{spec.path}/{spec.file}" if spec.file else spec.path
        if spec.layout == "directory":
            return read_csv_directory(spark, spec.path)
        if spec.layout == "file":
            return read_csv_file(spark, full)
        if spec.layout == "positional":
            return read_positional(spark, full, label_col=spec.label_col)
        if spec.layout == "parquet":
            return spark.read.parquet(full)
        if spec.layout == "table":
            return spark.table(spec.path)
        raise SourceError(f"Unknown layout {spec.layout!r} of dataset {spec.name}")

    def load(self, spark: SparkSession, name: str, label_col: str | None = None) -> DataFrame:
        """Cleaned numeric features, ``label`` and its integer code ``y``."""
        from ..operators.clean import apply_labels, fit_labels

        spec = self.spec(name, label_col)
        flows = as_flows(self.raw(spark, name, label_col), spec.label_col)
        return apply_labels(flows, fit_labels(flows))
