"""Bounded driver state: everything that is collected or broadcast passes through here.

A side is collected only while it stays under a stated row bound.  Past the
bound the caller gets the distributed DataFrame back and the join is an ordinary
shuffle join (with adaptive skew handling), so no result is ever cut short.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def bounded_rows(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> list[Row] | None:
    """Collect ``df`` if it has at most ``max_rows`` rows, else return None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def bounded_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A join side that is broadcast only when its size is proven to be small."""
    found = df.limit(max_rows + 1).toArrow()
    if found.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(),
    "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()),
}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-made table that the planner sees as a local relation."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), type=_ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[n for n, _ in fields]))


SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a small input that comes in too few pieces (one file of a few row groups).

    Only what Spark estimates at up to ``SPREAD_BYTES`` is dealt out; larger inputs come in enough pieces.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES
    return df.repartition(cores) if small and df.rdd.getNumPartitions() * 2 <= cores else df


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder that the session names in ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (master ``local[...]``) uses FLOWGAUGE_WORK_DIR or the temporary
    folder of that machine; on a cluster it is an error, as executors do not share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.environ.get("FLOWGAUGE_WORK_DIR") or os.path.join(tempfile.gettempdir(), "flowgauge-work")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
