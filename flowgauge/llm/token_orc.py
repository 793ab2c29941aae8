"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

``write_tokens`` deals the texts out by ranges of doc_id, sorts each range and encodes it on the way to its file, so
only texts are shuffled and each file holds a range of ids in ascending order.  ORC writes the id lists with integer
run-length encoding, keeps minimum and maximum of doc_id for every stripe and row group and a Bloom filter of doc_id, so
``find_documents`` reads only the stripes that may hold an id; every stripe can be read by a task of its own.

Defined cases: a null text is empty and has the end id alone; a null doc_id sorts first; rows with equal doc_id stay
together, ordered by their ids' number and checksum in ``token_index``; an empty table gives empty files and no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text
from .tokens import Encoder

ROWS_OUT = 1000


def encode_ids(docs: DataFrame, tokenizer: str, cuts: str, end_id: int) -> DataFrame:
    """(doc_id, ids) of every row, the end id last; keeps order and partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, cuts)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                found = encoder.encode(part.column(1).to_pylist())
                sizes = [0, *(len(x) + 1 for x in found)]
                flat = np.full(sum(sizes), end_id, dtype=np.int32)
                ends = np.cumsum(sizes)
                for a, b, x in zip(ends, ends[1:], found, strict=False):
                    flat[a : b - 1] = x
                ids = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, cuts: str = "byte",
                 stripe_bytes: int = 64 << 20, index_rows: int = 1000) -> None:
    """Write the ids of all texts as ORC files of ascending doc_id ranges."""
    ranges = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (encode_ids(ranges, tokenizer, cuts, end_id).write
     .option("orc.compress", "zstd")
     .option("orc.stripe.size", stripe_bytes)
     .option("orc.row.index.stride", index_rows)
     .option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", 0.01)
     .orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; stripes and row groups without them are skipped by statistics and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def checksums(ids: pa.Array) -> pa.Array:
    """Of each list of ids the unsigned crc32, as little-endian unsigned 32-bit integers."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    flat = ids.values.to_numpy().astype("<u4", copy=False)
    ends = ids.offsets.to_numpy()
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], type=pa.int64())


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return F.arrow_udf(checksums, "long")(ids)


def token_index(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): where each document's ids stand in the sequence of all files.

    Running sums go inside a file; files, whose ranges follow each other, are offset by the totals of earlier ones.
    A second level keeps each window small: a file's rows are summed in blocks by the first id of its row groups.
    """
    rows = tokens.select(
        "doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.size("ids").cast("long").alias("n_tokens"), ids_crc32(F.col("ids")).alias("ids_crc32"))
    # a split of a file is a contiguous run of its rows, so (file, block) are ranges of doc_id in ascending order
    totals = rows.groupBy("file", "block").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("low"))
    before = Window.orderBy(F.col("low").asc_nulls_first(), "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("file", "block").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return (placed.join(offsets, ["file", "block"])
            .select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
