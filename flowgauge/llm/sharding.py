"""Shards by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

A row's key has 40 bits of a hash of its document id, then 20 bits of a hash of its row number.  The shard of a row is
the shortest prefix of the key whose rows fit the byte limit, so a document is looked up by the hash of its id, and an
id that holds more than a shard of rows splits on by row.  Each round counts bytes for twelve more bits and only for
rows whose bucket is still too large; what is counted and joined per round are prefixes, never lists of rows.

Defined cases: a null text counts 0 bytes; a null doc_id is hashed like any value; equal rows are separate rows; a row
longer than the limit is alone in a shard that does not fit (``fits`` false), as are rows that share all 60 bits; an
empty table has no shards; other columns are ignored by ``shard_rows`` and kept by ``write_shards``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

ROUND_BITS = 12
ID_BITS, ROW_BITS = 40, 20
ALL_BITS = ID_BITS + ROW_BITS


def row_key() -> Column:
    """The hash of a row's document id and, below it, that of its row number."""
    by_id = F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - ID_BITS), ROW_BITS)
    by_row = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - ROW_BITS)
    return by_id.bitwiseOR(by_row)


def keyed(docs: DataFrame, key: Column) -> DataFrame:
    """(doc_id, bytes, key) of every row, written once so that row numbers stay as they are."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return written(docs.select("doc_id", size.alias("bytes"), key.alias("key")), "shard-keys")


def split_round(rows: DataFrame, start: int, end: int, max_bytes: int) -> DataFrame:
    """Directory cells (cell, depth, shard_bytes, shard_rows) of ``end`` bits; depth is null where none fits.

    ``rows`` are all rows of the buckets of ``start`` bits that were too large.
    """
    fine = (rows.groupBy(F.shiftright("key", ALL_BITS - end).alias("cell"))
            .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")))
    first = start + 1 if start else 0
    each = (fine.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(end))))
            .withColumn("prefix", F.expr(f"shiftright(cell, {end} - depth)")))
    sums = each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = (F.col("shard_bytes") <= max_bytes) | ((F.col("shard_rows") == 1) | (F.col("depth") == ALL_BITS))
    found = each.select("cell", "depth", "prefix").join(sums.where(fits), ["depth", "prefix"])
    # the shortest prefix that fits; the sizes of a longer prefix of the same cell are never larger
    shortest = found.groupBy("cell").agg(F.min("depth").alias("depth"), F.max("shard_bytes").alias("shard_bytes"),
                                         F.max("shard_rows").alias("shard_rows"))
    return fine.select("cell").join(shortest, "cell", "left")


def shard_rows(docs: DataFrame, max_bytes: int, round_bits: int = ROUND_BITS) -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, shard_rows, fits) for every row; ``shard`` is the prefix as bits."""
    return _shards(keyed(docs, row_key()), max_bytes, round_bits).drop("key")


def _shards(open_rows: DataFrame, max_bytes: int, round_bits: int) -> DataFrame:
    start, done = 0, []
    while True:
        end = min(start + round_bits, ALL_BITS)
        cells = written(split_round(open_rows, start, end, max_bytes), "shard-cells")
        dealt = open_rows.withColumn("cell", F.shiftright("key", ALL_BITS - end)).join(cells, "cell")
        done.append(dealt.where(F.col("depth").isNotNull()))
        if end == ALL_BITS or cells.where(F.col("depth").isNull()).isEmpty():
            break
        open_rows = written(dealt.where(F.col("depth").isNull()).select("doc_id", "bytes", "key"), "shard-open")
        start = end
    bits = F.lpad(F.conv(F.expr(f"shiftright(key, {ALL_BITS} - depth)").cast("string"), 10, 2), F.col("depth"), "0")
    return reduce(DataFrame.unionByName, done).select(
        "doc_id", "bytes", "key", F.when(F.col("depth") == 0, "").otherwise(bits).alias("shard"), "depth", "shard_bytes",
        "shard_rows", (F.col("shard_bytes") <= max_bytes).alias("fits"))


def write_shards(docs: DataFrame, path: str, max_bytes: int, round_bits: int = ROUND_BITS) -> None:
    """Write the rows of ``docs`` under one folder per shard, named by a column ``_shard`` (lengthened where taken).

    Rows are written once with their key.  The directory of shards is a table of distinct keys, so rows that share one,
    which have one shard, are neither lost nor doubled.
    """
    key, shard = free_name(docs, "_key"), free_name(docs, "_shard")
    rows = written(docs.withColumn(key, row_key()), "shard-rows")
    found = _shards(keyed(rows, F.col(key)), max_bytes, round_bits)
    where = found.select(F.col("key").alias(key), F.col("shard").alias(shard)).distinct()
    rows.join(where, key).drop(key).repartition(shard).write.partitionBy(shard).parquet(path)
