"""Best-fit packing of token sequences with large-item matching.

Texts are encoded once; a document longer than a sequence is cut into full pieces and a rest.  The packing itself only
needs how many pieces there are of each length, a table of at most ``capacity`` rows whatever the input, so the plan is
made on counts:

* full pieces have a sequence of their own;
* pieces above a third of the capacity, of which a sequence holds at most two, are matched greedily: the longest open
  piece with the longest other that still fits;
* shorter pieces, longest first, go where the smallest gap is that takes them, and open a sequence if none does.

A plan step says "the next m pieces of length L go to sequences s, s+1, ... at this offset".  Pieces of a length are
numbered across the table (inside hashed blocks, then offset by the blocks' counts) and joined to the steps by their
number, so no length is ever gathered in one task.

Defined cases: a null text is empty and has the end id alone, as has an empty one; rows with equal doc_id are separate
documents and each row's pieces are kept; an empty table has no sequences; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, let_go, tidied, written
from .tokens import Encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BLOCK_ROWS = 100_000


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, cuts: str = "word") -> DataFrame:
    """One row for each piece of at most ``capacity`` ids of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, cuts)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                let_go()  # several workers of an executor hold a tokenizer, and the library frees much in small pieces
                part = batch.slice(at, 500)
                rows = []
                found = encoder.encode(part.column(1).to_pylist())
                for doc, ids in zip(part.column(0).to_pylist(), found, strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((doc, k, start, len(piece), zlib.crc32(piece)))
                columns = zip(*rows, strict=True) if rows else ((),) * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(tidied(run), PIECES)


class Plan:
    """Groups of equally filled sequences; every step fills one more place in each sequence of a group."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.steps: list[tuple[int, int, int, int, int]] = []  # length, first number, count, first sequence, offset
        self.used: Counter = Counter()
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, count)
        self.order: list[int] = []  # the gaps that occur, ascending

    def put(self, length: int, first: int, count: int, offset: int) -> None:
        self.steps.append((length, self.used[length], count, first, offset))
        self.used[length] += count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def leave(self, first: int, count: int, gap: int) -> None:
        if gap not in self.gaps:
            bisect.insort(self.order, gap)
            self.gaps[gap] = []
        self.gaps[gap].append((first, count))

    def take(self, gap: int, most: int) -> tuple[int, int]:
        """Up to ``most`` sequences of one range with this gap."""
        first, count = self.gaps[gap].pop()
        if count > most:
            self.gaps[gap].append((first + most, count - most))
            count = most
        if not self.gaps[gap]:
            del self.gaps[gap]
            self.order.remove(gap)
        return first, count


def pack_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The steps for ``counts`` pieces of each length."""
    plan = Plan(capacity)
    left = {k: v for k, v in counts.items() if v}
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        longest = large[-1]
        room = capacity - longest
        # the longest other piece that fits beside it; a piece may be matched with one of its own length
        at = bisect.bisect_right(large, room) - 1
        if at < 0:
            many = left.pop(longest)
            first = plan.open(many)
            plan.put(longest, first, many, 0)
            if room:
                plan.leave(first, many, room)
            large.pop()
            continue
        other = large[at]
        if other == longest and left[longest] == 1 and at:
            other = large[at - 1]  # a single piece goes with the next shorter one
        if other == longest:
            many, odd = divmod(left[longest], 2)
            if not many:
                first = plan.open(1)
                plan.put(longest, first, 1, 0)
                plan.leave(first, 1, room)
                odd = 0
        else:
            many, odd = min(left[longest], left[other]), 0
        if many:
            first = plan.open(many)
            plan.put(longest, first, many, 0)
            plan.put(other, first, many, longest)
            if room > other:
                plan.leave(first, many, room - other)
        if other == longest:
            left[longest] = odd
        else:
            left[longest] -= many
            left[other] -= many
        large = [k for k in large if left[k]]
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        open_pieces = left[length]
        while open_pieces:
            at = bisect.bisect_left(plan.order, length)
            if at < len(plan.order):
                gap = plan.order[at]
                first, many = plan.take(gap, max(1, open_pieces // (gap // length)))
            else:
                gap, many = capacity, max(1, open_pieces // (capacity // length))
                first = plan.open(many)
            # best fit goes on with a sequence for as long as it has room
            times = min(gap // length, open_pieces // many)
            for k in range(times):
                plan.put(length, first, many, capacity - gap + k * length)
            open_pieces -= times * many
            if gap > times * length:
                plan.leave(first, many, gap - times * length)
    return plan


def numbered(pieces: DataFrame, total: int) -> DataFrame:
    """Number the pieces of each length from 0, without gathering a length in one task.

    ``pieces`` must be a written table: its rows are dealt into blocks by hash and numbered inside a block.
    """
    blocks = max(1, -(-total // BLOCK_ROWS)) * 4
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
               .select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    return (dealt.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, ["length", "block"])
            .withColumn("number", F.col("before") + F.col("inside")).drop("block", "inside", "before"))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give every piece a sequence and an offset there."""
    spark = pieces.sparkSession
    # at most ``capacity`` rows reach the driver, whatever the input
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pack_plan(counts, capacity)
    names = ["length", "low", "count", "first", "at"]
    columns = zip(*plan.steps, strict=True) if plan.steps else ((),) * 5
    steps = spark.createDataFrame(pa.table([pa.array(c, type=pa.int64()) for c in columns], names=names))
    rows = numbered(pieces, sum(counts.values()))
    # the step of a piece is the last of its length that begins at or before its number; both sides meet in cells of
    # equal numbers' width, so that a length with many pieces is many join keys
    width = F.lit(BLOCK_ROWS)
    cells = steps.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("count") - 1) / width))))
    mine = rows.withColumn("cell", F.floor(F.col("number") / width))
    met = mine.join(cells, ["length", "cell"]).where(
        (F.col("number") >= F.col("low")) & (F.col("number") < F.col("low") + F.col("count")))
    return met.select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("first") + F.col("number") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Encode, cut and pack all documents."""
    return pack(written(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
