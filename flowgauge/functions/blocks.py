"""Vectors packed in blocks, for rows that the steps of a training pass over again and again.

A block is one row: int names, and matrices of the vectors of many rows as bytes.  It costs a step next to nothing to hand a
block to Python, where a row of arrays is converted number by number.  Steps run on the blocks as one job without planning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row

#: Bytes of a vector column in one block, and of all blocks that a task fills at once.
BLOCK_BYTES, HELD_BYTES = 1 << 19, 64 << 20
#: Numbers that all tasks of a step together may hand to the driver; more are added up by name on the executors.
DIRECT_NUMBERS = 1 << 18


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=float).reshape(len(column), -1)


def packed(df: DataFrame, names: list[str], vectors: list[str]) -> DataFrame:
    """``names, n`` and ``vectors`` as bytes: the rows of equal int names in blocks.

    A vector column that is null in all rows of a name is null in its blocks.
    """
    width = len(names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        sizes: dict[tuple, int] = {}

        def block(name: tuple) -> pa.RecordBatch:
            parts, n = held.pop(name), 0
            del sizes[name]
            columns = [pa.array([v], type=pa.int32()) for v in name]
            data = []
            for column in zip(*parts, strict=True):
                n = sum(size for size, _ in column)
                given = [m for _, m in column if m is not None]
                data.append(pa.array([np.concatenate(given).tobytes() if given else None], type=pa.binary()))
            return pa.RecordBatch.from_arrays([*columns, pa.array([n], type=pa.int32()), *data], names=[*names, "n", *vectors])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
            for name in map(tuple, np.unique(keys, axis=0).tolist()):
                mine = batch.filter(pa.array((keys == name).all(axis=1)))
                some = [mine.column(i) for i in range(width, width + len(vectors))]
                full = [None if c.null_count == len(c) else _matrix(c) for c in some]
                bytes_of_row = max(8, *(8 * m.shape[1] for m in full if m is not None))
                step = max(1, BLOCK_BYTES // bytes_of_row)
                for at in range(0, mine.num_rows, step):
                    part = [None if m is None else m[at : at + step] for m in full]
                    rows = min(step, mine.num_rows - at)
                    held.setdefault(name, []).append([(rows, m) for m in part])
                    sizes[name] = sizes.get(name, 0) + rows * bytes_of_row
                    if sizes[name] >= BLOCK_BYTES:
                        yield block(name)
            if sum(sizes.values()) > HELD_BYTES:
                for name in list(held):
                    yield block(name)
        for name in list(held):
            yield block(name)

    schema = "".join(f"`{c}` int, " for c in names) + "n int" + "".join(f", `{c}` binary" for c in vectors)
    return df.select(*names, *vectors).mapInArrow(fold, schema)


def matrix(row: Row, column: str) -> np.ndarray:
    """The vectors of a block (none where it has none)."""
    return np.frombuffer(row[column]).reshape(row.n, -1) if row[column] is not None else np.empty((0, 0))


def added_up(blocks: RDD, fold: Callable[[Iterable[Row]], Iterator[tuple[int, np.ndarray]]], names: int, numbers: int) -> dict[int, np.ndarray]:
    """What all tasks' ``fold`` gives, (name, vector), added up by name; ``numbers`` is the length of all names' vectors."""
    found = blocks.mapPartitions(fold)
    if blocks.getNumPartitions() * numbers > DIRECT_NUMBERS:
        found = found.reduceByKey(np.add, max(1, min(names, blocks.getNumPartitions())))
    out: dict[int, np.ndarray] = {}
    for name, vec in found.collect():
        out[name] = out[name] + vec if name in out else vec
    return out
