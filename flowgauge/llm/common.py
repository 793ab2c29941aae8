"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions.bounded import work_dir, written  # noqa: F401

SLICE_BYTES = 1 << 18
#: Powers of the hash base that a process keeps.
POWERS = 1 << 16
#: Bits by which rows that a join would drop are known before they are shuffled.
MARKS = 1 << 24


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no other column of the input can clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def marked(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``df`` with ``marked``, which is true where ``wanted`` has the value of ``column``, and seldom elsewhere.

    Each value of ``wanted`` sets one of ``MARKS`` bits, which are broadcast in 64 bits a row: their number is bounded whatever
    the input, and rows that are not marked need not be shuffled for an exact join.
    """
    word = F.expr(f"pmod(xxhash64({column}), {MARKS}) div 64")
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))")
    bits = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = df.withColumn("word", word).join(F.broadcast(bits), "word", "left")
    return found.select(*df.columns, F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False)).alias("marked"))


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8, a few at a time; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for at in range(0, len(texts), 64):
        for x in texts.slice(at, 64).cast(pa.large_binary()).to_pylist():
            yield x or b""


def slices(texts: Iterable, limit: int = SLICE_BYTES) -> Iterator[list]:
    """Consecutive texts in lists of about ``limit`` bytes; a longer text is a list of its own."""
    some: list = []
    size = 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEPS = np.random.default_rng(7).integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, size=1 << 9, dtype=np.uint64)
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def process_cache() -> dict:
    """A dictionary that lives as long as this Python process, so that later tasks of a worker find it again."""
    return sys.modules.setdefault("_flowgauge_process_cache", types.ModuleType("_flowgauge_process_cache")).__dict__


def let_go() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and at its end what it freed goes back to the system: a worker outlives its tasks, also while others run."""

    def all_of(batches: Iterator) -> Iterator:
        yield from run(batches)
        let_go()

    return all_of


def tidied_call(run: Callable) -> Callable:
    """The same for a function of Arrow columns, which is called once a batch."""

    @functools.wraps(run)
    def one(*columns: pa.Array) -> pa.Array:
        out = run(*columns)
        let_go()
        return out

    return one


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty((2, n), dtype=np.uint64)
    up[0] = down[0] = 1
    size = 1
    while size < n:
        more = min(size, n - size)
        up[size : size + more] = up[:more] * np.uint64(pow(_BASE, size, 1 << 64))
        down[size : size + more] = down[:more] * np.uint64(pow(_BASE_INVERSE, size, 1 << 64))
        size += more
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers of the hash base and of its inverse modulo 2^64; only a table of fixed size is kept."""
    if n >= POWERS:
        return _powers(n + 1)
    if "powers" not in process_cache():
        process_cache()["powers"] = _powers(POWERS)
    return process_cache()["powers"]


def stretch_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every stretch of a sequence of symbols; stretches are in order, apart from each other and not empty.

    A polynomial over random symbol values modulo 2^64, scrambled together with the length.  Stretches are taken by
    blocks, so that memory follows the block (or the longest stretch) and not the sequence.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    lengths = ends - starts
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + POWERS, side="right")))
        size = lengths[at:stop]
        begin = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(begin, size)
        values = _BYTES[symbols[np.repeat(starts[at:stop], size) + inside]] * powers(int(size.max()))[0][inside]
        out[at:stop] = np.add.reduceat(values, begin)
        at = stop
    return mix64(out + lengths.astype(np.uint64))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """Words (bytes other than space and \\x09-\\x0D) of several texts, hashed together."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        self.symbols = np.frombuffer(self.data, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        blank = _BLANK[self.symbols]
        edges = np.flatnonzero(np.diff(blank)) + 1
        if len(blank) and not blank[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.hashes = stretch_hashes(self.symbols, self.starts, self.ends)
        #: words of text i are first[i] : first[i + 1]
        self.first = np.searchsorted(self.starts, self.text_starts)

    def windows(self, size: int) -> np.ndarray:
        """A hash for every word position of the run of ``size`` words from it (also across texts: see ``first``)."""
        return window_hashes(self.hashes, size)


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` word hashes; empty if there are fewer words."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out += ids[i : i + n] * _STEPS[i]
    return mix64(out)
