"""Diversity under the full kernel without a kernel matrix in one task: stochastic Lanczos quadrature.

The score is exp of the trace of f(A), f(x) = -x ln x, for A = D K D with unit trace, K the kernel of a key's distinct
points and D the roots of their shares.  Most of the trace lies in few directions, so it is split (Meyer et al., 2021): for
orthonormal Q that spans A times random sign vectors it is the sum of q' f(A) q, plus the mean of v' f(A) v over sign vectors
v less their part in Q.  Each of those forms is a Gauss rule that a few Lanczos steps give (Ubaru, Chen and Saad, 2017).  A
step needs only A times the current vectors: points are packed in blocks, every block meets every block of its key, a task
holds two of them, and Spark adds up their products by block.  All keys and vectors advance in the same jobs.  The driver
holds two numbers per key, vector and step, and a square of ``probes`` numbers per key.

The work is that of the kernel, quadratic in a key's distinct points, but it is spread over pairs of blocks and memory is
that of two blocks.  ``error`` is three standard errors over the sign vectors plus what the last two steps changed.  A key
with at most twice as many points as probes takes its unit vectors, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import bounded_rows, local_table, written
from ..functions.ordering import same_key
from .assign import ClusterError

PROBES, STEPS, BLOCK_ROWS = 16, 16, 1024
MAX_KEYS = 100_000


def entropy_rule(alpha: np.ndarray, beta: np.ndarray) -> float:
    """e1' f(T) e1 of the tridiagonal matrix with diagonal alpha and off-diagonal beta."""
    t = np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1)
    values, vectors = np.linalg.eigh(t)
    values = np.maximum(values, 0.0)
    f = np.where(values > 1e-300, -values * np.log(np.maximum(values, 1e-300)), 0.0)
    return float((vectors[0] ** 2 * f).sum())


class _Probes:
    """The recurrences of one key's vectors: of Q first, then of the sign vectors, or the unit vectors of a small key."""

    def __init__(self, n: int, probes: int):
        self.n, self.probes, self.exact = n, probes, n <= 2 * probes
        self.count = n if self.exact else 2 * probes
        self.alpha: list[np.ndarray] = []
        self.beta: list[np.ndarray] = []
        self.length = np.zeros(self.count, dtype=int)  # steps until a vector has seen its whole space
        self.open = np.ones(self.count, dtype=bool)
        self.weight = np.ones(self.count)

    def start(self, weight: np.ndarray) -> None:
        """Squared lengths of the vectors before they were scaled; 0 for those that Q lacks."""
        self.weight, self.open = weight, weight > 0

    def add(self, dot: np.ndarray, square: np.ndarray) -> None:
        before = self.beta[-1] if self.beta else np.zeros(self.count)
        rest = np.sqrt(np.maximum(square - dot**2 - before**2, 0.0))
        self.length[self.open] += 1
        self.open &= rest > 1e-7
        self.alpha.append(dot)
        self.beta.append(np.where(self.open, rest, 0.0))

    def forms(self, steps: int) -> np.ndarray:
        """The quadratic form of each vector from its first ``steps`` steps."""
        out = np.zeros(self.count)
        for p in np.flatnonzero(self.weight > 0):
            m = min(steps, int(self.length[p]))
            a, b = (np.array([x[p] for x in xs[:m]]) for xs in (self.alpha, self.beta))
            out[p] = self.weight[p] * entropy_rule(a, b[: m - 1])
        return out

    def _trace(self, forms: np.ndarray) -> float:
        if self.exact:
            return float(forms.sum())
        return float(forms[: self.probes].sum() + forms[self.probes :].mean())

    def estimate(self) -> tuple[float, float]:
        """The entropy and a bound of its error."""
        steps = len(self.alpha)
        forms = self.forms(steps)
        found = self._trace(forms)
        cut = abs(found - self._trace(self.forms(max(1, steps - 2))))
        spread = 0.0 if self.exact else 3.0 * float(forms[self.probes :].std(ddof=1)) / np.sqrt(self.probes)
        return found, spread + cut


def _matrix(flat, width: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(-1, width)


def _signs(seed: int, kid: int, block: int, rows: int, probes: int) -> np.ndarray:
    return np.random.default_rng([seed, kid, block]).choice([-1.0, 1.0], size=(rows, probes))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([x.ravel() for x in parts], type=pa.list_(pa.float64()))


def _values(column: pa.Array, i: int, width: int) -> np.ndarray:
    return _matrix(column[i].values.to_numpy(zero_copy_only=False), width)


def _sketch(widths: dict[int, int], seed: int):
    """The sign vectors that A is first applied to."""
    def run(kids: pa.Array, blocks: pa.Array, roots: pa.Array) -> pa.Array:
        return _lists([_signs(seed, kid, block, len(r), widths[kid])
                       for kid, block, r in zip(kids.to_pylist(), blocks.to_pylist(), roots, strict=True)])

    return F.arrow_udf(run, "array<double>")


def _gram(widths: dict[int, int], seed: int | None = None):
    """y'y of a block or, with a seed, y' times other sign vectors."""
    def run(kids: pa.Array, blocks: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for i, (kid, block) in enumerate(zip(kids.to_pylist(), blocks.to_pylist(), strict=True)):
            a = _values(y, i, widths[kid])
            out.append(a.T @ (a if seed is None else _signs(seed, kid, block, len(a), widths[kid])))
        return _lists(out)

    return F.arrow_udf(run, "array<double>")


def _starts(spans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], widths: dict[int, int], seed: int):
    """The vectors of Q beside sign vectors less their part in Q, all of unit length."""
    def run(kids: pa.Array, blocks: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for i, (kid, block) in enumerate(zip(kids.to_pylist(), blocks.to_pylist(), strict=True)):
            turn, inner, length = spans[kid]
            q = _values(y, i, widths[kid]) @ turn
            rest = (_signs(seed, kid, block, len(q), widths[kid]) - q @ inner) / np.maximum(length, 1e-300)
            out.append(np.concatenate([q, rest], axis=1))
        return _lists(out)

    return F.arrow_udf(run, "array<double>")


def _units(counts: dict[int, int]):
    """The unit vectors of keys that are one block."""
    return F.arrow_udf(lambda kids, r: _lists([np.eye(counts[kid]) for kid in kids.to_pylist()]), "array<double>")


def _products(widths: dict[int, int], dim: int, gamma: float):
    """The part of A V in the rows of one block that comes from another block."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kids, vecs = batch.column(0).to_pylist(), []
            columns = [batch.column(i) for i in range(2, 7)]
            for i, kid in enumerate(kids):
                z, r, z2, r2, v = (np.asarray(c[i].values.to_numpy(zero_copy_only=False)) for c in columns)
                x, y = _matrix(z, dim), _matrix(z2, dim)
                square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * x @ y.T
                k = np.exp(-gamma * np.maximum(square, 0.0))
                vecs.append((r[:, None] * (k @ (r2[:, None] * _matrix(v, widths[kid])))).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vecs, type=pa.list_(pa.float64()))],
                                             names=["kid", "block", "w"])

    return fold


def _next(probes: dict[int, _Probes]):
    """The next vectors of a block: (w - alpha v - beta v before) / the new beta, 0 where a probe is done."""
    steps = {}
    for kid, p in probes.items():
        before = p.beta[-2] if len(p.beta) > 1 else np.zeros(p.count)
        steps[kid] = p.count, p.alpha[-1], before, p.beta[-1]

    def run(kids: pa.Array, w: pa.Array, cur: pa.Array, prev: pa.Array) -> pa.Array:
        out = []
        for i, kid in enumerate(kids.to_pylist()):
            width, alpha, before, after = steps[kid]
            new, now, old = (_values(c, i, width) for c in (w, cur, prev))
            out.append(np.where(after > 0, (new - alpha * now - before * old) / np.where(after > 0, after, 1.0), 0.0).ravel())
        return _lists(out)

    return F.arrow_udf(run, "array<double>")


def _dots(widths: dict[int, int]):
    """Per probe w'v and w'w of a block."""
    def run(kids: pa.Array, w: pa.Array, cur: pa.Array) -> pa.Array:
        out = []
        for i, kid in enumerate(kids.to_pylist()):
            a, b = (_values(c, i, widths[kid]) for c in (w, cur))
            out.append(np.concatenate([(a * b).sum(axis=0), (a * a).sum(axis=0)]))
        return _lists(out)

    return F.arrow_udf(run, "array<double>")


def vendi_lanczos(
    distinct: DataFrame, keys: list[str], gamma: float = 1.0, normalize: bool = True, probes: int = PROBES,
    steps: int = STEPS, block_rows: int = BLOCK_ROWS, seed: int = 42,
) -> DataFrame:
    """``keys, diversity, error, n, method`` of ``z, weight`` rows (distinct points per key)."""
    spark = distinct.sparkSession
    sizes = bounded_rows(distinct.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("weight").cast("double").alias("_w"),
                                                     F.max(F.size("z")).alias("_d")), MAX_KEYS)
    if sizes is None:
        raise ClusterError(f"More than {MAX_KEYS} keys")
    types = {f.name: f.dataType.simpleString() for f in distinct.schema.fields}
    schema = "".join(f"`{k}` {types[k]}, " for k in keys)
    if not sizes:
        return spark.createDataFrame([], schema + "diversity double, error double, n bigint, method string")
    dim = max(r["_d"] for r in sizes)
    found = {i: _Probes(r["_n"], probes) for i, r in enumerate(sizes)}
    table = spark.createDataFrame(
        [(*(r[k] for k in keys), i, 1 if found[i].exact else -(-r["_n"] // block_rows), found[i].exact, r["_w"])
         for i, r in enumerate(sizes)], schema + "kid int, blocks int, exact boolean, total double")
    placed = distinct.alias("l").join(F.broadcast(table).alias("r"), same_key("l", "r", keys)).select(
        "r.kid", "r.blocks", "r.exact", "l.z", F.sqrt(F.col("l.weight") / F.col("r.total")).alias("root"))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("z"), F.col("blocks")).cast("int"))
    # a block holds about ``block_rows`` points, whatever the key's size
    packed = written(dealt.groupBy("kid", "block", "blocks", "exact").agg(F.collect_list(F.struct("z", "root")).alias("p")).select(
        "kid", "block", "blocks", "exact", F.flatten("p.z").alias("z"), F.col("p.root").alias("r")), "lanczos-blocks")
    on = ["kid", "block"]

    def applied(state: DataFrame, widths: dict[int, int]) -> DataFrame:
        """``kid, block, w``: A times the vectors ``cur``.

        Vectors grow with the points, so they are shuffled, and never sent through the driver as tables to broadcast.
        """
        mine = packed.join(state.select("kid").distinct(), "kid", "left_semi")
        left = mine.select(*on, "z", "r", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        right = packed.join(state.hint("merge"), on).select("kid", F.col("block").alias("other"), F.col("z").alias("z2"), F.col("r").alias("r2"), "cur")
        met = left.join(right.hint("merge"), ["kid", "other"]).select("kid", "block", "z", "r", "z2", "r2", "cur")
        parts = met.mapInArrow(_products(widths, dim, gamma), "kid int, block int, w array<double>")
        return parts.groupBy(*on).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("w")))).alias("w"))

    def summed(rows: DataFrame) -> dict[int, np.ndarray]:
        """The vectors ``d`` added up by key."""
        return {r.kid: np.array(r.d) for r in rows.groupBy("kid").agg(
            vector_to_array(Summarizer.sum(array_to_vector(F.col("d")))).alias("d")).collect()}

    state = packed.where("exact").select(*on, _units({i: p.n for i, p in found.items()})("kid", "r").alias("cur"))
    if not all(p.exact for p in found.values()):
        half = {i: probes for i in found}
        sketch = packed.where("not exact").select(*on, _sketch(half, seed)("kid", "block", "r").alias("cur"))
        y = written(applied(sketch, half), "lanczos-sketch")
        turns = {}
        for kid, gram in summed(y.select("kid", _gram(half)("kid", "block", "w").alias("d"))).items():
            values, vectors = np.linalg.eigh(gram.reshape(probes, probes))
            keep = values > 1e-12 * values[-1]
            turns[kid] = np.where(keep[None, :], vectors / np.sqrt(np.where(keep, values, 1.0))[None, :], 0.0), keep
        inner = summed(y.select("kid", _gram(half, seed + 1)("kid", "block", "w").alias("d")))
        spans = {}
        for kid, (turn, keep) in turns.items():
            c = turn.T @ inner[kid].reshape(probes, probes)
            length = np.sqrt(np.maximum(found[kid].n - (c**2).sum(axis=0), 0.0))
            spans[kid] = turn, c, length
            found[kid].start(np.concatenate([keep.astype(float), np.where(length > 1e-9, length**2, 0.0)]))
        state = state.unionByName(y.select(*on, _starts(spans, half, seed + 1)("kid", "block", "w").alias("cur")))
    state = written(state.withColumn("prev", F.transform("cur", lambda x: x * 0.0)), "lanczos-start")
    widths = {i: p.count for i, p in found.items()}
    for _ in range(steps):
        moved = written(applied(state.select(*on, "cur"), widths).join(state.hint("merge"), on), "lanczos-step")
        for kid, d in summed(moved.select("kid", _dots(widths)("kid", "w", "cur").alias("d"))).items():
            found[kid].add(d[: len(d) // 2], d[len(d) // 2 :])
        if not any(p.open.any() for p in found.values()):
            break
        state = moved.select(*on, _next(found)("kid", "w", "cur", "prev").alias("next"), F.col("cur").alias("prev")).withColumnRenamed(
            "next", "cur")
    out = []
    for i, r in enumerate(sizes):
        n = int(r["_w"])
        entropy, error = found[i].estimate()
        low, mid, high = (float(np.exp(max(0.0, e))) for e in (entropy - error, entropy, entropy + error))
        if n <= 1:
            score, wide = (0.0 if normalize else 1.0), 0.0
        elif normalize:
            score = min(1.0, max(0.0, (mid - 1.0) / (n - 1.0)))
            wide = max(high - mid, mid - low) / (n - 1.0)
        else:
            score, wide = mid, max(high - mid, mid - low)
        out.append((i, score, wide, n, f"lanczos{probes}x{steps}"))
    scores = local_table(spark, out, "kid int, diversity double, error double, n bigint, method string")
    return table.join(F.broadcast(scores), "kid").select(*keys, "diversity", "error", "n", "method")
