"""k-means of many models at once: every step is one pass over the rows, packed in blocks, that moves all of them.

A model is one (group, k, restart); a row belongs to a group, and meets all models of its group in one matrix product.  A
task hands on one vector per model: the counts, vector sums and sums of squared norms of its clusters' members; they are
added up by model, and the driver moves the centres, which are as many numbers as all models together have.
Models that stand still drop out of the next pass.  Starts are chosen by k-means++ on a bounded sample of each group
(``start_rows`` by hash of the row id); everything else sees all rows.

The mean squared silhouette of all chosen models is one more pass: the sums of the members give the mean squared distance
of a row to every cluster.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.blocks import added_up, matrix, packed
from ..functions.hashing import hash_unit
from .assign import ClusterError, as_matrix, from_matrix

START_ROWS = 2000
#: Distances that a block of models and a chunk of rows have at once, and the least rows of a chunk.
CHUNK_VALUES, MIN_CHUNK = 1 << 17, 256

Key = tuple[int, int, int]  # group, k, restart


@dataclass
class Fit:
    """A model after its last step, with what its members add up to."""

    centres: np.ndarray
    cost: float
    sizes: np.ndarray
    sums: np.ndarray
    norms: np.ndarray
    restart: int
    steps: int
    silhouette: float = 0.0


def starts(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each further start is a row drawn by its squared distance to the nearest one so far."""
    chosen = [int(rng.integers(len(sample)))]
    left = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = left.sum()
        at = int(rng.choice(len(sample), p=left / total)) if total > 0 else int(rng.integers(len(sample)))
        chosen.append(at)
        left = np.minimum(left, ((sample - sample[at]) ** 2).sum(axis=1))
    return sample[chosen].astype(float)


class _Stack:
    """The centres of several models of one group; models of the same k lie side by side and are met together."""

    def __init__(self, models: dict[int, np.ndarray]):
        by_k: dict[int, list[int]] = {}
        for name, centres in models.items():
            by_k.setdefault(len(centres), []).append(name)
        self.names = [name for names in by_k.values() for name in names]
        self.sizes = [k for k, names in by_k.items() for _ in names]
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.centres = np.concatenate([models[m] for m in self.names])
        #: per k its first model, its number of models, and its centres by place in the model, then model
        self.blocks = []
        first = 0
        for k, names in by_k.items():
            c = np.stack([models[m] for m in names], axis=1)
            # the squared norm of a centre meets a column of ones
            self.blocks.append((first, len(names), np.hstack([-2.0 * c.reshape(k * len(names), -1), (c * c).sum(axis=2).reshape(-1, 1)])))
            first += len(names)
        self.width = max(len(c) for _, _, c in self.blocks)

    def nearest(self, x: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per model (rows) and point (columns) the place of the nearest centre, and its squared distance."""
        at = np.empty((len(self.names), len(x)), dtype=np.int64)
        low = np.empty((len(self.names), len(x)))
        columns = np.vstack([x.T, np.ones(len(x))])
        for first, n, centres in self.blocks:
            d = (centres @ columns).reshape(-1, n, len(x))
            best, place = low[first : first + n], np.zeros((n, len(x)), dtype=np.min_scalar_type(len(d)))
            best[:] = d[0]
            for i in range(1, len(d)):
                # the last place that improves is the largest one; a masked copy would branch on every value
                np.maximum(place, (d[i] < best) * place.dtype.type(i), out=place)
                np.minimum(best, d[i], out=best)
            np.add(place, self.begins[first : first + n, None], out=at[first : first + n])
        low += squares
        return at, np.maximum(low, 0.0, out=low)

    def add_up(self, x: np.ndarray, squares: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per centre the count, the squared norms and the vector sum of the points that ``at`` gives it."""
        flat, size = at.ravel(), len(self.centres)

        def total(column: np.ndarray) -> np.ndarray:
            return np.bincount(flat, weights=np.tile(column, len(at)), minlength=size)

        sums = np.empty(self.centres.shape)
        for j, column in enumerate(x.T):
            sums[:, j] = total(column)
        return np.bincount(flat, minlength=size).astype(float), total(squares), sums


def _chunks(batches: Iterator[pa.RecordBatch], width: dict[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(group, points) of a few rows at a time."""
    for batch in batches:
        groups, points = batch.column(0).to_numpy(zero_copy_only=False), as_matrix(batch.column(1))
        for g in np.unique(groups).tolist():
            if g not in width:
                continue
            mine = points[groups == g]
            step = max(MIN_CHUNK, CHUNK_VALUES // max(1, width[g]))
            for i in range(0, len(mine), step):
                yield g, mine[i : i + step]


def _partials(stacks: dict[int, _Stack]):
    """Count, squared norms, cost and vector sum per model and cluster of a task's rows."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for g, x in _chunks(batches, {g: s.width for g, s in stacks.items()}):
            stack = stacks[g]
            squares = (x * x).sum(axis=1)
            at, cost = stack.nearest(x, squares)
            if g not in held:
                held[g] = [np.zeros(len(stack.centres)), np.zeros(len(stack.centres)), np.zeros(stack.centres.shape),
                           np.zeros(len(stack.names))]
            for total, part in zip(held[g], (*stack.add_up(x, squares, at), cost.sum(axis=1)), strict=True):
                total += part
        for g, (n, q, sums, cost) in held.items():
            stack = stacks[g]
            # one row per model: its cost, then counts, squared norms and sums of its clusters
            vecs = [np.concatenate([[c], n[a:b], q[a:b], sums[a:b].ravel()])
                    for c, a, b in zip(cost, stack.begins, stack.ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(stack.names, type=pa.int32()), pa.array(vecs, type=pa.list_(pa.float64()))], names=["model", "vec"])

    return fold


def _batches(blocks: Iterable[Row]) -> Iterator[pa.RecordBatch]:
    """Blocks as batches of (group, point)."""
    for block in blocks:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(block.n, block["_group"], dtype=np.int32)), from_matrix(matrix(block, "_z"))],
                                         names=["_group", "_z"])


def _pass(blocks: RDD, models: dict[Key, np.ndarray]) -> dict[Key, tuple]:
    """(sizes, squared norms, cost, vector sums) of every model after assigning all rows."""
    names = list(models)
    by_group: dict[int, dict[int, np.ndarray]] = {}
    for i, key in enumerate(names):
        by_group.setdefault(key[0], {})[i] = models[key]
    partials = _partials({g: _Stack(m) for g, m in by_group.items()})

    def fold(rows: Iterable[Row]) -> Iterator[tuple[int, np.ndarray]]:
        for out in partials(_batches(rows)):
            for name, vec in zip(out.column(0).to_pylist(), out.column(1), strict=True):
                yield name, np.array(vec.values)

    numbers = sum(1 + len(c) * (2 + c.shape[1]) for c in models.values())
    out = {key: (np.zeros(len(c)), np.zeros(len(c)), 0.0, np.zeros(c.shape)) for key, c in models.items()}
    for i, vec in added_up(blocks, fold, len(names), numbers).items():
        key = names[i]
        k = len(models[key])
        out[key] = vec[1 : k + 1], vec[k + 1 : 2 * k + 1], float(vec[0]), vec[2 * k + 1 :].reshape(k, -1)
    return out


def _samples(points: DataFrame, counts: dict[int, int], start_rows: int) -> dict[int, np.ndarray]:
    """Up to about ``start_rows`` rows of each group, by the hash of their id."""
    share = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(min(1.0, 1.2 * start_rows / n)))])
    some = points.where(F.col("_u") < share[F.col("_group")]).select("_group", "_z").orderBy("_group", "_u")
    table = some.limit(2 * start_rows * len(counts)).toArrow()
    groups, rows = table.column(0).to_numpy(), as_matrix(table.column(1).combine_chunks())
    return {g: rows[groups == g] for g in counts}


def kmeans_many(
    df: DataFrame, ks: list[int], restarts: int, seed: int = 42, z: str = "z", row_id: str = "row_id",
    group: str | None = None, max_iter: int = 50, tol: float = 1e-4, start_rows: int = START_ROWS,
) -> dict[tuple[int, int], Fit]:
    """The cheapest of ``restarts`` models for every (group, k) with k below the group's rows, with its silhouette.

    ``group`` names an int column; without one all rows are group 0.  A model stands still when its centres move by at
    most ``tol`` times the mean variance of the group's values (sum of squares).  A cluster that loses all its rows keeps
    its centre.
    """
    which = F.col(group).cast("int") if group else F.lit(0)
    points = df.select(which.alias("_group"), F.col(z).alias("_z"), hash_unit(seed, F.col(row_id)).alias("_u"))
    held = df.is_cached
    points = points if held else points.persist()
    vec = array_to_vector(F.col("_z"))
    sums = points.groupBy("_group").agg(F.count("*").alias("n"), Summarizer.variance(vec).alias("v")).collect()
    counts = {r["_group"]: r.n for r in sums}
    still = {r["_group"]: tol * float(np.mean(r.v.toArray())) for r in sums}
    models: dict[Key, np.ndarray] = {}
    samples = _samples(points, counts, start_rows) if counts else {}
    for g, n in sorted(counts.items()):
        for k in ks:
            if k < n:
                for r in range(restarts):
                    models[g, k, r] = starts(samples[g], k, np.random.default_rng([seed + r, g, k]))
    if not models:
        raise ClusterError(f"No candidate k is below the {sum(counts.values())} rows to cluster")
    moving, steps = dict(models), dict.fromkeys(models, 0)
    kept = packed(points, ["_group"], ["_z"]).persist()
    rows = kept.rdd
    for _ in range(max_iter):
        found = _pass(rows, moving)
        for key, (n, _, _, total) in found.items():
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1.0)[:, None], models[key])
            shift = float(((new - models[key]) ** 2).sum())
            models[key] = moving[key] = new
            steps[key] += 1
            if shift <= still[key[0]]:
                del moving[key]
        if not moving:
            break
    best: dict[tuple[int, int], Fit] = {}
    for (g, k, r), (n, q, cost, total) in sorted(_pass(rows, models).items()):
        if (g, k) not in best or cost < best[g, k].cost:
            best[g, k] = Fit(models[g, k, r], cost, n, total, q, r, steps[g, k, r])
    _silhouettes(rows, best)
    kept.unpersist()
    if not held:
        points.unpersist()
    return best


def _silhouettes(blocks: RDD, fits: dict[tuple[int, int], Fit]) -> None:
    """Fill in the mean silhouette of squared distances of all fits, in one pass."""
    names = list(fits)
    by_group: dict[int, dict[int, Fit]] = {}
    for i, key in enumerate(names):
        by_group.setdefault(key[0], {})[i] = fits[key]
    stacks = {g: _Stack({i: f.centres for i, f in m.items()}) for g, m in by_group.items()}

    def fold(rows: Iterable[Row]) -> Iterator[tuple[int, float]]:
        total: dict[int, float] = {}
        for g, x in _chunks(_batches(rows), {g: s.width for g, s in stacks.items()}):
            squares = (x * x).sum(axis=1)
            at, _ = stacks[g].nearest(x, squares)
            for j, i in enumerate(stacks[g].names):
                fit = by_group[g][i]
                n = np.maximum(fit.sizes, 1.0)
                d = squares[:, None] + (fit.norms / n)[None, :] - 2.0 * (x @ (fit.sums / n[:, None]).T)
                d[:, fit.sizes == 0] = np.inf
                own = at[j] - stacks[g].begins[j]
                at_row = np.arange(len(x))
                a = d[at_row, own] * fit.sizes[own] / np.maximum(fit.sizes[own] - 1.0, 1.0)
                d[at_row, own] = np.inf
                b = d.min(axis=1)
                top = np.maximum(a, b)
                value = np.where((fit.sizes[own] > 1) & np.isfinite(b) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
                total[i] = total.get(i, 0.0) + float(np.nan_to_num(value).sum())
        return iter(total.items())

    for i, total in added_up(blocks, fold, len(names), len(names)).items():
        fit = fits[names[i]]
        fit.silhouette = total / max(1.0, float(fit.sizes.sum()))


def nearest_of(df: DataFrame, centres: dict[int, np.ndarray], group: str | None = None, z: str = "z",
               out: str = "cluster_id") -> DataFrame:
    """The nearest centre of each row among those of its group (null where the group has none)."""
    stacks = {g: _Stack({0: c}) for g, c in centres.items()}

    def run(groups: pa.Array, points: pa.Array) -> pa.Array:
        found = np.full(len(points), -1, dtype=np.int32)
        if len(points):
            x, g = as_matrix(points), groups.to_numpy(zero_copy_only=False)
            for name in np.unique(g).tolist():
                if name in stacks:
                    mine = np.flatnonzero(g == name)
                    found[mine] = stacks[name].nearest(x[mine], (x[mine] ** 2).sum(axis=1))[0][0]
        return pa.array(found, mask=found < 0)

    which = F.col(group).cast("int") if group else F.lit(0)
    return df.withColumn(out, F.arrow_udf(run, "int")(which, F.col(z)))
