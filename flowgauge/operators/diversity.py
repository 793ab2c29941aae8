"""Vendi diversity by additive random features, or by the full kernel where a caller asks for it.

The method never depends on the number of rows.  Random features (the default) give one matrix of fixed size per key
that partials add up to; ``lanczos`` works on the full kernel block by block; the exact form holds all distinct points of a
key in one task and is for keys known to be small.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assign import as_matrix
from .clustering import block_sums
from .lanczos import vendi_lanczos

DEFAULT_FREQUENCIES = 512
METHODS = ("rff", "exact", "lanczos")
# Matrices that a task holds before it hands them on.
HELD_BYTES = 128 << 20
# Rows of a kernel matrix that are made at once.
KERNEL_ROWS = 1024
# Rows of one shuffled piece of a covariance matrix.
COVARIANCE_ROWS = 64


def spectral_score(eigenvalues: np.ndarray) -> float:
    """exp of the entropy of a spectrum that sums to 1."""
    lam = eigenvalues[eigenvalues > 1e-12]
    return float(np.exp(-(lam * np.log(lam)).sum()))


def normalised(score: float, n: int, normalize: bool) -> float:
    if n <= 1:
        return 0.0 if normalize else 1.0
    return float(min(1.0, max(0.0, (score - 1.0) / (n - 1.0)))) if normalize else score


def gaussian_kernel(gamma: float) -> Callable[[np.ndarray], np.ndarray]:
    def kernel(points: np.ndarray) -> np.ndarray:
        norms = (points * points).sum(axis=1)
        out = np.empty((len(points), len(points)))
        for at in range(0, len(points), KERNEL_ROWS):
            rows = out[at : at + KERNEL_ROWS]
            np.matmul(points[at : at + KERNEL_ROWS], -2.0 * points.T, out=rows)
            rows += norms[at : at + KERNEL_ROWS, None]
            rows += norms[None, :]
            np.maximum(rows, 0.0, out=rows)
            rows *= -gamma
            np.exp(rows, out=rows)
        return out

    return kernel


def weighted_vendi(points: np.ndarray, weights: np.ndarray, kernel) -> float:
    """Vendi score of points with multiplicities.

    Copies add nothing but weight: sqrt(w) K sqrt(w) / n over distinct points has the
    non-zero spectrum of the full kernel matrix.
    """
    root = np.sqrt(weights / weights.sum())
    matrix = kernel(points) * root[:, None]
    matrix *= root[None, :]
    return spectral_score(np.linalg.eigvalsh(matrix))


def _hash_unit(text: str) -> float:
    return (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48


def frequencies(dim: int, m: int, gamma: float, seed: int) -> np.ndarray:
    """Random Fourier frequencies of exp(-gamma |x-y|^2) (Rahimi and Recht, 2007).

    Normal draws of ``seed:dimension:frequency`` by the library's hash, which SQL can recompute.
    """
    draws = [[
        math.sqrt(-2.0 * math.log(_hash_unit(f"{seed}:{i}:{j}:u"))) * math.cos(2.0 * math.pi * _hash_unit(f"{seed}:{i}:{j}:v"))
        for j in range(m)] for i in range(dim)]
    return math.sqrt(2.0 * gamma) * np.array(draws).reshape(dim, m)


def fourier_features(points: np.ndarray, omega: np.ndarray) -> np.ndarray:
    angle = points @ omega
    return np.concatenate([np.cos(angle), np.sin(angle)], axis=1) / np.sqrt(omega.shape[1])


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{k}` {types[k]}, " for k in keys)


def _constant_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("_one", F.lit(0)), ["_one"])


def exact_vendi(
    distinct: DataFrame, keys: list[str], gamma: float = 1.0, normalize: bool = True, kernel=None
) -> DataFrame:
    """Exact score per key of ``z, weight`` rows (distinct points)."""
    fn = kernel or gaussian_kernel(gamma)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        weights = pdf["weight"].to_numpy(float)
        n = int(weights.sum())
        score = weighted_vendi(np.stack(pdf["z"].to_numpy()), weights, fn) if n > 1 else 1.0
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "diversity": [normalised(score, n, normalize)], "n": [n], "method": ["exact"]})

    schema = _key_schema(distinct, keys) + "diversity double, n bigint, method string"
    return distinct.select(*keys, "z", "weight").groupBy(*keys).applyInPandas(solve, schema)


def covariance_partials(
    df: DataFrame, keys: list[str], gamma: float = 1.0, m: int = DEFAULT_FREQUENCIES, seed: int = 42, z: str = "z"
) -> DataFrame:
    """Summed random-feature outer products ``keys, part, total, n``.

    Every task folds its rows into one matrix per key and emits its upper
    triangle in pieces; the pieces are added up by a vector aggregate.  The
    result is additive: partials of disjoint rows just sum.
    """
    schema = _key_schema(df, keys) + "part int, vec array<double>, n bigint"
    held = max(1, HELD_BYTES // (8 * 4 * m * m))

    def pieces(totals: dict, counts: dict) -> Iterator[pd.DataFrame]:
        for key, matrix in totals.items():
            out = []
            for part, start in enumerate(range(0, 2 * m, COVARIANCE_ROWS)):
                piece = matrix[start : start + COVARIANCE_ROWS, start:]
                out.append((*key, part, piece.ravel(), counts[key] if part == 0 else 0))
            yield pd.DataFrame(out, columns=[*keys, "part", "vec", "n"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        omega, totals, counts = None, {}, {}
        for pdf in batches:
            if not len(pdf):
                continue
            points = as_matrix(pa.array(pdf["z"], type=pa.list_(pa.float64())))
            if omega is None:
                omega = frequencies(points.shape[1], m, gamma, seed)
            for key, places in pdf.groupby(keys, dropna=False, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                phi = fourier_features(points[places], omega)
                if key not in totals and len(totals) >= held:
                    # partials add up, so what is held can be handed on at any time
                    yield from pieces(totals, counts)
                    totals, counts = {}, {}
                totals[key] = totals[key] + phi.T @ phi if key in totals else phi.T @ phi
                counts[key] = counts.get(key, 0) + len(places)
        yield from pieces(totals, counts)

    return add_covariances(df.select(*keys, F.col(z).alias("z")).mapInPandas(fold, schema), keys, "vec")


def add_covariances(partials: DataFrame, keys: list[str], vec: str = "total") -> DataFrame:
    return partials.groupBy(*keys, "part").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col(vec)))).alias("total"), F.sum("n").alias("n")
    )


def unpacked(pdf: pd.DataFrame, m: int) -> np.ndarray:
    """The symmetric matrix behind its stored pieces."""
    upper = np.zeros((2 * m, 2 * m))
    for part, vec in zip(pdf["part"], pdf["total"], strict=True):
        start = part * COVARIANCE_ROWS
        upper[start : start + COVARIANCE_ROWS, start:] = np.asarray(vec).reshape(-1, 2 * m - start)
    return np.triu(upper) + np.triu(upper, 1).T


def covariance_scores(
    partials: DataFrame, keys: list[str], m: int = DEFAULT_FREQUENCIES, normalize: bool = True
) -> DataFrame:
    """Score per key from summed outer products (one 2m x 2m matrix per key)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, full = int(pdf["n"].sum()), unpacked(pdf, m)
        score = spectral_score(np.linalg.eigvalsh(full / max(n, 1))) if n > 1 else 1.0
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "diversity": [normalised(score, n, normalize)], "n": [n], "method": [f"rff{m}"]})

    schema = _key_schema(partials, keys) + "diversity double, n bigint, method string"
    return partials.groupBy(*keys).applyInPandas(solve, schema)


def diversity(
    df: DataFrame,
    keys: list[str] | None = None,
    gamma: float = 1.0,
    normalize: bool = True,
    method: str = "rff",
    m: int = DEFAULT_FREQUENCIES,
    seed: int = 42,
    z: str = "z",
    kernel=None,
) -> DataFrame:
    """``diversity, n, method`` per key, by one method for all keys.

    ``rff``: random Fourier features (Ospanov et al., 2024) with ``m`` frequencies.  ``lanczos``: the full kernel by
    stochastic Lanczos quadrature, spread over pairs of blocks.  ``exact``: the kernel matrix of a key's distinct points,
    in one task per key.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown diversity method: {method}")
    if kernel is not None and method != "exact":
        raise ValueError("A custom kernel needs method='exact'")
    keys = keys or []
    points, inner = _constant_key(df.select(*keys, F.col(z).alias("z")), keys)
    if method == "lanczos":
        distinct = points.groupBy(*inner, "z").agg(F.count(F.lit(1)).alias("weight"))
        return vendi_lanczos(distinct, inner, gamma, normalize, seed=seed).select(*keys, "diversity", "n", "method")
    if method == "exact":
        distinct = points.groupBy(*inner, "z").agg(F.count(F.lit(1)).alias("weight"))
        return exact_vendi(distinct, inner, gamma, normalize, kernel).select(*keys, "diversity", "n", "method")
    partials = covariance_partials(points, inner, gamma, m, seed)
    return covariance_scores(partials, inner, m, normalize).select(*keys, "diversity", "n", "method")


def warn_if_coarse(gamma: float, dim: int, spread: float) -> None:
    """Random features are a poor fit where nearly all kernel values are close to 0."""
    if gamma * spread > 20.0:
        warnings.warn(
            f"gamma x squared distance is about {gamma * spread:.0f} in {dim} dimensions; "
            "random features will be coarse, prefer method='exact' or a smaller gamma",
            stacklevel=2,
        )


def order_two_diversity(
    df: DataFrame, keys: list[str] | None = None, gamma: float = 1.0, z: str = "z", row_id: str = "row_id"
) -> DataFrame:
    """Order-2 score n^2 / sum of k(x_i, x_j)^2 per key, exact, by block sums."""
    points, inner = _constant_key(df, keys or [])
    sums = block_sums(points.withColumn("_group", F.lit(0)), inner, "_group", z, row_id, kernel=gamma)
    return sums.groupBy(*inner).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) * F.count(F.lit(1)) / F.sum("total")).alias("vendi2"),
    ).select(*(keys or []), "n", "vendi2")
