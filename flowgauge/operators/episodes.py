"""Logged episodes: transitions, rollouts and policy evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import bounded_side
from ..functions.hashing import hash_hex
from ..functions.ordering import hash_cutoffs
from ..functions.vectors import dot
from .assign import as_matrix


def next_rows(
    df: DataFrame, col: str = "obs", out: str = "next_obs", episode: str = "episode", step: str = "step",
    terminal: str = "terminal",
) -> DataFrame:
    """Value of the following row of the episode; a last or terminal row keeps its own.

    Steps number the rows of an episode without gaps, so the follower is found
    by an equality join on (episode, step + 1) and a very long episode is
    spread over tasks like any other rows.
    """
    follower = df.select(
        F.col(episode).alias("_e"), (F.col(step) - 1).alias("_s"), F.col(col).alias("_next")
    )
    joined = df.join(
        follower, (F.col(episode) == F.col("_e")) & (F.col(step) == F.col("_s")), "left"
    )
    value = F.when(F.col(terminal) | F.col("_next").isNull(), F.col(col)).otherwise(F.col("_next"))
    return joined.withColumn(out, value).drop("_e", "_s", "_next")


def transitions(
    log: DataFrame, obs: str = "obs", episode: str = "episode", step: str = "step", max_steps: int | None = None
) -> DataFrame:
    """``episode, step, obs, action, reward, next_obs, terminal, timeout`` of a log.

    ``log`` has a boolean ``terminal``; a row at the step limit that is not
    terminal is a timeout.
    """
    if max_steps is None:
        timeout = F.lit(False)
    else:
        timeout = ~F.col("terminal") & (F.col(step) >= max_steps - 1)
    cols = [episode, step, obs, "action", "reward", "next_obs", "terminal", "timeout"]
    return next_rows(log, obs, "next_obs", episode, step).withColumn("timeout", timeout).select(*cols)


def initial_rows(df: DataFrame, step: str = "step") -> DataFrame:
    """Episode starts."""
    return df.filter(F.col(step) == 0)


def episode_totals(df: DataFrame, last: list[str] | None = None, keys: list[str] | None = None,
                   episode: str = "episode", step: str = "step") -> DataFrame:
    """Reward sum, length and the final value of the ``last`` columns."""
    return df.groupBy(*(keys or []), episode).agg(
        F.sum("reward").alias("total_reward"),
        F.count(F.lit(1)).alias("length"),
        *[F.max_by(c, step).alias(f"final_{c}") for c in last or []],
    )


def best_of(df: DataFrame, score: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """The row with the highest score; the lowest ``order`` on ties."""
    keys = keys or []
    rest = [c for c in df.columns if c not in keys]
    # One sort-free pass: highest score first, then lowest position.
    top = F.min_by(F.struct(*rest), F.struct(-F.col(score), F.col(order))).alias("_b")
    return df.groupBy(*keys).agg(top).select(*keys, "_b.*")


def rollout_summary(df: DataFrame, last: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Means over episodes of total reward, length and final scores."""
    totals = episode_totals(df, last, keys)
    return totals.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.avg("total_reward").alias("mean_reward"),
        F.avg("length").alias("mean_length"),
        *[F.avg(f"final_{c}").alias(f"mean_{c}") for c in last or []],
    )


def bellman_target(reward: Column, next_q: Column, terminal: Column, gamma: float = 0.99) -> Column:
    """r + gamma * Q(s', pi(s')) unless the row is terminal."""
    return reward + F.lit(gamma) * next_q * F.when(terminal, 0.0).otherwise(1.0)


def q_features(obs: Column, action: Column) -> Column:
    """Bias, state, action and their squares."""
    both = F.concat(obs, action)
    return F.concat(F.array(F.lit(1.0)), both, F.transform(both, lambda v: v * v))


def normal_equations(df: DataFrame, phi: Column, next_phi: Column, keys: list[str]) -> DataFrame:
    """Sums of phi phi', phi (1-terminal) next_phi' and phi r per key, in one pass.

    These three fix every later iteration, so the rows are read once whatever
    the number of iterations.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "vec array<double>"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for key, rows in pdf.groupby(keys, sort=False):
                a, b = np.stack(rows["_phi"].to_numpy()), np.stack(rows["_next"].to_numpy())
                alive = (~rows["terminal"].to_numpy(bool)).astype(float)
                vec = np.concatenate([
                    (a.T @ a).ravel(), (a.T @ (alive[:, None] * b)).ravel(), a.T @ rows["reward"].to_numpy(float),
                    [len(a)],
                ])
                sums[key] = sums[key] + vec if key in sums else vec
        for key, vec in sums.items():
            yield pd.DataFrame([(*key, vec)], columns=[*keys, "vec"])

    rows = df.select(*keys, "reward", "terminal", phi.alias("_phi"), next_phi.alias("_next"))
    return rows.mapInPandas(fold, schema).groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("vec")))).alias("vec")
    )


def solve_q(vec: list[float], gamma: float, iterations: int, ridge: float) -> np.ndarray:
    """Repeated ridge regression on Bellman targets from the summed equations."""
    v = np.asarray(vec)
    d = int((-1 + np.sqrt(1 + 8 * (len(v) - 1))) / 4)
    a, b, r, n = v[: d * d].reshape(d, d), v[d * d : 2 * d * d].reshape(d, d), v[2 * d * d : -1], v[-1]
    left = a + ridge * max(n, 1.0) * np.eye(d)
    w = np.zeros(d)
    for _ in range(iterations):
        w = np.linalg.solve(left, r + gamma * b @ w)
    return w


def fitted_q(
    df: DataFrame,
    policy,
    gamma: float = 0.99,
    iterations: int = 100,
    ridge: float = 1e-6,
    keys: list[str] | None = None,
) -> DataFrame:
    """Linear Q of ``policy`` from logged transitions: ``keys, w``.

    ``policy`` maps the observation column to an action column (an expression or
    a vectorised function).
    """
    keys = keys or []
    inner = keys or ["_one"]
    work = df if keys else df.withColumn("_one", F.lit(0))
    eq = normal_equations(
        work, q_features(F.col("obs"), F.col("action")), q_features(F.col("next_obs"), policy(F.col("next_obs"))), inner
    )

    @F.pandas_udf("array<double>")
    def solve(v: pd.Series) -> pd.Series:
        return pd.Series([solve_q(x, gamma, iterations, ridge) for x in v])

    return eq.select(*keys, solve("vec").alias("w"))


def policy_value(df: DataFrame, policy, weights: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean Q at the episode starts under the policy."""
    keys = keys or []
    phi = q_features(F.col("obs"), policy(F.col("obs")))
    starts = initial_rows(df).select(*keys, phi.alias("_phi"))
    if not keys:
        w = weights.first().w
        return starts.agg(F.avg(dot(F.col("_phi"), F.lit([float(v) for v in w]))).alias("value"), F.count(F.lit(1)).alias("n"))
    joined = starts.join(bounded_side(weights), keys)
    return joined.groupBy(*keys).agg(F.avg(dot(F.col("_phi"), F.col("w"))).alias("value"), F.count(F.lit(1)).alias("n"))


def split_sides(df: DataFrame, n_splits: int, seed: int = 42, episode: str = "episode", out: str = "held") -> DataFrame:
    """Add an array of ``n_splits`` flags: whether the row's episode is in the held-out half of each split.

    Halves are exact (by the rank of a hash of the episode); rows are neither copied nor shuffled.
    """
    hashed = df.select(episode).distinct().select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), hash_hex(seed + k, F.col(episode)).alias("_h")) for k in range(n_splits)])
                  ).alias("x")).select("x.*")
    cuts = hash_cutoffs(hashed, ["fold"], "_h", {"cut": F.floor(F.col("_n") / 2)})
    # one hash per split
    bounds = {r.fold: r.cut for r in cuts.collect()}
    held = F.array(*[hash_hex(seed + k, F.col(episode)) > F.lit(bounds.get(k, "")) for k in range(n_splits)])
    return df.withColumn(out, held)


def policy_equations(df: DataFrame, policies: dict[str, Callable[[Column], Column]], held: str = "held") -> DataFrame:
    """``split, policy, vec, start, n_starts``: the normal equations of every policy on every split's held-out rows.

    One pass over transitions: a row's features are made once, its next features once per policy, and both go into the sums
    of every split that holds it; rows that begin an episode also give the mean features under each policy.
    """
    names = list(policies)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            a, both, first = (as_matrix(batch.column(i)) for i in (0, 1, 2))
            d = a.shape[1]
            inside = np.array(batch.column(3).to_pylist(), dtype=bool)
            reward = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            alive = ~np.array(batch.column(5).to_pylist(), dtype=bool)
            begins = np.array(batch.column(6).to_pylist(), dtype=bool)
            for s in range(inside.shape[1]):
                mine = inside[:, s]
                x, r, live = a[mine], reward[mine], alive[mine].astype(float)
                start = begins & mine
                outer, right = (x.T @ x).ravel(), x.T @ r
                for p in range(len(names)):
                    part = slice(p * d, (p + 1) * d)
                    vec = np.concatenate([outer, (x.T @ (live[:, None] * both[mine, part])).ravel(), right, [len(x)],
                                          first[start, part].sum(axis=0), [start.sum()]])
                    sums[s, p] = sums[s, p] + vec if (s, p) in sums else vec
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in sums], type=pa.int32()), pa.array([p for _, p in sums], type=pa.int32()),
             pa.array(list(sums.values()), type=pa.list_(pa.float64()))], names=["split", "p", "vec"])

    obs, after = F.col("obs"), F.col("next_obs")
    rows = df.select(
        q_features(obs, F.col("action")).alias("phi"), F.concat(*[q_features(after, f(after)) for f in policies.values()]).alias("next"),
        F.concat(*[q_features(obs, f(obs)) for f in policies.values()]).alias("first"), held, F.col("reward").cast("double").alias("reward"),
        F.col("terminal").alias("terminal"), (F.col("step") == 0).alias("begins"))
    found = rows.mapInArrow(fold, "split int, p int, vec array<double>").groupBy("split", "p").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("vec")))).alias("vec"))
    return found.withColumn("policy", F.get(F.lit(names), F.col("p"))).drop("p")


def policy_values(
    df: DataFrame, policies: dict[str, Callable[[Column], Column]], n_splits: int = 20, gamma: float = 0.99,
    iterations: int = 100, ridge: float = 1e-6, seed: int = 42,
) -> DataFrame:
    """``split, policy, value``: the fitted value of every policy at the episode starts of every split's held-out half.

    ``df`` holds transitions (``episode, step, obs, action, reward, terminal, next_obs``), read once for all policies and
    splits.
    """
    equations = policy_equations(split_sides(df, n_splits, seed), policies)

    def run(vecs: pa.Array) -> pa.Array:
        out = []
        for v in vecs:
            v = v.values.to_numpy(zero_copy_only=False)
            d = int(round((-2 + np.sqrt(4 + 8 * (len(v) - 2))) / 4))
            w = solve_q(v[: 2 * d * d + d + 1], gamma, iterations, ridge)
            starts = v[-1]
            out.append(float(w @ v[-d - 1 : -1] / starts) if starts else None)
        return pa.array(out, type=pa.float64())

    return equations.select("split", "policy", F.arrow_udf(run, "double")("vec").alias("value"))
