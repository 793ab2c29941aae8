"""Generated batches: drawn settings perturb a dataset's rows, are scored, and the best ones retrain classifiers.

A dataset is prepared once (split, scaler, encoder, clusters, partials of its test set).  All batches of all settings are
drawn, perturbed, scaled, encoded and assigned in one plan keyed by batch; their scores come from the partials.  Classifiers
are fitted once per distinct chosen batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import bounded_rows, written
from ..functions.vectors import pack
from ..operators.assign import ClusterModel
from ..operators.classify import retrain_and_score
from ..operators.clean import apply_scaler, fit_scaler
from ..operators.clustering import cluster
from ..operators.mlp import Network, encode, fit_encoder
from ..operators.perturb import map_actions, perturb
from ..operators.sampling import SplitError, random_configs, stratified_split
from ..operators.scores import feature_stats
from .augment import BaseScores, base_scores, best_batches, candidate_scores, score_candidates

RATIOS = {"train": 0.6, "val": 0.2, "test": 0.2}
#: Classifiers are fitted one after the other, one set per chosen batch.
MAX_CHOSEN = 1000


@dataclass
class Workbench:
    """A dataset ready for generated batches."""

    train_raw: DataFrame  # row_id, features of the train rows, not scaled
    scaled: DataFrame  # row_id, y, side, features
    stats: DataFrame
    scaler: DataFrame
    net: Network
    clusters: DataFrame
    base: BaseScores
    label: int

    def release(self) -> None:
        self.base.release()
        for rows in (self.train_raw, self.scaled):
            rows.unpersist()


def prepare(
    df: DataFrame, features: list[str], seed: int = 42, label: int = 0, row_id: str = "row_id", ks: list[int] | None = None,
    restarts: int = 10, m: int = 64, **training,
) -> Workbench:
    """Split ``df`` (row_id, y, features), fit scaler, encoder and clusters to its train rows, and score its test rows.

    ``label`` is what generated rows are labelled with; ``training`` goes to ``fit_encoder``.
    """
    split = stratified_split(df, RATIOS, [seed], "y", row_id).persist()
    train = split.filter(F.col("split") == "train")
    scaler = fit_scaler(train, features)
    scaled = apply_scaler(split, scaler, features).select(
        F.col(row_id).alias("row_id"), "y", F.col("split").alias("side"), pack(features).alias("features")).persist()
    net, _ = fit_encoder(scaled.filter(F.col("side") == "train"), seed=seed, **training)
    latent = encode(scaled, net)
    table = cluster(latent.filter(F.col("side") == "train"), ks, restarts, seed)[0]
    base = base_scores(latent.filter(F.col("side") != "val"), ClusterModel.load(table), m=m)
    raw = train.select(F.col(row_id).alias("row_id"), pack(features).alias("features")).persist()
    return Workbench(raw, scaled, feature_stats(train, features), scaler, net, table, base, label)


def random_settings(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``batch, config``: n drawn settings."""
    draws = map_actions(random_configs(spark, n, 1, seed=seed))
    return draws.select(F.col("episode").alias("batch"), "config")


def generate(bench: Workbench, settings: DataFrame, draws: int = 50, seed: int = 42) -> DataFrame:
    """``batch, y, features, z``: ``draws`` rows for every setting (``batch, config``)."""
    requests = settings.select("batch", "config", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_i"))
    requests = requests.select("batch", "config", (F.col("batch") * draws + F.col("_i")).alias("draw_id"))
    rows = perturb(bench.train_raw, requests, bench.stats, seed, bench.label, bench.scaler)
    return encode(rows.select("batch", "y", "features"), bench.net)


def _retrained(bench: Workbench, batches: DataFrame, chosen: list, kinds: dict[str, dict] | None, seed: int) -> DataFrame:
    """Per chosen batch and model: metrics on the validation rows after fitting train, test and the batch's rows."""
    train, test, holdout = (bench.scaled.filter(F.col("side") == s) for s in ("train", "test", "val"))
    parts = []
    for b in chosen:
        extra = test.select("features", "y").unionByName(batches.filter(F.col("batch") == b).select("features", "y"))
        parts.append(retrain_and_score(train, extra, holdout, kinds, seed).withColumn("batch", F.lit(b)))
    return reduce(DataFrame.unionByName, parts)


def _distinct_batches(best: DataFrame) -> list:
    rows = bounded_rows(best.select("batch").distinct(), MAX_CHOSEN)
    if rows is None:
        raise SplitError(f"More than {MAX_CHOSEN} batches chosen: pass fewer weightings")
    return sorted(r.batch for r in rows)


def generated_comparison(
    bench: Workbench, settings: DataFrame, weights: DataFrame | None = None, draws: int = 50,
    kinds: dict[str, dict] | None = None, seed: int = 42,
) -> DataFrame:
    """Per reward weighting: the best generated batch, its scores, and classifiers retrained with its rows."""
    batches = generate(bench, settings, draws, seed).persist()
    best = best_batches(score_candidates(bench.base, batches, weights)).persist()
    return best.join(_retrained(bench, batches, _distinct_batches(best), kinds, seed), "batch")


def transfer_comparison(
    a: Workbench, b: Workbench, settings: DataFrame, weights: DataFrame | None = None, draws: int = 50,
    kinds: dict[str, dict] | None = None, seed: int = 42,
) -> DataFrame:
    """Settings chosen on dataset ``a``, applied to dataset ``b``.

    Every setting perturbs rows of ``a`` and is rewarded there; the best setting of each weighting perturbs rows of ``b``,
    which are embedded by its own encoder, assessed with its test set, and added to its training rows.
    Result: ``reward_config, batch, config, reward_a, diversity, proximity, scarcity`` (on b), ``model``, metrics on b.
    """
    tried = written(generate(a, settings, draws, seed), "tried-batches")
    scored = score_candidates(a.base, tried, weights)
    best = best_batches(scored).select("reward_config", "batch", F.col("reward").alias("reward_a")).persist()
    chosen = settings.join(best.select("batch").distinct(), "batch")
    # cut from their lineage, which every step of every classifier would plan again, in the partitions that they were kept in,
    # by which a forest draws its rows
    batches = generate(b, chosen, draws, seed).persist().localCheckpoint()
    scores = written(candidate_scores(b.base, batches), "batch-scores")
    return (best.join(settings, "batch").join(scores, "batch")
            .join(_retrained(b, batches, _distinct_batches(best), kinds, seed), "batch"))
