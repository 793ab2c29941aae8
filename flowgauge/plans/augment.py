"""Growing a test set: candidate batches, their scores, and retraining."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import bounded_side
from ..functions.ordering import running
from ..operators.assign import ClusterModel, assign, negative_counts
from ..operators.classify import retrain_and_score
from ..operators.curves import CurveSummary, curve_summary, ks_with_batches
from ..operators.diversity import (
    DEFAULT_FREQUENCIES,
    add_covariances,
    covariance_partials,
    covariance_scores,
    exact_vendi,
)
from ..operators.episodes import best_of
from ..operators.proximity import value_counts
from ..operators.sampling import sample_n, train_pool_holdout
from ..operators.scarcity import scarcity_from_counts
from ..operators.scores import reward, reward_weights


@dataclass
class BaseScores:
    """Mergeable partials of the fixed test set and train set."""

    model: ClusterModel
    counts: DataFrame  # pos, neg, n of test rows
    curves: CurveSummary  # of negative distances
    test: DataFrame  # pos, z of test rows
    points: DataFrame  # pos, z, weight of distinct test points
    scores: DataFrame  # pos, diversity, proximity, scarcity
    diversity: "DiversityOptions"  # how base and candidates alike are scored
    bins: float | None = None  # grid of the distances

    def release(self) -> None:
        """Give up the memory that holds the partials."""
        self.curves.release()
        for part in (self.counts, self.points, self.scores):
            part.unpersist()


@dataclass(frozen=True)
class DiversityOptions:
    method: str = "rff"
    m: int = DEFAULT_FREQUENCIES
    seed: int = 42
    gamma: float = 1.0


def base_scores(df: DataFrame, clusters: "DataFrame | ClusterModel", gamma: float = 1.0, bins: float | None = None,
                method: str = "rff", m: int = DEFAULT_FREQUENCIES, seed: int = 42, z: str = "z", y: str = "y") -> BaseScores:
    """Partials of ``side`` test / train rows; computed once, shared by all candidates."""
    from .assess import assess

    model = ClusterModel.load(clusters)
    found = assess(df, model, gamma=gamma, method=method, m=m, seed=seed, bins=bins, z=z, y=y)
    test = found.assignments.filter(F.col("side") == "test")
    return BaseScores(
        model,
        negative_counts(test).persist(),
        curve_summary(value_counts(found.assignments, "neg_dist", "side", ["pos"], bins)),
        test.select("pos", F.col(z).alias("z")),
        test.groupBy("pos", F.col(z).alias("z")).agg(F.count(F.lit(1)).alias("weight")).persist(),
        found.cluster_scores.select(F.col("cluster_id").alias("pos"), "diversity", "proximity", "scarcity").persist(),
        DiversityOptions(method, m, seed, gamma),
        bins,
    )


def candidate_scores(base: BaseScores, batches: DataFrame, z: str = "z", y: str = "y", batch: str = "batch") -> DataFrame:
    """Scores of test set plus batch, for every batch: ``batch, diversity, proximity, scarcity``.

    A batch only changes the clusters its rows fall into.  There its counts and matrices are added to those of the base,
    and proximity comes from the nodes of the base's curve summary that its values touch; all other clusters keep their
    base score.
    """
    rows = assign(batches, base.model, z=z, y=y).select(batch, "pos", "neg", "neg_dist", F.col(z).alias("z")).persist()
    touched = bounded_side(rows.select(batch, "pos").distinct())
    keys = [batch, "pos"]

    def with_base(part: DataFrame) -> DataFrame:
        return touched.join(part, "pos")

    counts = with_base(base.counts).select(batch, "pos", "neg", "n").unionByName(negative_counts(rows, [batch]))
    counts = counts.groupBy(*keys, "neg").agg(F.sum("n").alias("n"))
    s = scarcity_from_counts(counts, base.model, [batch])
    added = value_counts(rows.withColumn("side", F.lit("test")), "neg_dist", "side", keys, base.bins)
    p = ks_with_batches(base.curves, added.select(*keys, "value", F.col("n_test").alias("n")), batch)
    d = _candidate_diversity(base, rows, touched, keys)
    pieces = (
        touched.join(d.select(*keys, "diversity"), keys, "left")
        .join(p.select(*keys, F.col("ks").alias("proximity")), keys, "left")
        .join(s.select(*keys, "scarcity"), keys, "left")
        .na.fill(0.0, ["diversity", "proximity", "scarcity"])
    )
    # Untouched clusters: base scores, expanded per batch from one row with an entry per cluster of the model.
    known = F.broadcast(base.scores.groupBy(F.lit(0).alias("_one")).agg(
        F.collect_list(F.struct("pos", "diversity", "proximity", "scarcity")).alias("_s")))
    seen = touched.groupBy(batch).agg(F.collect_set("pos").alias("_seen")).withColumn("_one", F.lit(0))
    kept = seen.join(known, "_one").select(
        batch, F.inline(F.filter("_s", lambda s: ~F.array_contains("_seen", s["pos"]))))
    return pieces.unionByName(kept).groupBy(batch).agg(
        F.avg("diversity").alias("diversity"), F.max("proximity").alias("proximity"), F.avg("scarcity").alias("scarcity")
    )


def _candidate_diversity(base: BaseScores, rows: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of the touched (batch, cluster) pairs, by the base's own method and settings."""
    o = base.diversity
    if o.method == "exact":
        own = rows.groupBy(*keys, "z").agg(F.count(F.lit(1)).alias("weight"))
        both = touched.join(base.points, "pos").select(*keys, "z", "weight").unionByName(own)
        return exact_vendi(both.groupBy(*keys, "z").agg(F.sum("weight").alias("weight")), keys, o.gamma)
    shared = covariance_partials(base.test, ["pos"], o.gamma, o.m, o.seed)
    extra = covariance_partials(rows, keys, o.gamma, o.m, o.seed)
    merged = add_covariances(
        touched.join(shared, "pos").select(*keys, "part", "total", "n").unionByName(extra), keys, "total"
    )
    return covariance_scores(merged, keys, o.m)


def score_candidates(base: BaseScores, batches: DataFrame, weights: DataFrame | None = None, batch: str = "batch",
                     **options) -> DataFrame:
    """Reward of every batch under every weighting."""
    scores = candidate_scores(base, batches, batch=batch, **options)
    return reward(scores, reward_weights(batches.sparkSession) if weights is None else weights)


def best_batches(scored: DataFrame, batch: str = "batch") -> DataFrame:
    """The best batch of every weighting (lowest batch id on ties)."""
    return best_of(scored, "reward", batch, ["reward_config"])


def first_reaching(scored: DataFrame, target: float = 0.9, step: str = "step", max_steps: int = 5000,
                   keys: list[str] | None = None) -> DataFrame:
    """Where generation stops: the first step whose reward reaches the target, else the last
    step within the limit."""
    inside = scored.filter(F.col(step) <= max_steps)
    hit = F.when(F.col("reward") >= target, F.col(step))
    return inside.groupBy(*(keys or [])).agg(
        F.coalesce(F.min(hit), F.max(step)).alias("stop_step"),
        F.min(hit).isNotNull().alias("terminated"),
        (F.min(hit).isNull() & (F.max(step) >= max_steps)).alias("truncated"),
    )


def running_observations(
    log: DataFrame, dim: int, model: ClusterModel | None = None, episode: str = "episode", step: str = "step", z: str = "z"
) -> DataFrame:
    """``obs`` after each step: centroids, then mean, min, max, variance and std so far."""
    # Squares are taken around the overall mean, so large offsets cancel before they lose digits.
    shift = [float(v or 0.0) for v in log.agg(*[F.avg(F.col(z)[i]) for i in range(dim)]).first()]
    cols = {f"_z{i}": F.col(z)[i] - F.lit(shift[i]) for i in range(dim)}
    squares = {f"_q{i}": (F.col(z)[i] - F.lit(shift[i])) * (F.col(z)[i] - F.lit(shift[i])) for i in range(dim)}
    aggregates: dict[str, tuple[str, str]] = {"_n": ("sum", "_unit")}
    for i in range(dim):
        aggregates |= {
            f"_s{i}": ("sum", f"_z{i}"), f"_ss{i}": ("sum", f"_q{i}"), f"_lo{i}": ("min", f"_z{i}"), f"_hi{i}": ("max", f"_z{i}")
        }
    run = running(log.withColumns({**cols, **squares, "_unit": F.lit(1)}), [episode], step, aggregates)
    each = range(dim)
    mean = [F.col(f"_s{i}") / F.col("_n") for i in each]
    var = [F.greatest(F.lit(0.0), F.col(f"_ss{i}") / F.col("_n") - mean[i] * mean[i]) for i in each]
    place = [*mean, *[F.col(f"_lo{i}") for i in each], *[F.col(f"_hi{i}") for i in each]]
    stats = [*[c + F.lit(shift[i % dim]) for i, c in enumerate(place)], *var, *[F.sqrt(v) for v in var]]
    flat = [F.lit(float(v)) for c in model.centroids for v in c] if model else []
    return run.select(*log.columns, F.array(*flat, *stats).alias("obs"))


def augmentation_comparison(
    base: BaseScores, batches: DataFrame, train: DataFrame, holdout: DataFrame, weights: DataFrame | None = None,
    kinds: dict[str, dict] | None = None, seed: int = 42, batch: str = "batch", **options,
) -> DataFrame:
    """Per weighting: the best batch, its scores, and classifiers retrained with its rows.

    ``batches`` carries feature-space ``features`` beside the latent ``z``.  Weightings that
    choose the same batch share one fit.
    """
    best = best_batches(score_candidates(base, batches, weights, batch, **options), batch).persist()
    chosen = [r[batch] for r in best.select(batch).distinct().collect()]
    out = None
    for b in chosen:
        extra = batches.filter(F.col(batch) == b)
        part = retrain_and_score(train, extra, holdout, kinds, seed).withColumn("_b", F.lit(b))
        out = part if out is None else out.unionByName(part)
    return best.join(out, F.col(batch) == F.col("_b")).drop("_b")


def three_arm_retrain(
    df: DataFrame, selected, n_select, kinds: dict[str, dict] | None = None, seed: int = 42, row_id: str = "row_id"
) -> DataFrame:
    """Train only, plus random pool rows, plus selected pool rows; one holdout.

    ``df`` holds ``features, y``; ``selected`` ranks pool rows: a function of
    the pool that returns the chosen ones.
    """
    split = train_pool_holdout(df, seed, "y", row_id).persist()
    part = {n: split.filter(F.col("split") == n) for n in ("train", "pool", "holdout")}
    arms = {
        "train_only": None,
        "random": sample_n(part["pool"], n_select, seed, row_id=row_id),
        "selected": selected(part["pool"]),
    }
    out = None
    for name, extra in arms.items():
        scored = retrain_and_score(part["train"], extra, part["holdout"], kinds, seed)
        scored = scored.select(F.lit(name).alias("arm"), "*")
        out = scored if out is None else out.unionByName(scored)
    return out
