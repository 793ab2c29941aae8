"""Rewards, classification metrics, correlations and other summaries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import bounded_rows, bounded_side, local_table
from ..functions.ordering import running_sum, same_key
from ..functions.special import correlation_p_value
from ..functions.vectors import distance
from .assign import ClusterModel

# The named reward weightings (diversity, proximity, scarcity).
REWARD_WEIGHTS = {
    "full": (1.0, 1.0, 1.0),
    "diversity_only": (1.0, 0.0, 0.0),
    "proximity_only": (0.0, 1.0, 0.0),
    "scarcity_only": (0.0, 0.0, 1.0),
    "dp": (1.0, 1.0, 0.0),
    "ps": (0.0, 1.0, 1.0),
    "ds": (1.0, 0.0, 1.0),
}


def reward_weights(spark: SparkSession, configs: dict[str, tuple] | None = None) -> DataFrame:
    configs = REWARD_WEIGHTS if configs is None else configs
    rows = [(name, *w) for name, w in configs.items()]
    return local_table(spark, rows, "reward_config string, w_d double, w_p double, w_s double")


def reward_value(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the three scores; a missing weight counts as 1."""
    weights = weights or {}
    terms = [F.col(c) * F.lit(float(weights.get(c, 1.0))) for c in ("diversity", "proximity", "scarcity")]
    return terms[0] + terms[1] + terms[2]


def reward(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Every score row under every weighting (a NULL weight counts as 1)."""
    packed = weights.select(F.lit(0).alias("_one"), F.struct(
        F.col("reward_config").cast("string").alias("reward_config"),
        *[F.col(c).cast("double").alias(c) for c in ("w_d", "w_p", "w_s")]).alias("_w"))
    # every score row has a result row for every weighting
    out = scores.withColumn("_one", F.lit(0)).join(bounded_side(packed), "_one")
    value = (
        F.coalesce("_w.w_d", F.lit(1.0)) * F.col("diversity")
        + F.coalesce("_w.w_p", F.lit(1.0)) * F.col("proximity")
        + F.coalesce("_w.w_s", F.lit(1.0)) * F.col("scarcity")
    )
    return out.select(*scores.columns, F.col("_w.reward_config"), value.alias("reward"))


def latent_summary(
    df: DataFrame, clusters: "DataFrame | ClusterModel", keys: list[str] | None = None, z: str = "z"
) -> DataFrame:
    """``obs``: flattened centroids, then mean, min, max, variance and std per dimension.

    Population statistics; zeros for no rows.
    """
    keys = keys or []
    model = ClusterModel.load(clusters)
    flat = F.lit([v for c in model.centroids for v in c]).cast("array<double>")
    vec = array_to_vector(F.col(z))
    stats = Summarizer.metrics("mean", "min", "max", "variance", "count").summary(vec)
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), stats.alias("_s"))
    n = F.col("n_rows")
    # The library's variance is the sample one.
    var = F.transform(
        vector_to_array(F.col("_s.variance")), lambda v: v * (n - 1).cast("double") / n.cast("double")
    )
    blocks = F.concat(
        vector_to_array(F.col("_s.mean")), vector_to_array(F.col("_s.min")), vector_to_array(F.col("_s.max")),
        var, F.transform(var, lambda v: F.sqrt(v)),
    )
    empty = F.lit([0.0] * (5 * model.dim))
    return agg.select(
        *keys, "n_rows", F.concat(flat, F.when(n > 0, blocks).otherwise(empty)).alias("obs")
    )


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """Means and population deviations per feature; a zero deviation becomes 1."""

    def std(c: str) -> Column:
        return F.when(F.min(c) == F.max(c), 1.0).otherwise(F.stddev_pop(c))

    return df.agg(
        F.array(*[F.avg(c) for c in features]).alias("means"), F.array(*[std(c) for c in features]).alias("stds")
    )


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", keys: list[str] | None = None) -> DataFrame:
    """Counts per (truth, prediction): the mergeable partial behind all metrics."""
    return df.groupBy(*(keys or []), F.col(y).alias("y"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def metrics_from_confusion(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy and macro precision, recall, F1 over labels of truth or prediction."""
    keys = keys or []
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    sides = counts.select(
        *keys,
        F.explode(F.array(
            F.struct(F.col("y").alias("label"), hit.alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted")),
            F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted")),
        )).alias("s"),
    ).select(*keys, "s.*")
    per_label = sides.groupBy(*keys, "label").agg(
        F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("actual"))
    return per_label.withColumns({"_p": p, "_r": r}).groupBy(*keys).agg(
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        F.avg("_p").alias("precision"),
        F.avg("_r").alias("recall"),
        F.avg(F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0)).alias("f1"),
    )


def classification_metrics(df: DataFrame, y: str = "y", pred: str = "pred", keys: list[str] | None = None) -> DataFrame:
    return metrics_from_confusion(confusion(df, y, pred, keys), keys)


def misclassified(df: DataFrame, pred_cols: list[str], y: str = "y") -> DataFrame:
    """Rows that at least one prediction column gets wrong."""
    preds = F.array(*[F.col(c) for c in pred_cols])
    return df.filter(F.exists(preds, lambda p: p != F.col(y)))


def average_ranks(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """``value -> mean 1-based rank`` per key (over distinct values)."""
    counts = df.groupBy(*keys, F.col(col).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("_c"))
    run = running_sum(counts, keys, "value", {"_upto": "_c"})
    return run.select(*keys, "value", (F.col("_upto") - (F.col("_c") - 1) / 2).alias("rank"))


def correlations(df: DataFrame, x: str, y: str, keys: list[str] | None = None, p_values: bool = True) -> DataFrame:
    """Pearson and Spearman coefficients with two-sided p-values per key.

    NULL unless there are more than two points and both sides vary.  Rows with equal (x, y)
    are merged first, and ranks come from distinct values only, so neither hot
    values nor hot keys pile up rows in a task.
    """
    keys = keys or []
    pairs = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .agg(F.count(F.lit(1)).alias("_w"))
        .withColumn("_one", F.lit(0))
    )
    inner = [*keys, "_one"]
    flat = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_one", F.lit(0))
    rx, ry = average_ranks(flat, x, inner), average_ranks(flat, y, inner)
    with_x = (
        pairs.alias("l").join(rx.alias("r"), same_key("l", "r", inner) & (F.col("l._x") == F.col("r.value")))
        .select("l.*", F.col("r.rank").alias("_rx"))
    )
    ranked_pairs = (
        with_x.alias("l").join(ry.alias("r"), same_key("l", "r", inner) & (F.col("l._y") == F.col("r.value")))
        .select("l.*", F.col("r.rank").alias("_ry"))
    )
    means = bounded_side(pairs.groupBy(*inner).agg(
        F.sum("_w").alias("_n"),
        (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_mx"),
        (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_my"),
        F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"),
    ))
    centred = (
        ranked_pairs.alias("l").join(means.alias("r"), same_key("l", "r", inner))
        .select("l.*", *[f"r.{c}" for c in ("_n", "_mx", "_my", "_x0", "_x1", "_y0", "_y1")])
        .withColumns({
            "_dx": F.col("_x") - F.col("_mx"), "_dy": F.col("_y") - F.col("_my"),
            "_sx": F.col("_rx") - (F.col("_n") + 1) / 2, "_sy": F.col("_ry") - (F.col("_n") + 1) / 2,
        })
    )

    def sums(a: str, b: str) -> Column:
        w = F.col("_w")
        num = F.sum(w * F.col(a) * F.col(b))
        den = F.sqrt(F.sum(w * F.col(a) * F.col(a)) * F.sum(w * F.col(b) * F.col(b)))
        return F.when(den > 0, num / den)

    usable = (F.col("n") > 2) & F.col("_varies")
    out = centred.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.max((F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1"))).alias("_varies"),
        sums("_dx", "_dy").alias("_r"),
        sums("_sx", "_sy").alias("_rho"),
    ).select(*keys, "n", F.when(usable, F.col("_r")).alias("pearson_r"), F.when(usable, F.col("_rho")).alias("spearman_r"))
    if not p_values:
        return out
    return with_p_values(out, {"pearson_r": "pearson_p", "spearman_r": "spearman_p"})


def with_p_values(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the p-value of each coefficient column (one row per key; Arrow batches)."""

    @F.pandas_udf("double")
    def p_value(r, n):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series([
            None if rv is None or rv != rv else correlation_p_value(float(rv), int(nv))
            for rv, nv in zip(r, n, strict=True)
        ], dtype="float64")

    return df.withColumns({out: p_value(F.col(c), F.col("n")) for c, out in columns.items()})


def mean_std(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of score columns over splits."""
    aggs = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy(*(keys or [])).agg(*aggs, F.count(F.lit(1)).alias("n"))


def balanced_weights(df: DataFrame, y: str = "y", out: str = "weight") -> DataFrame:
    """Class weight n / (classes * members) on every row."""
    sizes = df.groupBy(F.col(y).alias("_cls")).agg(F.count(F.lit(1)).alias("_members"))
    totals = sizes.agg(F.sum("_members").alias("n"), F.count(F.lit(1)).alias("c")).first()
    small = bounded_side(sizes)
    return (
        df.join(small, F.col(y).eqNullSafe(F.col("_cls")))
        .withColumn(out, F.lit(float(totals.n or 0)) / (F.lit(totals.c) * F.col("_members")))
        .drop("_cls", "_members")
    )


def contrastive_loss(
    pairs: DataFrame, df: DataFrame, margin: float = 10.0, lam: float = 0.1, z: str = "z", row_id: str = "row_id",
    reconstruction: float = 0.0,
) -> DataFrame:
    """Mean pair loss, and the total with the reconstruction error.

    Same class: d^2/2; different: max(0, margin - d)^2 / 2.  Pairs are sorted by their first row before
    they get its vector, so that equal vectors stand together and pack well; with it they are shuffled once, but not sorted.
    """
    left = df.select(F.col(row_id).alias("row_i"), F.col(z).alias("_zi"))
    right = df.select(F.col(row_id).alias("row_j"), F.col(z).alias("_zj"))
    d = distance(F.col("_zi"), F.col("_zj"))
    hinge = F.greatest(F.lit(0.0), F.lit(margin) - F.col("_d"))
    loss = F.when(F.col("different") == 1, 0.5 * hinge * hinge).otherwise(0.5 * F.col("_d") * F.col("_d"))
    return (
        pairs.join(left.hint("merge"), "row_i").join(right.hint("shuffle_hash"), "row_j").withColumn("_d", d)
        .agg(F.avg(loss).alias("contrastive"), F.count(F.lit(1)).alias("n_pairs"))
        .withColumn("total", F.lit(float(reconstruction)) + F.lit(float(lam)) * F.col("contrastive"))
    )


def improvement(scores: DataFrame, baseline: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """Score minus baseline per metric; the baseline has one row per key (or one row)."""
    keys = keys or []
    if keys:
        joined = scores.alias("l").join(bounded_side(baseline).alias("r"), same_key("l", "r", keys))
        return joined.select("l.*", *[(F.col(f"l.{m}") - F.col(f"r.{m}")).alias(f"{m}_gain") for m in metrics])
    rows = bounded_rows(baseline, 1)
    if not rows:
        raise ValueError("A baseline without keys must have exactly one row")
    return scores.withColumns({f"{m}_gain": F.col(m) - F.lit(float(rows[0][m])) for m in metrics})
