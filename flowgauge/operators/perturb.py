"""Bulk perturbation of base rows under traffic-shaping settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_normal
from .sampling import draw_with_replacement

SETTINGS = ["loss", "jitter", "delay", "duplication", "corruption", "reordering", "correlation"]

# Low and high end of every setting for the linear mapping.
LINEAR_RANGES = {
    "loss": (0.05, 0.10),
    "jitter": (4.0, 10.0),
    "delay": (10.0, 40.0),
    "duplication": (0.001, 0.05),
    "corruption": (0.001, 0.10),
    "reordering": (0.001, 0.50),
    "correlation": (0.50, 1.00),
}

# Factor, low and high end of every setting for the scale-then-clip mapping
# (percent and milliseconds).
CLIP_RANGES = {
    "loss": (10.0, 5.0, 10.0),
    "jitter": (10.0, 4.0, 10.0),
    "delay": (40.0, 10.0, 40.0),
    "duplication": (5.0, 0.1, 5.0),
    "corruption": (10.0, 0.1, 10.0),
    "reordering": (50.0, 0.1, 50.0),
    "correlation": (100.0, 50.0, 100.0),
}

# First column position of the byte, timing and statistics groups.
GROUP_STARTS = (20, 40, 60)


def _between(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def map_actions(configs: DataFrame, mode: str = "linear", ranges: dict | None = None, action: str = "action") -> DataFrame:
    """Add the ``config`` struct for actions in [0,1] (values outside are clipped)."""
    if mode not in ("linear", "clip"):
        raise ValueError(f"Unknown mapping: {mode}")
    table = ranges or (LINEAR_RANGES if mode == "linear" else CLIP_RANGES)
    fields = []
    for i, name in enumerate(SETTINGS):
        a = _between(F.col(action)[i], 0.0, 1.0)
        if mode == "linear":
            lo, hi = table[name]
            value = F.lit(lo) + a * F.lit(hi - lo)
        else:
            factor, lo, hi = table[name]
            value = _between(a * F.lit(factor), lo, hi)
        fields.append(value.alias(name))
    return configs.withColumn("config", F.struct(*fields))


def noise_scales(config: Column, weights: dict[str, float] | None = None) -> Column:
    """Noise level of the packet, byte and timing groups of columns."""
    w = weights or {}

    def part(name: str) -> Column:
        return config[name] * F.lit(float(w.get(name, 1.0)))

    return F.array(
        part("loss") + part("duplication"), part("corruption"), part("jitter") + part("delay") + part("reordering")
    )


def perturb(
    base: DataFrame,
    configs: DataFrame,
    stats: DataFrame,
    seed: int = 42,
    label: int = 0,
    scaler: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    row_id: str = "row_id",
) -> DataFrame:
    """One new row per config (``draw_id``, ``config``) from a drawn base row.

    Noise is a normal draw per (draw, column) times the column deviation and the
    level of the column's group; the statistics group mixes a shared draw with its own
    by the correlation setting.  Values are clipped at 0, scaled once and
    labelled.  ``base`` holds raw ``features``.
    """
    deviations = F.lit([float(v) for v in stats.first().stds])
    drawn = draw_with_replacement(base.select(row_id, "features"), configs, seed, "draw_id", row_id)
    levels = noise_scales(F.col("config"), weights)
    shared = hash_normal(seed, F.lit("shared"), F.col("draw_id"))
    drawn = drawn.withColumns({"_levels": levels, "_shared": shared})
    c = F.col("config.correlation")
    byte, timing, statistics = GROUP_STARTS

    def moved(x: Column, i: Column) -> Column:
        own = hash_normal(seed, F.lit("noise"), F.col("draw_id"), i)
        level = F.when(i < byte, F.col("_levels")[0]).when(i < timing, F.col("_levels")[1]).otherwise(F.col("_levels")[2])
        noise = F.when(i < statistics, level * own).otherwise(c * F.col("_shared") + (1 - c) * own)
        return F.greatest(F.lit(0.0), x + noise * F.get(deviations, i))

    out = drawn.withColumn("features", F.transform("features", moved)).drop("_levels", "_shared")
    if scaler is not None:
        s = scaler.first()
        center, scale = F.lit([float(v) for v in s.center]), F.lit([float(v) for v in s.scale])
        out = out.withColumn(
            "features", F.transform("features", lambda x, i: (x - F.get(center, i)) / F.get(scale, i))
        )
    return out.withColumnRenamed(row_id, "base_row").withColumn("y", F.lit(label))
