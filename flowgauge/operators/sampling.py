"""Splits, folds and samples in hash order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import MAX_BROADCAST_ROWS, bounded_rows, bounded_side
from ..functions.hashing import hash_hex, hash_int, hash_unit
from ..functions.ordering import hash_cutoffs, hash_rank, ranked, same_key

# The ten default split seeds.
DEFAULT_SEEDS = [42, 43, 44, 45, 46, 47, 48, 49, 50, 51]


# Keys that the rows of a class stand under at least where draws are joined to them.
SPREAD = 1024


class SplitError(ValueError):
    """Split ratios that do not add up."""


def _share(ratio: float) -> Column:
    """floor(n * ratio); the small term keeps 0.6 * 10 at 6 whatever its rounding."""
    return F.floor(F.col("_n") * F.lit(ratio) + F.lit(1e-9))


def _check_ratios(ratios: dict[str, float]) -> None:
    if abs(sum(ratios.values()) - 1.0) > 1e-6:
        raise SplitError(f"Ratios must sum to 1, got {ratios}")


def stratified_split(
    df: DataFrame,
    ratios: dict[str, float],
    seeds: list[int] | None = None,
    label_col: str = "y",
    row_id: str = "row_id",
    exact: bool = True,
    keep_hashes: bool = False,
) -> DataFrame:
    """Add ``seed`` and ``split``; every seed holds every row once.

    Rows of a class are ordered by ``md5(seed:row_id)``; the splits are
    consecutive stretches of that order, in the order of ``ratios``.  With
    ``exact`` each class is cut at floor(n * cumulative ratio), found by a
    histogram of hash prefixes.  Otherwise the uniform hash itself is
    compared with the ratios: no counting at all, sizes right on average.
    With ``keep_hashes`` the rows and their hashes are persisted by the first of the passes, so that the others and all later
    reads of the result begin there; the result itself need not be persisted then.
    """
    _check_ratios(ratios)
    seeds = [42] if seeds is None else seeds
    names = [n for n, r in ratios.items() if r > 0]
    cumulative, total = [], 0.0
    for n in names[:-1]:
        total = round(total + ratios[n], 9)
        cumulative.append(total)
    keyed = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    if not exact:
        u = hash_unit(F.col("seed"), F.col(row_id))
        pick = reduce(
            lambda rest, i: F.when(u < cumulative[i], names[i]).otherwise(rest),
            reversed(range(len(cumulative))),
            F.lit(names[-1]),
        )
        return keyed.withColumn("split", pick)
    hashed = keyed.withColumn("_hash", hash_hex(F.col("seed"), F.col(row_id)))
    if keep_hashes:
        hashed = hashed.persist()
    wanted = {f"_c{i}": _share(r) for i, r in enumerate(cumulative)}
    if not wanted:
        return keyed.withColumn("split", F.lit(names[0]))
    keys = ["seed", label_col]
    cuts = bounded_side(hash_cutoffs(hashed, keys, "_hash", wanted))
    joined = hashed.alias("l").join(cuts.alias("r"), same_key("l", "r", keys))
    pick = reduce(
        lambda rest, i: F.when(F.col("l._hash") <= F.col(f"r._c{i}"), names[i]).otherwise(rest),
        reversed(range(len(cumulative))),
        F.lit(names[-1]),
    )
    return joined.select(*[F.col(f"l.`{c}`") for c in keyed.columns], pick.alias("split"))


def train_pool_holdout(df: DataFrame, seed: int = 42, label_col: str = "y", row_id: str = "row_id") -> DataFrame:
    """Stratified 70/15/15 split for the retraining experiment."""
    return stratified_split(df, {"train": 0.7, "pool": 0.15, "holdout": 0.15}, [seed], label_col, row_id)


def half_splits(df: DataFrame, k: int = 20, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """``k`` independent half/half splits: ``fold`` and ``part`` (train gets floor(n/2))."""
    keyed = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    hashed = keyed.withColumn("_hash", hash_hex(F.col("fold") + F.lit(seed), F.col(row_id)))
    cuts = bounded_side(hash_cutoffs(hashed, ["fold"], "_hash", {"_cut": F.floor(F.col("_n") / 2)}))
    joined = hashed.alias("l").join(cuts.alias("r"), same_key("l", "r", ["fold"]))
    part = F.when(F.col("l._hash") <= F.col("r._cut"), "train").otherwise("val")
    return joined.select(*[F.col(f"l.`{c}`") for c in keyed.columns], part.alias("part"))


def stratified_folds(
    df: DataFrame, k: int = 5, seed: int = 42, label_col: str = "y", row_id: str = "row_id"
) -> DataFrame:
    """Add ``fold``: rows of a class are dealt out in turn in hash order."""
    hashed = df.withColumn("_hash", hash_hex(seed, F.col(row_id)))
    return (
        hash_rank(hashed, [label_col], "_hash", "_rank")
        .withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int"))
        .drop("_hash", "_rank")
    )


def sample_n(
    df: DataFrame, n: int | Column, seed: int = 42, keys: list[str] | None = None, row_id: str = "row_id"
) -> DataFrame:
    """``n`` rows per variant without replacement (all rows if there are fewer).

    ``n`` may be an expression over ``_n``, the size of the variant.  The n-th
    smallest hash is found first; taking the rows is then a plain filter, so a
    large sample never gathers in one task.
    """
    keys = keys or []
    size = n if isinstance(n, Column) else F.lit(n)
    hashed = df.withColumn("_hash", hash_hex(seed, F.col(row_id))).withColumn("_all", F.lit(0))
    cuts = hash_cutoffs(
        hashed, [*keys, "_all"], "_hash", {"_cut": F.least(size.cast("bigint"), F.col("_n"))}
    )
    joined = hashed.alias("l").join(
        bounded_side(cuts).alias("r"), same_key("l", "r", [*keys, "_all"])
    )
    return joined.filter(F.col("l._hash") <= F.col("r._cut")).select(
        *[F.col(f"l.`{c}`") for c in df.columns]
    )


def draw_with_replacement(
    df: DataFrame, draws: DataFrame, seed: int = 42, draw_id: str = "draw_id", row_id: str = "row_id"
) -> DataFrame:
    """A base row for every draw.

    Rows get a dense number in hash order and each draw an independent uniform
    number, so the join key is spread evenly.
    """
    n = df.count()
    numbered = hash_rank(
        df.withColumn("_hash", hash_hex(seed, F.col(row_id))).withColumn("_all", F.lit(0)),
        ["_all"],
        "_hash",
        "_index",
    ).drop("_hash", "_all")
    picks = draws.withColumn("_pick", hash_int(F.lit(n), seed, F.lit("draw"), F.col(draw_id)) + 1)
    return (
        picks.alias("d")
        .join(numbered.alias("b"), F.col("d._pick") == F.col("b._index"))
        .select("d.*", *[F.col(f"b.`{c}`") for c in df.columns])
        .drop("_pick")
    )


def salts(members: int) -> int:
    """Under how many keys each row of a class stands, so that even the smallest class has ``SPREAD`` of them."""
    return max(1, SPREAD // max(members, 1))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose value is made once a row.

    Conditions that Spark derives from later joins (that a key is not null) are not written out in terms of what it is made of.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def sample_pairs(
    df: DataFrame,
    n: int | None = None,
    seed: int = 42,
    label_col: str = "y",
    row_id: str = "row_id",
    requests: DataFrame | None = None,
    group: str | None = None,
    n_groups: int = 1,
) -> DataFrame:
    """Contrastive pairs ``pair_id, row_i, row_j, different``.

    A fair coin picks the kind.  Different: two distinct classes drawn evenly
    over the classes (not by size), then one member of each.  Same: one class, then two
    distinct members - or the row itself if the class has one.  With one class
    only, all pairs are of the same class.  ``requests`` (``pair_id``) may stand
    in for 0 .. n-1 so the number of pairs can follow a table.  With ``group``, an int column of rows and requests with
    ``n_groups`` values, both members of a pair are of the request's group, and the group is its seed.
    """
    spark = df.sparkSession
    keys = [group] if group else []
    seed = F.col(group) if group else seed
    classes = (
        df.groupBy(*keys, label_col).agg(F.count(F.lit(1)).alias("members")).withColumnRenamed(label_col, "cls")
    )
    rows = bounded_rows(classes, MAX_BROADCAST_ROWS * n_groups)
    if rows is None:
        raise SplitError("Pair sampling needs a class column with a bounded number of classes")
    rows = sorted(rows, key=lambda r: r.cls)
    by_group: dict[int | None, list] = {} if group else {None: []}
    for r in rows:
        by_group.setdefault(r[group] if group else None, []).append(r)

    def of_group(value: Callable[[list], Column]) -> Column:
        if not group:
            return value(by_group[None])
        return F.create_map(*[x for g, mine in by_group.items() for x in (F.lit(g), value(mine))])[F.col(group)]

    n_classes = of_group(lambda mine: F.lit(len(mine)))
    table = of_group(lambda mine: F.array(*[
        F.struct(F.lit(r.cls).alias("cls"), F.lit(r.members).alias("members"), F.lit(salts(r.members)).alias("salts"))
        for r in mine
    ]))
    pairs = requests if requests is not None else spark.range(n).withColumnRenamed("id", "pair_id")
    pid = F.col("pair_id")

    draws = ("class_a", "class_b", "coin", "member_a", "member_b", "salt_a", "salt_b")
    drawn = _once(pairs, "_u", F.struct(*[hash_unit(seed, F.lit(name), pid).alias(name) for name in draws]))

    def draw(name: str, upto: Column) -> Column:
        """``hash_int`` of the draw."""
        return F.floor(F.col(f"_u.{name}") * upto).cast("bigint")

    first = draw("class_a", n_classes)
    # A draw over the other classes, shifted past the first one.
    skip = draw("class_b", F.greatest(n_classes - 1, F.lit(1)))
    second = F.when(skip >= first, skip + 1).otherwise(skip)
    different = (F.col("_u.coin") > 0.5) & (n_classes > 1)
    chosen = (
        drawn.withColumn("different", different.cast("int"))
        .withColumn("_a", F.get(table, first.cast("int")))
        .withColumn("_b", F.when(F.col("different") == 1, F.get(table, second.cast("int"))).otherwise(F.col("_a")))
        .withColumn("_i", draw("member_a", F.col("_a.members")))
        .withColumn("_other", draw("member_b", F.when(
            F.col("different") == 1, F.col("_b.members")
        ).otherwise(F.greatest(F.col("_a.members") - 1, F.lit(1)))))
        .withColumn("_j", F.when(F.col("different") == 1, F.col("_other"))
            .when(F.col("_a.members") == 1, F.col("_i"))
            .when(F.col("_other") >= F.col("_i"), F.col("_other") + 1)
            .otherwise(F.col("_other")))
    )
    picked = _once(chosen, "_pick", F.struct(
        "different", F.col("_a.cls").alias("cls_a"), F.col("_b.cls").alias("cls_b"), "_i", "_j",
        draw("salt_a", F.col("_a.salts")).alias("salt_a"), draw("salt_b", F.col("_b.salts")).alias("salt_b"),
    )).select(*keys, "pair_id", "_pick.*")
    members = hash_rank(
        df.select(*keys, F.col(label_col).alias("_cls"), F.col(row_id).alias("_row"))
        .withColumn("_hash", hash_hex(seed, F.col("_row"))),
        [*keys, "_cls"],
        "_hash",
        "_rank",
    ).select(*keys, "_cls", "_row", (F.col("_rank") - 1).alias("_index"))
    # Classes are drawn evenly, so the members of a small one are drawn often: its rows are repeated under salts.
    copies = of_group(
        lambda mine: F.create_map(*[x for r in mine for x in (F.lit(r.cls), F.lit(salts(r.members)))]))[F.col("_cls")]
    members = members.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), copies.cast("bigint") - 1)))

    def member(of: DataFrame, side: str, at: str, out: str) -> DataFrame:
        some = members.select(*[F.col(c).alias(f"{c}{side}") for c in (*keys, "_cls", "_index", "_salt")], F.col("_row").alias(out))
        same = reduce(Column.__and__, [F.col(c) == F.col(f"{c}{side}") for c in keys], F.col(f"salt{side}") == F.col(f"_salt{side}"))
        return of.join(some, (F.col(f"cls{side}") == F.col(f"_cls{side}")) & (F.col(at) == F.col(f"_index{side}")) & same)

    left = member(picked, "_a", "_i", "row_i")
    return member(left, "_b", "_j", "row_j").select(*keys, "pair_id", "row_i", "row_j", "different")


def rank_bins(
    df: DataFrame,
    by: str,
    n_bins: int = 100,
    keys: list[str] | None = None,
    row_id: str = "row_id",
    seed: int = 0,
) -> DataFrame:
    """First cumulative subset (1..n_bins) that holds the row, largest ``by`` first.

    Subset p is the leading max(1, int(n*p/n_bins)) rows.  A row belongs to all
    subsets from ``bin`` on, so sweeps accumulate over bins instead of copying rows.
    """
    keys = keys or []
    keyed = df.withColumn("_all", F.lit(0))
    sizes = bounded_side(keyed.groupBy(*keys, "_all").agg(F.count(F.lit(1)).alias("_n")))
    with_rank = ranked(keyed, [*keys, "_all"], by, row_id, True, "rank", seed)
    joined = (
        with_rank.alias("l")
        .join(sizes.alias("r"), same_key("l", "r", [*keys, "_all"]))
        .select("l.*", "r._n")
    )
    # Smallest p with floor(n*p/B) >= rank; the first row is always in subset 1.
    first = F.when(F.col("rank") == 1, F.lit(1)).otherwise(
        F.expr(f"(rank * {n_bins} + _n - 1) div _n")
    )
    return joined.withColumn("bin", first.cast("int")).drop("_n", "_all")


def label_subsets(labels: DataFrame, max_labels: int = 62, label_col: str = "y") -> DataFrame:
    """Every non-empty label subset: ``subset_id, size, y`` (one row per member).

    ``subset_id`` is the bit mask of label positions in ascending order, which has room for 62.
    """
    rows = bounded_rows(labels.select(label_col).distinct(), min(max_labels, 62))
    if rows is None:
        raise SplitError(f"More than {max_labels} labels")
    values = sorted(r[0] for r in rows)
    spark = labels.sparkSession
    members = F.array(*[F.struct(F.lit(1 << i).cast("bigint").alias("mask"), F.lit(v).alias("v")) for i, v in enumerate(values)])
    return (
        spark.range(1, 2 ** len(values))
        .withColumnRenamed("id", "subset_id")
        .withColumn("size", F.bit_count("subset_id"))
        .withColumn("_m", F.explode(F.filter(
            members, lambda m: F.col("subset_id").bitwiseAND(m["mask"]) != 0
        )))
        .select("subset_id", F.col("size").cast("int"), F.col("_m.v").alias(label_col))
    )


def shuffled(df: DataFrame, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Rows in hash order (range partitioned sort), for order-sensitive consumers."""
    return df.withColumn("_hash", hash_hex(seed, F.col(row_id))).orderBy("_hash").drop("_hash")


def random_configs(
    spark: SparkSession,
    n_episodes: int,
    n_steps: int,
    dims: int = 7,
    seed: int = 42,
    requests: DataFrame | None = None,
) -> DataFrame:
    """Uniform actions in [0,1] per (episode, step); ``requests`` may supply these keys."""
    base = requests
    if base is None:
        base = spark.range(n_episodes * n_steps).select(
            F.floor(F.col("id") / n_steps).cast("bigint").alias("episode"),
            (F.col("id") % n_steps).cast("bigint").alias("step"),
        )
    draws = [
        hash_unit(seed, F.col("episode"), F.col("step"), F.lit(d)) for d in range(dims)
    ]
    return base.withColumn("action", F.array(*draws))


__all__ = [
    "DEFAULT_SEEDS",
    "SplitError",
    "draw_with_replacement",
    "half_splits",
    "label_subsets",
    "random_configs",
    "rank_bins",
    "sample_n",
    "sample_pairs",
    "shuffled",
    "stratified_folds",
    "stratified_split",
    "train_pool_holdout",
]
