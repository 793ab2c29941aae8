"""Small dense networks: batch encoding and data-parallel training.

Weights are a self-describing table (one row per layer).  Inference runs numpy
on Arrow batches; training sums per-task gradients, so that a few rows
of parameters reach the driver per step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import added_up, matrix, packed
from ..functions.bounded import local_table, written
from ..functions.hashing import hash_hex, hex_int
from ..functions.vectors import dot
from .assign import as_matrix, from_matrix
from .sampling import sample_pairs

WEIGHT_SCHEMA = (
    "part string, layer int, weight array<array<double>>, bias array<double>, activation string"
)
MAX_LAYERS = 64
#: The kind of a block of rows; pairs are of the kind 0 (same class) or 1.
ROWS = -1
#: Rows whose layers are held at once in training, few enough for a core's cache.
GRADIENT_ROWS = 512


class WeightsError(ValueError):
    """Stored weights that do not describe a network."""


@dataclass
class Layer:
    weight: np.ndarray  # inputs x outputs
    bias: np.ndarray
    activation: str = "identity"  # identity | relu | tanh | leaky_relu | sigmoid


@dataclass
class Network:
    """Named stacks of layers (``encoder``, ``decoder``, ``classifier``)."""

    parts: dict[str, list[Layer]] = field(default_factory=dict)

    @staticmethod
    def create(sizes: dict[str, list[int]], seed: int = 42, activation: str = "relu") -> "Network":
        """Uniform start values in +-1/sqrt(inputs); no activation after a stack's last layer."""
        rng = np.random.default_rng(seed)
        parts = {}
        for name, dims in sizes.items():
            stack = []
            for i, (a, b) in enumerate(zip(dims[:-1], dims[1:], strict=True)):
                lim = 1.0 / np.sqrt(a)
                act = activation if i < len(dims) - 2 else "identity"
                stack.append(Layer(rng.uniform(-lim, lim, (a, b)), rng.uniform(-lim, lim, b), act))
            parts[name] = stack
        return Network(parts)

    @staticmethod
    def autoencoder(inputs: int, hidden: list[int], latent: int, seed: int = 42) -> "Network":
        return Network.create(
            {"encoder": [inputs, *hidden, latent], "decoder": [latent, *reversed(hidden), inputs]}, seed
        )

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (part, i, layer.weight.tolist(), layer.bias.tolist(), layer.activation)
            for part, stack in self.parts.items()
            for i, layer in enumerate(stack)
        ]
        return spark.createDataFrame(rows, WEIGHT_SCHEMA)

    @staticmethod
    def from_table(weights: DataFrame) -> "Network":
        needed = {"part", "layer", "weight", "bias", "activation"}
        if not needed <= set(weights.columns):
            raise WeightsError(f"Weights without their architecture: need columns {sorted(needed)}")
        rows = weights.orderBy("part", "layer").take(MAX_LAYERS + 1)
        if not rows or len(rows) > MAX_LAYERS:
            raise WeightsError(f"A network has 1 to {MAX_LAYERS} layers")
        net = Network()
        for r in rows:
            net.parts.setdefault(r.part, []).append(Layer(np.array(r.weight), np.array(r.bias), r.activation))
        return net

    # Flat parameter vectors for the optimiser.
    def flat(self) -> np.ndarray:
        return np.concatenate([
            np.concatenate([layer.weight.ravel(), layer.bias]) for s in self.parts.values() for layer in s
        ])

    def with_flat(self, theta: np.ndarray) -> "Network":
        at, parts = 0, {}
        for name, stack in self.parts.items():
            new = []
            for layer in stack:
                w, b = layer.weight.size, layer.bias.size
                new.append(Layer(theta[at : at + w].reshape(layer.weight.shape), theta[at + w : at + w + b], layer.activation))
                at += w + b
            parts[name] = new
        return Network(parts)


def activate(x: np.ndarray, kind: str) -> np.ndarray:
    """The activation of ``x``, in the same array where that saves one."""
    if kind == "relu":
        return np.maximum(x, 0.0, out=x)
    if kind == "tanh":
        return np.tanh(x)
    if kind == "leaky_relu":
        return np.where(x > 0, x, 0.01 * x)
    if kind == "sigmoid":
        return 1.0 / (1.0 + np.exp(-x))
    return x


def _slope(out: np.ndarray, kind: str) -> np.ndarray | float:
    if kind == "relu":
        return out > 0
    if kind == "tanh":
        return 1.0 - out * out
    if kind == "leaky_relu":
        return np.where(out > 0, 1.0, 0.01)
    if kind == "sigmoid":
        return out * (1.0 - out)
    return 1.0


def forward(x: np.ndarray, stack: list[Layer]) -> list[np.ndarray]:
    """Outputs of all layers, input first."""
    outs = [x]
    for layer in stack:
        sums = outs[-1] @ layer.weight
        sums += layer.bias
        outs.append(activate(sums, layer.activation))
    return outs


def backward(outs: list[np.ndarray], grad: np.ndarray, stack: list[Layer],
             at_input: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradient at the input (if wanted, else after the first layer), and per layer the flat (weight, bias) gradient."""
    grads: list[np.ndarray] = []
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].activation != "identity":
            grad = grad * _slope(outs[i + 1], stack[i].activation)
        grads.append(np.concatenate([(outs[i].T @ grad).ravel(), grad.sum(axis=0)]))
        if i or at_input:
            grad = grad @ stack[i].weight.T
    return grad, grads[::-1]


def _apply(df: DataFrame, stack: list[Layer], source: str, out: str) -> DataFrame:
    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        return from_matrix(forward(as_matrix(v), stack)[-1] if len(v) else np.empty((0, 1)))

    return df.withColumn(out, run(F.col(source)))


def _stack(weights: "DataFrame | Network", part: str) -> list[Layer]:
    net = weights if isinstance(weights, Network) else Network.from_table(weights)
    if part not in net.parts:
        raise WeightsError(f"The stored network has no {part!r} part")
    return net.parts[part]


def encode(df: DataFrame, weights: "DataFrame | Network", features: str = "features", out: str = "z",
           upto: int | None = None, part: str = "encoder") -> DataFrame:
    """Latent vector of every row; ``upto=-1`` stops before the last layer."""
    return _apply(df, _stack(weights, part)[:upto], features, out)


def decode(df: DataFrame, weights: "DataFrame | Network", z: str = "z", out: str = "restored") -> DataFrame:
    return _apply(df, _stack(weights, "decoder"), z, out)


def activations(df: DataFrame, weights: "DataFrame | Network", features: str = "features",
                part: str = "classifier") -> DataFrame:
    """Output of the last hidden layer."""
    return encode(df, weights, features, "activation", -1, part)


def squared_error(a: Column, b: Column) -> Column:
    """Mean squared difference of two vectors."""
    diff = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def reconstruction_error(df: DataFrame, weights: "DataFrame | Network", features: str = "features") -> DataFrame:
    """Encode, decode and measure: per-row ``mse`` (its average is the loss)."""
    restored = decode(encode(df, weights, features), weights)
    return restored.withColumn("mse", squared_error(F.col(features), F.col("restored")))


#: Products of one unit that are written out one by one.
WRITTEN_OUT = 32


def mlp_columns(features: Column, stack: list[Layer]) -> Column:
    """The same network as an array expression (narrow networks, no Python worker)."""
    x = features
    # written out, a unit repeats all that it rests on: so only while that is little, else by functions of whole arrays
    terms = 1
    for depth, layer in enumerate(stack):
        terms *= layer.weight.shape[0]

        def unit(weights: list[float], x: Column = x, first: bool = depth == 0, short: bool = terms <= WRITTEN_OUT) -> Column:
            if not short:
                return dot(x, F.lit(weights))
            total = reduce(Column.__add__, [F.get(x, F.lit(i)) * F.lit(w) for i, w in enumerate(weights)], F.lit(0.0))
            # a vector of another length has no value, as in ``dot``
            return F.when(F.size(x) == len(weights), total) if first else total

        units = [unit([float(v) for v in layer.weight[:, j]]) + F.lit(float(layer.bias[j])) for j in range(layer.weight.shape[1])]
        if layer.activation == "relu":
            units = [F.greatest(u, F.lit(0.0)) for u in units]
        elif layer.activation == "tanh":
            units = [F.tanh(u) for u in units]
        elif layer.activation == "leaky_relu":
            units = [F.when(u > 0, u).otherwise(u * 0.01) for u in units]
        x = F.array(*units)
    return x


def gradient(net: Network, x: np.ndarray, a: np.ndarray, b: np.ndarray, different: np.ndarray,
             margin: float, lam: float) -> tuple[np.ndarray, float, float]:
    """Summed gradient of row reconstruction and pair losses, and both loss sums.

    The caller divides: reconstruction counts per row, pairs per pair.
    """
    enc, dec = net.parts["encoder"], net.parts["decoder"]
    zeros_e = [np.zeros(w.weight.size + w.bias.size) for w in enc]
    recon_e, recon_d, recon = zeros_e, [np.zeros(w.weight.size + w.bias.size) for w in dec], 0.0
    if len(x):
        e_out = forward(x, enc)
        d_out = forward(e_out[-1], dec)
        diff = d_out[-1] - x
        recon = float((diff * diff).mean(axis=1).sum())
        gz, recon_d = backward(d_out, 2.0 * diff / x.shape[1], dec)
        _, recon_e = backward(e_out, gz, enc, False)
    pair_e, pair = zeros_e, 0.0
    if len(a):
        oa, ob = forward(a, enc), forward(b, enc)
        delta = oa[-1] - ob[-1]
        d = np.sqrt((delta * delta).sum(axis=1))
        gap = np.maximum(margin - d, 0.0)
        pair = float(np.where(different == 1, 0.5 * gap * gap, 0.5 * d * d).sum())
        coef = np.where(different == 1, -gap / np.maximum(d, 1e-12), 1.0)
        g = coef[:, None] * delta
        _, ga = backward(oa, g, enc, False)
        _, gb = backward(ob, -g, enc, False)
        pair_e = [p + q for p, q in zip(ga, gb, strict=True)]
    return (
        np.concatenate([*recon_e, *recon_d, *[lam * p for p in pair_e]]), recon, pair
    )


def training_batches(
    df: DataFrame, batches: int, seed: int, y: str, row_id: str, features: str, group: str | None = None,
    seeds: list[int] | None = None,
) -> DataFrame:
    """``set, batch, x, x2, different``: rows (x2 is null) and contrastive pairs of all training sets.

    Each row belongs to one batch by its hash; the number of pairs follows the rows (one per two rows).  With ``group``
    there is one training set per value of ``seeds`` in that column, which also seeds its pairs; the pairs of all sets are
    drawn together.  The table is written once and partitioned by batch, so that a step reads only its own.
    """
    of = F.col("set") if group else F.lit(seed)
    cell = F.pmod(hex_int(hash_hex(of, "batch", F.col("_key")), 8), F.lit(batches)).cast("int")
    base = df.filter(F.col(group).isin(seeds)) if group else df
    base = base.select(
        (F.col(group).cast("int") if group else F.lit(0)).alias("set"),
        F.col(row_id).alias("_row"), F.col(y).alias("_y"), F.col(features).alias("_x"))
    rows = base.select(
        "set", F.col("_row").cast("string").alias("_key"), F.col("_x").alias("x"),
        F.lit(None).cast("array<double>").alias("x2"), F.lit(None).cast("int").alias("different"),
    )
    requests = base.filter(F.pmod(hex_int(hash_hex(of, "pair", F.col("_row")), 8), F.lit(2)) == 0).select(
        "set", F.col("_row").cast("string").alias("pair_id")
    )
    if group:
        pairs = sample_pairs(base, label_col="_y", row_id="_row", requests=requests, group="set", n_groups=len(seeds))
    else:
        pairs = sample_pairs(base, seed=seed, label_col="_y", row_id="_row", requests=requests.drop("set")).withColumn("set", F.lit(0))
    left = base.select("set", F.col("_row").alias("row_i"), F.col("_x").alias("x"))
    right = base.select("set", F.col("_row").alias("row_j"), F.col("_x").alias("x2"))
    on = ["set"] if group else []
    if not group:
        left, right = left.drop("set"), right.drop("set")
    joined = pairs.join(left, [*on, "row_i"]).join(right, [*on, "row_j"]).select(
        "set", F.concat(F.lit("p"), F.col("pair_id")).alias("_key"), "x", "x2", "different"
    )
    table = rows.unionByName(joined).withColumn("batch", cell).drop("_key")
    return table.select("x", "x2", "different", "batch", "set")


@dataclass(frozen=True)
class Arm:
    """The settings of one of several networks trained side by side."""

    lam: float = 0.1
    margin: float = 10.0
    lr: float = 1e-3
    weight_decay: float = 0.0
    hidden: tuple[int, ...] = (64, 32, 16)
    latent: int = 3


class _Adam:
    """A network under training."""

    def __init__(self, net: Network, arm: Arm):
        self.net, self.arm, self.step = net, arm, 0
        self.theta = net.flat()
        self.m, self.v = np.zeros_like(self.theta), np.zeros_like(self.theta)
        self.encoder_size = sum(w.weight.size + w.bias.size for w in net.parts["encoder"])
        self.history: list[dict] = []

    def move(self, vec: np.ndarray) -> None:
        """One step from the summed gradients of rows and pairs, with their numbers at the end."""
        n_rows, n_pairs = vec[-2:]
        grad = vec[: self.theta.size] / max(n_rows, 1.0)
        grad[: self.encoder_size] += vec[self.theta.size : -4] / max(n_pairs, 1.0)
        grad = grad + self.arm.weight_decay * self.theta
        self.step += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        first, second = self.m / (1 - 0.9**self.step), self.v / (1 - 0.999**self.step)
        self.theta = self.theta - self.arm.lr * first / (np.sqrt(second) + 1e-8)
        self.net = self.net.with_flat(self.theta)

    def told(self, epoch: int, totals: np.ndarray) -> None:
        recon, pair = totals[0] / max(totals[2], 1.0), totals[1] / max(totals[3], 1.0)
        self.history.append({"epoch": epoch, "reconstruction": float(recon), "contrastive": float(pair),
                             "loss": float(recon + self.arm.lam * pair)})


def _gradients(nets: list[tuple[int, Network, Arm]]):
    """Per network the summed gradients of a task's rows and pairs of its training set."""
    def fold(blocks: Iterable[Row]) -> Iterator[tuple[int, np.ndarray]]:
        total: dict[int, np.ndarray] = {}
        for block in blocks:
            x, x2 = matrix(block, "x"), matrix(block, "x2")
            pairs = block.kind != ROWS
            for i, (of, net, arm) in enumerate(nets):
                if of != block.set:
                    continue
                for at in range(0, block.n, GRADIENT_ROWS):
                    some, other = x[at : at + GRADIENT_ROWS], x2[at : at + GRADIENT_ROWS]
                    if pairs:
                        g, recon, pair = gradient(net, x[:0], some, other, np.full(len(some), block.kind), arm.margin, arm.lam)
                        vec = np.concatenate([g, [recon, pair, 0, len(some)]])
                    else:
                        g, recon, pair = gradient(net, some, x[:0], x[:0], np.empty(0), arm.margin, arm.lam)
                        vec = np.concatenate([g, [recon, pair, len(some), 0]])
                    total[i] = total[i] + vec if i in total else vec
        return iter(total.items())

    return fold


def fit_encoders(
    df: DataFrame, arms: dict[str, Arm], group: str | None = None, epochs: int = 10, batches: int = 4, seed: int = 42,
    features: str = "features", y: str = "y", row_id: str = "row_id",
) -> dict[tuple[int, str], tuple[Network, list[dict]]]:
    """One contrastive autoencoder per (value of ``group``, arm), all trained in the same jobs.

    A step is one job over a batch of all training sets, which sums gradients by network; the networks travel with the
    function.  ``group`` is an int column, whose values seed start weights and pairs; without it there is one training
    set, 0, seeded by ``seed``.
    """
    seeds = [0] if group is None else sorted(r[0] for r in df.select(group).distinct().collect())
    inputs = len(df.select(features).first()[0])
    table = training_batches(df, batches, seed, y, row_id, features, group, seeds).withColumn(
        "kind", F.coalesce("different", F.lit(ROWS)))
    # written once and partitioned by batch, so that a step reads only its own
    blocks = written(packed(table, ["batch", "set", "kind"], ["x", "x2"]), "training-batches", ["batch"])
    steps = [blocks.filter(F.col("batch") == b).rdd for b in range(batches)]
    keys = [(s, name) for s in seeds for name in arms]
    fits = {}
    for s, name in keys:
        shape = list(arms[name].hidden), arms[name].latent
        fits[s, name] = _Adam(Network.autoencoder(inputs, *shape, seed if group is None else s), arms[name])
    numbers = sum(fit.theta.size + fit.encoder_size + 4 for fit in fits.values())
    for epoch in range(epochs):
        totals = {key: np.zeros(4) for key in keys}
        for b in range(batches):
            nets = [(s, fits[s, name].net, arms[name]) for s, name in keys]
            summed = added_up(steps[b], _gradients(nets), len(nets), numbers)
            for i, vec in sorted(summed.items()):
                totals[keys[i]] += vec[-4:]
                fits[keys[i]].move(vec)
        for key in keys:
            fits[key].told(epoch, totals[key])
    return {key: (fit.net, fit.history) for key, fit in fits.items()}


def fit_encoder(
    df: DataFrame,
    hidden: list[int] | None = None,
    latent: int = 3,
    epochs: int = 10,
    batches: int = 4,
    lr: float = 1e-3,
    margin: float = 10.0,
    lam: float = 0.1,
    seed: int = 42,
    weight_decay: float = 0.0,
    features: str = "features",
    y: str = "y",
    row_id: str = "row_id",
) -> tuple[Network, list[dict]]:
    """Contrastive autoencoder by synchronous Adam; ``lam=0`` gives a plain autoencoder.

    One Spark job per step sums the gradients of one batch over all tasks.
    Returns the network and the loss per epoch.
    """
    arm = Arm(lam, margin, lr, weight_decay, tuple([64, 32, 16] if hidden is None else hidden), latent)
    return fit_encoders(df, {"": arm}, None, epochs, batches, seed, features, y, row_id)[0, ""]


def encode_many(
    df: DataFrame, nets: dict[int, Network], group: str, features: str = "features", out: str = "z", part: str = "encoder",
) -> DataFrame:
    """Latent vector of every row by the network of its group (null where the group has none)."""
    stacks = {g: net.parts[part] for g, net in nets.items()}

    def run(groups: pa.Array, v: pa.Array) -> pa.Array:
        names = groups.to_numpy(zero_copy_only=False)
        found = np.zeros((len(v), max(s[-1].bias.size for s in stacks.values())))
        x = as_matrix(v)
        for name in np.unique(names).tolist():
            if name in stacks:
                mine = np.flatnonzero(names == name)
                found[mine] = forward(x[mine], stacks[name])[-1]
        return from_matrix(found)

    known = F.col(group).isin(list(stacks))
    return df.withColumn(out, F.when(known, F.arrow_udf(run, "array<double>")(F.col(group).cast("int"), F.col(features))))


def sweep_encoder(
    df: DataFrame, trials: list[dict], ks: list[int] | None = None, restarts: int = 1, epochs: int = 10, batches: int = 4,
    seed: int = 42, features: str = "features", y: str = "y", row_id: str = "row_id", validation: DataFrame | None = None,
) -> DataFrame:
    """Fit an encoder per trial, all in the same jobs; score each by k-means accuracy.

    A trial is a dict of ``Arm`` settings.  Result: ``trial, km_accuracy, silhouette, best_k, val_mse, loss``.
    """
    from .clustering import cluster

    arms = {str(i): Arm(**{k: tuple(v) if k == "hidden" else v for k, v in trial.items()}) for i, trial in enumerate(trials)}
    fits = fit_encoders(df, arms, None, epochs, batches, seed, features, y, row_id)
    rows = []
    for i in range(len(trials)):
        net, history = fits[0, str(i)]
        _, _, summary = cluster(encode(df, net, features), ks, restarts, row_id=row_id, y=y)
        s = summary.first()
        mse = reconstruction_error(df if validation is None else validation, net, features).agg(F.avg("mse")).first()[0]
        rows.append((i, s.km_accuracy, s.silhouette, s.best_k, float(mse), history[-1]["loss"]))
    return local_table(df.sparkSession, rows, "trial int, km_accuracy double, silhouette double, best_k int, val_mse double, loss double"
    )


# The ranges and layer lists that trials are drawn from.
HIDDEN_OPTIONS = [[128, 64, 32], [64, 32, 16], [128, 64, 32, 16]]
LATENT_SIZES = [2, 3, 4, 5]
RATE_RANGE, WEIGHT_RANGE, MARGIN_RANGE = (1e-4, 1e-2), (0.01, 1.0), (5.0, 20.0)


def random_trials(n: int, seed: int = 42, hidden_options: list[list[int]] | None = None) -> list[dict]:
    """Random settings over the documented ranges (log-uniform rates and weights)."""
    hidden_options = hidden_options or HIDDEN_OPTIONS
    rng = np.random.default_rng(seed)
    return [
        {
            "hidden": hidden_options[rng.integers(len(hidden_options))],
            "latent": int(rng.choice(LATENT_SIZES)),
            "lr": float(np.exp(rng.uniform(*np.log(RATE_RANGE)))),
            "lam": float(np.exp(rng.uniform(*np.log(WEIGHT_RANGE)))),
            "margin": float(rng.uniform(*MARGIN_RANGE)),
        }
        for _ in range(n)
    ]
