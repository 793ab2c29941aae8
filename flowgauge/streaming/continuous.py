"""Assessment of rows that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assign import ClusterModel, assign, negative_counts
from ..operators.curves import curve_summary, ks_from_slots, slot_counts
from ..operators.diversity import DEFAULT_FREQUENCIES, add_covariances, covariance_partials, covariance_scores
from ..operators.proximity import value_counts
from ..operators.scarcity import scarcity_from_counts


class ContinuousAssessment:
    """Running scores against fixed clusters and train rows, from a state whose size does not follow the rows.

    The state holds pair counts per (cluster, other cluster), counts of test rows per slot between the fixed train values
    (what the statistic depends on, so nothing is rounded), and the random-feature matrix of each cluster.  A micro-batch is
    reduced to the same partials and added to the last state, which is written as a new version; a pointer row then names
    it.  A batch that the pointer has passed changes nothing when it is replayed; one that failed before the pointer moved
    is added again to the same state; readers only follow the pointer.  Three versions are kept, so a reader has the time
    of two batches.
    """

    VERSIONS = 3

    def __init__(self, spark: SparkSession, clusters: "DataFrame | ClusterModel", train: DataFrame, state: str,
                 gamma: float = 1.0, m: int = DEFAULT_FREQUENCIES, bins: float | None = None, diversity: bool = True):
        self.spark, self.state, self.gamma, self.m, self.bins = spark, state.rstrip("/"), gamma, m, bins
        self.model = ClusterModel.load(clusters)
        self.with_diversity = diversity
        base = assign(train.withColumn("side", F.lit("train")), self.model)
        self.curves = curve_summary(value_counts(base, "neg_dist", "side", ["pos"], bins))
        # the first pointer; a state that is there already goes on
        first = spark.range(1).select(F.lit(-1).cast("bigint").alias("batch"), F.lit(0).alias("version"))
        first.write.mode("ignore").parquet(f"{self.state}/pointer")

    def _pointer(self) -> tuple[int, int]:
        """The last batch that is part of the state, and the version that holds it."""
        rows = self.spark.read.schema("batch bigint, version int").parquet(f"{self.state}/pointer")
        found = rows.agg(F.max(F.struct("batch", "version")).alias("p")).first().p
        return found.batch, found.version

    def _read(self, kind: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.state}/version={version}/{kind}")

    def _merged(self, kind: str, part: DataFrame, last: tuple[int, int]) -> DataFrame:
        """``part`` added to what the last version has."""
        both = part if last[0] < 0 else part.unionByName(self._read(kind, last[1]))
        if kind == "matrices":
            return add_covariances(both.select("pos", "part", "total", "n"), ["pos"])
        keys = ["pos", "neg"] if kind == "counts" else ["pos", "node", "slot"]
        return both.groupBy(*keys).agg(F.sum("n").alias("n"))

    def update(self, rows: DataFrame, batch_id: int) -> None:
        """foreachBatch body."""
        last = self._pointer()
        if batch_id <= last[0]:
            return
        version = (last[1] + 1) % self.VERSIONS
        assigned = assign(rows.withColumn("side", F.lit("test")), self.model).persist()
        values = value_counts(assigned, "neg_dist", "side", ["pos"], self.bins)
        parts = {
            "counts": negative_counts(assigned),
            "slots": slot_counts(self.curves, values.select("pos", "value", F.col("n_test").alias("n")), []),
        }
        if self.with_diversity:
            parts["matrices"] = covariance_partials(assigned, ["pos"], self.gamma, self.m)
        for kind, part in parts.items():
            self._merged(kind, part, last).write.mode("overwrite").parquet(f"{self.state}/version={version}/{kind}")
        assigned.unpersist()
        self.spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch"), F.lit(version).alias("version")).write.mode(
            "append").parquet(f"{self.state}/pointer")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        writer = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def cluster_scores(self) -> DataFrame:
        """Scores of everything seen so far, per cluster."""
        batch, version = self._pointer()
        frame = self.model.table(self.spark).select(F.col("cluster_id").alias("pos"), "majority_y", "n_train")
        if batch < 0:
            zeros = {"proximity": F.lit(0.0), "n_test": F.lit(0).cast("bigint"), "scarcity": F.lit(0.0)}
            zeros |= {"diversity": F.lit(0.0)} if self.with_diversity else {}
            return frame.withColumns(zeros).withColumnRenamed("pos", "cluster_id")
        counts = self._read("counts", version)
        sizes = counts.groupBy("pos").agg(F.sum("n").alias("n"))
        p = ks_from_slots(self.curves, self._read("slots", version), sizes, []).select("pos", F.col("ks").alias("proximity"))
        s = scarcity_from_counts(counts, self.model)
        out = frame.join(p, "pos", "left").join(sizes.withColumnRenamed("n", "n_test"), "pos", "left").join(s, "pos", "left")
        if self.with_diversity:
            d = covariance_scores(self._read("matrices", version), ["pos"], self.m).select("pos", "diversity")
            out = out.join(d, "pos", "left").na.fill(0.0, ["diversity"])
        return out.na.fill(0.0, ["proximity", "scarcity"]).na.fill(0, ["n_test"]).withColumnRenamed("pos", "cluster_id")

    def global_scores(self) -> DataFrame:
        aggs = [F.max("proximity").alias("proximity"), F.avg("scarcity").alias("scarcity"), F.sum("n_test").alias("n_test")]
        if self.with_diversity:
            aggs.insert(0, F.avg("diversity").alias("diversity"))
        return self.cluster_scores().agg(*aggs)


def windowed_counts(
    stream: DataFrame, clusters: "DataFrame | ClusterModel", time: str = "ts", width: str = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """Pair counts per tumbling event-time window; rows later than ``delay`` are dropped.

    Works on a stream (append mode: a window appears once it is final) and on a
    batch.  State is one row per window and pair of clusters.
    """
    assigned = assign(stream.withWatermark(time, delay), clusters)
    return assigned.groupBy(F.window(time, width), "pos", "neg").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "pos", "neg", "n"
    )


def windowed_scarcity(counts: DataFrame, clusters: "DataFrame | ClusterModel") -> DataFrame:
    """Scarcity per finished window and cluster, and the test rows behind it."""
    keys = ["window_start", "window_end"]
    per_cluster = scarcity_from_counts(counts, clusters, keys)
    model = clusters if isinstance(clusters, ClusterModel) else ClusterModel.load(clusters)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("n_rows"))
    score = per_cluster.groupBy(*keys).agg((F.sum("scarcity") / F.lit(len(model.ids))).alias("scarcity"))
    return sizes.join(score, keys, "left").na.fill(0.0, ["scarcity"])
