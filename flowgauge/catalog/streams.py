"""The assessment as a stream."""

from pyspark.sql import functions as F

from ..functions.bounded import work_dir
from ..operators.assign import ClusterModel
from ..operators.clean import apply_labels, fit_labels
from ..plans.sweeps import label_mean_clusters
from ..streaming.continuous import ContinuousAssessment, windowed_counts, windowed_scarcity
from . import query
from .views import SCORES_SQL, cell_model, latent, rounded, table


def _continuous(spark, sf, diversity):
    rows = latent(spark, sf)
    model, _ = cell_model(rows)
    root = work_dir(spark, "stream")
    rows.filter("side = 'test'").select("row_id", "y", "z").repartition(3).write.parquet(f"{root}/arriving")
    running = ContinuousAssessment(spark, model, rows.filter("side = 'train'"), f"{root}/state", m=64, diversity=diversity)
    stream = (
        spark.readStream.schema("row_id bigint, y int, z array<double>").option("maxFilesPerTrigger", 1)
        .parquet(f"{root}/arriving")
    )
    running.start(stream, f"{root}/checkpoint").awaitTermination()
    return running


@query(
    "w1_continuous_assessment",
    SCORES_SQL + "SELECT cluster_id, majority_y, n_train, n_test, round(proximity, 6) AS proximity, round(scarcity, 6) AS scarcity FROM cluster_scores",
)
def w1(spark, sf):
    scores = _continuous(spark, sf, False).cluster_scores()
    return rounded(
        scores.select("cluster_id", "majority_y", "n_train", "n_test", "proximity", "scarcity"), "proximity", "scarcity"
    )


@query("w1b_continuous_with_diversity")
def w1b(spark, sf):
    return rounded(_continuous(spark, sf, True).global_scores(), "diversity", "proximity", "scarcity")


_W2 = """WITH e AS (SELECT ts, value, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS y FROM events),
c AS (SELECT y AS id, avg(value) AS c FROM e GROUP BY y),
a AS (SELECT ts, y, min({'d': abs(value - c.c), 'id': c.id}) FILTER (c.id <> e.y).id AS neg, value FROM e, c GROUP BY ts, y, value),
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ws, y AS pos, neg, count(*) AS n FROM a
      WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL),
g AS (SELECT s.ws, p.id AS pos, q.id AS neg, coalesce(w.n, 0) AS n FROM (SELECT DISTINCT ws FROM w) s, c p JOIN c q ON p.id <> q.id
      LEFT JOIN w ON w.ws = s.ws AND w.pos = p.id AND w.neg = q.id),
pl AS (SELECT *, row_number() OVER (PARTITION BY ws, pos ORDER BY n, neg) AS i, count(*) OVER (PARTITION BY ws, pos) AS m, sum(n) OVER (PARTITION BY ws, pos) AS total FROM g),
s AS (SELECT ws, pos, total, CASE WHEN total = 0 THEN 0 ELSE 1 - greatest(0, least(1, (m + 1 - 2 * sum((m - i + 1) * n) / total) / m
      * CASE WHEN m > 1 THEN m / (m - 1) ELSE 1 END)) END AS sc FROM pl GROUP BY ws, pos, m, total)
SELECT epoch(ws)::BIGINT AS window_start, sum(total)::BIGINT AS n_rows, round(sum(sc) / (SELECT count(*) FROM c), 6) AS scarcity FROM s GROUP BY ws"""


@query("w2_windowed_assessment", _W2)
def w2(spark, sf):
    events = table(spark, sf, "events")
    labels = fit_labels(events.withColumnRenamed("event_type", "label"))
    coded = apply_labels(events.withColumnRenamed("event_type", "label"), labels).withColumn("z", F.array("value"))
    model = ClusterModel.load(label_mean_clusters(coded, []))
    root = work_dir(spark, "windows")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = apply_labels(source.withColumnRenamed("event_type", "label"), labels).select(
        F.col("ts").cast("timestamp").alias("ts"), "y", F.array("value").alias("z")
    )
    (
        windowed_counts(stream, model).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/windows")
        .awaitTermination()
    )
    found = windowed_scarcity(spark.read.parquet(f"{root}/windows"), model)
    return rounded(
        found.select(F.unix_seconds("window_start").alias("window_start"), "n_rows", "scarcity"), "scarcity"
    )
