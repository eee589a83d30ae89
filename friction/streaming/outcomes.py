"""The outcome loop as a stream: what became of interventions, joined to the interventions that were shown.

Both sides may come late and in any order. An outcome counts for the intervention with its tracking id that was shown at most
`within` before it; one that finds none before the watermark passes goes to quarantine. Counters are kept as the increments
of each batch, which a retry replaces, so that no outcome counts twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from friction.functions.tables import listed
from friction.operators.dispatch import OUTCOMES

COUNTERS = [c for _, c in OUTCOMES.values()]


def timed_by(rows: DataFrame, ms: str, time: str, delay: str) -> DataFrame:
    return rows.withColumn(time, F.timestamp_millis(F.col(ms) + 1)).withWatermark(time, delay)


def resolved(outcomes: DataFrame, shown: DataFrame, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Streams of outcomes (session_id, tracking_id, kind, ms) and interventions (tracking_id, row_id, ms), joined: row_id is
    null where no intervention came in time."""
    left = timed_by(outcomes.select("session_id", "tracking_id", "kind", "ms"), "ms", "event_time", delay)
    right = timed_by(shown.select(F.col("tracking_id").alias("of"), "row_id", F.col("ms").alias("shown_ms")), "shown_ms", "shown_time", delay)
    own = (F.col("tracking_id") == F.col("of")) & F.expr(f"event_time >= shown_time and event_time <= shown_time + interval {within}")
    return left.join(right, own, "left_outer").select("session_id", "tracking_id", "kind", "ms", "row_id")


def count_outcomes(joined: DataFrame, at: str, checkpoint: str):
    """Start a query that keeps the increments of each batch in at/increments, and unknown outcomes in at/quarantine."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        counts = [F.count_if(F.col("kind") == k).alias(c) for k, (_, c) in OUTCOMES.items()]
        batch.where("row_id is not null").groupBy("row_id").agg(*counts).write.mode("overwrite").parquet(f"{at}/increments/outcome_batch={number}")
        batch.where("row_id is null").drop("row_id").write.mode("overwrite").parquet(f"{at}/quarantine/outcome_batch={number}")
        batch.unpersist()

    return joined.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counters_of(spark: SparkSession, at: str, stats: DataFrame) -> DataFrame:
    """stats (row_id, impressions, successes, dismissals) with all increments so far, and their success rate."""
    rows = stats.select("row_id", *COUNTERS)
    if listed(spark, f"{at}/increments"):
        more = spark.read.schema("row_id string, " + ", ".join(f"{c} long" for c in COUNTERS)).parquet(f"{at}/increments")
        more = more.groupBy("row_id").agg(*[F.sum(c).alias(f"more_{c}") for c in COUNTERS])
        rows = rows.join(more, "row_id", "left")
        rows = rows.select("row_id", *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in COUNTERS])
    return rows.withColumn("success_rate", F.when(F.col("impressions") > 0, F.col("successes") / F.col("impressions")).otherwise(F.lit(0.0)))
