"""The look-back job: at every tick, the struggles of the last half hour that no window before has found.

Windows overlap, so a struggle is seen by several; the first keeps it. A window has a partition and, written last, a record
of its own: one with a record is not run again, one without, whose run broke off, replaces its partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from friction.functions.tables import listed, touched
from friction.operators.detect import detect
from friction.operators.ingest import unseen_struggles

#: How far a window looks back, and how far windows are apart, in milliseconds.
WINDOW_MS, TICK_MS = 1_800_000, 300_000
STRUGGLES = "session_id string, element_id string, type string, severity double, ts_ms long"


def committed(spark: SparkSession, at: str) -> list[int]:
    return sorted(int(n) for n in listed(spark, f"{at}/_windows"))


def found_before(spark: SparkSession, at: str, end_ms: int) -> DataFrame:
    """What windows with a record found, but for one."""
    windows = [w for w in committed(spark, at) if w != end_ms]
    folders = [f"{at}/struggles/window_end={w}" for w in windows]
    return spark.read.schema(STRUGGLES).parquet(*folders) if folders else spark.createDataFrame([], STRUGGLES)


def run_window(events: DataFrame, at: str, end_ms: int, window_ms: int = WINDOW_MS, **options) -> bool:
    """Run the window that ends at a time; False if it has been. options: of detect()."""
    spark = events.sparkSession
    if end_ms in committed(spark, at):
        return False
    rows = events.where((F.col("ms") >= end_ms - window_ms) & (F.col("ms") < end_ms))
    found = detect(rows, **options).select("session_id", "element_id", "type", "severity", "ts_ms")
    new = unseen_struggles(found, found_before(spark, at, end_ms), end_ms - window_ms)
    new.write.mode("overwrite").parquet(f"{at}/struggles/window_end={end_ms}")
    touched(spark, f"{at}/_windows/{end_ms}")
    return True


def due(spark: SparkSession, at: str, now_ms: int, first_ms: int, tick_ms: int = TICK_MS) -> list[int]:
    """Ends of the windows that should have run and have not: after a stop, the missed ones come first."""
    done = set(committed(spark, at))
    return [t for t in range(first_ms, now_ms + 1, tick_ms) if t not in done]


def scheduled(spark: SparkSession, events: Callable[[], DataFrame], at: str, first_ms: int, now_ms: Callable[[], int], checkpoint: str, every: str = "5 minutes", tick_ms: int = TICK_MS, window_ms: int = WINDOW_MS):
    """Start a query that runs the due windows at every tick of a processing-time trigger."""

    def tick(_: DataFrame, number: int) -> None:
        for end in due(spark, at, now_ms(), first_ms, tick_ms):
            run_window(events(), at, end, window_ms)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
