"""The hot path: events arrive, and each batch gives struggles and what is shown for them.

A session's state is its stored events of the last minutes. With a batch come the session's new events; together with the
state they are what the rules see, as if the store had been read for that session alone. State is dropped by a timer once the
watermark passes the time for which it can matter. Struggles and interventions of a batch have a partition of their own that
a retry replaces; a struggle of a session, element and type that an earlier batch found in what is still seen is not repeated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from friction.functions.tables import listed
from friction.operators.detect import detect
from friction.operators.dispatch import choose, dispatch, last_routes
from friction.operators.ingest import unseen_struggles
from friction.schema import EVENT_COLUMNS, STORED_TYPES

#: How far back a batch looks, in milliseconds; variants of an intervention.
LOOK_BACK_MS, VARIANTS = 300_000, 3
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STRUGGLES = "session_id string, element_id string, type string, severity double, ts_ms long"
INTERVENTIONS = f"{STRUGGLES}, variant_index int, row_id string, tracking_id string, confidence double, confirm boolean"


class Recent(StatefulProcessor):
    """Of each session: the events of the batch with those of the look-back, which stay in its state. An event is its time,
    number and whether it is stored; all else is one text that passes through, for each column costs each session time."""

    def __init__(self, look_back_ms: int):
        self.look_back_ms = look_back_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "ms long, seq long, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        here, stored = [], []
        for part in rows:
            named = list(zip(part["ms"].tolist(), part["seq"].tolist(), part["event"].tolist()))
            here += named
            stored += [r for r, stays in zip(named, part["stored"].tolist()) if stays]
        since = max(r[0] for r in here) - self.look_back_ms
        known = self.events.exists()
        old = []
        if known:
            names = {r[:2] for r in here}
            old = [r for r in map(tuple, self.events.get()) if r[0] >= since and r[:2] not in names]
            for t in list(self.handle.listTimers()):  # only a session with state has one
                self.handle.deleteTimer(t)
        stay = old + [r for r in stored if r[0] >= since]
        if stay:
            self.events.put(stay)
            self.handle.registerTimer(max(max(r[0] for r in stay) + self.look_back_ms, timerValues.getCurrentWatermarkInMs() + 1))
        elif known:
            self.events.clear()
        yield pd.DataFrame({"event": [r[2] for r in old] + [r[2] for r in here], "fresh": [False] * len(old) + [True] * len(here)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        return iter([])

    def close(self) -> None:
        pass


def with_recent(events: DataFrame, look_back_ms: int = LOOK_BACK_MS, kept: tuple[str, ...] = STORED_TYPES) -> DataFrame:
    """A stream of timed() events, EVENT_COLUMNS, as the rows that the rules see with each batch: its own (fresh) and those of
    the look-back before the session's last one, of the kinds that are stored."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    names = list(EVENT_COLUMNS)
    schema = T.StructType([events.schema[c] for c in names])
    stored = F.coalesce(F.col("event_type").isin(*kept), F.lit(False)).alias("stored")
    rows = events.select("session_id", "ms", "seq", stored, F.to_json(F.struct(*names)).alias("event"), "event_time").groupBy("session_id")
    out = rows.transformWithStateInPandas(Recent(look_back_ms), "event string, fresh boolean", "Append", "EventTime")
    return out.select(F.from_json("event", schema, {"mode": "FAILFAST"}).alias("event"), "fresh").select("event.*", "fresh")


def earlier(spark: SparkSession, at: str, schema: str, number: int) -> DataFrame:
    """What other batches wrote to a table."""
    if not listed(spark, at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, hot_batch long").parquet(at).where(F.col("hot_batch") != number).drop("hot_batch")


def hot_batch(rows: DataFrame, number: int, at: str, stats: DataFrame, baselines: DataFrame | None = None, look_back_ms: int = LOOK_BACK_MS, **guards) -> None:
    """Detect and dispatch for one batch of with_recent(). A struggle is new unless another batch found it within the look-back
    before the first of these rows. guards: denied, roles, paused, safe_mode of dispatch()."""
    spark = rows.sparkSession
    seen = rows.select(*EVENT_COLUMNS)
    since = rows.agg(F.min("ms")).first()[0]
    if since is None:
        return
    found = detect(seen, baselines=baselines).select("session_id", "element_id", "type", "severity", "ts_ms")
    new = unseen_struggles(found, earlier(spark, f"{at}/struggles", STRUGGLES, number), since - look_back_ms)
    new.write.mode("overwrite").parquet(f"{at}/struggles/hot_batch={number}")
    new = spark.read.schema(STRUGGLES).parquet(f"{at}/struggles/hot_batch={number}")
    shown = earlier(spark, f"{at}/interventions", INTERVENTIONS, number).select("tracking_id")
    ready = dispatch(choose(new, stats, VARIANTS), last_routes(seen), shown=shown, **guards)
    names = [c.split()[0] for c in INTERVENTIONS.split(", ")]
    ready.select(*names).write.mode("overwrite").parquet(f"{at}/interventions/hot_batch={number}")


def hot_path(events: DataFrame, at: str, checkpoint: str, stats: DataFrame, look_back_ms: int = LOOK_BACK_MS, kept: tuple[str, ...] = STORED_TYPES, baselines: DataFrame | None = None, **guards):
    """Start a query from a stream of timed() events to at/struggles and at/interventions."""

    def act(batch: DataFrame, number: int) -> None:
        batch.persist()
        hot_batch(batch, number, at, stats, baselines, look_back_ms, **guards)
        batch.unpersist()

    return with_recent(events, look_back_ms, kept).writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
