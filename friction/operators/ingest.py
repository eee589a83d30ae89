"""Batch semantics of the ingest path: storing once, history for detection, sampling and metering."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.schema import EVENT_TYPES, STORED_TYPES

EXEMPT = ("JS_ERROR", "VALIDATION_ERROR")


def validated(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the wire constraints, and the others, with the reason, for quarantine."""
    bad = F.when(F.coalesce(F.length("session_id"), F.lit(0)).between(1, 128), None).otherwise("session_id")
    bad = F.coalesce(bad, F.when(F.coalesce(F.length("route"), F.lit(0)).between(1, 2048), None).otherwise("route"), F.when(F.col("event_type").isin(*EVENT_TYPES), None).otherwise("event_type"))
    rows = events.withColumn("reason", bad)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def storable(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*STORED_TYPES))


def first_by_key(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the first; rows with a null in the key never conflict."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    kept = events.where(whole).groupBy(*key).agg(F.min_by(F.struct(*events.columns), F.struct(*order)).alias("r")).select("r.*")
    return kept.unionByName(events.where(~whole))


def new_rows(events: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not stored."""
    return events.join(stored.select(*key).distinct(), key, "left_anti")


def history(batch: DataFrame, stored: DataFrame, key: list[str], since_ms: int) -> DataFrame:
    """The batch with the stored events of its sessions since a time, stored ones not repeated."""
    old = stored.where(F.col("ms") >= since_ms).join(batch.select("session_id").distinct(), "session_id", "left_semi")
    return old.join(batch.select(*key), key, "left_anti").unionByName(batch)


def sampled(events: DataFrame, default: float, by_type: dict[str, float], key: Column, keep: Column | None = None) -> DataFrame:
    """A share of the events that a hash of the key chooses. Errors and outcomes of interventions (CUSTOM, m_kind) always stay:
    the outcome loop lives of them. Rates are clamped to 0..1. keep: a condition in place of the rates; null keeps."""
    clamp = lambda x: 1.0 if x != x or x in (float("inf"), float("-inf")) else min(1.0, max(0.0, x))
    rate = F.lit(clamp(default))
    for t, r in by_type.items():
        rate = F.when(F.col("event_type") == t, F.lit(clamp(r))).otherwise(rate)
    u = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    outcome = (F.col("event_type") == "CUSTOM") & F.coalesce(F.startswith("m_kind", F.lit("intervention_")), F.lit(False))
    stays = u < rate if keep is None else F.coalesce(keep, F.lit(True))
    return events.where(F.col("event_type").isin(*EXEMPT) | outcome | stays)


def usage(events: DataFrame, month: Column, user: Column) -> DataFrame:
    """month, events, mau: metering by month; users count once, however often they come."""
    return events.groupBy(month.alias("month")).agg(F.count("*").alias("events"), F.countDistinct(user).alias("mau"))


def unseen_struggles(detections: DataFrame, stored: DataFrame, since_ms: int) -> DataFrame:
    """Detections without a stored one of their session, element and type since a time; a null element equals null."""
    s = stored.where(F.col("ts_ms") >= since_ms).select(F.col("session_id").alias("s"), F.col("element_id").alias("el"), F.col("type").alias("t")).distinct()
    return detections.join(s, (F.col("session_id") == F.col("s")) & F.col("element_id").eqNullSafe(F.col("el")) & (F.col("type") == F.col("t")), "left_anti")


def authorised(batches: DataFrame, keys: DataFrame) -> DataFrame:
    """Batches (token, ...) with the org of their token; batches whose key is unknown or revoked are left out.

    keys: key_hash (SHA-256 of the token), org, revoked_at."""
    live = keys.where("revoked_at is null").select(F.col("key_hash").alias("token_hash"), "org")
    return batches.withColumn("token_hash", F.sha2("token", 256)).join(live, "token_hash").drop("token_hash", "token")


def newest(events: DataFrame, keep: int = 200) -> DataFrame:
    """What a client's buffer still holds: the last events of each session by arrival."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return events.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= keep).drop("nth")


def debounced(events: DataFrame, quiet_ms: int) -> DataFrame:
    """Events that no other of the session, element and type follows within a time."""
    w = Window.partitionBy("session_id", "element_id", "event_type").orderBy("ms", "seq")
    gap = F.lead("ms").over(w) - F.col("ms")
    return events.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= quiet_ms)).drop("gap")


def input_growth(events: DataFrame) -> DataFrame:
    """Input events with `delta`: how much longer the field is than at its input before (at first: its length)."""
    w = Window.partitionBy("session_id", "element_id").orderBy("ms", "seq")
    rows = events.where("event_type = 'INPUT_CHANGE'")
    return rows.withColumn("delta", F.coalesce("m_length", F.lit(0.0)) - F.coalesce(F.lag("m_length").over(w), F.lit(0.0)))


def counted(batch: DataFrame, accepted: DataFrame) -> DataFrame:
    """accepted, duplicates: events stored, and storable ones that were not."""
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    rows = one(storable(batch), "storable").join(one(accepted, "accepted"), "one")
    return rows.select("accepted", (F.col("storable") - F.col("accepted")).alias("duplicates"))


def store_counted(batch: DataFrame, stored: DataFrame, key: list[str], order: list[str], at: str) -> dict[str, int]:
    """Write what of a batch is not stored, and count while writing: accepted, duplicates. The batch is read once.

    stored: the keys that are stored. A row with a null in its key never conflicts."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    known = stored.select(*[F.col(k).alias(f"known_{k}") for k in key]).distinct().withColumn("known", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"known_{k}") for k in key])
    rows = storable(batch).withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    rows = rows.join(known, same, "left").withColumn("new", ~whole | ((F.col("nth") == 1) & F.col("known").isNull()))
    counts = Observation()
    rows = rows.observe(counts, F.count_if("new").alias("accepted"), F.count_if(~F.col("new")).alias("duplicates"))
    rows.where("new").select(*batch.columns).write.mode("overwrite").parquet(at)
    return dict(counts.get)


def user_sketches(events: DataFrame, group: list[Column], user: Column) -> DataFrame:
    """events and a sketch of the users of each group (org and month, say): sketches of batches, kept, merge to that of all."""
    return events.groupBy(*group).agg(F.count("*").alias("events"), F.hll_sketch_agg(user).alias("users"))


def users_of_sketches(sketches: DataFrame, group: list[str]) -> DataFrame:
    """events and mau of each group from the sketches of any number of batches; mau within some 1.6 % (one standard error)."""
    return sketches.groupBy(*group).agg(F.sum("events").alias("events"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("mau"))


#: Fixed value: events in a request.
MOST_EVENTS = 500


def event_batches(spark, at: str, schema: str, stream: bool = False) -> DataFrame:
    """Batches of a folder of JSON documents {token, org, events: [...]} as a row for each event, with batch_id (file and
    place), token, org and the columns of `schema`. stream: as a stream of the files that arrive."""
    reader = spark.readStream if stream else spark.read
    raw = reader.schema(f"token string, org string, events array<struct<{schema}>>").json(at)
    batch = F.sha2(F.concat_ws("|", "_metadata.file_path", "token", "org", F.to_json("events")), 256)
    return raw.select(batch.alias("batch_id"), "token", "org", F.size("events").alias("batch_size"), F.posexplode("events").alias("seq", "e")).select("batch_id", "token", "org", "batch_size", "seq", "e.*")


def whole_batches(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of batches (batch_id) of at most MOST_EVENTS in which every event is valid, and all events of the others."""
    good, bad = validated(events)
    refused = bad.select("batch_id").unionByName(events.groupBy("batch_id").count().where(F.col("count") > MOST_EVENTS).select("batch_id")).distinct()
    return good.join(refused, "batch_id", "left_anti"), events.join(refused, "batch_id", "left_semi")


def resolved_org(batches: DataFrame, keys: DataFrame, orgs: DataFrame, required: bool = False) -> tuple[DataFrame, DataFrame]:
    """Batches (token, header_org) with `org`: that of their live token, else, unless a token is required, the one in their
    header; and those refused, with the reason: no_key or unknown_org."""
    live = keys.where("revoked_at is null").select(F.col("key_hash").alias("token_hash"), F.col("org").alias("token_org"))
    rows = batches.withColumn("token_hash", F.sha2("token", 256)).join(live, "token_hash", "left")
    rows = rows.withColumn("org", F.coalesce("token_org", F.lit(None) if required else F.when(F.col("token").isNull(), F.col("header_org"))))
    rows = rows.join(orgs.select(F.col("org").alias("known")).distinct(), F.col("org") == F.col("known"), "left")
    reason = F.when(F.col("org").isNull(), "no_key").when(F.col("known").isNull(), "unknown_org")
    rows = rows.withColumn("reason", reason).drop("token", "token_hash", "token_org", "known")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def without_types(events: DataFrame, disabled: list[str]) -> DataFrame:
    """Events but those of disabled types."""
    return events.where(~F.col("event_type").isin(*disabled)) if disabled else events


def throttled(events: DataFrame, event_type: str = "SCROLL", gap_ms: int = 200) -> DataFrame:
    """Events of a type of which one follows the one kept before it by gap_ms at least; others stay.

    What is kept depends on what was kept, so a session's events pass a task in order, a batch at a time, and all that the task
    remembers is the last one kept."""

    def greedy(batches):
        before, last = None, None
        for batch in batches:
            keep = []
            for session, ms in zip(batch.column("session_id").to_pylist(), batch.column("ms").to_pylist()):
                keep.append(last is None or session != before or ms - last >= gap_ms)
                if keep[-1]:
                    before, last = session, ms
            yield batch.filter(pa.array(keep, pa.bool_()))

    mine = events.where(F.col("event_type") == event_type)
    kept = mine.repartition("session_id").sortWithinPartitions("session_id", "ms", "seq").mapInArrow(greedy, mine.schema)
    return events.where(F.col("event_type") != event_type).unionByName(kept)


def metered(usage: DataFrame, bumps: DataFrame) -> DataFrame:
    """usage (org, month, events, interventions, tokens) after bumps of the same columns, rows without a month among them."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("events", "interventions", "tokens")]
    columns = ["org", "month", "events", "interventions", "tokens"]
    return usage.select(*columns).unionByName(bumps.select(*columns)).groupBy("org", "month").agg(*sums)


def remapped(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A map (org, ...) after orgs were mapped anew: all old rows of the orgs in `new` go, its own come in, a key once."""
    return table.join(new.select("org").distinct(), "org", "left_anti").select(*new.columns).unionByName(new.dropDuplicates(["org", *key]))


def demo_events(spark, sessions: int = 8, start_ms: int = 0) -> DataFrame:
    """A session every five minutes that visits five routes; every third has a burst of four clicks, 250 ms apart."""
    rows = spark.range(sessions).select(F.concat(F.lit("demo"), "id").alias("session_id"), (F.lit(start_ms) + F.col("id") * 300_000).alias("at"), "id")
    visits = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(F.lit("NAVIGATION").alias("event_type"), F.concat(F.lit("/demo/"), i).alias("route"), (i * 10_000).cast("long").alias("after")))
    burst = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.lit("CLICK").alias("event_type"), F.lit("/demo/4").alias("route"), (F.lit(45_000) + i * 250).cast("long").alias("after")))
    rows = rows.select("session_id", "at", F.posexplode(F.when(F.col("id") % 3 == 0, F.concat(visits, burst)).otherwise(visits)).alias("seq", "e"))
    return rows.select("session_id", "e.event_type", "e.route", (F.col("at") + F.col("e.after")).alias("ms"), "seq", F.when(F.col("e.event_type") == "CLICK", "demo-button").alias("element_id"))


def recent_activity(events: DataFrame, as_of_ms: int, hour_ms: int) -> DataFrame:
    """events_hour, events_day, sessions_hour, sessions_day before as_of."""
    hour, day = F.col("ms") > as_of_ms - hour_ms, F.col("ms") > as_of_ms - 24 * hour_ms
    s = F.col("session_id")
    return events.agg(F.count_if(hour).alias("events_hour"), F.count_if(day).alias("events_day"), F.countDistinct(F.when(hour, s)).alias("sessions_hour"), F.countDistinct(F.when(day, s)).alias("sessions_day"))
