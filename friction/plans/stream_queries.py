"""Queries that run streams, keyed tables and states of days over the driver's tables, with their SQL: what comes of small
batches, some of them tried twice, is what the whole would give."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from friction.functions.tables import shared_dir, written
from friction.operators import baselines, ingest
from friction.plans import service_queries
from friction.plans.product_queries import SINCE, table
from friction.plans.rule_queries import ADAPTER, oracle_sql as rule_sql
from friction.sources.driver_events import HOUR, driver_events
from friction.sources.keyed_table import KeyedTable, added, owned
from friction.streaming import hot_path, outcomes, store
from friction.streaming.rage import timed

E = ADAPTER.format(div=HOUR)
#: Virtual milliseconds of a day of the states; SINCE begins one.
DAY = 10_000
KEPT = ("CLICK", "INPUT_CHANGE", "SUBMIT", "NAVIGATION", "HOVER", "DWELL", "CUSTOM")


def place(s, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keyed_usage(s, d):
    """Metering by month: an upsert for each year of orders, every second one tried twice."""
    o = table(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_custkey") % 7).alias("org"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.lit(1).alias("events"), F.when(F.col("o_orderstatus") == "F", 1).alias("interventions"), F.when(F.col("o_orderstatus") == "O", F.col("o_custkey") % 10).alias("tokens"), F.year("o_orderdate").alias("year"))
    counters = ["events", "interventions", "tokens"]
    t = KeyedTable(s, place(s, "usage"), "org string, month string, events long, interventions long, tokens long", ["org", "month"], 16)
    first, last = o.agg(F.min("year"), F.max("year")).first()
    for year in range(first, last + 1):
        for _ in range(1 + year % 2):
            t.apply(o.where(F.col("year") == year).drop("year"), year, added(["org", "month"], counters))
    t.vacuum()
    return t.read()


def keyed_remap(s, d):
    """A map of elements by org: suppliers first, then all orgs that have customers in some nations are mapped anew."""
    old = table(s, d, "supplier").select(F.concat(F.lit("o"), F.col("s_nationkey")).alias("org"), F.concat(F.lit("e"), "s_suppkey").alias("id"), F.col("s_name").alias("label"))
    new = table(s, d, "customer").where("c_nationkey < 10").select(F.concat(F.lit("o"), "c_nationkey").alias("org"), F.concat(F.lit("e"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("label"))
    t = KeyedTable(s, place(s, "map"), "org string, id string, label string", ["org"], 16)
    for version, rows in enumerate((old, new, new)):
        t.apply(rows, min(version, 1), owned(["org"], ["id"]))
    return t.read()


def stored_batches(s, d):
    """The store after five batches of events, each with a part of the one before it; the third is tried twice."""
    e = written(driver_events(s, d), "events")  # each batch reads its part of it
    first, last = e.agg(F.min("ms"), F.max("ms")).first()
    step, at = -(-(last + 1 - first) // 5), place(s, "events")
    for number in (0, 1, 2, 2, 3, 4):
        batch = e.where((F.col("ms") >= first + step * number - step // 4) & (F.col("ms") < first + step * (number + 1)))
        store.store_batch(batch, number, at, ["session_id", "seq"], ["ms"])
    return s.read.schema(e.schema).parquet(*[f"{at}/{store.PARTITION}={n}" for n in range(5)]).select("session_id", "event_type", "ms", "seq")


def daily(s, d):
    """Baselines of the days since a time, from the states of all days."""
    values, sessions = baselines.daily_states(driver_events(s, d), DAY)
    values, sessions = written(values, "values"), written(sessions, "sessions")
    return baselines.baselines_of_days(values, sessions, SINCE // DAY, 1 << 40)


def monthly_users(s, d):
    """Users of an org and month by merged sketches of three batches, beside the exact count: both rows, and whether they agree."""
    e = s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 5).alias("org"), F.date_format("ts", "yyyy-MM").alias("month"), "user_id", (F.col("event_id") % 3).alias("batch"))
    parts = ingest.user_sketches(e, [F.col("batch"), F.col("org"), F.col("month")], F.col("user_id"))
    merged = ingest.users_of_sketches(written(parts, "sketches"), ["org", "month"])
    exact = e.groupBy("org", "month").agg(F.countDistinct("user_id").alias("exact"))
    near = F.abs(F.col("mau") - F.col("exact")) <= F.greatest(F.lit(1), F.ceil(F.col("exact") * 0.05))
    return merged.join(exact, ["org", "month"]).select("org", "month", "events", "exact", near.alias("within_error"))


def observed(s, d):
    """Events accepted and duplicates, counted while the new ones are written."""
    e = driver_events(s, d)
    counts = ingest.store_counted(e, e.where("ms < 47340000").select("session_id", "route"), ["session_id", "route"], ["ms", "seq"], place(s, "accepted"))
    return s.range(1).select(*[F.lit(counts[c]).cast("long").alias(c) for c in ("accepted", "duplicates")])


def outcome_stream(s, d):
    """Counters after a stream of outcomes met the stream of interventions that were shown."""
    found, ledger = service_queries.outcome_parts(s, d)
    at = place(s, "outcomes")
    found.repartition(3).write.parquet(f"{at}/in/outcomes")
    ledger.withColumn("ms", F.lit(0).cast("long")).repartition(2).write.parquet(f"{at}/in/shown")
    stream = lambda name: s.readStream.schema(s.read.parquet(f"{at}/in/{name}").schema).parquet(f"{at}/in/{name}")
    joined = outcomes.resolved(stream("outcomes"), stream("shown"), "365 days", "365 days")
    outcomes.count_outcomes(joined, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return outcomes.counters_of(s, f"{at}/out", service_queries.interventions(s, d))


def hot_struggles(s, d):
    """The struggles that the hot path finds when all events arrive as one batch."""
    at = place(s, "hot")
    driver_events(s, d).coalesce(4).write.parquet(f"{at}/in")
    stream = timed(s.readStream.schema(s.read.parquet(f"{at}/in").schema).parquet(f"{at}/in"), "1 hour")
    stats = s.createDataFrame([], "row_id string, impressions long, successes long")
    hot_path.hot_path(stream, f"{at}/out", f"{at}/checkpoint", stats, safe_mode=False).awaitTermination()
    return s.read.schema(hot_path.STRUGGLES).parquet(f"{at}/out/struggles").drop("hot_batch")


def queries() -> dict:
    return {
        "keyed_usage": keyed_usage, "keyed_remap": keyed_remap, "stored_batches": stored_batches, "baselines_daily": daily,
        "monthly_users": monthly_users, "ingest_observed": observed, "outcome_stream": outcome_stream, "hot_path_struggles": hot_struggles,
    }


def oracle_sql() -> dict[str, str]:
    service = service_queries.oracle_sql()
    kept = ", ".join(f"'{t}'" for t in KEPT)
    return {
        "keyed_usage": """SELECT 'o' || (o_custkey % 7) AS org, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS events, count(*) FILTER (o_orderstatus = 'F') AS interventions,
            CAST(sum(CASE WHEN o_orderstatus = 'O' THEN o_custkey % 10 ELSE 0 END) AS BIGINT) AS tokens FROM orders GROUP BY 1, 2""",
        "keyed_remap": service["remapped"],
        "stored_batches": E + f" SELECT session_id, et AS event_type, ms, seq FROM e WHERE et IN ({kept})",
        "baselines_daily": service["baselines_since"],
        "monthly_users": "SELECT user_id % 5 AS org, strftime(ts, '%Y-%m') AS month, count(*) AS events, count(DISTINCT user_id) AS exact, true AS within_error FROM events GROUP BY 1, 2",
        "ingest_observed": E + f""" , kk AS (SELECT session_id, route, et IN ({kept}) AS fits, ms < 47340000 AS old FROM e)
            SELECT count(DISTINCT (session_id, route)) FILTER (NOT known) AS accepted, count(*) - count(DISTINCT (session_id, route)) FILTER (NOT known) AS duplicates
            FROM (SELECT *, bool_or(old) OVER (PARTITION BY session_id, route) AS known FROM kk) WHERE fits""",
        "outcome_stream": service["outcome_counters"],
        "hot_path_struggles": "SELECT session_id, element_id, type, severity, ts_ms FROM (" + rule_sql()["detect_all"] + ")",
    }
