"""The `events` star-schema table as interaction events: a deterministic mapping in virtual time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from friction.schema import EVENT_COLUMNS

HOUR = 36_000_000


def driver_events(spark: SparkSession, sf_dir: str, time_div: int = HOUR, crowd: int | None = None) -> DataFrame:
    """EVENT_COLUMNS of the driver's events. time_div: microseconds in a virtual millisecond. crowd: users that share a
    session, which makes it dense; every other crowd signs up in a session of its own."""
    k, kind = F.col("k"), F.col("event_type")
    session = F.concat(F.lit("s"), F.col("user_id"))
    if crowd:
        group = F.floor(F.col("user_id") / crowd)
        session = F.concat(F.lit("s"), group, F.when((F.col("event_type") == "signup") & (group % 2 == 1), "n").otherwise(""))
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"), session.alias("session_id"), F.col("event_type").alias("kind"), "value",
        F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / F.lit(time_div)).alias("ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    signup = F.element_at(F.array(*[F.lit(x) for x in ("INPUT_CHANGE", "HOVER", "SCROLL", "FOCUS", "BLUR", "PASTE", "COPY", "DWELL", "INPUT_CHANGE", "HOVER")]), k % 10 + 1)
    of = F.col("kind")
    typed = F.when(of == "click", "CLICK").when(of == "view", "NAVIGATION").when(of == "purchase", "SUBMIT").when((of == "error") & (k % 2 == 0), "JS_ERROR").when(of == "error", "VALIDATION_ERROR").otherwise(signup)
    e = raw.withColumn("event_type", typed)
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), k % n + 1)
    submit, click = kind == "SUBMIT", kind == "CLICK"
    value = {
        "element_id": F.when(k % 10 != 9, F.concat(F.lit("e"), k % 3)),
        "route": F.when(k % 16 == 0, F.lit("/404")).otherwise(F.concat(F.lit("/r"), k % 4)),
        "m_disabled": F.when(click, k % 7 == 0),
        "m_dead": F.when(click, k % 7 == 1),
        "m_role": F.when(click, pick(5, None, "menu", "dismiss", "retry", "help")),
        "m_kind": F.when(submit, pick(4, "search", "filter", "login", "checkout")).when(kind == "VALIDATION_ERROR", pick(3, "login", "format", "required")),
        "m_empty": F.when(submit, k % 6 == 0),
        "m_results": F.when(submit, k % 3),
        "m_query": F.when(submit, F.concat(F.lit("q"), k % 2)),
        "el_form_valid": F.when(submit, k % 5 != 0),
        "m_trigger": F.when(kind == "NAVIGATION", pick(3, "popstate", "pushstate", "initial")),
        "m_ms": F.when(kind == "DWELL", k * 1000),
        "m_tooltip": F.when(kind == "HOVER", k % 4 == 1),
        "m_length": F.when(kind == "INPUT_CHANGE", F.floor("value")),
        "m_dy": F.when(kind == "SCROLL", F.floor("value") - 120),
        "m_target": F.when(kind.isin("FOCUS", "BLUR") & (F.floor(k / 10) % 2 == 0), "window"),
    }
    return e.select(*[value.get(c, F.col(c) if c in ("session_id", "event_type", "ms", "seq") else F.lit(None)).cast(t).alias(c) for c, t in EVENT_COLUMNS.items()])
