"""What is usual for an element: upper percentiles of click rate, dwell and hovers before a click."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upper_percentile(values: DataFrame, key: str, value: str, p: float, name: str) -> DataFrame:
    """key and the value at index min(n - 1, floor(p n)) of each key's sorted values. Equal values meet before any sort."""
    counts = values.where(F.col(value).isNotNull()).groupBy(key, value).count()
    upto = Window.partitionBy(key).orderBy(value)
    counts = counts.select(key, value, F.sum("count").over(upto).alias("upto"), F.sum("count").over(Window.partitionBy(key)).alias("n"))
    rank = F.least(F.col("n"), F.floor(F.col("n") * F.lit(p)) + 1)
    return counts.where(F.col("upto") >= rank).groupBy(key).agg(F.min(value).cast("double").alias(name))


def baselines(events: DataFrame, least_events: int = 30, least_sessions: int = 3, p: float = 0.95, since_ms: int | None = None) -> DataFrame:
    """element_id, p95_clicks_per_sec, p95_dwell_ms, p95_hovers_before_click, sample_size (sessions) of elements with enough events.

    since_ms: only events from then on count (a look-back of fourteen days, say)."""
    e = events.where("element_id is not null")
    e = e if since_ms is None else e.where(F.col("ms") >= since_ms)
    sizes = e.groupBy("element_id").agg(F.count("*").alias("n"), F.countDistinct("session_id").cast("int").alias("sample_size"))
    sizes = sizes.where((F.col("n") >= least_events) & (F.col("sample_size") >= least_sessions)).drop("n")
    own = Window.partitionBy("session_id", "element_id")
    within = own.orderBy("ms").rangeBetween(0, 1000)
    clicks = e.where("event_type = 'CLICK'").select("element_id", (F.count("*").over(within) - (F.row_number().over(own.orderBy("ms", "seq")) - F.rank().over(own.orderBy("ms")))).alias("x"))
    dwell = e.where("event_type = 'DWELL' and m_ms > 0").select("element_id", F.col("m_ms").alias("x"))
    click = F.min(F.when(F.col("event_type") == "CLICK", F.struct("ms", "seq"))).over(own)
    hovers = e.withColumn("click", click).where("event_type = 'HOVER'").where(F.struct("ms", "seq") < F.col("click")).groupBy("session_id", "element_id").agg(F.count("*").alias("x"))
    out = sizes
    for values, name in ((clicks, "p95_clicks_per_sec"), (dwell, "p95_dwell_ms"), (hovers, "p95_hovers_before_click")):
        out = out.join(upper_percentile(values, "element_id", "x", p, name), "element_id", "left")
    return out.select("element_id", "p95_clicks_per_sec", "p95_dwell_ms", "p95_hovers_before_click", "sample_size")


def stored_baselines(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored baselines after a run: new ones win, those of elements that had too few events this time stay."""
    return stored.join(new.select("element_id"), "element_id", "left_anti").select(*new.columns).unionByName(new)


def daily_states(events: DataFrame, day_ms: int) -> tuple[DataFrame, DataFrame]:
    """What a day adds to the baselines, computed once and kept: counts of values (element_id, day, measure, x, n), and of each
    session the events, hovers, hovers before its first click and clicks (element_id, session_id, day, ...).

    A click at the end of a day counts those of the next second, so a day is final one second after it. Days add up: the
    states of any range of days hold what its events do."""
    e = events.where("element_id is not null").withColumn("day", F.floor(F.col("ms") / day_ms))
    own = Window.partitionBy("session_id", "element_id")
    within = own.orderBy("ms").rangeBetween(0, 1000)
    clicks = e.where("event_type = 'CLICK'").select("element_id", "day", F.lit("clicks").alias("measure"), (F.count("*").over(within) - (F.row_number().over(own.orderBy("ms", "seq")) - F.rank().over(own.orderBy("ms")))).cast("double").alias("x"))
    dwell = e.where("event_type = 'DWELL' and m_ms > 0").select("element_id", "day", F.lit("dwell"), F.col("m_ms"))
    values = clicks.union(dwell).groupBy("element_id", "day", "measure", "x").agg(F.count("*").alias("n"))
    at = F.struct("ms", "seq")
    click = F.min(F.when(F.col("event_type") == "CLICK", at)).over(Window.partitionBy("session_id", "element_id", "day"))
    hover = F.col("event_type") == "HOVER"
    sessions = e.withColumn("click", click).groupBy("element_id", "session_id", "day").agg(
        F.count("*").alias("n"), F.count_if(hover).alias("hovers"), F.count_if(hover & (at < F.col("click"))).alias("before"), F.count_if(F.col("event_type") == "CLICK").alias("clicks")
    )
    return values, sessions


def baselines_of_days(values: DataFrame, sessions: DataFrame, first: int, last: int, least_events: int = 30, least_sessions: int = 3, p: float = 0.95) -> DataFrame:
    """baselines() of the events of the days first to last, from their states alone.

    Hovers before a session's first click are all of its days without one, and those before it on the day that has it."""
    values, sessions = (t.where(F.col("day").between(first, last)) for t in (values, sessions))
    sizes = sessions.groupBy("element_id").agg(F.sum("n").alias("n"), F.countDistinct("session_id").cast("int").alias("sample_size"))
    sizes = sizes.where((F.col("n") >= least_events) & (F.col("sample_size") >= least_sessions)).drop("n")
    clicked = F.min(F.when(F.col("clicks") > 0, F.col("day"))).over(Window.partitionBy("element_id", "session_id"))
    hovers = sessions.withColumn("clicked", clicked).where("clicked is not null")
    mine = F.when(F.col("day") < F.col("clicked"), F.col("hovers")).when(F.col("day") == F.col("clicked"), F.col("before"))
    hovers = hovers.groupBy("element_id", "session_id").agg(F.sum(mine).alias("x")).where("x > 0").groupBy("element_id", "x").agg(F.count("*").alias("n"))
    out = sizes
    parts = [(values.where("measure = 'clicks'"), "p95_clicks_per_sec"), (values.where("measure = 'dwell'"), "p95_dwell_ms"), (hovers, "p95_hovers_before_click")]
    for counts, name in parts:
        counts = counts.groupBy("element_id", "x").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("element_id").orderBy("x"))
        counts = counts.select("element_id", "x", upto.alias("upto"), F.sum("n").over(Window.partitionBy("element_id")).alias("n"))
        rank = F.least(F.col("n"), F.floor(F.col("n") * F.lit(p)) + 1)
        out = out.join(counts.where(F.col("upto") >= rank).groupBy("element_id").agg(F.min("x").cast("double").alias(name)), "element_id", "left")
    return out.select("element_id", "p95_clicks_per_sec", "p95_dwell_ms", "p95_hovers_before_click", "sample_size")
