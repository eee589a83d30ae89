"""The rollups of the dashboard. Ties are broken by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def friction_table(detections: DataFrame, since_ms: int | None = None, limit: int = 100) -> DataFrame:
    """element_id, type, n, avg_severity, last_ms: the most frequent pairs; pairs without element count as none."""
    d = detections if since_ms is None else detections.where(F.col("ts_ms") >= since_ms)
    g = d.groupBy("element_id", "type").agg(F.count("*").alias("n"), F.round(F.avg("severity"), 6).alias("avg_severity"), F.max("ts_ms").alias("last_ms"), F.count("element_id").alias("known"))
    return g.orderBy(F.desc("known"), F.asc_nulls_last("element_id"), "type").limit(limit).drop("known")


def type_counts(detections: DataFrame) -> DataFrame:
    g = detections.groupBy("type").agg(F.count("*").alias("n"))
    return g.select("type", "n", F.sum("n").over(Window.partitionBy()).alias("total"))


def flow_map(events: DataFrame) -> DataFrame:
    """from_route, to_route, n: moves between different routes in consecutive navigations of a session."""
    w = Window.partitionBy("session_id").orderBy("ms", "seq")
    nav = events.where("event_type = 'NAVIGATION'").select(F.col("route").alias("from_route"), F.lead("route").over(w).alias("to_route"))
    return nav.where("from_route <> to_route").groupBy("from_route", "to_route").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, detections: DataFrame, limit: int = 50) -> DataFrame:
    """session_id, events, first_ms, last_ms, struggles: the sessions seen last."""
    e = events.groupBy("session_id").agg(F.count("*").alias("events"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    e = e.orderBy(F.desc("last_ms"), "session_id").limit(limit)
    d = detections.groupBy("session_id").agg(F.count("*").alias("struggles"))
    return e.join(d, "session_id", "left").withColumn("struggles", F.coalesce("struggles", F.lit(0).cast("long")))


def top_struggle(detections: DataFrame) -> DataFrame:
    """element_id, type, n: each element's most frequent type."""
    g = detections.where("element_id is not null").groupBy("element_id", "type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("element_id").orderBy(F.desc("n"), "type")
    return g.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def leaderboard(interventions: DataFrame, warm: int = 30, limit: int = 5) -> DataFrame:
    """label, type, winner, loser, margin of groups with two warm variants (row_id, label, type, impressions, successes)."""
    rate = F.col("successes") / F.col("impressions")
    g = interventions.where(F.col("impressions") >= warm).withColumn("rate", rate)
    order = F.struct("rate", "row_id")
    g = g.groupBy("label", "type").agg(F.count("*").alias("n"), F.max_by("row_id", order).alias("winner"), F.min_by("row_id", order).alias("loser"), F.round(F.max("rate") - F.min("rate"), 6).alias("margin"))
    return g.where("n >= 2").drop("n").orderBy(F.desc("margin"), "label", "type").limit(limit)


def activity(events: DataFrame, as_of_ms: int, day_ms: int) -> DataFrame:
    """sessions and events of the last day before as_of, all events, and how alive the source is."""
    day = F.col("ms") > as_of_ms - day_ms
    return events.agg(
        F.countDistinct(F.when(day, F.col("session_id"))).alias("sessions"), F.count_if(day).alias("events"), F.count("*").alias("all_events"),
        F.when(as_of_ms - F.max("ms") < day_ms / 720, "connected").when(as_of_ms - F.max("ms") < day_ms, "idle").otherwise("disconnected").alias("state"),
    )


def totals(events: DataFrame, detections: DataFrame, elements: DataFrame, described: DataFrame, since_ms: int) -> DataFrame:
    """events, struggles_today, struggles, elements, described: one row. An element is described once, however often."""
    known = elements.select("element_id").distinct()
    parts = [
        events.agg(F.count("*").alias("events")),
        detections.agg(F.count_if(F.col("ts_ms") >= since_ms).alias("struggles_today"), F.count("*").alias("struggles")),
        known.agg(F.count("*").alias("elements")),
        known.join(described.select("element_id"), "element_id", "left_semi").agg(F.count("*").alias("described")),
    ]
    rows = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:  # single rows each
        rows = rows.join(p.withColumn("one", F.lit(1)), "one")
    return rows.drop("one")


def latest(rows: DataFrame, labels: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """The last rows by time with the label and route of their element (labels: element_id, label, route)."""
    keys = [c for c in ("session_id", "element_id", "type") if c in rows.columns]
    return rows.orderBy(F.desc(by), *[F.asc_nulls_last(k) for k in keys]).limit(limit).join(labels.select("element_id", "label", "route"), "element_id", "left")


def top_element(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """element_id, n, label of the element with most detections; those without element count as none."""
    g = detections.groupBy("element_id").agg(F.count("element_id").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("element_id")).limit(1)
    return g.join(labels.select("element_id", "label"), "element_id", "left")


def session_detail(events: DataFrame, labels: DataFrame, session: str, limit: int = 500) -> DataFrame:
    """The first events of one session in order, with labels."""
    e = events.where(F.col("session_id") == session).orderBy("ms", "seq").limit(limit).select("ms", "seq", "event_type", "route", "element_id")
    return e.join(labels.select("element_id", "label"), "element_id", "left")


def element_detail(detections: DataFrame, element: str, last: int = 25, top: int = 5) -> DataFrame:
    """type, n, sessions: the most frequent types among the last detections of an element, and the sessions of all of these."""
    d = detections.where(F.col("element_id") == element).orderBy(F.desc("ts_ms"), "session_id", "type").limit(last)
    d = d.withColumn("sessions", F.size(F.collect_set("session_id").over(Window.partitionBy())).cast("long"))  # over `last` rows
    return d.groupBy("type", "sessions").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(top)


def variant_performance(interventions: DataFrame, warm: int = 30) -> DataFrame:
    """label, type, variants, shown, winner of groups with several variants: the best warm one, or the best of all if none is."""
    rate = F.when(F.col("impressions") > 0, F.col("successes") / F.col("impressions")).otherwise(F.lit(0.0))
    order = F.struct((F.col("impressions") >= warm).alias("warm"), rate.alias("rate"), "row_id")
    g = interventions.groupBy("label", "type").agg(F.count("*").alias("variants"), F.sum("impressions").alias("shown"), F.max_by("row_id", order).alias("winner"))
    return g.where("variants > 1")


def recent_usage(usage: DataFrame, months: int = 6) -> DataFrame:
    """The last months of metering, newest first."""
    return usage.orderBy(F.desc("month")).limit(months)


def ready_orgs(keys: DataFrame, described: DataFrame) -> DataFrame:
    """org: those with a key and with at least one described element."""
    return keys.select("org").distinct().join(described.select("org"), "org", "left_semi")


#: Copy of an intervention that has none of its own, by how it works.
NO_COPY = {"DOM": "(DOM mutation)", "BEHAVIOR": "(behavior override)", "AUTO_FIX": "(auto-fix)"}


def top_types(detections: DataFrame, since_ms: int, limit: int = 5) -> DataFrame:
    """type, n: the most frequent types since a time."""
    return detections.where(F.col("ts_ms") >= since_ms).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(limit)


def filtered_friction(detections: DataFrame, labels: DataFrame, kind: str | None, since_ms: int, limit: int = 100) -> DataFrame:
    """friction_table() of one type (None: of all) since a time, with label and route of the element."""
    d = detections if kind is None else detections.where(F.col("type") == kind)
    return friction_table(d, since_ms, limit).join(labels.select("element_id", "label", "route"), "element_id", "left")


def flow_nodes(events: DataFrame, oldest: int | None = None) -> DataFrame:
    """route, node: routes of all navigations (oldest: of so many of the first), numbered as they first appear in a move to
    another route. The numbers are given in one task, to one row a route: routes are patterns, and stay few."""
    nav = events.where("event_type = 'NAVIGATION'")
    nav = nav if oldest is None else nav.orderBy("ms", "seq").limit(oldest)
    w = Window.partitionBy("session_id").orderBy("ms", "seq")
    moves = nav.select("session_id", "ms", "seq", "route", F.lead("route").over(w).alias("next")).where("route <> next")
    ends = moves.select("session_id", "ms", "seq", F.posexplode(F.array("route", "next")).alias("end", "route"))
    first = ends.groupBy("route").agg(F.min(F.struct("session_id", "ms", "seq", "end")).alias("first"))
    return first.select("route", (F.row_number().over(Window.orderBy("first")) - F.lit(1)).alias("node"))  # as many rows as routes


def interventions(rows: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """row_id, label, kind, copy, enabled, impressions, successes, dismissals, success_rate, created: interventions, newest
    first, with a copy that stands for how they work where they have none."""
    copy = F.coalesce("copy", F.create_map(*[F.lit(x) for kv in NO_COPY.items() for x in kv])[F.col("kind")], F.lit(""))
    out = rows.join(labels.select("element_id", "label"), "element_id").select("row_id", "label", "kind", copy.alias("copy"), "enabled", "impressions", "successes", "dismissals", "success_rate", "created")
    return out if limit is None else out.orderBy(F.desc("created"), "row_id").limit(limit)


def toggled(rows: DataFrame, row_id: str, enabled: bool) -> DataFrame:
    """Interventions with one of them turned on or off."""
    return rows.withColumn("enabled", F.when(F.col("row_id") == row_id, F.lit(enabled)).otherwise(F.col("enabled")))


def revoked(keys: DataFrame, org: str, key_hash: str, now) -> DataFrame:
    """Keys with one of an org revoked; one that is revoked keeps its time."""
    mine = (F.col("org") == org) & (F.col("key_hash") == key_hash) & F.col("revoked_at").isNull()
    return keys.withColumn("revoked_at", F.when(mine, now).otherwise(F.col("revoked_at")))


def keys_of(keys: DataFrame, org: str) -> DataFrame:
    """The keys of an org as they are listed: prefix, created_at, revoked_at, newest first."""
    return keys.where(F.col("org") == org).select("prefix", "created_at", "revoked_at").orderBy(F.desc("created_at"), "prefix")


def checklist(orgs: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """org (orgs: org, platform_name, safe_mode) and what is left to set up: named, safe_mode_off, and for each table of counts
    (org, ...) whether the org has a row in it."""
    out = orgs.select("org", (F.trim(F.coalesce("platform_name", F.lit(""))) != "").alias("named"), (~F.coalesce("safe_mode", F.lit(True))).alias("safe_mode_off"))
    for name, table in counts.items():
        out = out.join(table.select("org").distinct().withColumn(name, F.lit(True)), "org", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def newest_frameworks(found: DataFrame, limit: int = 20) -> DataFrame:
    """The frameworks that were detected last (detected_at)."""
    return found.orderBy(F.desc("detected_at"), "repo", "framework").limit(limit)


def session_struggles(detections: DataFrame, session: str) -> DataFrame:
    """All detections of one session in order."""
    return detections.where(F.col("session_id") == session).orderBy("ts_ms", "type", F.asc_nulls_last("element_id"))


def element_page(element: str, interventions: DataFrame, events: DataFrame, cache: DataFrame, last: int = 20) -> dict[str, DataFrame]:
    """The other tables of an element's page: its interventions by success rate, its cached variants and its last events."""
    mine = lambda t: t.where(F.col("element_id") == element)
    return {
        "interventions": mine(interventions).orderBy(F.desc("success_rate"), "row_id"),
        "cache": mine(cache).orderBy("type", "variant_index"),
        "events": mine(events).orderBy(F.desc("ms"), F.desc("seq")).limit(last),
    }


def active_interventions(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("enabled").alias("active"), F.count("*").alias("interventions"))


def description_counts(elements: DataFrame, described: DataFrame) -> DataFrame:
    """described, undescribed: elements (element_id) with and without a description."""
    known = elements.select("element_id").distinct().join(described.select("element_id").distinct().withColumn("has", F.lit(True)), "element_id", "left")
    return known.agg(F.count("has").alias("described"), F.count_if(F.col("has").isNull()).alias("undescribed"))


def described_elements(elements: DataFrame, semantics: DataFrame) -> DataFrame:
    """elements (element_id, ...) with what their latest description says (intent, semantic_name, enriched_at), null without one;
    described ones first, the newest description first."""
    last = semantics.groupBy("element_id").agg(F.max(F.struct("enriched_at", "intent", "semantic_name")).alias("s"))
    out = elements.join(last, "element_id", "left").select(*elements.columns, "s.enriched_at", "s.intent", "s.semantic_name")
    return out.orderBy(F.desc_nulls_last("enriched_at"), "element_id")
