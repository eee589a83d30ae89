"""From detections to interventions: variant choice, confidence and the outcome loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.functions.ids import pick_variant, row_id, tracking_id

#: Confidence of the types whose rule is more reliable than DEFAULT_CONFIDENCE.
CONFIDENCE = {"JS_ERROR": 0.95, "LOCKED_OUT": 0.9, "SILENT_FAIL": 0.85, "NOT_FOUND_BOUNCE": 0.85, "LOGIN_FAILURE": 0.85, "REQUIRED_MISSED": 0.8, "FORMAT_ERROR": 0.8, "VALIDATION_LOOP": 0.8, "DEAD_CLICK": 0.8, "INVALID_CLICK": 0.8}
DEFAULT_CONFIDENCE = 0.6
#: Chance to explore, and impressions of a group before its scores count.
EPSILON, WARM = 0.1, 30
DESTRUCTIVE, CAUTIOUS = ("DANGER", "DELETE", "LOGOUT"), ("RAGE_CLICK", "LONG_DWELL", "HOVER_HUNT")


def confidence(kind, severity):
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[kind], F.lit(DEFAULT_CONFIDENCE))
    return F.least(F.lit(0.99), base * F.lit(0.6) + F.least(F.lit(1.0), severity) * F.lit(0.4))


def choose(detections: DataFrame, stats: DataFrame, variants: int, epsilon: float = EPSILON, warm: int = WARM, seed: int = 0) -> DataFrame:
    """detections with variant_index, row_id, tracking_id and confidence.

    stats: row_id, impressions, successes. A group with fewer than `warm` impressions keeps the session's own pick; others
    explore with probability epsilon (drawn from a hash, so reruns agree), else take the best (s + 1) / (i + 2), the
    first of equals. Scores are computed once for each (type, element), not for each detection."""
    pairs = detections.select("type", "element_id").distinct().withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    scored = pairs.withColumn("row_id", row_id(F.col("type"), F.col("element_id"), F.col("v").cast("string"))).join(stats, "row_id", "left")
    i, s = F.coalesce("impressions", F.lit(0)), F.coalesce("successes", F.lit(0))
    best = scored.groupBy("type", "element_id").agg(F.sum(i).alias("shown"), F.max_by("v", F.struct((s + 1) / (i + 2), -F.col("v"))).alias("best"))
    d = detections.join(best.withColumnRenamed("type", "t").withColumnRenamed("element_id", "el"), (F.col("type") == F.col("t")) & F.col("element_id").eqNullSafe(F.col("el"))).drop("t", "el")
    u = lambda salt: F.conv(F.substring(F.sha2(F.concat_ws("|", "session_id", "type", F.lit(seed), F.lit(salt)), 256), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    own = pick_variant(F.col("session_id"), F.col("type"), F.lit(variants)).cast("int")
    pick = F.when(F.lit(variants) <= 1, F.lit(0)).when(F.col("shown") < warm, own).when(u("explore") < epsilon, F.floor(u("which") * variants).cast("int")).otherwise(F.col("best"))
    d = d.withColumn("variant_index", pick)
    v = F.col("variant_index").cast("string")
    return d.select(
        "session_id", "element_id", "type", "severity", "ts_ms", "variant_index",
        row_id(F.col("type"), F.col("element_id"), v).alias("row_id"), tracking_id(F.col("session_id"), F.col("type"), F.col("element_id"), v).alias("tracking_id"),
        confidence(F.col("type"), F.col("severity")).alias("confidence"),
    )


def dispatch(chosen: DataFrame, last_routes: DataFrame, denied: list[str] = (), roles: DataFrame | None = None, paused: DataFrame | None = None, shown: DataFrame | None = None, safe_mode: bool = True) -> DataFrame:
    """The interventions that may be shown: none in safe mode, which is on unless it is turned off, on a denied last route, twice, paused or already shown.

    A destructive element (roles: element_id, role) gets a confirmation (variant -1) for types that suggest haste, under ids of
    its own: whatever variants were chosen before, a session sees it once, and it counts for no other variant."""
    if safe_mode:
        return chosen.limit(0).withColumn("confirm", F.lit(False))
    out = chosen.join(last_routes.where(F.col("route").isin(list(denied))), "session_id", "left_anti") if denied else chosen
    confirm = F.lit(False)
    if roles is not None:
        out = out.join(roles.select(F.col("element_id").alias("of"), "role"), F.col("element_id") == F.col("of"), "left")
        confirm = F.coalesce(F.col("role").isin(*DESTRUCTIVE) & F.col("type").isin(*CAUTIOUS), F.lit(False))
    out = out.withColumn("confirm", confirm).withColumn("variant_index", F.when(F.col("confirm"), -1).otherwise(F.col("variant_index"))).drop("of", "role")
    own = {"row_id": row_id(F.col("type"), F.col("element_id"), F.lit("-1")), "tracking_id": tracking_id(F.col("session_id"), F.col("type"), F.col("element_id"), F.lit("-1"))}
    out = out.withColumns({k: F.when(F.col("confirm"), v).otherwise(F.col(k)) for k, v in own.items()}) if roles is not None else out
    # what may not be shown goes first: ids have 32 bits, and what shares one with it may still be shown
    for table, key in ((paused, "row_id"), (shown, "tracking_id")):
        if table is not None:
            out = out.join(table.select(key), key, "left_anti")
    first = Window.partitionBy("tracking_id").orderBy("ts_ms")
    return out.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def last_routes(events: DataFrame) -> DataFrame:
    """session_id, route: of the last navigation by arrival, else of the first event."""
    nav = F.col("event_type") == "NAVIGATION"
    return events.groupBy("session_id").agg(F.coalesce(F.max_by(F.when(nav, F.col("route")), F.when(nav, F.col("seq"))), F.min_by("route", "seq")).alias("route"))


#: What an outcome is recorded as, and which counter it adds to.
OUTCOMES = {"intervention_shown": ("ABANDON", "impressions"), "intervention_success": ("SUCCESS", "successes"), "intervention_dismissed": ("DISMISSED", "dismissals")}


def outcome_events(events: DataFrame) -> DataFrame:
    """session_id, tracking_id, kind, ms of the CUSTOM events (m_kind, m_iid) that report what became of an intervention."""
    rows = events.where((F.col("event_type") == "CUSTOM") & F.col("m_kind").isin(*OUTCOMES) & F.col("m_iid").isNotNull())
    return rows.select("session_id", F.col("m_iid").alias("tracking_id"), F.col("m_kind").alias("kind"), "ms")


def impressions(outcomes: DataFrame, ledger: DataFrame) -> DataFrame:
    """row_id, session_id, outcome, ms: a row for each outcome (of outcome_events()) that the ledger (tracking_id, row_id) knows."""
    recorded = F.create_map(*[F.lit(x) for k, (o, _) in OUTCOMES.items() for x in (k, o)])
    return outcomes.join(ledger.select("tracking_id", "row_id"), "tracking_id").select("row_id", "session_id", recorded[F.col("kind")].alias("outcome"), "ms")


def counters(stats: DataFrame, outcomes: DataFrame, ledger: DataFrame) -> DataFrame:
    """stats (row_id, impressions, successes, dismissals) with what outcomes add to stored rows, and their success rate."""
    known = outcomes.join(ledger.select("tracking_id", "row_id"), "tracking_id")
    added = known.groupBy("row_id").agg(*[F.count_if(F.col("kind") == k).alias(f"more_{c}") for k, (_, c) in OUTCOMES.items()])
    out = stats.join(added, "row_id", "left")
    total = {c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for _, c in OUTCOMES.values()}
    out = out.select("row_id", *[total[c] for c in ("impressions", "successes", "dismissals")])
    return out.withColumn("success_rate", F.when(F.col("impressions") > 0, F.col("successes") / F.col("impressions")).otherwise(F.lit(0.0)))


def last_titles(events: DataFrame) -> DataFrame:
    """session_id, title: the last page title (page_title) by arrival that is not empty."""
    return events.where("page_title <> ''").groupBy("session_id").agg(F.max_by("page_title", "seq").alias("title"))


def latest_semantics(semantics: DataFrame) -> DataFrame:
    """element_id, intent, ...: of each element the description that was made last (enriched_at), of equals the larger."""
    rest = [c for c in semantics.columns if c not in ("element_id", "enriched_at")]
    return semantics.groupBy("element_id").agg(F.max(F.struct("enriched_at", *rest)).alias("s")).select("element_id", *[f"s.{c}" for c in rest])


def with_context(chosen: DataFrame, elements: DataFrame, semantics: DataFrame, routes: DataFrame, last: DataFrame, titles: DataFrame) -> DataFrame:
    """chosen with what its copy can speak of: label (the element's latest semantic_name, else its own), role, validation
    (elements), intent and help_copy (the latest of semantics), route (last: of last_routes()), page_title (titles: of
    last_titles(), else that of the route), route_purpose and journey_stage (routes: route, title, purpose, stage), which are
    known together or not at all. Each side has one row a key, so no row is doubled."""
    out = chosen.join(elements.select("element_id", F.col("label").alias("own_label"), "role", "validation"), "element_id", "left")
    out = out.join(latest_semantics(semantics).select("element_id", "intent", "semantic_name", "help_copy"), "element_id", "left")
    out = out.join(last, "session_id", "left").join(titles, "session_id", "left")
    said = lambda c: F.when((F.coalesce("purpose", F.lit("")) != "") & (F.coalesce("stage", F.lit("")) != ""), F.col(c))
    out = out.join(routes.select("route", F.col("title").alias("route_title"), said("purpose").alias("route_purpose"), said("stage").alias("journey_stage")), "route", "left")
    label, title = F.coalesce("semantic_name", "own_label").alias("label"), F.coalesce("title", "route_title").alias("page_title")
    return out.select(*chosen.columns, label, "role", "validation", "intent", "help_copy", "route", title, "route_purpose", "journey_stage")


def with_cached(chosen: DataFrame, cached: DataFrame) -> DataFrame:
    """chosen with the confidence that a cached variant (element_id, type, variant_index, confidence, help_copy) states, between
    0 and 0.99, else its own, and `cached_help`. A confirmation (variant -1) is no cached variant."""
    own = cached.select(F.col("element_id").alias("of"), F.col("type").alias("of_type"), F.col("variant_index").alias("of_variant"), F.col("confidence").alias("stated"), F.col("help_copy").alias("cached_help"))
    same = (F.col("element_id") == F.col("of")) & (F.col("type") == F.col("of_type")) & (F.col("variant_index") == F.col("of_variant"))
    out = chosen.join(own, same, "left")
    stated = F.when(F.col("stated").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.col("stated"))))
    return out.withColumn("confidence", F.coalesce(stated, "confidence")).select(*chosen.columns, "cached_help")


def with_options(chosen: DataFrame, templates: DataFrame) -> DataFrame:
    """chosen with `options` (target, severity) of the template (type, variant_index, target, severity_opt, auto_dismiss_ms),
    null if it has neither, and auto_dismiss_ms, 0 unless it says otherwise. A confirmation (variant -1) has no template."""
    t = templates.select("type", "variant_index", "target", "severity_opt", "auto_dismiss_ms")
    out = chosen.join(t, ["type", "variant_index"], "left")
    options = F.when(F.col("target").isNotNull() | F.col("severity_opt").isNotNull(), F.struct("target", F.col("severity_opt").alias("severity")))
    return out.select(*chosen.columns, options.alias("options"), F.coalesce("auto_dismiss_ms", F.lit(0)).alias("auto_dismiss_ms"))
