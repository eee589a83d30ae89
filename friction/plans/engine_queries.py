"""Queries over the rest of the engine on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from friction.functions.ids import java_hash, row_id, tracking_id
from friction.functions.scrub import PATTERNS, scrub
from friction.functions.tables import written
from friction.operators import dashboard, html_map, ingest
from friction.operators.baselines import baselines
from friction.operators.detect import detect
from friction.operators.dispatch import EPSILON, choose, dispatch, last_routes
from friction.plans.rule_queries import ADAPTER, CROWD, DENSE, DENSE_ADAPTER, all_sql, dedup, oracle_sql as rule_sql
from friction.sources.driver_events import HOUR, driver_events

VARIANTS = 3


def found(spark, sf):
    return detect(driver_events(spark, sf))


def stats_of(detections):
    """Impressions and successes of every variant, made up from its place: enough for both branches of the choice."""
    pairs = detections.select("type", "element_id").distinct().withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    n = F.length("type") + F.coalesce(F.length("element_id"), F.lit(0))
    return pairs.select("type", "element_id", row_id(F.col("type"), F.col("element_id"), F.col("v").cast("string")).alias("row_id"), (n * 2 + F.col("v")).cast("long").alias("impressions"), (n * (F.col("v") % 2) + 3 * F.col("v")).cast("long").alias("successes"))


def chosen(spark, sf, epsilon=0.0):
    d = written(found(spark, sf), "detections")  # read for the choice, its pairs and their stats
    return choose(d, stats_of(d).drop("type", "element_id"), VARIANTS, epsilon=epsilon)


def adaptive(events):
    return detect(events, baselines=baselines(events))


def queries() -> dict:
    e = driver_events
    return {
        "friction_table": lambda s, d: dashboard.friction_table(found(s, d)),
        "type_counts": lambda s, d: dashboard.type_counts(found(s, d)),
        "flow_map": lambda s, d: dashboard.flow_map(e(s, d)),
        "sessions_list": lambda s, d: dashboard.sessions(e(s, d), found(s, d)),
        "top_struggle": lambda s, d: dashboard.top_struggle(found(s, d)),
        "activity": lambda s, d: dashboard.activity(e(s, d), int(1.7064e15 // HOUR), int(8.64e10 // HOUR)),
        "leaderboard": lambda s, d: dashboard.leaderboard(stats_of(found(s, d)).select("row_id", F.coalesce("element_id", F.lit("none")).alias("label"), "type", "impressions", "successes")),
        "baselines": lambda s, d: baselines(e(s, d)),
        "detect_adaptive": lambda s, d: adaptive(e(s, d)),
        "detect_adaptive_dense": lambda s, d: adaptive(e(s, d, DENSE, CROWD)),
        "choose_variant": chosen,
        "choose_variant_exploring": lambda s, d: chosen(s, d, EPSILON),
        "dispatch": lambda s, d: dispatch(chosen(s, d), last_routes(e(s, d)), denied=["/404"], safe_mode=False).select("tracking_id", "session_id", "type", "variant_index"),
        "last_routes": lambda s, d: last_routes(e(s, d)),
        "usage": lambda s, d: ingest.usage(s.read.parquet(f"{d}/events.parquet"), F.date_format("ts", "yyyy-MM"), F.col("user_id")),
        "store_once": lambda s, d: ingest.new_rows(ingest.first_by_key(ingest.storable(e(s, d)), ["session_id", "route"], ["ms", "seq"]), e(s, d).where("ms < 47340000"), ["session_id", "route"]).select("session_id", "route", "event_type", "ms", "seq"),
        "history": lambda s, d: ingest.history(e(s, d).where("ms >= 47390000"), e(s, d), ["seq"], 47_380_000).select("session_id", "ms", "seq"),
        "element_map": lambda s, d: html_map.elements(s.read.parquet(f"{d}/pages.parquet")).select("page_id", "tag", "tag_index", "href", "label", "element_id"),
        "page_metadata": lambda s, d: html_map.metadata(s.read.parquet(f"{d}/pages.parquet")).select("page_id", F.size("sections").alias("sections"), "spa_shell"),
        "scrub": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", scrub(F.col("text")).alias("scrubbed")),
        "java_hash": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", java_hash(F.col("c_name")).alias("h"), tracking_id(F.col("c_name"), F.lit("LOOP"), F.lit(None).cast("string"), F.lit("0")).alias("tracking_id")),
    }


E = ADAPTER.format(div=HOUR)
HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(regexp_extract_all({s}, '.'), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296)"


def hashed(s: str) -> str:
    h = HASH.format(s=s)
    return f"(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END)"


def named(s: str) -> str:
    x = f"lower(to_hex(abs({hashed(s)})))"
    return f"'iv_' || rpad(substr({x} || {x}, 1, 16), 16, '0')"


def oracle_sql() -> dict[str, str]:
    f = rule_sql()["detect_all"]
    body = f[len(E) :]
    d = E + ", d AS (" + body + ")"
    stats = d + f""", p AS (SELECT DISTINCT type, element_id FROM d), st AS (SELECT type, element_id, v, {named("type || '|' || coalesce(element_id, '_') || '|v' || v")} AS row_id,
        (length(type) + coalesce(length(element_id), 0)) * 2 + v AS impressions, (length(type) + coalesce(length(element_id), 0)) * (v % 2) + 3 * v AS successes FROM p, range({VARIANTS}) r(v))"""
    conf = "CASE WHEN type = 'JS_ERROR' THEN 0.95 WHEN type = 'LOCKED_OUT' THEN 0.9 WHEN type IN ('SILENT_FAIL','NOT_FOUND_BOUNCE','LOGIN_FAILURE') THEN 0.85 WHEN type IN ('REQUIRED_MISSED','FORMAT_ERROR','VALIDATION_LOOP','DEAD_CLICK','INVALID_CLICK') THEN 0.8 ELSE 0.6 END"
    choice = stats + f""", b AS (SELECT type, element_id, sum(impressions) AS shown, arg_max(v, ((successes + 1) / (impressions + 2), -v)) AS best FROM st GROUP BY 1, 2),
      c AS (SELECT d.*, CAST(CASE WHEN shown < 30 THEN abs({hashed("session_id || ':' || d.type")}) % {VARIANTS} ELSE best END AS INTEGER) AS variant_index FROM d JOIN b ON d.type = b.type AND d.element_id IS NOT DISTINCT FROM b.element_id),
      ch AS (SELECT *, {named("type || '|' || coalesce(element_id, '_') || '|v' || variant_index")} AS row_id, {named("session_id || '|' || type || '|' || coalesce(element_id, '_') || '|v' || variant_index")} AS tracking_id,
        least(0.99::DOUBLE, ({conf})::DOUBLE * 0.6::DOUBLE + least(1.0::DOUBLE, severity) * 0.4::DOUBLE) AS confidence FROM c)"""
    routes = ", lr AS (SELECT session_id, coalesce(arg_max(route, seq) FILTER (et = 'NAVIGATION'), arg_min(route, seq)) AS route FROM e GROUP BY 1)"
    top = "list_sort(list({x}))[CAST(least(count(*), floor(0.95 * count(*)) + 1) AS BIGINT)]"
    base = f""", sz AS (SELECT el, count(DISTINCT session_id) AS s FROM e WHERE el IS NOT NULL GROUP BY 1 HAVING count(*) >= 30 AND count(DISTINCT session_id) >= 3),
      cl AS (SELECT a.el, a.session_id, a.seq, count(*) AS x FROM e a JOIN e b ON a.et = 'CLICK' AND b.et = 'CLICK' AND a.el = b.el AND a.session_id = b.session_id AND b.ms BETWEEN a.ms AND a.ms + 1000 AND (b.ms > a.ms OR b.seq >= a.seq) GROUP BY 1, 2, 3),
      ho AS (SELECT el, session_id, count(*) AS x FROM e h WHERE et = 'HOVER' AND (ms, seq) < (SELECT min((ms, seq)) FROM e c WHERE c.et = 'CLICK' AND c.el = h.el AND c.session_id = h.session_id) GROUP BY 1, 2),
      bl AS (SELECT el AS element_id, c.x AS p95_clicks_per_sec, w.x AS p95_dwell_ms, h.x AS p95_hovers_before_click, CAST(s AS INTEGER) AS sample_size FROM sz
        LEFT JOIN (SELECT el, CAST({top.format(x="x")} AS DOUBLE) AS x FROM cl GROUP BY 1) c USING (el)
        LEFT JOIN (SELECT el, CAST({top.format(x="k * 1000")} AS DOUBLE) AS x FROM e WHERE et = 'DWELL' AND k > 0 GROUP BY 1) w USING (el)
        LEFT JOIN (SELECT el, CAST({top.format(x="x")} AS DOUBLE) AS x FROM ho GROUP BY 1) h USING (el))"""
    raised = base + """, ev AS (SELECT e.*, greatest(3, coalesce(ceil(p95_clicks_per_sec * 3), 0)) AS n, greatest(30000, coalesce(ceil(p95_dwell_ms * 1.5), 0)) AS dw,
        greatest(6, coalesce(ceil(p95_hovers_before_click * 1.5), 0)) AS hf FROM e LEFT JOIN bl ON e.el = bl.element_id AND sample_size >= 10),
      ck AS (SELECT *, row_number() OVER (PARTITION BY session_id, el ORDER BY ms, seq) AS rn, count(*) OVER (PARTITION BY session_id, el) AS total FROM ev WHERE et = 'CLICK'),
      nx AS (SELECT *, min(CASE WHEN et = 'CLICK' THEN ms END) OVER (PARTITION BY session_id ORDER BY ms RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nc FROM ev),
      hv AS (SELECT *, row_number() OVER w AS nth, lag(ms, 5) OVER w AS ms5, lag(nc, 5) OVER w AS nc5 FROM nx WHERE et = 'HOVER' WINDOW w AS (PARTITION BY session_id ORDER BY ms, seq)) """
    by_baseline = {
        "RAGE_CLICK": """SELECT a.session_id, a.el AS element_id, least(1.0, a.total / (2.0 * a.n)) AS severity, a.ms AS ts_ms, coalesce(a.el, '_') AS scope, a.ms AS o1, a.seq AS o2
          FROM ck a JOIN ck b ON a.session_id = b.session_id AND a.el IS NOT DISTINCT FROM b.el AND b.rn = a.rn - a.n + 1 AND a.ms - b.ms <= 2000""",
        "LONG_DWELL": "SELECT session_id, el AS element_id, 0.3 AS severity, ms AS ts_ms, coalesce(el, '_') AS scope, ms AS o1, seq AS o2 FROM ev WHERE et = 'DWELL' AND k * 1000 >= dw",
        "HOVER_HUNT": "SELECT session_id, el AS element_id, 0.4 AS severity, ms AS ts_ms, '_' AS scope, ms AS o1, seq AS o2 FROM hv WHERE nth >= hf AND ms - ms5 <= 4000 AND (nc5 IS NULL OR nc5 >= ms + 500)",
    }
    adapted = raised + " UNION ALL ".join([*[f"({dedup(k, x)})" for k, x in by_baseline.items()], all_sql(without=tuple(by_baseline))])
    drawn = "CAST('0x' || substr(sha256(d.session_id || '|' || d.type || '|0|{salt}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
    explored = choice.replace(" ELSE best END", f" WHEN {drawn.format(salt='explore')} < {EPSILON} THEN floor({drawn.format(salt='which')} * {VARIANTS}) ELSE best END")
    stored = "('CLICK','INPUT_CHANGE','SUBMIT','NAVIGATION','HOVER','DWELL','CUSTOM')"
    scrubbed = "text"
    for p in PATTERNS:
        scrubbed = f"regexp_replace({scrubbed}, '" + p.replace("'", "''") + "', '[redacted]', 'g')"
    anchors = r"""WITH a AS (SELECT page_id, url, generate_subscripts(l, 1) - 1 AS tag_index, unnest(l) AS t FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\b[^>]*>[^<]*') AS l FROM pages))
      SELECT page_id, 'a' AS tag, CAST(tag_index AS INTEGER) AS tag_index, nullif(regexp_extract(t, 'href="([^"]*)"', 1), '') AS href, nullif(substr(trim(regexp_replace(regexp_extract(t, '>([^<]*)$', 1), '\s+', ' ', 'g')), 1, 200), '') AS label,
             'sh_' || substr(sha256('org:' || url || ':a[' || tag_index || ']'), 1, 32) AS element_id FROM a"""
    as_of, day = int(1.7064e15 // HOUR), int(8.64e10 // HOUR)
    return {
        "friction_table": d + " SELECT element_id, type, count(*) AS n, round(avg(severity), 6) AS avg_severity, max(ts_ms) AS last_ms FROM d GROUP BY 1, 2 ORDER BY count(element_id) DESC, element_id NULLS LAST, type LIMIT 100",
        "type_counts": d + " SELECT type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM d GROUP BY 1",
        "flow_map": E + " SELECT route AS from_route, nr AS to_route, count(*) AS n FROM (SELECT route, lead(route) OVER (PARTITION BY session_id ORDER BY ms, seq) AS nr FROM e WHERE et = 'NAVIGATION') WHERE route <> nr GROUP BY 1, 2",
        "sessions_list": d + " SELECT s.*, coalesce(n, 0) AS struggles FROM (SELECT session_id, count(*) AS events, min(ms) AS first_ms, max(ms) AS last_ms FROM e GROUP BY 1 ORDER BY max(ms) DESC, session_id LIMIT 50) s LEFT JOIN (SELECT session_id, count(*) AS n FROM d GROUP BY 1) USING (session_id)",
        "top_struggle": d + " SELECT element_id, type, count(*) AS n FROM d WHERE element_id IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY count(*) DESC, type) = 1",
        "activity": E + f" SELECT count(DISTINCT session_id) FILTER (ms > {as_of - day}) AS sessions, count(*) FILTER (ms > {as_of - day}) AS events, count(*) AS all_events, CASE WHEN {as_of} - max(ms) < {day / 720} THEN 'connected' WHEN {as_of} - max(ms) < {day} THEN 'idle' ELSE 'disconnected' END AS state FROM e",
        "leaderboard": stats + " SELECT coalesce(element_id, 'none') AS label, type, arg_max(row_id, (successes / impressions, row_id)) AS winner, arg_min(row_id, (successes / impressions, row_id)) AS loser, round(max(successes / impressions) - min(successes / impressions), 6) AS margin FROM st WHERE impressions >= 30 GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY margin DESC, label, type LIMIT 5",
        "baselines": E + base + " SELECT * FROM bl",
        "detect_adaptive": E + adapted,
        "detect_adaptive_dense": DENSE_ADAPTER + adapted,
        "choose_variant": choice + " SELECT session_id, element_id, type, severity, ts_ms, variant_index, row_id, tracking_id, confidence FROM ch",
        "choose_variant_exploring": explored + " SELECT session_id, element_id, type, severity, ts_ms, variant_index, row_id, tracking_id, confidence FROM ch",
        "dispatch": choice + routes + " SELECT tracking_id, session_id, type, variant_index FROM ch JOIN lr USING (session_id) WHERE route <> '/404' QUALIFY row_number() OVER (PARTITION BY tracking_id ORDER BY ts_ms) = 1",
        "last_routes": E + routes + " SELECT * FROM lr",
        "usage": "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS events, count(DISTINCT user_id) AS mau FROM events GROUP BY 1",
        "store_once": E + f" SELECT session_id, route, et AS event_type, ms, seq FROM (SELECT * FROM e WHERE et IN {stored} QUALIFY row_number() OVER (PARTITION BY session_id, route ORDER BY ms, seq) = 1) f WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.ms < 47340000 AND o.session_id = f.session_id AND o.route = f.route)",
        "history": E + " SELECT session_id, ms, seq FROM e WHERE ms >= 47390000 OR ms >= 47380000 AND session_id IN (SELECT session_id FROM e WHERE ms >= 47390000)",
        "element_map": anchors,
        "page_metadata": r"SELECT page_id, CAST(least(12, len(list_filter(regexp_extract_all(html, '(?is)<h[23][^>]*>(.*?)</h[23]>', 1), lambda h: trim(regexp_replace(h, '<[^>]+>|\s', ' ', 'g')) <> ''))) AS INTEGER) AS sections, len(regexp_extract_all(html, '(?i)<(button|input|textarea|select|form|a)\b([^>]*)>')) < 4 AND (regexp_matches(html, '(?i)<div[^>]*id=[""'']('||'root|app|__next|svelte)[""'']') OR regexp_matches(html, '(?i)<script[^>]*type=[""'']module[""'']')) AS spa_shell FROM pages".replace('""', '"'),
        "scrub": f"SELECT doc_id, {scrubbed} AS scrubbed FROM documents",
        "java_hash": f"SELECT c_custkey, {hashed('c_name')} AS h, {named("c_name || '|LOOP|_|v0'")} AS tracking_id FROM customer",
    }
