"""Queries on copy, enrichment, code maps, lists and ingest details over the driver's tables, with their SQL.

The star schema stands in for what it lacks: parts are elements, suppliers are described elements, customers bring evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from friction.functions import text
from friction.operators import content, dashboard, enrichment, html_map, ingest, source_map
from friction.operators.detect import detect
from friction.plans.rule_queries import ADAPTER, oracle_sql as rule_sql
from friction.sources.driver_events import HOUR, driver_events

TEMPLATE = "{label} on {route}: {intent}, {validation}{journeyStage}"
SINCE = 47_380_000


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def found(spark, sf):
    return detect(driver_events(spark, sf))


def labels(spark, sf):
    """e0 to e2 and more, with the name of a part as label and its brand as route."""
    return table(spark, sf, "part").select(F.concat(F.lit("e"), "p_partkey").alias("element_id"), F.col("p_name").alias("label"), F.col("p_brand").alias("route"))


def rules():
    n = F.col("p_size")
    return {
        "required": n % 2 == 0, "inputType": F.element_at(F.array(*[F.lit(x).cast("string") for x in ("email", "url", "tel", "number", None, "number")]), n % 6 + 1),
        "min": F.when(n % 4 < 2, n), "max": F.when(n % 5 < 3, n + 10), "minLength": n % 7, "maxLength": n % 3 * 10, "pattern": F.when(n % 5 == 0, "x"),
    }


def hints(spark, sf):
    return table(spark, sf, "part").withColumn("hint", content.validation_hint(rules()))


def described(spark, sf):
    s = table(spark, sf, "supplier").withColumn("element_id", F.concat(F.lit("s"), "s_suppkey"))
    return s.select("element_id", F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("c"), F.col("s_nationkey"))).alias("context"), F.concat(F.lit("/n"), F.col("s_nationkey")).alias("route"), "s_suppkey")


def tried(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_mktsegment").alias("label"), F.concat(F.lit("t"), F.col("c_nationkey")).alias("type"), F.concat(F.lit("v"), "c_custkey").alias("row_id"), (F.col("c_custkey") % 60).alias("impressions"), (F.col("c_custkey") % 60 * (F.col("c_custkey") % 11) / 20).cast("long").alias("successes"))


def evidence(spark, sf):
    kinds = F.array(*[F.lit(k) for k in source_map.EVIDENCE])
    return table(spark, sf, "customer").select(F.concat(F.lit("r"), "c_nationkey").alias("repo"), F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int")).alias("kind"), F.col("c_mktsegment").alias("value"))


def registry(spark):
    rows = [(f"fw{i}", k, v, i, i == 0) for i, v in enumerate(("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY")) for k in list(source_map.EVIDENCE)[: 4 - i]]
    return spark.createDataFrame(rows, "framework string, kind string, value string, priority int, build_tool boolean")


def pools(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("e"), F.col("c_custkey") % 40).alias("element_id"), F.col("c_mktsegment").alias("type"), (F.col("c_custkey") * 2).alias("variant_index"), F.col("c_name").alias("copy"), "c_custkey", "c_acctbal")
    d = c.select(F.col("c_custkey").alias("seq"), "element_id", F.when(F.col("c_custkey") % 3 == 0, "AFRICA").otherwise(F.col("type")).alias("type"))
    general = table(spark, sf, "region").select(F.col("r_name").alias("type"), F.col("r_regionkey").alias("variant_index"), F.concat(F.lit("of "), "r_name").alias("copy"))
    out = content.variant_pools(d, c.where("c_acctbal > 5000").drop("c_custkey", "c_acctbal"), general)
    return out.select("seq", "element_id", "type", F.array_join("pool", "|").alias("pool"))


def part_files(spark, sf):
    name = F.concat(F.lit("pages/("), "p_brand", F.lit(")/["), "p_type", F.lit("]/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.when(F.col("p_size") % 2 == 0, "/index.vue").otherwise(".vue"))
    return table(spark, sf, "part").select(F.lit("r").alias("repo"), name.alias("path"))


def queries() -> dict:
    e = driver_events
    return {
        "validation_hint": lambda s, d: hints(s, d).select("p_partkey", "hint"),
        "rendered_copy": lambda s, d: hints(s, d).select("p_partkey", content.rendered(F.lit(TEMPLATE), {"label": F.when(F.col("p_size") % 4 != 0, F.col("p_name")), "route": F.col("p_brand"), "intent": F.when(F.col("p_size") % 3 == 0, F.col("p_type")), "validation": F.col("hint")}).alias("copy")),
        "variant_pools": pools,
        "related_elements": lambda s, d: content.related_elements(table(s, d, "part").select(F.concat(F.lit("e"), "p_partkey").alias("element_id"), F.array(F.upper("p_name"), F.col("p_brand"), F.concat("p_name", F.lit(" "))).alias("actions")), labels(s, d)).select("element_id", F.array_join("related", ",").alias("related")),
        "valid_variants": lambda s, d: content.valid_variants(table(s, d, "orders").select(F.concat(F.lit("e"), F.col("o_custkey")).alias("element_id"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("place"), F.when(F.col("o_orderkey") % 3 == 0, "OVERLAY").when(F.col("o_orderkey") % 3 == 1, "CONFIRM").otherwise("NONE").alias("kind"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit(" "), "o_orderpriority")).alias("copy"))),
        "pairs_to_prepare": lambda s, d: enrichment.pairs_to_prepare(described(s, d), described(s, d).where("route < '/n2'").withColumn("type", F.lit("LOOP"))),
        "enrichment_batches": lambda s, d: enrichment.in_batches(enrichment.undescribed(described(s, d).drop("context"), described(s, d).where("context is not null"), table(s, d, "nation").select(F.concat(F.lit("/n"), "n_nationkey").alias("route"), F.col("n_name").alias("title"))), "route", ["s_suppkey"], 8).select("element_id", "route", "route_title", "batch"),
        "upserted": lambda s, d: enrichment.upserted(labels(s, d), labels(s, d).where("length(label) % 2 = 0").withColumn("label", F.upper("label")), ["element_id"]),
        "inserted": lambda s, d: enrichment.inserted(tried(s, d).where("impressions < 20"), tried(s, d).withColumn("element_id", F.when(F.col("impressions") != 25, F.concat(F.lit("e"), F.col("impressions") * 9))), labels(s, d)).select("row_id", "element_id"),
        "route_signatures": lambda s, d: enrichment.route_signatures(described(s, d).where("context is not null")),
        "changed_routes": lambda s, d: enrichment.changed_routes(enrichment.route_signatures(described(s, d)), enrichment.route_signatures(described(s, d).where("s_suppkey < 50"))).select("route", "members"),
        "file_routes": lambda s, d: source_map.file_routes(part_files(s, d)).select("route", "parent", "path"),
        "frameworks": lambda s, d: source_map.frameworks(evidence(s, d), registry(s)),
        "totals": lambda s, d: dashboard.totals(e(s, d), found(s, d), labels(s, d), labels(s, d).where("label like 's%'"), SINCE),
        "latest_struggles": lambda s, d: dashboard.latest(found(s, d), labels(s, d), "ts_ms").select("session_id", "element_id", "type", "ts_ms", "label"),
        "top_element": lambda s, d: dashboard.top_element(found(s, d), labels(s, d)),
        "session_detail": lambda s, d: dashboard.session_detail(e(s, d), labels(s, d), "s7"),
        "element_detail": lambda s, d: dashboard.element_detail(found(s, d), "e1"),
        "variant_performance": lambda s, d: dashboard.variant_performance(tried(s, d)),
        "recent_usage": lambda s, d: dashboard.recent_usage(ingest.usage(table(s, d, "orders"), F.date_format("o_orderdate", "yyyy-MM"), F.col("o_custkey"))),
        "ready_orgs": lambda s, d: dashboard.ready_orgs(table(s, d, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("org")), table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("org"))),
        "authorised": lambda s, d: ingest.authorised(table(s, d, "customer").select("c_custkey", F.concat(F.lit("ck_"), F.col("c_nationkey")).alias("token")), table(s, d, "nation").select(F.sha2(F.concat(F.lit("ck_"), "n_nationkey"), 256).alias("key_hash"), F.col("n_name").alias("org"), F.when(F.col("n_regionkey") == 1, "x").alias("revoked_at"))),
        "client_buffer": lambda s, d: ingest.newest(e(s, d)).select("session_id", "seq"),
        "debounced": lambda s, d: ingest.debounced(e(s, d), 2000).select("seq"),
        "input_growth": lambda s, d: ingest.input_growth(e(s, d)).select("seq", "delta"),
        "ingest_counts": lambda s, d: ingest.counted(e(s, d), ingest.first_by_key(ingest.storable(e(s, d)), ["session_id", "route"], ["ms", "seq"])),
        "relative_time": lambda s, d: table(s, d, "customer").select("c_custkey", text.relative_time(F.col("c_custkey") * 211).alias("age")),
        "humanised": lambda s, d: found(s, d).groupBy("type").agg(F.count("*").alias("n")).select(text.humanised(F.col("type")).alias("kind"), "n"),
        "label_hash": lambda s, d: table(s, d, "part").select("p_partkey", text.label_hash(F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" e\u0301"), "p_size", F.lit("\u212b"))).otherwise(F.col("p_name"))).alias("h"), text.masked(F.col("p_brand")).alias("masked"), text.form_factor(F.col("p_size") * 40).alias("form_factor")),
        "element_roles": lambda s, d: html_map.elements(table(s, d, "pages")).groupBy("semantic_role", "destructive").agg(F.count("*").alias("n")),
    }


E = ADAPTER.format(div=HOUR)


def oracle_sql() -> dict[str, str]:
    d = E + ", d AS (" + rule_sql()["detect_all"][len(E) :] + ")"
    lab = "(SELECT 'e' || p_partkey AS element_id, p_name AS label, p_brand AS route FROM part)"
    n = "p_size"
    parts = f"""[CASE WHEN {n} % 2 = 0 THEN 'required' END, CASE {n} % 6 WHEN 0 THEN 'valid email' WHEN 1 THEN 'valid URL' WHEN 2 THEN 'valid phone number' WHEN 4 THEN NULL
      ELSE CASE WHEN {n} % 4 < 2 AND {n} % 5 < 3 THEN 'between ' || {n} || ' and ' || ({n} + 10) WHEN {n} % 4 < 2 THEN 'at least ' || {n} WHEN {n} % 5 < 3 THEN 'at most ' || ({n} + 10) END END,
      CASE WHEN {n} % 7 > 0 THEN 'at least ' || ({n} % 7) || ' characters' END, CASE WHEN {n} % 3 > 0 THEN 'at most ' || ({n} % 3 * 10) || ' characters' END, CASE WHEN {n} % 5 = 0 AND {n} % 6 = 4 THEN 'a valid format' END]"""
    hint = f"(SELECT *, CASE WHEN len(p) > 0 THEN 'needs ' || array_to_string(p, ', ') ELSE '' END AS hint FROM (SELECT *, list_filter({parts}, lambda x: x IS NOT NULL) AS p FROM part))"
    desc = "(SELECT 's' || s_suppkey AS element_id, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'c' || s_nationkey END AS context, '/n' || s_nationkey AS route, s_suppkey FROM supplier)"
    tried_ = "(SELECT c_mktsegment AS label, 't' || c_nationkey AS type, 'v' || c_custkey AS row_id, c_custkey % 60 AS impressions, CAST(floor(c_custkey % 60 * (c_custkey % 11) / 20) AS BIGINT) AS successes FROM customer)"
    types = ", ".join(f"('{t}')" for t in enrichment.PREPARED)
    signature = "SELECT route, count(*) AS members, sha256(string_agg(element_id || ':' || name, '|' ORDER BY element_id || ':' || name)) AS signature FROM {} WHERE {} GROUP BY 1"
    fw = ", ".join(f"('fw{i}', '{k}', '{v}', {i}, {str(i == 0).lower()})" for i, v in enumerate(("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY")) for k in list(source_map.EVIDENCE)[: 4 - i])
    weight = " ".join(f"WHEN '{k}' THEN {w}" for k, w in source_map.EVIDENCE.items())
    kinds = "[" + ", ".join(f"'{k}'" for k in source_map.EVIDENCE) + "]"
    stored = "('CLICK','INPUT_CHANGE','SUBMIT','NAVIGATION','HOVER','DWELL','CUSTOM')"
    return {
        "validation_hint": f"SELECT p_partkey, hint FROM {hint}",
        "rendered_copy": f"SELECT p_partkey, (CASE WHEN {n} % 4 <> 0 THEN p_name ELSE 'this' END) || ' on ' || p_brand || ': ' || (CASE WHEN {n} % 3 = 0 THEN p_type WHEN {n} % 4 <> 0 THEN p_name ELSE 'continue' END) || ', ' || hint AS copy FROM {hint}",
        "variant_pools": """WITH c AS (SELECT 'e' || (c_custkey % 40) AS element_id, c_mktsegment AS type, c_name AS copy, c_custkey, c_acctbal FROM customer), d AS (SELECT c_custkey AS seq, element_id, CASE WHEN c_custkey % 3 = 0 THEN 'AFRICA' ELSE type END AS type FROM c),
          own AS (SELECT element_id, type, string_agg(copy, '|' ORDER BY c_custkey) AS p FROM c WHERE c_acctbal > 5000 GROUP BY 1, 2) SELECT seq, d.element_id, d.type, coalesce(p, 'of ' || r_name, '') AS pool FROM d LEFT JOIN own USING (element_id, type) LEFT JOIN region ON r_name = d.type""",
        "related_elements": f"WITH l AS (SELECT label, max(element_id) AS target FROM {lab} GROUP BY 1) SELECT 'e' || p_partkey AS element_id, target AS related FROM part JOIN l ON label = p_name",
        "valid_variants": """WITH o AS (SELECT 'e' || o_custkey AS element_id, o_orderstatus AS type, o_orderkey AS k, ['OVERLAY','CONFIRM','NONE'][o_orderkey % 3 + 1] AS kind, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS copy FROM orders), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY element_id, type ORDER BY k) <= 2)
          SELECT element_id, type, CAST(row_number() OVER (PARTITION BY element_id, type ORDER BY k) - 1 AS INTEGER) AS variant_index, kind, copy FROM f WHERE kind <> 'NONE' AND copy IS NOT NULL""",
        "pairs_to_prepare": f"SELECT element_id, type, context FROM {desc}, (VALUES {types}) t(type) WHERE context IS NOT NULL AND NOT (type = 'LOOP' AND route < '/n2')",
        "enrichment_batches": f"SELECT element_id, route, n_name AS route_title, CAST((row_number() OVER (PARTITION BY route ORDER BY s_suppkey) - 1) // 8 AS INTEGER) AS batch FROM {desc} JOIN nation ON route = '/n' || n_nationkey WHERE context IS NULL",
        "upserted": f"SELECT element_id, CASE WHEN length(label) % 2 = 0 THEN upper(label) ELSE label END AS label, route FROM {lab}",
        "inserted": f"SELECT row_id, CASE WHEN impressions <> 25 THEN 'e' || (impressions * 9) END AS element_id FROM {tried_} WHERE impressions >= 20 AND (impressions = 25 OR 'e' || (impressions * 9) IN (SELECT element_id FROM {lab}))",
        "route_signatures": signature.format(desc, "context IS NOT NULL"),
        "changed_routes": f"SELECT route, members FROM ({signature.format(desc, 'true')}) a WHERE NOT EXISTS (SELECT 1 FROM ({signature.format(desc, 's_suppkey < 50')}) b WHERE a.route = b.route AND a.signature = b.signature)",
        "file_routes": """WITH r AS (SELECT '/:' || p_type || '/' || replace(p_name, ' ', '/') AS route, 'pages/(' || p_brand || ')/[' || p_type || ']/' || replace(p_name, ' ', '/') || CASE WHEN p_size % 2 = 0 THEN '/index.vue' ELSE '.vue' END AS path FROM part)
          SELECT route, regexp_replace(route, '/[^/]*$', '') AS parent, min(path) AS path FROM r GROUP BY 1""",
        "frameworks": f"""WITH ev AS (SELECT DISTINCT 'r' || c_nationkey AS repo, {kinds}[c_custkey % 4 + 1] AS kind, c_mktsegment AS value FROM customer), reg AS (SELECT * FROM (VALUES {fw}) t(framework, kind, value, priority, build_tool)),
          g AS (SELECT repo, framework, round(least(0.99, 1 - product(1 - (CASE kind {weight} END)::DOUBLE)), 6) AS confidence, max(priority) AS priority, bool_or(build_tool) AS build_tool FROM ev JOIN reg USING (kind, value) GROUP BY 1, 2),
          k AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, priority DESC, framework) AS INTEGER) AS rank FROM g) SELECT repo, framework, confidence, rank, row_number() OVER (PARTITION BY repo ORDER BY build_tool, rank) = 1 AS "primary" FROM k""",
        "totals": d + f" SELECT (SELECT count(*) FROM e) AS events, count(*) FILTER (ts_ms >= {SINCE}) AS struggles_today, count(*) AS struggles, (SELECT count(*) FROM part) AS elements, (SELECT count(*) FROM part WHERE p_name LIKE 's%') AS described FROM d",
        "latest_struggles": d + f" SELECT session_id, d.element_id, type, ts_ms, label FROM (SELECT * FROM d ORDER BY ts_ms DESC, session_id, element_id NULLS LAST, type LIMIT 10) d LEFT JOIN {lab} l ON d.element_id = l.element_id",
        "top_element": d + f" SELECT g.*, label FROM (SELECT element_id, count(element_id) AS n FROM d GROUP BY 1 ORDER BY n DESC, element_id NULLS LAST LIMIT 1) g LEFT JOIN {lab} USING (element_id)",
        "session_detail": E + f" SELECT e.ms, e.seq, e.et AS event_type, e.route, e.el AS element_id, label FROM (SELECT * FROM e WHERE session_id = 's7' ORDER BY ms, seq LIMIT 500) e LEFT JOIN {lab} l ON el = element_id",
        "element_detail": d + ", x AS (SELECT * FROM d WHERE element_id = 'e1' ORDER BY ts_ms DESC, session_id, type LIMIT 25) SELECT type, (SELECT count(DISTINCT session_id) FROM x) AS sessions, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, type LIMIT 5",
        "variant_performance": f"SELECT label, type, count(*) AS variants, CAST(sum(impressions) AS BIGINT) AS shown, arg_max(row_id, (impressions >= 30, CASE WHEN impressions > 0 THEN successes / impressions ELSE 0 END, row_id)) AS winner FROM {tried_} GROUP BY 1, 2 HAVING count(*) > 1",
        "recent_usage": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS events, count(DISTINCT o_custkey) AS mau FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 6",
        "ready_orgs": "SELECT DISTINCT c_nationkey AS org FROM customer WHERE c_acctbal > 9500 AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
        "authorised": "SELECT c_custkey, n_name AS org FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1",
        "client_buffer": E + " SELECT session_id, seq FROM e QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 200",
        "debounced": E + " SELECT seq FROM (SELECT seq, lead(ms) OVER (PARTITION BY session_id, el, et ORDER BY ms, seq) - ms AS gap FROM e) WHERE gap IS NULL OR gap >= 2000",
        "input_growth": E + " SELECT seq, CAST(len - coalesce(lag(len) OVER (PARTITION BY session_id, el ORDER BY ms, seq), 0) AS DOUBLE) AS delta FROM e WHERE et = 'INPUT_CHANGE'",
        "ingest_counts": E + f" SELECT count(DISTINCT (session_id, route)) AS accepted, count(*) - count(DISTINCT (session_id, route)) AS duplicates FROM e WHERE et IN {stored}",
        "relative_time": "SELECT c_custkey, CASE WHEN a < 60 THEN CAST(round(a) AS BIGINT) || 's' WHEN a < 3600 THEN CAST(round(a / 60) AS BIGINT) || 'm' WHEN a < 86400 THEN CAST(round(a / 3600) AS BIGINT) || 'h' ELSE CAST(round(a / 86400) AS BIGINT) || 'd' END || ' ago' AS age FROM (SELECT c_custkey, c_custkey * 211 AS a FROM customer)",
        "humanised": d + " SELECT type[1] || replace(lower(type[2:]), '_', ' ') AS kind, count(*) AS n FROM d GROUP BY 1",
        "label_hash": "SELECT p_partkey, sha256(CASE WHEN p_size % 3 = 0 THEN nfc_normalize(p_name || ' e\u0301' || p_size || '\u212b') ELSE p_name END) AS h, repeat('•', length(p_brand) - 4) || right(p_brand, 4) AS masked, CASE WHEN p_size * 40 <= 640 THEN 'mobile' WHEN p_size * 40 <= 1024 THEN 'tablet' ELSE 'desktop' END AS form_factor FROM part",
        "element_roles": r"WITH a AS (SELECT unnest(regexp_extract_all(html, '(?i)<a\b[^>]*>')) AS t FROM pages), h AS (SELECT regexp_extract(t, 'href=\"([^\"]*)\"', 1) AS href FROM a) SELECT CASE WHEN href IN ('#help','/help') THEN 'HELP' WHEN href IN ('#search','/search') THEN 'SEARCH' ELSE 'NAV' END AS semantic_role, false AS destructive, count(*) AS n FROM h GROUP BY 1".replace('\\"', '"'),
    }
