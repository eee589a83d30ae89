"""Queries on dispatch context, outcomes, ingest, pages, routes and dashboards over the driver's tables, with their SQL.

As in product_queries, the star schema stands in for what it lacks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from friction.functions import text
from friction.functions.ids import row_id, tracking_id, user_hash
from friction.operators import baselines, dashboard, detect, dispatch, html_map, ingest, source_map
from friction.plans import engine_queries
from friction.plans.product_queries import SINCE, labels, table
from friction.plans.rule_queries import ADAPTER, oracle_sql as rule_sql
from friction.sources.driver_events import HOUR, driver_events

E = ADAPTER.format(div=HOUR)
#: A time after the last event, and one near it.
AS_OF, NOW = 47_425_000, 47_407_000
FEW = {"RAGE_CLICK", "LONG_DWELL", "JS_ERROR"}
#: Labels of buttons, one for each role that words give.
BUTTONS = ("Save it", "Cancel", "Delete all", "Hide", "Retry", "Help me", "Search", "Log in", "Log out", "Pay now")
BUTTON_ROLES = ("SUBMIT", "CANCEL", "DANGER", "DISMISS", "RETRY", "HELP", "SEARCH", "LOGIN", "LOGOUT", "PAYMENT")


def found(s, d, only=None):
    return detect.detect(driver_events(s, d), only=only)


def interventions(s, d):
    c = table(s, d, "customer")
    n, i = F.col("c_custkey"), F.col("c_custkey") % 60
    return c.select(
        F.concat(F.lit("v"), n).alias("row_id"), F.concat(F.lit("e"), n % 40).alias("element_id"), F.element_at(F.array(*[F.lit(x) for x in ("DOM", "BEHAVIOR", "AUTO_FIX", "COPY")]), (n % 4 + 1).cast("int")).alias("kind"),
        F.when(F.col("c_acctbal") > 3000, F.col("c_name")).alias("copy"), (F.col("c_acctbal") > 0).alias("enabled"), i.alias("impressions"), F.floor(i / 3).alias("successes"), (i % 3).alias("dismissals"),
        F.when(i > 0, F.floor(i / 3) / i).otherwise(0.0).alias("success_rate"), (n * 7 % 1009).alias("created"),
    )


INTERVENTIONS = """iv AS (SELECT 'v' || c_custkey AS row_id, 'e' || (c_custkey % 40) AS element_id, ['DOM','BEHAVIOR','AUTO_FIX','COPY'][c_custkey % 4 + 1] AS kind,
  CASE WHEN c_acctbal > 3000 THEN c_name END AS copy, c_acctbal > 0 AS enabled, c_custkey % 60 AS impressions, (c_custkey % 60) // 3 AS successes, c_custkey % 60 % 3 AS dismissals,
  CASE WHEN c_custkey % 60 > 0 THEN ((c_custkey % 60) // 3) / (c_custkey % 60) ELSE 0.0 END AS success_rate, c_custkey * 7 % 1009 AS created FROM customer),
lb AS (SELECT 'e' || p_partkey AS element_id, p_name AS label, p_brand AS route FROM part)"""


def outcome_parts(s, d):
    o = table(s, d, "orders")
    kinds = F.array(*[F.lit(x) for x in ("intervention_shown", "intervention_success", "intervention_dismissed", "other")])
    events = o.select(F.concat(F.lit("s"), "o_custkey").alias("session_id"), F.when(F.col("o_orderstatus") == "P", "CLICK").otherwise("CUSTOM").alias("event_type"), F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("m_kind"), F.concat(F.lit("t"), "o_custkey").alias("m_iid"), F.col("o_orderkey").alias("ms"))
    ledger = table(s, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("t"), "c_custkey").alias("tracking_id"), F.concat(F.lit("v"), "c_custkey").alias("row_id"))
    return dispatch.outcome_events(events), ledger


OUTCOMES = """oc AS (SELECT 's' || o_custkey AS session_id, 'v' || o_custkey AS row_id, ['intervention_shown','intervention_success','intervention_dismissed','other'][o_orderkey % 4 + 1] AS kind, o_orderkey AS ms
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderstatus <> 'P' AND o_orderkey % 4 < 3)"""


def context(s, d):
    e = driver_events(s, d)
    k = F.col("p_size")
    elements = labels(s, d).join(table(s, d, "part").select(F.concat(F.lit("e"), "p_partkey").alias("element_id"), F.when(k < 25, "SUBMIT").alias("role"), F.col("p_type").alias("validation")), "element_id")
    semantics = table(s, d, "orders").select(F.concat(F.lit("e"), F.col("o_custkey") % 50).alias("element_id"), F.col("o_orderdate").alias("enriched_at"), F.col("o_orderpriority").alias("intent"), F.when(F.col("o_custkey") % 50 != 1, F.concat(F.lit("N"), F.col("o_custkey") % 7)).alias("semantic_name"), F.concat(F.lit("H"), F.col("o_custkey") % 3).alias("help_copy"))
    routes = table(s, d, "nation").select(F.concat(F.lit("/r"), "n_nationkey").alias("route"), F.col("n_name").alias("title"), F.concat(F.lit("p"), "n_regionkey").alias("purpose"), F.when(F.col("n_nationkey") != 2, F.concat(F.lit("stage"), "n_regionkey")).alias("stage"))
    titled = e.withColumn("page_title", F.when(F.col("event_type") == "CLICK", F.concat(F.lit("At "), "route")).otherwise(""))
    return dispatch.with_context(found(s, d).select("session_id", "element_id", "type", "severity", "ts_ms"), elements, semantics, routes, dispatch.last_routes(e), dispatch.last_titles(titled))


def cached_confidence(s, d):
    """Confidence of what was chosen where an element has cached variants, some beyond the bounds, some without their own."""
    p = table(s, d, "part").where("p_partkey <= 2")
    kinds = F.explode(F.array(*[F.lit(t) for t in ("RAGE_CLICK", "LOOP", "LONG_DWELL", "JS_ERROR", "SILENT_FAIL", "DEAD_CLICK")])).alias("type")
    rows = p.select("p_partkey", F.concat(F.lit("e"), "p_partkey").alias("element_id"), kinds).withColumn("variant_index", F.explode(F.array(*[F.lit(v) for v in range(3)])))
    stated = F.when((F.col("variant_index") + F.length("type")) % 4 != 0, (F.length("type") * 3 + F.col("variant_index") - 20 * F.col("p_partkey")) / F.lit(10.0))
    cached = rows.select("element_id", "type", "variant_index", stated.alias("confidence"), F.concat(F.lit("help "), "variant_index").alias("help_copy"))
    out = dispatch.with_cached(engine_queries.chosen(s, d), cached)
    return out.select("session_id", "element_id", "type", "variant_index", "confidence", "cached_help")


def options(s, d):
    """Options and time to dismissal of what was chosen, from the templates of some types; confirmations among them have none."""
    kinds = F.explode(F.array(*[F.lit(t) for t in ("RAGE_CLICK", "LOOP", "LONG_DWELL", "JS_ERROR", "SILENT_FAIL", "DEAD_CLICK")])).alias("type")
    v = F.col("variant_index")
    rows = table(s, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("int").alias("variant_index"), kinds)
    templates = rows.select("type", "variant_index", F.when((v + F.length("type")) % 2 == 0, "body").alias("target"), F.when(v == 1, "warn").alias("severity_opt"), F.when(v == 2, 5000).alias("auto_dismiss_ms"))
    ch = engine_queries.chosen(s, d)
    ch = ch.withColumn("variant_index", F.when(F.col("session_id").endswith("3"), -1).otherwise(v))
    out = dispatch.with_options(ch, templates)
    return out.select("session_id", "element_id", "type", "variant_index", F.col("options").isNotNull().alias("has_options"), "options.target", F.col("options.severity").alias("severity_opt"), "auto_dismiss_ms")


#: Labels of a template's buttons, one for each role that its words give, and one that none gives.
TEMPLATE_BUTTONS = ("Save it", "Cancel", "Delete all", "Hide", "Try again", "Help me", "Approve it", "Find", "Refine", "Options", "Rename", "Archive", "Authenticate", "Sign out", "Complete order", "Other", "Updated")
TEMPLATE_ROLES = ("SUBMIT", "CANCEL", "DANGER", "DISMISS", "RETRY", "HELP", "CONFIRM", "SEARCH", "FILTER", "MENU", "EDIT", "DELETE", "LOGIN", "LOGOUT", "PAYMENT", None, None)


def template_roles(s, d):
    """Roles of the elements of templates: by their words, or what they name themselves, if that is a role."""
    n = F.col("p_size")
    named = F.when(n % 4 == 1, F.lit(' data-role="toggle"')).when(n % 4 == 2, F.lit(' data-role="wonder"')).otherwise(F.lit(""))
    label = F.element_at(F.array(*[F.lit(x) for x in TEMPLATE_BUTTONS]), (F.col("p_partkey") % len(TEMPLATE_BUTTONS) + 1).cast("int"))
    html = F.concat(F.lit("<button"), named, F.lit(">"), label, F.lit('</button><a data-role="expand" href="/help">x</a><input type="submit" data-role="menu" value="Go">'))
    pages = table(s, d, "part").select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    return html_map.elements(pages, template=True).select("page_id", "tag", "label", "semantic_role", "destructive")


def guarded(s, d):
    """Dispatch with a denied route, a destructive element, paused rows and interventions that were shown before. Hasty types
    are found once more with another variant, as after the statistics changed: a destructive element still asks once."""
    ch = engine_queries.chosen(s, d)
    again = ch.where(F.col("type").isin(*dispatch.CAUTIOUS)).withColumn("variant_index", (F.col("variant_index") + 1) % engine_queries.VARIANTS).withColumn("ts_ms", F.col("ts_ms") + 1)
    v = F.col("variant_index").cast("string")
    again = again.withColumn("row_id", row_id(F.col("type"), F.col("element_id"), v)).withColumn("tracking_id", tracking_id(F.col("session_id"), F.col("type"), F.col("element_id"), v))
    roles = s.createDataFrame([("e0", "DELETE"), ("e1", "HELP")], "element_id string, role string")
    paused = ch.where("type = 'JS_ERROR' and variant_index = 1").select("row_id").distinct()
    shown = ch.where(F.col("session_id").endswith("7")).select("tracking_id").distinct()
    out = dispatch.dispatch(ch.unionByName(again), dispatch.last_routes(driver_events(s, d)), ["/r1"], roles, paused, shown, safe_mode=False)
    return out.select("session_id", "element_id", "type", "variant_index", "row_id", "tracking_id", "confirm")


def sampling(s, d):
    """A quarter of the clicks, a tenth of the rest, by rates and by a condition; outcomes of interventions and errors stay."""
    o = table(s, d, "orders")
    kinds = F.array(*[F.lit(x) for x in ("intervention_shown", "intervention_success", "intervention_dismissed", "other")])
    kind = F.when(F.col("o_orderstatus") == "P", "CLICK").when(F.col("o_orderkey") % 11 == 0, "JS_ERROR").when(F.col("o_orderkey") % 11 == 1, "HOVER").otherwise("CUSTOM")
    events = o.select(F.col("o_orderkey").alias("key"), kind.alias("event_type"), F.when(kind == "CUSTOM", F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("m_kind"))
    rates = ingest.sampled(events, 0.1, {"CLICK": 0.25, "HOVER": float("nan")}, F.col("key"))
    chosen = ingest.sampled(events, 0.0, {}, F.col("key"), keep=F.col("key") % 5 == 0)
    return rates.withColumn("by", F.lit("rate")).unionByName(chosen.withColumn("by", F.lit("condition"))).groupBy("by", "event_type", "m_kind").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


def batches(s, d):
    e = driver_events(s, d)
    wrong = F.when((F.col("event_type") == "HOVER") & (F.col("seq") % 50 == 0), "WINK").otherwise(F.col("event_type"))
    return e.withColumn("event_type", wrong).withColumn("batch_id", F.floor(F.col("seq") / 25))


def orgs_of_batches(s, d):
    c = table(s, d, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.concat(F.lit("ck_"), F.col("c_nationkey"))).alias("token"), F.concat(F.lit("n"), F.col("c_nationkey") + F.when(F.col("c_acctbal") < -500, 20).otherwise(0)).alias("header_org"))
    n = table(s, d, "nation")
    keys = n.select(F.sha2(F.concat(F.lit("ck_"), "n_nationkey"), 256).alias("key_hash"), F.concat(F.lit("n"), "n_nationkey").alias("org"), F.when(F.col("n_regionkey") == 1, "2026").alias("revoked_at"))
    good, bad = ingest.resolved_org(rows, keys, n.select(F.concat(F.lit("n"), "n_nationkey").alias("org")))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).groupBy("org", "reason").agg(F.count("*").alias("n"))


def meter(s, d):
    o = table(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_custkey") % 7).alias("org"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.lit(1).alias("events"), F.when(F.col("o_orderstatus") == "F", 1).alias("interventions"), F.when(F.col("o_orderstatus") == "O", F.col("o_custkey") % 10).alias("tokens"))
    stored = table(s, d, "nation").select(F.concat(F.lit("o"), F.col("n_regionkey")).alias("org"), F.lit("1996-01").alias("month"), F.lit(5).alias("events"), F.lit(1).alias("interventions"), F.lit(2).alias("tokens"))
    return ingest.metered(stored, o)


def remap(s, d):
    old = table(s, d, "supplier").select(F.concat(F.lit("o"), F.col("s_nationkey")).alias("org"), F.concat(F.lit("e"), "s_suppkey").alias("id"), F.col("s_name").alias("label"))
    new = table(s, d, "customer").where("c_nationkey < 10").select(F.concat(F.lit("o"), "c_nationkey").alias("org"), F.concat(F.lit("e"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("label"))
    return ingest.remapped(old, new, ["id"])


def form_pages(s, d):
    n, at = F.col("p_size"), F.col("p_partkey") % 10
    button = F.element_at(F.array(*[F.lit(x) for x in BUTTONS]), (at + 1).cast("int"))
    html = F.concat(
        F.lit('<h1>Part '), F.col("p_name"), F.lit('</h1><form action="/f" id="f'), n, F.lit("\"><input type='text' name=a name='b' placeholder=\"Size of it\" required minlength=\""), n, F.lit('" max=9>'),
        F.lit('<textarea title="">x <i>'), F.col("p_brand"), F.lit('</i> y</textarea><input type="submit" value="Go on"></form><button class="'), F.when(n % 2 == 0, "hidden icon").otherwise("plain"), F.lit('" onclick="go('), n, F.lit(')"'), F.when(n % 3 == 0, " disabled").otherwise(""), F.lit('>'), button,
        F.lit('</button><a href="/x" class=q>See <b>'), F.col("p_brand"), F.lit('</b> more</a><div hx-get="/h" title="T">z</div><span x-on:click="open = true">w</span>'),
    )
    return table(s, d, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("u"), "p_partkey").alias("url"), html.alias("html"))


def form_elements(s, d):
    return html_map.elements(form_pages(s, d)).select("page_id", "tag", "tag_index", "label", "semantic_role", "destructive", "required", "validation", "form_context", "handler", F.array_join("tags", "|").alias("tags"), "endpoint")


FORM_ELEMENTS = f"""WITH p AS (SELECT p_partkey AS page_id, p_size AS n, p_brand AS b, CAST(p_partkey % 10 AS INTEGER) + 1 AS nth, p_name FROM part), x AS (
SELECT page_id, 'form' AS tag, 0 AS tag_index, 'x ' || b || ' y' AS label, NULL AS semantic_role, false AS destructive, false AS required, NULL AS validation, 'f' || n AS form_context, NULL AS handler, '' AS tags, '/f' AS endpoint FROM p
UNION ALL SELECT page_id, 'input', 0, 'Size of it', NULL, false, true, '{{"required":true,"minLength":' || n || ',"max":"9","inputType":"text"}}', 'f' || n, NULL, '', NULL FROM p
UNION ALL SELECT page_id, 'textarea', 0, 'x ' || b || ' y', NULL, false, false, NULL, 'f' || n, NULL, '', NULL FROM p
UNION ALL SELECT page_id, 'input', 1, 'Go on', 'SUBMIT', false, false, '{{"inputType":"submit"}}', 'f' || n, NULL, '', NULL FROM p
UNION ALL SELECT page_id, 'button', 0, {list(BUTTONS)}[nth], {list(BUTTON_ROLES)}[nth], {list(BUTTON_ROLES)}[nth] IN ('DANGER','LOGOUT'), false, CASE WHEN n % 3 = 0 THEN '{{"disabled":true}}' END, NULL, 'go',
  concat_ws('|', CASE WHEN n % 3 = 0 THEN 'disabled' END, CASE WHEN n % 2 = 0 THEN 'hidden' END), NULL FROM p
UNION ALL SELECT page_id, 'a', 0, 'See ' || b || ' more', 'NAV', false, false, NULL, NULL, NULL, '', NULL FROM p) SELECT * FROM x"""


def custom(s, d):
    return html_map.custom_elements(form_pages(s, d)).withColumn("tags", F.array_join("tags", "|"))


def repo_files(s, d):
    """Files of a repo for each brand: routes of the app convention for some, of pages or flat ones for the others."""
    n, name = F.col("p_size"), F.replace("p_name", F.lit(" "), F.lit("-"))
    path = F.when(n % 3 == 0, F.concat(F.lit("app/(shop)/"), name, F.lit("/["), n, F.lit("]/page.tsx"))).when(n % 3 == 1, F.concat(F.lit("pages/"), name, F.when(n % 2 == 0, "/index.js").otherwise(".jsx"))).otherwise(F.concat(F.lit("app/routes/"), name, F.lit(".$id."), n, F.lit(".ts")))
    source = F.concat(F.lit("export const metadata = { title: '"), F.col("p_name"), F.lit("', description: \"of "), F.col("p_brand"), F.lit('" }\n<h2>One <b>'), n, F.lit("</b></h2><h3>Two</h3>"), F.when(n > 25, " await auth()").otherwise(""))
    return table(s, d, "part").select(F.concat(F.col("p_brand"), F.when(n % 3 < 2, n % 3).otherwise(2)).alias("repo"), path.alias("path"), source.alias("source"))


FILES = """f AS (SELECT p_brand || (p_size % 3) AS repo, p_size AS n, replace(p_name, ' ', '-') AS nm, p_name, p_brand FROM part),
r AS (SELECT repo, n, p_name, p_brand, CASE n % 3 WHEN 0 THEN '/' || nm || '/[' || n || ']' WHEN 1 THEN '/' || nm || CASE WHEN n % 2 = 0 THEN '/' ELSE '' END ELSE '/' || nm || '/:id/' || n END AS route,
  CASE n % 3 WHEN 0 THEN 'app/(shop)/' || nm || '/[' || n || ']/page.tsx' WHEN 1 THEN 'pages/' || nm || CASE WHEN n % 2 = 0 THEN '/index.js' ELSE '.jsx' END ELSE 'app/routes/' || nm || '.$id.' || n || '.ts' END AS path, ['app','pages','flat'][n % 3 + 1] AS convention FROM f)"""


def routes_of(s, d):
    return source_map.route_metadata(source_map.conventional_routes(repo_files(s, d))).select("repo", "route", "path", "title", "description", F.array_join("sections", "|").alias("sections"), F.array_join("params", "|").alias("params"), "auth_required")


def files_read(s, d):
    endings = F.array(*[F.lit(x) for x in (".tsx", ".d.ts", ".test.js", ".vue", ".css", ".HTML", ".js")])
    folders = F.array(*[F.lit(x) for x in ("src", "dist", "node_modules/x", "app", "tests")])
    n = F.col("p_partkey")
    files = table(s, d, "part").select(F.lit("r").alias("repo"), F.concat(F.element_at(folders, (n % 5 + 1).cast("int")), F.lit("/f"), n, F.element_at(endings, (n % 7 + 1).cast("int"))).alias("path"))
    return source_map.source_files(files)


def setup(s, d):
    orgs = table(s, d, "nation").select(F.concat(F.lit("o"), "n_nationkey").alias("org"), F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("platform_name"), F.when(F.col("n_regionkey") < 3, F.col("n_regionkey") > 1).alias("safe_mode"))
    rows = {
        "has_events": table(s, d, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("o"), "c_nationkey").alias("org")),
        "has_elements": table(s, d, "supplier").select(F.concat(F.lit("o"), "s_nationkey").alias("org")),
        "has_interventions": table(s, d, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("o"), "s_nationkey").alias("org")),
    }
    return dashboard.checklist(orgs, rows)


def keys(s, d):
    return table(s, d, "customer").select(F.concat(F.lit("o"), "c_nationkey").alias("org"), F.sha2("c_name", 256).alias("key_hash"), text.token_prefix(F.col("c_mktsegment")).alias("prefix"), F.col("c_custkey").alias("created_at"), F.when(F.col("c_acctbal") < 0, F.lit(1)).alias("revoked_at"))


def revocation(s, d):
    """Keys after the one of an org with the largest hash was revoked."""
    k = keys(s, d)
    last = k.where("org = 'o3'").agg(F.max("key_hash").alias("last"))  # one row
    gone = dashboard.revoked(k.join(F.broadcast(last), F.col("key_hash") == F.col("last"), "left"), "o3", F.col("last"), F.lit(9))
    return gone.groupBy("org", "revoked_at").agg(F.count("*").alias("n"))


def session_page(s, d):
    return dashboard.session_struggles(found(s, d), "s7").select("session_id", "element_id", "type", "severity", "ts_ms")


def element_tables(s, d):
    """What an element's page lists besides its struggles: a row for each of its interventions, cached variants and last events."""
    cached = table(s, d, "part").select(F.concat(F.lit("e"), F.col("p_partkey") % 5).alias("element_id"), F.col("p_type").alias("type"), F.col("p_size").alias("variant_index"), "p_partkey")
    page = dashboard.element_page("e2", interventions(s, d), driver_events(s, d), cached)
    row = lambda name, key, value: page[name].select(F.lit(name).alias("table"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    return row("interventions", F.col("row_id"), F.col("success_rate")).unionByName(row("cache", F.col("p_partkey"), F.col("variant_index"))).unionByName(row("events", F.col("seq"), F.col("ms")))


def toggles(s, d):
    return dashboard.toggled(interventions(s, d), "v5", False).select("row_id", "enabled").unionByName(dashboard.toggled(interventions(s, d), "v6", True).where("row_id = 'v6'").select(F.lit("again").alias("row_id"), "enabled"))


def key_list(s, d):
    c = table(s, d, "customer")
    rows = c.select(F.concat(F.lit("o"), "c_nationkey").alias("org"), text.token_prefix(F.col("c_name")).alias("prefix"), F.col("c_custkey").alias("created_at"), F.when(F.col("c_acctbal") < 0, 1).alias("revoked_at"))
    return dashboard.keys_of(rows, "o3")


def last_frameworks(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_type").alias("framework"), F.col("p_partkey").alias("detected_at"))
    return dashboard.newest_frameworks(p)


def elements_described(s, d):
    o = table(s, d, "orders").select(F.concat(F.lit("e"), F.col("o_custkey") % 50).alias("element_id"), F.col("o_orderkey").alias("enriched_at"), F.col("o_orderpriority").alias("intent"), F.col("o_orderstatus").alias("semantic_name"))
    return dashboard.described_elements(labels(s, d), o)


def helpers(s, d):
    """Hash of a user, hash of a context, and the role that class and text give."""
    css = F.element_at(F.array(*[F.lit(x) for x in ("btn close-x", "retry-link", "help", "menu", "plain")]), (F.col("p_size") % 5 + 1).cast("int"))
    context = text.context_hash({"name": F.col("p_name"), "size": F.when(F.col("p_size") > 9, F.col("p_size"))})
    return table(s, d, "part").select("p_partkey", user_hash(F.col("p_brand")).alias("user"), context.alias("context"), text.inferred_role(css, F.lit("Go"), F.col("p_size") % 10 == 9).alias("role"))


def kept_baselines(s, d):
    """Stored baselines after a run that found fewer elements."""
    e = driver_events(s, d)
    return baselines.stored_baselines(baselines.baselines(e), baselines.baselines(e.where("element_id <> 'e1'"), since_ms=SINCE))


def queries() -> dict:
    e = driver_events
    return {
        "summaries": lambda s, d: detect.detect(e(s, d), only=set(detect.SAID) - {"IDLE_AFTER_LOAD"}, summaries=True).select("session_id", "element_id", "type", "ts_ms", "summary"),
        "counted_summaries": lambda s, d: detect.detect(e(s, d), only={"LOGIN_FAILURE", "PASSWORD_RETRY", "CIRCULAR_NAV", "LONG_DWELL", "RETRY_LOOP", "RAGE_CLICK"}, summaries=True).select("session_id", "element_id", "type", "summary"),
        "detect_as_of": lambda s, d: detect.detect(e(s, d), as_of=AS_OF, only={"DEAD_END", "IDLE_AFTER_LOAD"}),
        "dispatch_guarded": guarded,
        "sampled_events": sampling,
        "session_struggles": session_page,
        "element_tables": element_tables,
        "interventions_toggled": toggles,
        "key_list": key_list,
        "newest_frameworks": last_frameworks,
        "elements_described": elements_described,
        "text_helpers": helpers,
        "stored_baselines": kept_baselines,
        "cached_confidence": cached_confidence,
        "template_roles": template_roles,
        "dispatch_options": options,
        "dispatch_context": context,
        "outcome_counters": lambda s, d: dispatch.counters(interventions(s, d), *outcome_parts(s, d)),
        "impression_rows": lambda s, d: dispatch.impressions(*outcome_parts(s, d)),
        "whole_batches": lambda s, d: ingest.whole_batches(batches(s, d))[0].select("batch_id", "seq", "event_type"),
        "refused_batches": lambda s, d: ingest.whole_batches(batches(s, d))[1].groupBy("batch_id").agg(F.count("*").alias("n")),
        "resolved_orgs": orgs_of_batches,
        "without_types": lambda s, d: ingest.without_types(e(s, d), ["HOVER", "SCROLL"]).groupBy("event_type").agg(F.count("*").alias("n")),
        "metered": meter,
        "remapped": remap,
        "recent_activity": lambda s, d: ingest.recent_activity(e(s, d), NOW, 1_000),
        "baselines_since": lambda s, d: baselines.baselines(e(s, d), since_ms=SINCE),
        "form_elements": form_elements,
        "custom_elements": custom,
        "crawl_modes": lambda s, d: html_map.crawl_mode(table(s, d, "pages")),
        "page_titles": lambda s, d: html_map.metadata(table(s, d, "pages")).select("page_id", "title", "description", F.array_join("sections", "|").alias("headings")),
        "conventional_routes": lambda s, d: source_map.conventional_routes(repo_files(s, d)).drop("source"),
        "route_metadata": routes_of,
        "source_files": files_read,
        "top_types": lambda s, d: dashboard.top_types(found(s, d), SINCE),
        "friction_filtered": lambda s, d: dashboard.filtered_friction(found(s, d), labels(s, d), "LOOP", SINCE).drop("avg_severity"),
        "flow_nodes": lambda s, d: dashboard.flow_nodes(e(s, d)),
        "interventions_list": lambda s, d: dashboard.interventions(interventions(s, d), labels(s, d)),
        "latest_interventions": lambda s, d: dashboard.interventions(interventions(s, d), labels(s, d), 10).select("row_id", "label", "copy", "created"),
        "active_interventions": lambda s, d: dashboard.active_interventions(interventions(s, d)),
        "description_counts": lambda s, d: dashboard.description_counts(labels(s, d), interventions(s, d).where("copy is not null")),
        "keys_revoked": revocation,
        "setup_checklist": setup,
        "number_formats": lambda s, d: table(s, d, "customer").select("c_custkey", text.number(F.col("c_custkey") * 12345).alias("number"), text.percent(F.col("c_custkey") % 7 / 7).alias("percent"), text.is_element_id(F.concat(F.lit("sh_"), F.substring(F.sha2("c_name", 256), F.lit(1), (F.col("c_custkey") % 3 + 31).cast("int")))).alias("is_id")),
    }


def since_sql() -> str:
    """SQL of the baselines of the events since a time."""
    whole = engine_queries.oracle_sql()["baselines"][len(E) :]
    return E + f", es AS (SELECT * FROM e WHERE ms >= {SINCE})" + re.sub(r"\b(FROM|JOIN) e\b", r"\1 es", whole)


def oracle_sql() -> dict[str, str]:
    all_rules = rule_sql()["detect_all"]
    texts = ", ".join(f"('{k}', '{v}')" for k, v in detect.SAID.items() if k != "IDLE_AFTER_LOAD")
    ch = engine_queries.oracle_sql()["choose_variant"]
    few = ", ".join(f"'{k}'" for k in sorted(FEW))
    moves = "SELECT session_id, ms, seq, route, nr FROM (SELECT *, lead(route) OVER (PARTITION BY session_id ORDER BY ms, seq) AS nr FROM (SELECT * FROM e WHERE et = 'NAVIGATION')) WHERE route <> nr"
    last = "last AS (SELECT session_id, coalesce(arg_max(route, seq) FILTER (et = 'NAVIGATION'), arg_min(route, seq)) AS route FROM e GROUP BY 1)"
    no_copy = "coalesce(copy, CASE kind WHEN 'DOM' THEN '(DOM mutation)' WHEN 'BEHAVIOR' THEN '(behavior override)' WHEN 'AUTO_FIX' THEN '(auto-fix)' END, '') AS copy"
    strip = lambda x: f"nullif(trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '')"
    batch = "b AS (SELECT seq // 25 AS batch_id, seq, CASE WHEN et = 'HOVER' AND seq % 50 = 0 THEN 'WINK' ELSE et END AS event_type FROM e)"
    return {
        "summaries": f"SELECT session_id, element_id, type, ts_ms, said AS summary FROM ({all_rules}) JOIN (VALUES {texts}) v(kind, said) ON type = kind",
        "counted_summaries": E + f""", n AS (SELECT session_id, el, count(*) FILTER (et = 'CLICK') AS clicks, count(*) FILTER (et = 'CLICK' AND role = 'retry') AS retries FROM e GROUP BY 1, 2),
            m AS (SELECT session_id, count(*) FILTER (et = 'VALIDATION_ERROR' AND mkind = 'login') AS logins FROM e GROUP BY 1),
            c AS (SELECT session_id, count(*) FILTER (route = r2 AND r1 = r3 AND route <> r1) AS cycles FROM (SELECT session_id, route, lag(route) OVER w AS r1, lag(route, 2) OVER w AS r2, lag(route, 3) OVER w AS r3 FROM e WHERE et = 'NAVIGATION' WINDOW w AS (PARTITION BY session_id ORDER BY ms, seq)) GROUP BY 1),
            w AS (SELECT session_id, el, arg_min(k, (ms, seq)) AS secs FROM e WHERE et = 'DWELL' AND k >= 30 GROUP BY 1, 2)
            SELECT d.session_id, d.element_id, type, CASE type WHEN 'LOGIN_FAILURE' THEN 'Login attempt failed' WHEN 'RAGE_CLICK' THEN clicks || ' clicks within 2000ms' WHEN 'PASSWORD_RETRY' THEN logins || ' login failures'
              WHEN 'RETRY_LOOP' THEN 'Hit retry ' || retries || ' times' WHEN 'CIRCULAR_NAV' THEN 'Bouncing between ' || (cycles + 1) || ' routes' ELSE 'Stared at this for ' || secs || 's' END AS summary
            FROM ({all_rules}) d LEFT JOIN n ON n.session_id = d.session_id AND n.el IS NOT DISTINCT FROM element_id LEFT JOIN m ON m.session_id = d.session_id LEFT JOIN c ON c.session_id = d.session_id LEFT JOIN w ON w.session_id = d.session_id AND w.el IS NOT DISTINCT FROM element_id
            WHERE type IN ('LOGIN_FAILURE', 'PASSWORD_RETRY', 'CIRCULAR_NAV', 'LONG_DWELL', 'RETRY_LOOP', 'RAGE_CLICK')""",
        "detect_as_of": E + f""", l AS (SELECT session_id, arg_max(et, (ms, seq)) AS et, arg_max(coalesce(trig, ''), (ms, seq)) AS trig, max(ms) AS ts_ms FROM e GROUP BY 1)
            SELECT session_id, CAST(NULL AS VARCHAR) AS element_id, type, CAST(0.45 AS DOUBLE) AS severity, ts_ms FROM l, (VALUES ('DEAD_END', 20000), ('IDLE_AFTER_LOAD', 15000)) v(type, idle)
            WHERE et = 'NAVIGATION' AND {AS_OF} - ts_ms >= idle AND (type = 'DEAD_END' OR trig = 'initial')""",
        "dispatch_guarded": f"""WITH ch0 AS (SELECT * FROM ({ch})), ev AS ({E} SELECT * FROM e), last AS (SELECT session_id, coalesce(arg_max(route, seq) FILTER (et = 'NAVIGATION'), arg_min(route, seq)) AS route FROM ev GROUP BY 1),
            al AS (SELECT session_id, element_id, type, ts_ms, variant_index AS v FROM ch0 UNION ALL SELECT session_id, element_id, type, ts_ms + 1, (variant_index + 1) % 3 FROM ch0 WHERE type IN ('RAGE_CLICK', 'LONG_DWELL', 'HOVER_HUNT')),
            o AS (SELECT *, coalesce(element_id = 'e0', false) AND type IN ('RAGE_CLICK', 'LONG_DWELL', 'HOVER_HUNT') AS confirm FROM al JOIN last USING (session_id) WHERE route <> '/r1'),
            i AS (SELECT * REPLACE (CAST(CASE WHEN confirm THEN -1 ELSE v END AS INTEGER) AS v) FROM o),
            n AS (SELECT *, {engine_queries.named("type || '|' || coalesce(element_id, '_') || '|v' || v")} AS row_id, {engine_queries.named("session_id || '|' || type || '|' || coalesce(element_id, '_') || '|v' || v")} AS tracking_id FROM i)
            SELECT session_id, element_id, type, v AS variant_index, row_id, tracking_id, confirm FROM n
            WHERE row_id NOT IN (SELECT row_id FROM ch0 WHERE type = 'JS_ERROR' AND variant_index = 1) AND tracking_id NOT IN (SELECT tracking_id FROM ch0 WHERE session_id LIKE '%7')
            QUALIFY row_number() OVER (PARTITION BY tracking_id ORDER BY ts_ms) = 1""",
        "cached_confidence": f"""WITH ch AS (SELECT * FROM ({ch})), c AS (SELECT 'e' || p AS element_id, type, v AS variant_index, CASE WHEN (v + length(type)) % 4 <> 0 THEN (length(type) * 3 + v - 20 * p) / 10.0::DOUBLE END AS stated, 'help ' || v AS help
              FROM range(0, 3) a(p), range(3) b(v), (VALUES ('RAGE_CLICK'), ('LOOP'), ('LONG_DWELL'), ('JS_ERROR'), ('SILENT_FAIL'), ('DEAD_CLICK')) t(type) WHERE p IN (SELECT p_partkey FROM part))
            SELECT session_id, ch.element_id, ch.type, ch.variant_index, CASE WHEN stated IS NULL THEN confidence ELSE greatest(0.0::DOUBLE, least(0.99::DOUBLE, stated)) END AS confidence, help AS cached_help
            FROM ch LEFT JOIN c ON c.element_id = ch.element_id AND c.type = ch.type AND c.variant_index = ch.variant_index""",
        "dispatch_options": f"""WITH ch AS (SELECT * FROM ({ch})), c AS (SELECT *, CAST(CASE WHEN session_id LIKE '%3' THEN -1 ELSE variant_index END AS INTEGER) AS v,
              type IN ('RAGE_CLICK', 'LOOP', 'LONG_DWELL', 'JS_ERROR', 'SILENT_FAIL', 'DEAD_CLICK') AS known FROM ch),
            o AS (SELECT *, CASE WHEN known AND v >= 0 AND (v + length(type)) % 2 = 0 THEN 'body' END AS target, CASE WHEN known AND v = 1 THEN 'warn' END AS severity_opt FROM c)
            SELECT session_id, element_id, type, v AS variant_index, target IS NOT NULL OR severity_opt IS NOT NULL AS has_options, target, severity_opt, CASE WHEN known AND v = 2 THEN 5000 ELSE 0 END AS auto_dismiss_ms FROM o""",
        "template_roles": f"""WITH p AS (SELECT p_partkey AS page_id, p_size AS n, CAST(p_partkey % {len(TEMPLATE_BUTTONS)} AS INTEGER) + 1 AS nth FROM part),
            b AS (SELECT page_id, 'button' AS tag, {list(TEMPLATE_BUTTONS)}[nth] AS label, CASE WHEN n % 4 = 1 THEN 'TOGGLE' ELSE {str(list(TEMPLATE_ROLES)).replace("None", "NULL")}[nth] END AS semantic_role FROM p
              UNION ALL SELECT page_id, 'a', 'x', 'EXPAND' FROM p UNION ALL SELECT page_id, 'input', 'Go', 'SUBMIT' FROM p)
            SELECT *, coalesce(semantic_role IN ('DANGER', 'DELETE', 'LOGOUT'), false) AS destructive FROM b""",
        "session_struggles": f"SELECT session_id, element_id, type, severity, ts_ms FROM ({all_rules}) WHERE session_id = 's7'",
        "element_tables": f"""WITH {INTERVENTIONS}, ev AS ({E} SELECT * FROM e)
            SELECT 'interventions' AS "table", row_id AS key, success_rate::DOUBLE AS value FROM iv WHERE element_id = 'e2'
            UNION ALL SELECT 'cache', CAST(p_partkey AS VARCHAR), p_size::DOUBLE FROM part WHERE p_partkey % 5 = 2
            UNION ALL SELECT * FROM (SELECT 'events', CAST(seq AS VARCHAR), ms::DOUBLE FROM ev WHERE el = 'e2' ORDER BY ms DESC, seq DESC LIMIT 20)""",
        "interventions_toggled": f"WITH {INTERVENTIONS} SELECT row_id, enabled AND row_id <> 'v5' AS enabled FROM iv UNION ALL SELECT 'again', true FROM iv WHERE row_id = 'v6'",
        "key_list": "SELECT substr(c_name, 1, 8) AS prefix, c_custkey AS created_at, CASE WHEN c_acctbal < 0 THEN 1 END AS revoked_at FROM customer WHERE c_nationkey = 3",
        "newest_frameworks": "SELECT p_brand AS repo, p_type AS framework, p_partkey AS detected_at FROM part ORDER BY p_partkey DESC, p_brand, p_type LIMIT 20",
        "elements_described": """SELECT element_id, p_name AS label, p_brand AS route, enriched_at, intent, semantic_name FROM (SELECT 'e' || p_partkey AS element_id, p_name, p_brand FROM part) p
            LEFT JOIN (SELECT 'e' || (o_custkey % 50) AS element_id, max(o_orderkey) AS enriched_at, arg_max(o_orderpriority, o_orderkey) AS intent, arg_max(o_orderstatus, o_orderkey) AS semantic_name FROM orders GROUP BY 1) o USING (element_id)""",
        "text_helpers": """SELECT p_partkey, substr(sha256(p_brand), 1, 32) AS "user", sha256('{"name":"' || p_name || '","size":' || CASE WHEN p_size > 9 THEN CAST(p_size AS VARCHAR) ELSE 'null' END || '}') AS context,
            CASE WHEN p_size % 5 < 4 THEN ['dismiss', 'retry', 'help', 'menu'][p_size % 5 + 1] WHEN p_size % 10 = 9 THEN 'menu' END AS role FROM part""",
        "stored_baselines": f"WITH o AS ({engine_queries.oracle_sql()['baselines']}), n AS ({since_sql()}) SELECT * FROM n WHERE element_id <> 'e1' UNION ALL SELECT * FROM o WHERE element_id NOT IN (SELECT element_id FROM n WHERE element_id <> 'e1')",
        "sampled_events": """WITH k AS (SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN 'CLICK' WHEN o_orderkey % 11 = 0 THEN 'JS_ERROR' WHEN o_orderkey % 11 = 1 THEN 'HOVER' ELSE 'CUSTOM' END AS event_type FROM orders),
            e AS (SELECT *, CASE WHEN event_type = 'CUSTOM' THEN ['intervention_shown','intervention_success','intervention_dismissed','other'][key % 4 + 1] END AS m_kind FROM k),
            f AS (SELECT *, event_type = 'JS_ERROR' OR coalesce(m_kind LIKE 'intervention_%', false) AS stays, CAST('0x' || substr(sha256(CAST(key AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM e)
            SELECT "by", event_type, m_kind, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM (
              SELECT 'rate' AS "by", * FROM f WHERE stays OR u < CASE event_type WHEN 'CLICK' THEN 0.25 WHEN 'HOVER' THEN 1.0 ELSE 0.1 END
              UNION ALL SELECT 'condition', * FROM f WHERE stays OR key % 5 = 0) GROUP BY 1, 2, 3""",
        "dispatch_context": f"""WITH d AS (SELECT * FROM ({all_rules})), ev AS ({E} SELECT * FROM e), last AS (SELECT session_id, coalesce(arg_max(route, seq) FILTER (et = 'NAVIGATION'), arg_min(route, seq)) AS route FROM ev GROUP BY 1),
            t AS (SELECT session_id, 'At ' || arg_max(route, seq) AS title FROM ev WHERE et = 'CLICK' GROUP BY 1),
            so AS (SELECT 'e' || (o_custkey % 50) AS element_id, o_orderdate, o_orderpriority, CASE WHEN o_custkey % 50 <> 1 THEN 'N' || (o_custkey % 7) END AS name, 'H' || (o_custkey % 3) AS help FROM orders),
            sem AS (SELECT element_id, arg_max(o_orderpriority, k) AS intent, arg_max(name, k) AS name, arg_max(help, k) AS help FROM (SELECT *, (o_orderdate, o_orderpriority, coalesce(name, ''), help) AS k FROM so) GROUP BY 1)
            SELECT d.session_id, d.element_id, type, severity, ts_ms, coalesce(sem.name, p_name) AS label, help AS help_copy, CASE WHEN n_nationkey <> 2 THEN 'stage' || n_regionkey END AS journey_stage, CASE WHEN p_size < 25 THEN 'SUBMIT' END AS role, p_type AS validation, intent, route, coalesce(t.title, n_name) AS page_title, CASE WHEN n_nationkey <> 2 THEN 'p' || n_regionkey END AS route_purpose
            FROM d LEFT JOIN part ON d.element_id = 'e' || p_partkey LEFT JOIN sem ON sem.element_id = d.element_id LEFT JOIN last ON last.session_id = d.session_id LEFT JOIN t ON t.session_id = d.session_id LEFT JOIN nation ON route = '/r' || n_nationkey""",
        "outcome_counters": f"""WITH {INTERVENTIONS}, {OUTCOMES}, a AS (SELECT row_id, count(*) FILTER (kind = 'intervention_shown') AS i, count(*) FILTER (kind = 'intervention_success') AS su, count(*) FILTER (kind = 'intervention_dismissed') AS di FROM oc GROUP BY 1)
            SELECT row_id, impressions + coalesce(i, 0) AS impressions, successes + coalesce(su, 0) AS successes, dismissals + coalesce(di, 0) AS dismissals,
              CASE WHEN impressions + coalesce(i, 0) > 0 THEN (successes + coalesce(su, 0)) / (impressions + coalesce(i, 0)) ELSE 0.0 END AS success_rate FROM iv LEFT JOIN a USING (row_id)""",
        "impression_rows": f"WITH {OUTCOMES} SELECT row_id, session_id, CASE kind WHEN 'intervention_shown' THEN 'ABANDON' WHEN 'intervention_success' THEN 'SUCCESS' ELSE 'DISMISSED' END AS outcome, ms FROM oc",
        "whole_batches": E + f", {batch} SELECT * FROM b WHERE batch_id NOT IN (SELECT batch_id FROM b WHERE event_type = 'WINK')",
        "refused_batches": E + f", {batch} SELECT batch_id, count(*) AS n FROM b WHERE batch_id IN (SELECT batch_id FROM b WHERE event_type = 'WINK') GROUP BY 1",
        "resolved_orgs": """WITH r AS (SELECT c_acctbal > 0 AS token, n_regionkey <> 1 AS live, 'n' || c_nationkey AS mine, c_nationkey + CASE WHEN c_acctbal < -500 THEN 20 ELSE 0 END AS header FROM customer JOIN nation ON c_nationkey = n_nationkey),
            o AS (SELECT CASE WHEN token AND live THEN mine WHEN NOT token THEN 'n' || header END AS org, header FROM r)
            SELECT org, CASE WHEN org IS NULL THEN 'no_key' WHEN CAST(substr(org, 2) AS INTEGER) > 24 THEN 'unknown_org' END AS reason, count(*) AS n FROM o GROUP BY 1, 2""",
        "without_types": E + " SELECT et AS event_type, count(*) AS n FROM e WHERE et NOT IN ('HOVER', 'SCROLL') GROUP BY 1",
        "metered": """SELECT org, month, CAST(sum(e) AS BIGINT) AS events, CAST(sum(i) AS BIGINT) AS interventions, CAST(sum(t) AS BIGINT) AS tokens FROM (
            SELECT 'o' || (o_custkey % 7) AS org, strftime(o_orderdate, '%Y-%m') AS month, 1 AS e, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS i, CASE WHEN o_orderstatus = 'O' THEN o_custkey % 10 ELSE 0 END AS t FROM orders
            UNION ALL SELECT 'o' || n_regionkey, '1996-01', 5, 1, 2 FROM nation) GROUP BY 1, 2""",
        "remapped": """SELECT 'o' || c_nationkey AS org, 'e' || c_custkey AS id, c_name AS label FROM customer WHERE c_nationkey < 10
            UNION ALL SELECT 'o' || s_nationkey, 'e' || s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 10)""",
        "recent_activity": E + f" SELECT count(*) FILTER (ms > {NOW - 1_000}) AS events_hour, count(*) FILTER (ms > {NOW - 24_000}) AS events_day, count(DISTINCT session_id) FILTER (ms > {NOW - 1_000}) AS sessions_hour, count(DISTINCT session_id) FILTER (ms > {NOW - 24_000}) AS sessions_day FROM e",
        "baselines_since": since_sql(),
        "form_elements": FORM_ELEMENTS,
        "custom_elements": "SELECT p_partkey AS page_id, 'div[custom-0]' AS descriptor, 'div' AS tag, 'T' AS label, NULL AS handler, '/h' AS route_target, 'htmx' AS tags FROM part UNION ALL SELECT p_partkey, 'span[custom-1]', 'span', NULL, 'open = true', NULL, 'alpine-or-vue' FROM part",
        "crawl_modes": r"""SELECT page_id, CAST(n AS INTEGER) AS elements, CASE WHEN n < 3 OR n < 4 AND (regexp_matches(html, '(?i)<div[^>]+id=["''](?:root|app|__next|svelte)["'']') OR regexp_matches(html, '(?i)<script[^>]+type=["'']module["'']')) THEN 'headless' ELSE 'http' END AS mode
            FROM (SELECT *, len(regexp_extract_all(html, '(?i)<(?:button|input|textarea|select|form|a)\b[^>]*>')) AS n FROM pages)""",
        "page_titles": rf"""SELECT page_id, substr(coalesce({strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, {strip("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}), 1, 200) AS title,
            substr(nullif(regexp_extract(html, '(?i)<meta[^>]+name=["'']description["''][^>]+content=["'']([^"'']+)["'']', 1), ''), 1, 500) AS description,
            array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[23][^>]*>(.*?)</h[23]>', 1), lambda h: substr({strip("h")}, 1, 120)), lambda h: h IS NOT NULL)[1:12], '|') AS headings FROM pages""",
        "conventional_routes": f"WITH {FILES} SELECT repo, route, path, convention FROM r",
        "route_metadata": f"WITH {FILES} SELECT repo, route, path, p_name AS title, 'of ' || p_brand AS description, 'One ' || n || '|Two' AS sections, CASE WHEN convention = 'flat' THEN 'id' ELSE '' END AS params, n > 25 AS auth_required FROM r",
        "source_files": """SELECT 'r' AS repo, path, kind FROM (SELECT ['src','dist','node_modules/x','app','tests'][p_partkey % 5 + 1] AS d, ['script',NULL,NULL,'template',NULL,'template','script'][p_partkey % 7 + 1] AS kind,
            d || '/f' || p_partkey || ['.tsx','.d.ts','.test.js','.vue','.css','.HTML','.js'][p_partkey % 7 + 1] AS path FROM part) WHERE kind IS NOT NULL AND d IN ('src', 'app', 'tests')""",
        "top_types": f"SELECT type, count(*) AS n FROM ({all_rules}) WHERE ts_ms >= {SINCE} GROUP BY 1 ORDER BY n DESC, type LIMIT 5",
        "friction_filtered": f"SELECT g.*, p_name AS label, p_brand AS route FROM (SELECT element_id, type, count(*) AS n, max(ts_ms) AS last_ms FROM ({all_rules}) WHERE ts_ms >= {SINCE} AND type = 'LOOP' GROUP BY 1, 2) g LEFT JOIN part ON element_id = 'e' || p_partkey",
        "flow_nodes": E + f", m AS ({moves}), x AS (SELECT session_id, ms, seq, 0 AS side, route FROM m UNION ALL SELECT session_id, ms, seq, 1, nr FROM m) SELECT route, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS node FROM (SELECT route, min((session_id, ms, seq, side)) AS f FROM x GROUP BY 1)",
        "interventions_list": f"WITH {INTERVENTIONS} SELECT row_id, label, kind, {no_copy}, enabled, impressions, successes, dismissals, success_rate, created FROM iv JOIN lb USING (element_id)",
        "latest_interventions": f"WITH {INTERVENTIONS} SELECT row_id, label, {no_copy}, created FROM iv JOIN lb USING (element_id) ORDER BY created DESC, row_id LIMIT 10",
        "active_interventions": f"WITH {INTERVENTIONS} SELECT count(*) FILTER (enabled) AS active, count(*) AS interventions FROM iv",
        "description_counts": f"WITH {INTERVENTIONS} SELECT count(*) FILTER (element_id IN (SELECT element_id FROM iv WHERE copy IS NOT NULL)) AS described, count(*) FILTER (element_id NOT IN (SELECT element_id FROM iv WHERE copy IS NOT NULL)) AS undescribed FROM lb",
        "keys_revoked": "WITH k AS (SELECT 'o' || c_nationkey AS org, CASE WHEN c_acctbal < 0 THEN 1 WHEN c_nationkey = 3 AND sha256(c_name) = max(sha256(c_name)) OVER (PARTITION BY c_nationkey) THEN 9 END AS revoked_at FROM customer) SELECT org, revoked_at, count(*) AS n FROM k GROUP BY 1, 2",
        "setup_checklist": """SELECT 'o' || n_nationkey AS org, n_regionkey > 0 AS named, coalesce(n_regionkey <= 1, false) AS safe_mode_off, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AS has_events,
            n_nationkey IN (SELECT s_nationkey FROM supplier) AS has_elements, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS has_interventions FROM nation""",
        "number_formats": "SELECT c_custkey, format('{:,}', c_custkey * 12345) AS number, printf('%.1f', (c_custkey % 7) / 7 * 100) || '%' AS percent, c_custkey % 3 = 1 AS is_id FROM customer",
    }
