import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from friction.functions.ids import java_hash, row_id
from friction.functions.scrub import scrub
from friction.operators.baselines import upper_percentile
from friction.operators.detect import detect
from friction.operators.dispatch import counters, choose, dispatch, last_titles, with_options
from friction.operators.html_map import elements, metadata
from friction.operators.ingest import demo_events, event_batches, first_by_key, sampled, throttled, unseen_struggles, validated
from friction.schema import EVENT_COLUMNS
from friction.streaming.rage import observe, rage_clicks, timed
from friction.streaming.store import store_once

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["friction_table", "flow_map", "baselines", "last_routes", "usage", "store_once", "history", "element_map", "page_metadata", "scrub", "java_hash", "choose_variant", "detect_all", "rule_hover_hunt", "rule_rapid_scroll"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf).toPandas(), c.execute(entry.oracle_sql()[name]).df()
    order = lambda df: df[sorted(df)].sort_values(sorted(df)).reset_index(drop=True)
    assert len(want) > 0
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_every_query_of_the_engine_has_sql():
    assert {k for k in entry.queries() if not k.startswith("op") and k != "pipeline"} <= set(entry.oracle_sql())


def test_ids(spark):
    h = lambda s: spark.range(1).select(java_hash(F.lit(s))).first()[0]
    assert [h("sess_1:LOOP"), h(f"RAGE_CLICK|sh_{'a' * 32}|v0"), h("")] == [-2130872070, -453810734, 0]
    assert spark.range(1).select(row_id(F.lit("RAGE_CLICK"), F.lit("sh_" + "a" * 32), F.lit("0"))).first()[0] == "iv_1b0c9a2e1b0c9a2e"


def test_scrub(spark):
    for text, want in [("éabc@x.com", "é[redacted]"), ("card 4111 1111 1111 1111!", "card [redacted]!"), ("ssn 123-45-6789", "ssn [redacted]"), ("call 555-123-4567", "call [redacted]"), ("10.0.0.1 up", "[redacted] up"), ("nothing 12", "nothing 12")]:
        assert spark.range(1).select(scrub(F.lit(text))).first()[0] == want


def test_percentile_is_the_upper_nearest_rank(spark):
    for n, want in ((20, 19.0), (1, 0.0), (19, 18.0)):
        rows = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("x"))
        assert upper_percentile(rows, "k", "x", 0.95, "p").first().p == want


D = "session_id string, element_id string, type string, severity double, ts_ms long"


def test_bandit_dispatch_and_outcomes(spark):
    d = spark.createDataFrame([(f"s{i}", "e", "LOOP", 0.5, i) for i in range(300)], D)
    ids = [spark.range(1).select(row_id(F.lit("LOOP"), F.lit("e"), F.lit(str(v)))).first()[0] for v in range(3)]
    warm = spark.createDataFrame([(ids[0], 100, 10), (ids[1], 100, 80), (ids[2], 100, 30)], "row_id string, impressions long, successes long")
    assert {r.variant_index for r in choose(d, warm, 3, epsilon=0.0).collect()} == {1}
    assert {r.variant_index for r in choose(d, warm, 3, epsilon=1.0).collect()} == {0, 1, 2}
    cold = warm.withColumn("impressions", F.lit(5).cast("long"))
    assert {r.variant_index for r in choose(d, cold, 3).collect()} == {0, 1, 2}
    chosen = choose(d, warm, 3, epsilon=0.0)
    routes = spark.createDataFrame([("s1", "/no"), ("s2", "/yes")], "session_id string, route string")
    assert dispatch(chosen, routes, denied=["/no"], safe_mode=False).count() == 299 and dispatch(chosen, routes, safe_mode=True).count() == 0
    hunt = spark.createDataFrame([("s", "e", "LONG_DWELL", 0.3, 1)], D)
    roles = spark.createDataFrame([("e", "DELETE")], "element_id string, role string")
    picked = choose(hunt, warm, 3).crossJoin(spark.createDataFrame([(0,), (1,), (2,)], "v int")).withColumn("variant_index", F.col("v")).withColumn("tracking_id", F.concat("tracking_id", "v")).drop("v")
    asked = dispatch(picked, routes, roles=roles, safe_mode=False).collect()
    assert [(r.variant_index, r.row_id) for r in asked] == [(-1, spark.range(1).select(row_id(F.lit("LONG_DWELL"), F.lit("e"), F.lit("-1"))).first()[0])]
    ledger = chosen.select("tracking_id", "row_id")
    first = ledger.first()
    stats = warm.withColumn("dismissals", F.lit(0).cast("long"))
    outcomes = spark.createDataFrame([(first.tracking_id, "intervention_shown"), (first.tracking_id, "intervention_success")], "tracking_id string, kind string")
    after = {r.row_id: r for r in counters(stats, outcomes, ledger).collect()}
    assert (after[ids[1]].impressions, after[ids[1]].successes) == (101, 81)


def test_ingest(spark):
    rows = [tuple({"session_id": s, "route": r, "event_type": t, "ms": 1, "seq": i}.get(c) for c in EVENT_COLUMNS) for i, (s, r, t) in enumerate([("a", "/", "CLICK"), ("", "/", "CLICK"), ("a", None, "CLICK"), ("a", "/", "WINK"), (None, "/", "HOVER"), ("a", "/", "HOVER")])]
    events = spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in EVENT_COLUMNS.items()))
    good, bad = validated(events)
    assert good.count() == 2 and sorted(r.reason for r in bad.collect()) == ["event_type", "route", "session_id", "session_id"]
    assert first_by_key(events, ["session_id", "route"], ["seq"]).count() == 4
    assert sampled(events, 0.0, {"CLICK": float("nan")}, F.col("seq")).count() == 3
    d = spark.createDataFrame([("s", None, "LOOP", 0.5, 10), ("s", "e", "LOOP", 0.5, 10)], D)
    assert unseen_struggles(d, d.where("element_id is null"), 0).count() == 1


def test_html(spark):
    html = """<title> A  page </title><h2>x</h2><form action="/f"><input type="submit" value="Go" aria-label="Go on"><a href='/q'>See <b>more</b></a></form><div id="root"></div>"""
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    got = [(r.tag, r.tag_index, r.href, r.label, r.semantic_role) for r in elements(pages).collect()]
    assert ("input", 0, None, "Go on", "SUBMIT") in got and ("a", 0, "/q", "See more", "NAV") in got
    m = metadata(pages).first()
    assert (m.title, m.sections, m.spa_shell) == ("A page", ["x"], True)


def test_html_labels_forms_and_fallbacks(spark):
    html = """<meta property="og:title" content="Shared"><script type="application/ld+json">{"description": "Stated"}</script>
      <input type=submit value=Go><a title="" href="/a" href="/b">No end <b>tag</b>
      <form name="n1"><button aria-label="Pay" class="icon" onclick="function_that_is_far_too_long_to_show + 1"></button><select disabled><option>x</option></select></form>
      <form><input minlength="3" maxlength="x" pattern="[a-z]+" step=2></form><button>out</button>"""
    pages = spark.createDataFrame([(1, "u", html), (2, "v", ""), (3, "w", None)], "page_id long, url string, html string")
    got = {(r.tag, r.tag_index): r for r in elements(pages).collect()}
    assert (got["input", 0].label, got["input", 0].semantic_role, got["input", 0].form_context) == ("Go", "SUBMIT", None)
    assert got["a", 0].href == "/b" and got["a", 0].label.startswith("No end tag")
    assert [got[k].form_context for k in (("form", 0), ("button", 0), ("select", 0), ("form", 1), ("input", 1), ("button", 1))] == ["n1", "n1", "n1", "(unnamed-form)", "(unnamed-form)", None]
    assert got["button", 0].label == "Pay" and got["button", 0].handler == "(inline)" and got["select", 0].tags == ["disabled"]
    assert got["input", 1].validation == '{"minLength":3,"pattern":"[a-z]+","step":"2"}'
    m = {r.page_id: r for r in metadata(pages).collect()}
    assert (m[1].title, m[1].description, m[1].spa_shell) == ("Shared", "Stated", False) and m[2].title is None


def test_summaries(spark):
    rows = [dict(session_id="s", element_id="e", route="/a", event_type="CLICK", ms=1000 + i, seq=i) for i in range(4)]
    rows += [dict(session_id="s", element_id="f", route="/a", event_type="DWELL", ms=9000, seq=9, m_ms=200_500.0), dict(session_id="s", element_id="f", route="/a", event_type="JS_ERROR", ms=9001, seq=10, m_message="x is null")]
    rows += [dict(session_id="s", route="/r", event_type="NAVIGATION", ms=20_000 + i * 5000, seq=20 + i) for i in range(3)]
    rows += [dict(session_id="s", element_id="g", route="/a", event_type="SUBMIT", ms=50_000, seq=30, el_validity="tooShort,x")]
    events = spark.createDataFrame([tuple(r.get(c) for c in EVENT_COLUMNS) for r in rows], ", ".join(f"{k} {v}" for k, v in EVENT_COLUMNS.items()))
    base = spark.createDataFrame([("f", None, 90_000.0, None, 30)], "element_id string, p95_clicks_per_sec double, p95_dwell_ms double, p95_hovers_before_click double, sample_size int")
    said = {r.type: r.summary for r in detect(events, baselines=base, summaries=True).collect()}
    assert said["RAGE_CLICK"] == "4 clicks within 2000ms" and said["LONG_DWELL"] == "Stared at this for 201s (adapted threshold: 135s)"
    assert said["JS_ERROR"] == "x is null" and said["LOOP"] == "Visited /r 3 times" and said["FORMAT_ERROR"] == "Native validity: tooShort"


def test_options_titles_and_safe_mode(spark):
    chosen = spark.createDataFrame([("s", "LOOP", 0), ("s", "LOOP", -1), ("s", "THRASH", 0)], "session_id string, type string, variant_index int")
    templates = spark.createDataFrame([("LOOP", 0, "#x", None, 500), ("THRASH", 0, None, None, None)], "type string, variant_index int, target string, severity_opt string, auto_dismiss_ms int")
    got = {(r.type, r.variant_index): (r.options and r.options.target, r.auto_dismiss_ms) for r in with_options(chosen, templates).collect()}
    assert got == {("LOOP", 0): ("#x", 500), ("LOOP", -1): (None, 0), ("THRASH", 0): (None, 0)}
    events = spark.createDataFrame([("s", 1, "A"), ("s", 2, ""), ("t", 3, None)], "session_id string, seq long, page_title string")
    assert [tuple(r) for r in last_titles(events).collect()] == [("s", "A")]
    routes = spark.createDataFrame([("s", "/")], "session_id string, route string")
    shown = chosen.selectExpr("*", "concat(type, variant_index) tracking_id", "1 ts_ms")
    assert dispatch(shown, routes).count() == 0 and dispatch(shown, routes, safe_mode=False).count() == 3


def test_scroll_throttle_against_a_loop(spark):
    rnd = random.Random(2)
    rows = [(f"s{i % 7}", "SCROLL" if i % 5 else "CLICK", rnd.randint(0, 9000), i) for i in range(600)]
    kept = []
    for s in range(7):
        last = None
        for _, t, ms, seq in sorted((r for r in rows if r[0] == f"s{s}" and r[1] == "SCROLL"), key=lambda r: r[2:]):
            if last is None or ms - last >= 200:
                kept.append(seq)
                last = ms
    got = throttled(spark.createDataFrame(rows, "session_id string, event_type string, ms long, seq long"))
    assert sorted(r.seq for r in got.collect()) == sorted(kept + [r[3] for r in rows if r[1] == "CLICK"])


def test_json_batches_and_demo(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"token": "ck_1", "events": [{"session_id": "s", "ms": 1}, {"session_id": "s", "ms": 2}]}\n{"org": "o", "events": [{"session_id": "t", "ms": 3}]}\n')
    got = event_batches(spark, str(tmp_path), "session_id string, ms long").collect()
    assert sorted((r.token, r.org, r.seq, r.ms, r.batch_size) for r in got if r.token) == [("ck_1", None, 0, 1, 2), ("ck_1", None, 1, 2, 2)]
    assert len({r.batch_id for r in got}) == 2
    demo = demo_events(spark).collect()
    assert len(demo) == 8 * 5 + 3 * 4 and sum(r.event_type == "CLICK" for r in demo) == 12


def test_rage_clicks_reset_when_they_fire():
    clicks, fired = [], []
    for ms in (0, 100, 200, 300, 400, 500, 5000):
        clicks, fires = observe(clicks, ms)
        fired.append(fires)
    assert fired == [False, False, True, False, False, True, False]


def test_streams(spark, tmp_path):
    schema = ", ".join(f"{k} {v}" for k, v in EVENT_COLUMNS.items())
    row = lambda i, ms: tuple({"session_id": "s", "element_id": "e", "event_type": "CLICK", "ms": ms, "seq": i}.get(c) for c in EVENT_COLUMNS)
    for n, ms in enumerate([(0, 100), (200, 5000)]):
        spark.createDataFrame([row(10 * n + i, m) for i, m in enumerate(ms)] + [row(0, 0)] * n, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store_once(stream, str(tmp_path / "table"), str(tmp_path / "cp"), ["seq"], ["ms"]).awaitTermination()
    assert sorted(r.ms for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [0, 100, 200, 5000]
    clean = spark.readStream.schema(schema).parquet(str(tmp_path / "table"))
    q = rage_clicks(timed(clean)).writeStream.format("memory").queryName("rage").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.ms for r in spark.sql("select * from rage").collect()] == [200]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    """The checkpoint is lost, so every batch comes again: keys are known, and rows without a key replace themselves."""
    schema = ", ".join(f"{k} {v}" for k, v in EVENT_COLUMNS.items())
    row = lambda i, ms: tuple({"session_id": "s", "element_id": "e", "event_type": "CLICK", "ms": ms, "seq": i}.get(c) for c in EVENT_COLUMNS)
    spark.createDataFrame([row(1, 10), row(None, 20), row(1, 10)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for run in "ab":
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        store_once(stream, str(tmp_path / "table"), str(tmp_path / run), ["seq"], ["ms"]).awaitTermination()
        assert sorted(r.ms for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [10, 20]


def test_state_of_quiet_elements_goes(spark, tmp_path):
    schema = ", ".join(f"{k} {v}" for k, v in EVENT_COLUMNS.items())
    row = lambda i, e, ms: tuple({"session_id": "s", "element_id": e, "event_type": "CLICK", "ms": ms, "seq": i}.get(c) for c in EVENT_COLUMNS)
    batches = [[row(i, f"e{i}", 1000) for i in range(20)], [row(30, "late", 3_600_000)], [row(31, "late", 3_600_001)], [row(32, "late", 3_600_002)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rage_clicks(timed(stream, "1 minute")).writeStream.format("memory").queryName("quiet").outputMode("append").start()
    q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    assert left <= 1 and [r.ms for r in spark.sql("select * from quiet").collect()] == [3_600_002]


def test_what_is_paused_hides_nothing_that_shares_its_id(spark):
    rows = [("s1", "e", "LOOP", 0.5, 1, 0, "paused", "iv_x", 0.5), ("s2", "f", "LOOP", 0.5, 2, 1, "open", "iv_x", 0.5), ("s3", "f", "LOOP", 0.5, 3, 1, "open", "iv_x", 0.5)]
    chosen = spark.createDataFrame(rows, f"{D}, variant_index int, row_id string, tracking_id string, confidence double")
    paused = spark.createDataFrame([("paused",)], "row_id string")
    routes = spark.createDataFrame([], "session_id string, route string")
    assert [r.session_id for r in dispatch(chosen, routes, paused=paused, safe_mode=False).collect()] == ["s2"]
