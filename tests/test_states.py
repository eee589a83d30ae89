"""States of days, scheduled windows, counting while writing, source trees and the wire."""

import os

import pytest
from pyspark.sql import functions as F

from friction.functions.text import context_hash, inferred_role
from friction.functions.ids import user_hash
from friction.operators import html_map, ingest, source_map
from friction.operators.baselines import baselines, baselines_of_days, daily_states, stored_baselines
from friction.operators.detect import detect
from friction.operators.dispatch import with_cached
from friction.operators.html_map import elements
from friction.schema import EVENT_COLUMNS
from friction.sources import wire
from friction.sources.driver_events import driver_events
from friction.streaming import schedule

SCHEMA = ", ".join(f"{k} {v}" for k, v in EVENT_COLUMNS.items())
VALID = '{"schemaVersion":3,"idempotencyKey":"k","sessionId":"s","userIdHash":null,"elementId":null,"route":"/","eventType":"CLICK","ts":"2026-01-02T03:04:05Z"%s}'


def rows(df):
    return sorted(map(str, df.collect()))


def test_states_of_days_are_the_baselines_of_every_look_back(spark, sf):
    e = driver_events(spark, sf).cache()
    day = 15_000
    values, sessions = (t.cache() for t in daily_states(e, day))
    first, last = e.agg(F.floor(F.min("ms") / day), F.floor(F.max("ms") / day)).first()
    some = 0
    for since in range(first, last + 1):
        want = baselines(e, since_ms=since * day)
        got = baselines_of_days(values, sessions, since, last)
        assert rows(got) == rows(want), since
        some += want.count()
    assert some and last - first >= 3


def test_stored_baselines_keep_quiet_elements(spark):
    schema = "element_id string, p95_dwell_ms double"
    out = stored_baselines(spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema), spark.createDataFrame([("b", 3.0), ("c", 4.0)], schema))
    assert rows(out) == rows(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 4.0)], schema))


def events_at(spark, *times):
    row = lambda i, ms: tuple({"session_id": "s", "element_id": "e", "route": "/", "event_type": "CLICK", "ms": ms, "seq": i}.get(c) for c in EVENT_COLUMNS)
    return spark.createDataFrame([row(i, ms) for i, ms in enumerate(times)], SCHEMA)


def test_overlapping_windows_repeat_no_struggle_over_a_kill(spark, tmp_path):
    at, e = str(tmp_path / "job"), events_at(spark, 1000, 1100, 1200, 1300, 9000, 9100, 9200)
    run = lambda end: schedule.run_window(e, at, end, window_ms=6000)
    assert schedule.due(spark, at, 12_000, 3000, 3000) == [3000, 6000, 9000, 12_000]
    assert run(3000) and not run(3000) and run(6000)
    assert run(9000) and run(12_000)
    got = spark.read.parquet(f"{at}/struggles").where("type = 'RAGE_CLICK'")
    want = sorted((r.ts_ms, r.window_end) for r in got.collect())
    assert want == [(1200, 3000), (9200, 12_000)]
    os.remove(f"{at}/_windows/12000")  # it broke off after its rows and before its record
    assert schedule.due(spark, at, 12_000, 3000, 3000) == [12_000]
    assert run(12_000) and sorted((r.ts_ms, r.window_end) for r in spark.read.parquet(f"{at}/struggles").where("type = 'RAGE_CLICK'").collect()) == want
    assert detect(e).where("type = 'RAGE_CLICK'").count() == 1  # the rule alone gives one for all time


def test_ticks_run_what_is_due(spark, tmp_path):
    at, e = str(tmp_path / "job"), events_at(spark, 1000, 1100, 1200)
    q = schedule.scheduled(spark, lambda: e, at, 3000, lambda: 6000, str(tmp_path / "cp"), "1 second", 3000, 6000)
    for _ in range(60):
        if schedule.committed(spark, at) == [3000, 6000]:
            break
        q.awaitTermination(1)
    q.stop()
    assert schedule.committed(spark, at) == [3000, 6000]


def test_counts_while_writing_read_the_batch_once(spark, tmp_path):
    schema = "session_id string, route string, event_type string, ms long, seq long"
    batch = [("a", "/", "CLICK", 1, 1), ("a", "/", "CLICK", 2, 2), ("a", "/x", "HOVER", 3, 3), ("b", "/", "SCROLL", 4, 4), (None, "/", "CLICK", 5, 5), (None, "/", "CLICK", 6, 6), ("c", "/", "CLICK", 7, 7)]
    df = spark.createDataFrame(batch, schema)
    stored = spark.createDataFrame([("c", "/")], "session_id string, route string")
    counts = ingest.store_counted(df, stored, ["session_id", "route"], ["ms", "seq"], str(tmp_path / "out"))
    assert counts == {"accepted": 4, "duplicates": 2}
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 5, 6]
    none = ingest.store_counted(df.limit(0), stored, ["session_id", "route"], ["ms", "seq"], str(tmp_path / "none"))
    assert none == {"accepted": 0, "duplicates": 0}


def test_source_trees(spark, tmp_path):
    files = {"one/pages/index.vue": "<h1>A</h1>", "one/pages/é.vue": "ü", "two/src/routes/x/+page.svelte": "x", "two/README.md": "# r", "two/big.vue": "y" * 5000}
    for name, text in files.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    kept, left = source_map.source_tree(spark, str(tmp_path / "tree"), most_bytes=1000)
    assert {(r.repo, r.path): r.source for r in kept.collect()} == {tuple(k.split("/", 1)): v for k, v in files.items() if len(v) < 1000}
    assert [tuple(r) for r in left.collect()] == [("two", "big.vue", 5000)]
    routes = source_map.file_routes(kept.select("repo", "path"))
    assert {(r.repo, r.route) for r in routes.collect()} == {("one", "/"), ("one", "/é"), ("two", "/x")}
    some, _ = source_map.source_tree(spark, f"file://{tmp_path}/tree/", "*.vue", 1000)
    assert {r.path for r in some.collect()} == {"pages/index.vue", "pages/é.vue"}


@pytest.mark.parametrize(
    "more, reasons",
    [
        ("", []),
        (',"meta":{"a":{}}', ["meta"]),
        (',"page":{"title":1,"viewportW":-1}', ["page.title", "page.viewportW"]),
        (',"element":{"dead":"true"},"page":[]', ["element.dead", "page"]),
        (',"element":{"unknown":[1]}', []),
    ],
)
def test_wire(spark, more, reasons):
    r = wire.parsed(spark.createDataFrame([(VALID % more,)], "payload string")).first()
    assert r.reasons == reasons


def test_wire_texts_that_are_no_events(spark):
    df = spark.createDataFrame([(None,), ("",), ("{",), ("[]",), ("1",), ("null",), ('{"a":1}',)], "payload string")
    got = {r.payload: r.reasons for r in wire.parsed(df).collect()}
    assert got[None] == got[""] == got["{"] == ["json"]
    required = ["elementId", "eventType", "idempotencyKey", "route", "schemaVersion", "sessionId", "ts", "userIdHash"]
    assert got["[]"] == got["1"] == got["null"] == got['{"a":1}'] == required
    good, bad = wire.split(wire.parsed(df))
    assert good.count() == 0 and bad.count() == 7


def test_wire_batches(spark):
    texts = ['{"schemaVersion":3,"clockOffsetMs":1.5,"events":[]}', '{"schemaVersion":4,"events":{}}', "x", '{"schemaVersion":1,"clockOffsetMs":"1","events":[1,2,3]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", wire.batch_reasons(F.try_parse_json("t"), 2).alias("r"))
    assert [r.r for r in df.collect()] == [[], ["clockOffsetMs", "events", "schemaVersion"], ["json"], ["clockOffsetMs", "events"]]


def test_templates_know_more_words(spark):
    html = '<button>Archive</button><button>⋮x</button><button data-role="Nav">Save</button><button>Confirmed</button><input type=submit data-role="menu">'
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    roles = lambda **k: [r.semantic_role for r in sorted(elements(pages, **k).collect(), key=lambda r: (r.tag, r.tag_index))]
    assert roles(template=True) == ["DELETE", "MENU", "NAV", None, "SUBMIT"]
    assert roles() == [None, None, "SUBMIT", None, "SUBMIT"]


def test_cached_confidence_is_clamped(spark):
    chosen = spark.createDataFrame([("e", "LOOP", v, 0.5) for v in (-1, 0, 1, 2)], "element_id string, type string, variant_index int, confidence double")
    cached = spark.createDataFrame([("e", "LOOP", 0, 1.7, "h"), ("e", "LOOP", 1, None, None), ("e", "LOOP", 2, -3.0, None)], "element_id string, type string, variant_index int, confidence double, help_copy string")
    assert {r.variant_index: (r.confidence, r.cached_help) for r in with_cached(chosen, cached).collect()} == {-1: (0.5, None), 0: (0.99, "h"), 1: (0.5, None), 2: (0.0, None)}


def test_small_functions(spark):
    import hashlib

    one = spark.range(1)
    assert one.select(user_hash(F.lit("u@x"))).first()[0] == hashlib.sha256(b"u@x").hexdigest()[:32]
    assert one.select(context_hash({"a": F.lit("x"), "b": F.lit(None).cast("string")})).first()[0] == hashlib.sha256(b'{"a":"x","b":null}').hexdigest()
    role = lambda css, label, popup=None: one.select(inferred_role(F.lit(css).cast("string"), F.lit(label).cast("string"), F.lit(popup).cast("boolean"))).first()[0]
    assert [role("btn-close", None), role(None, "Try again"), role(None, "Help!"), role("x", "y", True), role(None, None)] == ["dismiss", "retry", "help", "menu", None]


def test_work_on_rows_of_one_file_is_dealt_out(spark):
    pages = spark.range(0, 40, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit('<div hx-get="/h">z</div><a href="/x">y</a>').alias("html"))
    files = spark.range(0, 40, 1, 1).select(F.lit("r").alias("repo"), F.format_string("pages/(g)/[...p%s]/index.vue", "id").alias("path"), F.lit("{}").alias("payload"))
    assert len({r.route for r in source_map.file_routes(files).collect()}) == 40
    assert source_map.file_routes(files).where("route = '/*p7'").count() == 1
    for rows in (html_map.parsed(pages), html_map.custom_elements(pages), source_map.file_routes(files), wire.parsed(files)):
        assert "RoundRobinPartitioning" in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.n for r in wire.parsed(files).select(F.spark_partition_id().alias("n")).collect()} > {0}
