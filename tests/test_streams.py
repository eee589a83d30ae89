"""Streams against their batch forms: small batches in any order, restarts, and what is read and kept."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from friction.functions.tables import written
from friction.operators.detect import detect
from friction.operators.dispatch import choose, counters, dispatch, last_routes
from friction.operators.ingest import event_batches, history, storable, unseen_struggles
from friction.schema import EVENT_COLUMNS, EVENT_TYPES, STORED_TYPES
from friction.sources.driver_events import driver_events
from friction.sources.keyed_table import KeyedTable, added, owned, replaced
from friction.streaming import hot_path as hot
from friction.streaming import outcomes as loop
from friction.streaming import store
from friction.streaming.rage import timed

SCHEMA = ", ".join(f"{k} {v}" for k, v in EVENT_COLUMNS.items())
STATS = "row_id string, impressions long, successes long"


def event(i, ms, session="s", **more):
    row = {"session_id": session, "element_id": "e", "route": "/", "event_type": "CLICK", "ms": ms, "seq": i} | more
    return tuple(row.get(c) for c in EVENT_COLUMNS)


def put(df, at):
    df.coalesce(1).write.mode("append").parquet(str(at))


def arriving(spark, schema, at, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(at))


def struggles(df):
    return sorted((r.session_id, r.element_id or "", r.type, round(r.severity, 9), r.ts_ms) for r in df.collect())


def some_events(spark, sf):
    """Events of a hundred sessions within two minutes, in the columns of the rules."""
    e = driver_events(spark, sf, crowd=12).select(*EVENT_COLUMNS)
    first = e.agg(F.min("ms")).first()[0]
    return e.withColumn("ms", (F.col("ms") - first) % 110_000)


def run_hot(spark, schema, tmp_path, name, **more):
    stream = timed(arriving(spark, schema, tmp_path / "in"), "10 minutes")
    stats = spark.createDataFrame([], STATS)
    query = hot.hot_path(stream, str(tmp_path / name), str(tmp_path / f"{name}-cp"), stats, safe_mode=False, **more)
    query.awaitTermination()
    return query


def test_one_batch_of_the_hot_path_is_detect_and_dispatch(spark, sf, tmp_path):
    e = some_events(spark, sf)
    put(e, tmp_path / "in")
    run_hot(spark, e.schema, tmp_path, "out")
    events = spark.read.parquet(str(tmp_path / "in"))
    found = detect(events).select("session_id", "element_id", "type", "severity", "ts_ms")
    got = spark.read.schema(hot.STRUGGLES).parquet(str(tmp_path / "out/struggles"))
    assert struggles(got) == struggles(found) and got.count() > 100
    want = dispatch(choose(found, spark.createDataFrame([], STATS), hot.VARIANTS), last_routes(events), safe_mode=False)
    shown = spark.read.schema(hot.INTERVENTIONS).parquet(str(tmp_path / "out/interventions"))
    assert sorted(r.tracking_id for r in shown.collect()) == sorted(r.tracking_id for r in want.collect())


def test_small_batches_see_what_the_store_would_give_them(spark, sf, tmp_path):
    """State against the batch form: the history of each batch's sessions read from all stored events."""
    e = some_events(spark, sf).where("session_id < 's2'").cache()
    cuts, seen, want = [0, 30_000, 60_000, 110_000], None, spark.createDataFrame([], hot.STRUGGLES)
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = e.where((F.col("ms") >= a) & (F.col("ms") < b))
        put(batch, tmp_path / "in")
        batch = spark.read.parquet(str(tmp_path / "in")).where((F.col("ms") >= a) & (F.col("ms") < b))
        rows = batch if seen is None else history(batch, seen, ["ms", "seq", "session_id"], 0)
        found = detect(rows).select("session_id", "element_id", "type", "severity", "ts_ms")
        want = want.unionByName(unseen_struggles(found, want, 0)).transform(lambda df: written(df, 'want'))
        seen = storable(batch) if seen is None else seen.unionByName(storable(batch))
    run_hot(spark, e.schema, tmp_path, "out")
    got = spark.read.parquet(str(tmp_path / "out/struggles"))
    assert {r.hot_batch for r in got.select("hot_batch").distinct().collect()} == {0, 1, 2}
    assert set(struggles(got)) ^ set(struggles(want)) == set() and got.count() == want.count()


def test_a_struggle_over_two_batches_and_state_that_goes(spark, tmp_path):
    for rows in ([event(1, 0), event(2, 500)], [event(3, 900)], [event(4, 1000)], [event(9, 7_200_000, "later")], [event(10, 7_200_001, "later")], [event(11, 7_200_002, "later")]):
        put(spark.createDataFrame(rows, SCHEMA), tmp_path / "in")
    query = run_hot(spark, spark.createDataFrame([], SCHEMA).schema, tmp_path, "out", kept=EVENT_TYPES)
    got = spark.read.parquet(str(tmp_path / "out/struggles")).where("type = 'RAGE_CLICK'").collect()
    assert [(r.session_id, r.ts_ms, r.hot_batch) for r in sorted(got)] == [("later", 7_200_002, 5), ("s", 900, 1)]
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["stateOperators"]]
    assert max(rows) > rows[-1]
    assert [r.tracking_id for r in spark.read.parquet(str(tmp_path / "out/interventions")).where("type = 'RAGE_CLICK'").collect()]


def test_state_of_a_session_costs_few_calls_and_columns():
    """A session without state asks for no timers; an event passes through as one text."""

    class Held:
        def __init__(self):
            self.rows, self.timers, self.calls = [], [], []

        def __getattr__(self, name):
            def call(*args):
                self.calls.append(name)
                if name == "exists":
                    return bool(self.rows)
                if name in ("put", "clear"):
                    self.rows = [*args, []][0]
                elif name == "registerTimer":
                    self.timers.append(args[0])
                elif name == "deleteTimer":
                    self.timers.remove(args[0])
                return {"getListState": self, "get": iter(self.rows), "listTimers": iter(list(self.timers)), "getCurrentWatermarkInMs": 0}.get(name)

            return call

    held, recent = Held(), hot.Recent(1000)
    recent.init(held)
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["ms", "seq", "event", "stored"])])
    seen = lambda *rows: next(recent.handleInputRows(("s",), batch(*rows), held)).values.tolist()
    assert seen((5, 1, "a", True), (6, 2, "b", False)) == [["a", True], ["b", True]]
    assert "listTimers" not in held.calls and "get" not in held.calls and held.timers == [1005]
    assert seen((900, 3, "c", True), (5, 1, "a", True)) == [["c", True], ["a", True]] and held.timers == [1900]
    assert seen((1000, 4, "d", True)) == [["c", False], ["a", False], ["d", True]] and held.timers == [2000]
    assert seen((9000, 5, "e", False)) == [["e", True]] and held.timers == [] and held.rows == []


def test_odd_values_pass_the_state(spark, tmp_path):
    rows = [event(1, 0), event(2, 5), event(2**53 + 1, 9)]
    e = spark.createDataFrame(rows, SCHEMA).withColumn("m_query", F.lit('"\\ \n\u00e9\U0001f600')).withColumn("m_length", F.when(F.col("ms") == 0, -0.0).when(F.col("ms") == 5, float("inf")).otherwise(0.1 + 0.2)).select(*EVENT_COLUMNS)
    put(e, tmp_path / "in")
    out = hot.with_recent(timed(arriving(spark, e.schema, tmp_path / "in"), "10 minutes"))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("fresh").count() == 3
    assert sorted(map(str, got.select(*EVENT_COLUMNS).collect())) == sorted(map(str, e.collect()))


def test_a_batch_tried_again_repeats_nothing(spark, tmp_path):
    rows = spark.createDataFrame([event(i, 100 * i) for i in range(5)], SCHEMA)
    stats = spark.createDataFrame([], STATS)
    for _ in range(2):
        hot.hot_batch(rows, 0, str(tmp_path / "out"), stats, safe_mode=False)
    hot.hot_batch(rows, 1, str(tmp_path / "out"), stats, safe_mode=False)
    got = spark.read.parquet(str(tmp_path / "out/struggles"))
    assert got.where("type = 'RAGE_CLICK'").count() == 1 and got.where("hot_batch = 1").count() == 0


# outcomes


@pytest.mark.parametrize("order", [0, 1, 2])
def test_outcomes_in_any_order(spark, tmp_path, order):
    rnd = random.Random(order)
    shown = [(f"t{i}", f"r{i % 4}", 1000 * i) for i in range(30)]
    kinds = ("intervention_shown", "intervention_success", "intervention_dismissed")
    outcomes = [("s", f"t{i}", rnd.choice(kinds), 1000 * i + rnd.randint(0, 50_000)) for i in range(30) for _ in range(3)]
    unknown = [("s", f"x{i}", kinds[0], 5000) for i in range(5)] + [("s", "t0", kinds[1], 3_700_000)]  # an hour and more later
    far = 40_000_000  # lets the watermark pass
    left, right = outcomes + unknown, list(shown)
    rnd.shuffle(left), rnd.shuffle(right)
    one, two = "session_id string, tracking_id string, kind string, ms long", "tracking_id string, row_id string, ms long"
    for k in range(3):
        put(spark.createDataFrame(left[k::3], one), tmp_path / "outcomes")
        put(spark.createDataFrame(right[(k + order) % 3 :: 3], two), tmp_path / "shown")
    for k in range(2):
        put(spark.createDataFrame([("s", f"end{k}", kinds[0], far + k)], one), tmp_path / "outcomes")
        put(spark.createDataFrame([(f"end{k}", "end", far + k)], two), tmp_path / "shown")
    read = lambda name, schema: arriving(spark, spark.createDataFrame([], schema).schema, tmp_path / name)
    joined = loop.resolved(read("outcomes", one), read("shown", two), "1 hour", "2 hours")
    loop.count_outcomes(joined, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stats = spark.createDataFrame([(f"r{i}", 5, 2, 1) for i in range(4)], "row_id string, impressions long, successes long, dismissals long")
    want = counters(stats, spark.createDataFrame(outcomes, one), spark.createDataFrame(shown, two))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(loop.counters_of(spark, str(tmp_path / "out"), stats)) == rows(want)
    kept = spark.read.parquet(str(tmp_path / "out/quarantine"))
    assert sorted(r.tracking_id for r in kept.collect()) == sorted(u[1] for u in unknown)


def test_counters_before_any_outcome(spark, tmp_path):
    stats = spark.createDataFrame([("r", 4, 1, 0)], "row_id string, impressions long, successes long, dismissals long")
    assert loop.counters_of(spark, str(tmp_path / "none"), stats).first().success_rate == 0.25


# keyed tables

USAGE = "org string, month string, events long"


def files(at):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(at) for f in names if f.endswith(".parquet"))


def test_increments_are_added_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), USAGE, ["org", "month"], 8)
    rows = lambda: sorted(map(tuple, table.read().collect()))
    batch = lambda *r: spark.createDataFrame(r, USAGE)
    add = added(["org", "month"], ["events"])
    assert rows() == []
    assert table.apply(batch(("a", "1", 2), ("b", "1", 5), ("a", "1", None)), 0, add)
    first = files(tmp_path / "t")
    assert not table.apply(batch(("a", "1", 2), ("b", "1", 5)), 0, add)  # committed: changes nothing
    assert rows() == [("a", "1", 2), ("b", "1", 5)] and files(tmp_path / "t") == first
    # a try of version 1 that broke off before its marker
    assert table.apply(batch(("a", "1", 3)), 1, add)
    os.remove(tmp_path / "t/_committed/1")
    assert rows() == [("a", "1", 2), ("b", "1", 5)]
    assert table.apply(batch(("a", "1", 3)), 1, add)
    assert rows() == [("a", "1", 5), ("b", "1", 5)]
    assert set(first) <= set(files(tmp_path / "t"))  # what the batch does not touch keeps its files
    table.vacuum()
    assert rows() == [("a", "1", 5), ("b", "1", 5)] and not set(first) <= set(files(tmp_path / "t"))
    assert table.apply(batch(), 2, add) and rows() == [("a", "1", 5), ("b", "1", 5)]


def test_groups_are_replaced_whole(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "org string, id string, label string", ["org"], 16)
    put_all = lambda rows, v: table.apply(spark.createDataFrame(rows, table.schema), v, owned(["org"], ["id"]))
    put_all([(f"o{i}", f"e{k}", "old") for i in range(9) for k in range(3)], 1)
    before = {b: f for b, f in table.folders().items()}
    put_all([("o1", "e7", "new"), ("o1", "e7", "new"), ("o99", "e1", "new")], 2)
    got = {(r.org, r.id): r.label for r in table.read().collect()}
    assert {k for k in got if k[0] == "o1"} == {("o1", "e7")} and ("o99", "e1") in got and len(got) == 8 * 3 + 2
    assert sum(before[b] != f for b, f in table.folders().items() if b in before) <= 2
    assert table.read(before=2).count() == 27


def test_rows_are_replaced_by_key(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], 4)
    table.apply(spark.range(20).select(F.col("id").alias("k"), F.lit("a").alias("v")), 1, replaced(["k"]))
    table.apply(spark.range(5, 25).select(F.col("id").alias("k"), F.lit("b").alias("v")), 2, replaced(["k"]))
    assert sorted(map(tuple, table.read().collect())) == [(k, "a" if k < 5 else "b") for k in range(25)]


# stored batches


def test_what_a_batch_reads_does_not_grow(spark, tmp_path):
    table = str(tmp_path / "t")
    for n in range(12):
        rows = [event(1000 * n + i, 1000 * n + i) for i in range(100)]
        again = [event(1000 * k, 1000 * n) for k in range(n) if k in (2, 5)]  # known keys of two batches
        store.store_batch(spark.createDataFrame(rows + again, SCHEMA), n, table, ["session_id", "seq"], ["ms"])
    assert spark.read.parquet(table).count() == 1200
    keys = store.digests(spark.createDataFrame([event(2001, 0), event(5002, 0), event(77_777, 0)], SCHEMA), ["session_id", "seq"])
    read = store.stored_of(spark, table, keys, spark.createDataFrame([], SCHEMA).schema, 99)
    batches = {f.split("stored_batch=")[1].split("/")[0] for f in read.inputFiles()}
    assert {"2", "5"} <= batches and len(batches) <= 4


def test_filters_know_all_keys(spark):
    keys = store.digests(spark.range(20_000).withColumnRenamed("id", "k"), ["k"])
    index = store.filters(keys).withColumn(store.PARTITION, F.lit(7).cast("long"))
    for some in (keys.limit(1), keys):
        assert [r[0] for r in store.possible(some, index).collect()] == [7]
    other = store.digests(spark.range(10**6, 10**6 + 20).withColumnRenamed("id", "k"), ["k"])
    assert store.possible(other, index).count() == 0


def test_columns_of_a_batch_survive_storing(spark, tmp_path):
    os.makedirs(tmp_path / "json")
    for b in range(3):
        events = [{"session_id": "s", "event_type": "CLICK", "ms": 10 * b + i} for i in range(2)]
        (tmp_path / f"json/{b}.json").write_text(json.dumps({"token": f"t{b}", "org": "o", "events": events}))
    stream = event_batches(spark, str(tmp_path / "json"), "session_id string, event_type string, ms long", stream=True)
    store.store_once(stream, str(tmp_path / "t"), str(tmp_path / "cp"), ["session_id", "ms"], ["seq"]).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "t")).collect()
    assert len(got) == 6 and len({r.batch_id for r in got}) == 3 and all(len(r.batch_id) == 64 for r in got)
    with pytest.raises(ValueError):
        store.store_batch(spark.createDataFrame([(1, 2)], "ms long, stored_batch long"), 0, str(tmp_path / "u"), ["ms"], ["ms"])


def test_repeats_within_the_delay_never_reach_the_store(spark, tmp_path):
    put(spark.createDataFrame([event(1, 0), event(2, 10)], SCHEMA), tmp_path / "in")
    put(spark.createDataFrame([event(1, 0), event(3, 20)], SCHEMA), tmp_path / "in")
    stream = store.without_repeats(timed(arriving(spark, spark.createDataFrame([], SCHEMA).schema, tmp_path / "in")), ["session_id", "seq"])
    q = stream.writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.seq for r in spark.sql("select seq from once").collect()) == [1, 2, 3]
    assert STORED_TYPES


def test_a_batch_is_made_once_for_its_digests_and_its_rows(spark, tmp_path):
    table, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    for n in range(2):
        before = seen.value
        batch = spark.createDataFrame([event(1000 * n + i, 1000 * n + i) for i in range(100)], SCHEMA).mapInPandas(count, SCHEMA)
        store.store_batch(batch, n, table, ["session_id", "seq"], ["ms"])
        assert seen.value - before <= 200  # rows with a whole key, and those with a null in it
    assert spark.read.parquet(table).count() == 200
