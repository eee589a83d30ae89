"""Golden cases of the rules: positive, negative, boundary."""

import pytest

from friction.operators.baselines import baselines
from friction.operators.detect import detect
from friction.schema import EVENT_COLUMNS
from friction.sources.driver_events import driver_events

A, B = "sh_" + "a" * 32, "sh_" + "b" * 32
SCHEMA = ", ".join(f"{k} {v}" for k, v in EVENT_COLUMNS.items())


@pytest.fixture(scope="module")
def run(spark):
    def go(cases, **options):
        """cases: events of one session each; the types found in each."""
        rows = []
        for s, events in enumerate(cases):
            for i, (kind, ms, more) in enumerate(events):
                values = {"session_id": f"s{s}", "event_type": kind, "ms": ms, "seq": i, "route": "/checkout"} | more
                rows.append(tuple(values.get(c) for c in EVENT_COLUMNS))
        found = detect(spark.createDataFrame(rows, SCHEMA), **options).collect()
        return [{r.type: r for r in found if r.session_id == f"s{s}"} for s in range(len(cases))]

    return go


def clicks(*ms, **more):
    return [("CLICK", t, {"element_id": A} | more) for t in ms]


def of(kind, *ms, **more):
    return [(kind, t, more) for t in ms]


def nav(*steps, **more):
    return [("NAVIGATION", t, {"route": r} | more) for r, t in steps]


#: (type, events that have it, events that don't)
CASES = [
    ("RAGE_CLICK", clicks(0, 500, 2000), clicks(0, 500, 2001)),
    ("MIS_CLICK", clicks(0) + clicks(300, element_id=B), clicks(0) + clicks(301, element_id=B)),
    ("MIS_CLICK", clicks(0, element_id=None) + clicks(100), clicks(0, 100, element_id=None)),
    ("INVALID_CLICK", clicks(0, m_disabled=True), of("HOVER", 0, m_disabled=True)),
    ("DEAD_CLICK", clicks(0, el_dead=True), clicks(0)),
    ("THRASH", of("INPUT_CHANGE", 0, 1, 2, 3, 4000, element_id=A), of("INPUT_CHANGE", 0, 1, 2, 3, 4001, element_id=A)),
    ("THRASH", of("INPUT_CHANGE", 0, 1, 2, 3, 4, element_id=A), of("INPUT_CHANGE", 0, 1, 2, 3, 4)),
    ("BACKTRACK", [("INPUT_CHANGE", i * 2000, {"element_id": A, "m_length": float(n)}) for i, n in enumerate((1, 3, 1, 3, 1))], [("INPUT_CHANGE", i * 2001, {"element_id": A, "m_length": float(n)}) for i, n in enumerate((1, 3, 1, 3, 1))]),
    ("VALIDATION_LOOP", of("SUBMIT", 0, 9, el_form_valid=False), of("SUBMIT", 0, el_form_valid=False) + of("VALIDATION_ERROR", 1, 2)),
    ("ABANDONED_FIELD", of("FOCUS", 0, element_id=A) + of("INPUT_CHANGE", 1, element_id=A) + of("HOVER", 30001), of("FOCUS", 0, element_id=A) + of("INPUT_CHANGE", 1, element_id=A) + of("HOVER", 30000)),
    ("PASTE_REPEAT", of("PASTE", 0, 5000, element_id=A), of("PASTE", 0, 1000, 6000, element_id=A)),
    ("REQUIRED_MISSED", of("HOVER", 0, el_validity="valueMissing"), of("HOVER", 0, el_validity="")),
    ("FORMAT_ERROR", of("HOVER", 0, el_validity="tooShort,x"), of("HOVER", 0, el_validity="x")),
    ("PASSWORD_RETRY", of("VALIDATION_ERROR", 0, 1, m_kind="login"), of("VALIDATION_ERROR", 0, m_kind="login")),
    ("LOCKED_OUT", of("VALIDATION_ERROR", 0, 1, 2, 3, 4, m_kind="login"), of("VALIDATION_ERROR", 0, 1, 2, 3, m_kind="login")),
    ("LOGIN_FAILURE", of("VALIDATION_ERROR", 0, m_kind="login"), of("VALIDATION_ERROR", 0, m_kind="format")),
    ("SLOW_FILL", of("INPUT_CHANGE", 0, 1, 2, 60000, element_id=A), of("INPUT_CHANGE", 0, 1, 2, 60001, element_id=A)),
    ("LOOP", nav(("/a", 0), ("/a", 9000), ("/a", 20000)), nav(("/a", 0), ("/a", 1))),
    ("SILENT_FAIL", of("SUBMIT", 0) + of("HOVER", 0, 8001), of("SUBMIT", 0) + of("SUBMIT", 8000)[:0] + of("HOVER", 8000)),
    ("BACK_THRASH", of("NAVIGATION", 0, 2000, 5000, m_trigger="popstate"), of("NAVIGATION", 0, 2000, 5001, m_trigger="popstate")),
    ("QUICK_BOUNCE", nav(("/a", 0), ("/b", 1500)), nav(("/a", 0), ("/b", 1501))),
    ("CIRCULAR_NAV", nav(*[(r, i * 9000) for i, r in enumerate("ABABA")]), nav(*[(r, i * 9000) for i, r in enumerate("ABAB")])),
    ("HOVER_HUNT", of("HOVER", 0, 1, 2, 3, 4, 4000) + clicks(0, 4500), of("HOVER", 0, 1, 2, 3, 4, 4000) + clicks(4499)),
    ("LONG_DWELL", of("DWELL", 0, m_ms=30000.0), of("DWELL", 0, m_ms=29999.0)),
    ("RAPID_SCROLL", of("SCROLL", 0, 1, 2, 3, 2000), of("SCROLL", 0, 1, 2, 3, 2001)),
    ("SCROLL_OVERSHOOT", [("SCROLL", i * 1200, {"m_dy": d}) for i, d in enumerate((5.0, -1.0, 0.0, 2.0, -1.0))], [("SCROLL", i * 1200, {"m_dy": d}) for i, d in enumerate((5.0, -1.0, 0.0, 2.0, 1.0))]),
    ("EMPTY_SEARCH", of("SUBMIT", 0, m_kind="search", m_empty=True), of("SUBMIT", 0, m_kind="filter", m_empty=True)),
    ("ZERO_RESULTS", of("SUBMIT", 0, m_kind="search", m_results=0.0), of("SUBMIT", 0, m_kind="search")),
    ("FAILED_FILTER", of("SUBMIT", 0, m_kind="filter", m_results=0.0), of("SUBMIT", 0, m_kind="search", m_results=0.0)),
    ("REPEAT_SEARCH", of("SUBMIT", 0, 1, 2, m_kind="search"), of("SUBMIT", 0, 1, m_kind="search")),
    ("MENU_THRASH", clicks(0, 1, 5000, m_role="menu"), clicks(0, 1, 5000, el_role="menu")),
    ("TOOLTIP_HOVER_REPEAT", of("HOVER", 0, 9, 99, m_tooltip=True), of("HOVER", 0, 9, m_tooltip=True)),
    ("TAB_HOPPING", of("BLUR", 0, 9, m_target="window") + of("FOCUS", 8000, m_target="window"), of("BLUR", 0, 9, 8001, m_target="window")),
    ("ERROR_DISMISS", clicks(0, 9, m_role="dismiss"), clicks(0, m_role="dismiss")),
    ("RETRY_LOOP", clicks(0, 9, m_role="retry"), clicks(0, 9, el_role="retry")),
    ("NOT_FOUND_BOUNCE", nav(("/x/not-found", 0), ("/a", 3000)), nav(("/4040", 0), ("/a", 1))),
    ("JS_ERROR", of("JS_ERROR", 0), of("HOVER", 0)),
    ("KEYBOARD_LOST_FOCUS", of("FOCUS", 0, element_id=A) + of("BLUR", 499, element_id=A), of("FOCUS", 0, element_id=A) + of("INPUT_CHANGE", 1, element_id=A) + of("BLUR", 2, element_id=A)),
    ("COPY_BOUNCE", of("COPY", 0) + of("HOVER", 5) + nav(("/a", 5000)), of("COPY", 0) + nav(("/a", 5001))),
    ("HELP_HUNT", clicks(0, el_role="HELP"), clicks(0, el_role="help")),
]


def test_positive_and_negative_cases(run):
    for (kind, yes, no), with_it, without in zip(CASES, run([c[1] for c in CASES]), run([c[2] for c in CASES])):
        assert kind in with_it, (kind, yes)
        assert kind not in without, (kind, no)


def test_once_for_each_element_and_first_bucket(run):
    loops, none, severe = run([nav(*[("/a", i) for i in (0, 10, 40)], *[("/b", i) for i in (5, 11, 12)]), [], clicks(0, 1, 2, 3, 4, 5, 6, 7)])
    assert loops["LOOP"].ts_ms == 40 and severe["RAGE_CLICK"].severity == 1.0 and severe["RAGE_CLICK"].ts_ms == 2


def test_idle_rules_need_a_clock(run):
    case = nav(("/a", 0), m_trigger="initial")
    assert not {"DEAD_END", "IDLE_AFTER_LOAD"} & set(run([case])[0])
    assert {"DEAD_END", "IDLE_AFTER_LOAD"} <= set(run([case], as_of=20_000)[0])


def test_baselines_raise_thresholds(spark, run):
    schema = "element_id string, p95_clicks_per_sec double, p95_dwell_ms double, p95_hovers_before_click double, sample_size int"
    b = spark.createDataFrame([(A, 3.0, 90000.0, None, 50), (B, 3.0, 90000.0, None, 5)], schema)
    dwell = lambda ms, e: of("DWELL", 0, m_ms=ms, element_id=e)
    got = run([clicks(*range(8)), clicks(*range(9)), clicks(0, 1, 2, element_id=B), dwell(134999.0, A), dwell(135000.0, A), dwell(30000.0, B)], baselines=b)
    assert ["RAGE_CLICK" in g for g in got[:3]] == [False, True, True]
    assert ["LONG_DWELL" in g for g in got[3:]] == [False, True, True]


def test_sessions_are_dealt_once_and_their_tasks_stay_apart(spark, sf):
    """Partitions by number are not merged, so a task's memory is its share of the sessions; with baselines too."""
    e = driver_events(spark, sf)
    for found in (detect(e), detect(e, baselines=baselines(e))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


def test_events_are_dealt_twice_and_sorted_four_times(spark, sf):
    """All rules share two orders of one deal; repeated routes and queries have a narrow deal and order, what was found the last."""
    plan = detect(driver_events(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 4


def test_clicks_and_events_of_equal_time_are_not_later(run):
    hovers = of("HOVER", 0, 1, 2, 3, 4, 4000)
    tied, late = run([hovers[:1] + clicks(0, 0) + hovers[1:] + clicks(4500), hovers[:1] + clicks(0, 0, 4499) + hovers[1:]])
    assert "HOVER_HUNT" in tied and "HOVER_HUNT" not in late
    silent, heard = run([of("SUBMIT", 0, 0) + of("HOVER", 0, 8001), of("SUBMIT", 0, 0) + of("HOVER", 0, 8000)])
    assert "SILENT_FAIL" in silent and "SILENT_FAIL" not in heard
