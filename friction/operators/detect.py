"""The forty struggle rules as one plan.

All rules read sessions, so the events are dealt out once, by session. Each task sorts its part twice, by time and by element
and time. Windows over these two orders give every rule what it asks of neighbours (the last event of some kind is a lag that
ignores nulls), and aggregates of whole sessions and elements stand beside their last event. Each event emits an array of
detections; repeated routes and queries are grouped beside that, and the first of each (session, element, type) is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.schema import FORMAT_FLAGS, RULES

#: A detection: type, element, severity, time; scope: the element for deduplication ('_': once a session); order: when
#: its bucket came to be.
KIND = "struct<type:string,element_id:string,severity:double,ts_ms:bigint,scope:string,o1:bigint,o2:bigint>"
SAYING = KIND[:-1] + ",summary:string>"
NOT_FOUND = r"(?i)(^|/)(404|not[-_]found)\b"


def Ws():
    return Window.partitionBy("session_id").orderBy("ms", "seq")


def We():
    return Window.partitionBy("session_id", "element_id").orderBy("ms", "seq")


#: Ws() and We() in SQL, for lags that ignore nulls.
BY_TIME, BY_ELEMENT = "PARTITION BY session_id ORDER BY ms, seq", "PARTITION BY session_id, element_id ORDER BY ms, seq"
BEFORE = (Window.unboundedPreceding, -1)
TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def detection(when: Column, kind: str, element, severity, ts, once: bool = False, order=("ms", "seq")) -> tuple[str, Column, Column]:
    """The type, when there is a detection, and the detection. once: at most one for the session, whatever the element."""
    element = F.lit(None).cast("string") if element is None else F.col(element) if isinstance(element, str) else element
    severity = F.lit(float(severity)) if isinstance(severity, (int, float)) else severity.cast("double")
    scope = F.lit("_") if once else F.coalesce(element, F.lit("_"))
    ts = F.col(ts) if isinstance(ts, str) else ts
    o1, o2 = (F.col(o) if isinstance(o, str) else o for o in order)
    made = F.struct(F.lit(kind).alias("type"), element.alias("element_id"), severity.alias("severity"), ts.alias("ts_ms"), scope.alias("scope"), o1.alias("o1"), o2.alias("o2"))
    return kind, when, made.cast(KIND)


def capped(n: Column, most: float) -> Column:
    return F.least(F.lit(1.0), n / F.lit(float(most)))


def back(n: int, kind: str, value: str, over: str) -> Column:
    """The value (SQL) of the event of some kind that is n such events before; n below 0: after."""
    value = f"CASE WHEN event_type = '{kind}' THEN {value} END"
    return F.expr(f"{'lag' if n > 0 else 'lead'}({value}, {abs(n)}) IGNORE NULLS OVER ({over})" if n else value)


def by_time(e: DataFrame, r: dict) -> DataFrame:
    """Window columns of the session. Structs tell an event without a time from none."""
    later = lambda value, n=1: F.expr(f"lead({value}, {n}) IGNORE NULLS OVER ({BY_TIME})")
    kind = F.col("event_type")
    e = e.withColumn("turn", F.when((kind == "SCROLL") & (F.col("m_dy") != 0), F.signum("m_dy")))
    click, navs = back(1, "CLICK", "struct(ms, element_id)", BY_TIME), [back(i, "NAVIGATION", "struct(ms, route)", BY_TIME) for i in (1, 2, 3)]
    e = e.select(
        "*", click.alias("click1"), *[n.alias(f"nav{i}") for i, n in enumerate(navs, 1)], back(-1, "NAVIGATION", "ms", BY_TIME).alias("next_nav"),
        back(r["scroll_n"] - 1, "SCROLL", "struct(ms)", BY_TIME).alias("scroll_back"), F.last("turn", True).over(Ws().rowsBetween(*BEFORE)).alias("turn1"),
        F.count(F.when(kind == "HOVER", 1)).over(Ws().rowsBetween(*TO_HERE)).alias("nth"), F.lag("ms", 1).over(Ws()).alias("before"),
        F.max("ms").over(Window.partitionBy("session_id")).alias("session_end"), F.lead(F.lit(True)).over(Ws()).isNull().alias("ends_session"),
    )
    # the first event and the first click at each time: what comes after them in this order is later
    first = F.coalesce(F.col("before") < F.col("ms"), F.lit(True))
    first_click = (kind == "CLICK") & F.coalesce(F.col("click1.ms") < F.col("ms"), F.lit(True))
    e = e.withColumn("at", F.when(first, F.col("ms"))).withColumn("click_at", F.when(first_click, F.col("ms")))
    e = e.select("*", later("at").alias("next_ms"), later("click_at").alias("click_a"), later("click_at", 2).alias("click_b"))
    e = e.withColumn("next_click", F.when(F.col("click_a") > F.col("ms"), F.col("click_a")).otherwise(F.col("click_b")))
    return e.withColumn("hunt", back(r["hunt_n"] - 1, "HOVER", "struct(ms, next_click)", BY_TIME))


def by_element(e: DataFrame, r: dict) -> DataFrame:
    """Window columns of the session's element."""
    kind, whole = F.col("event_type"), Window.partitionBy("session_id", "element_id")
    change = kind == "INPUT_CHANGE"
    e = e.select(
        "*", back(r["rage_n"] - 1, "CLICK", "struct(ms)", BY_ELEMENT).alias("rage_back"), back(r["thrash_n"] - 1, "INPUT_CHANGE", "struct(ms)", BY_ELEMENT).alias("thrash_back"),
        F.when(kind == "CLICK", F.count_if(kind == "CLICK").over(whole)).when(change, F.count_if(change).over(whole)).alias("of_element"),
        F.lead("event_type").over(We()).alias("element_next_type"), F.lead("ms").over(We()).alias("element_next_ms"),
        F.last(F.when(change, F.col("m_length")), True).over(We().rowsBetween(*BEFORE)).alias("length1"),
        F.lead(F.lit(True)).over(We()).isNull().alias("ends_element"),
    )
    grow = F.signum(F.when(change, F.col("m_length") - F.col("length1")))
    e = e.withColumn("grow", F.when(grow != 0, grow))
    return e.withColumn("grow1", F.last("grow", True).over(We().rowsBetween(*BEFORE)))


def adapted(base: float, p95: str, sample: Column, factor: float, per: float = 1.0) -> Column:
    """The rule's threshold, or what the element's own baseline makes of it if that is larger."""
    trusted = (sample >= RULES["baseline_min"]) & (F.col(p95) != 0)
    return F.when(trusted, F.greatest(F.lit(float(base)), F.ceil(F.col(p95) * F.lit(per) * F.lit(factor)).cast("double"))).otherwise(F.lit(float(base)))


#: What detections say whose text holds nothing of the events.
SAID = {
    "MIS_CLICK": "Two clicks on different elements within 300ms", "INVALID_CLICK": "Clicked a disabled element",
    "DEAD_CLICK": "Clicked a non-interactive element", "ABANDONED_FIELD": "Started typing then walked away",
    "REQUIRED_MISSED": "Required field was missed", "FORMAT_ERROR": "Input did not match expected format",
    "SILENT_FAIL": "Submitted, nothing happened", "IDLE_AFTER_LOAD": "Loaded the page, did nothing",
    "EMPTY_SEARCH": "Searched with empty query", "ZERO_RESULTS": "Search returned zero results",
    "FAILED_FILTER": "Filter narrowed to zero", "JS_ERROR": "Uncaught JS error", "LOGIN_FAILURE": "Login attempt failed",
    "KEYBOARD_LOST_FOCUS": "Focused, then lost focus before typing", "COPY_BOUNCE": "Copied, then left",
    "HELP_HUNT": "Clicked help / support",
}


def text(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def seconds(ms: Column) -> Column:
    """Whole seconds, halves up."""
    return F.floor(ms / 1000 + F.lit(0.5)).cast("string")


def row_texts(r: dict) -> dict[str, Column]:
    """What detections of single events say; null: see SAID."""
    c, at = F.col, lambda name: F.col(name).cast("string")
    raised = lambda name, usual, said: F.when(c(name) != usual, text(" (adapted threshold: %s)", said)).otherwise("")
    flags = F.array_intersect(F.split(c("el_validity"), ","), F.array(*[F.lit(x) for x in FORMAT_FLAGS]))
    return {
        "RAGE_CLICK": F.concat(text(f"%s clicks within {r['rage_ms']}ms", at("of_element")), raised("rage_from", r["rage_n"], c("rage_from").cast("long").cast("string"))),
        "THRASH": text(f"%s input changes within {r['thrash_ms']}ms", at("of_element")),
        "FORMAT_ERROR": F.when(F.size(flags) > 0, text("Native validity: %s", F.array_join(flags, ","))),
        "QUICK_BOUNCE": text("Left %s within %sms", c("nav1.route"), (c("ms") - c("nav1.ms")).cast("string")),
        "HOVER_HUNT": F.concat(text("%s hovers without a click", at("of_type")), raised("hunt_from", r["hunt_n"], c("hunt_from").cast("long").cast("string"))),
        "LONG_DWELL": F.concat(text("Stared at this for %ss", seconds(c("m_ms"))), F.when(c("dwell_from") != r["dwell_ms"], text(" (adapted threshold: %ss)", seconds(c("dwell_from")))).otherwise("")),
        "RAPID_SCROLL": text(f"%s scroll events in {r['scroll_ms']}ms", at("of_type")),
        "NOT_FOUND_BOUNCE": text("Hit %s and bounced", c("route")),
        "JS_ERROR": c("m_message"),
    }


def group_texts() -> dict[str, Column]:
    """What detections of whole groups say; n of the group that found() was called on."""
    n = lambda name: F.col(f"{name}_n").cast("string")
    return {
        "BACKTRACK": text("%s write/erase cycles", F.col("flips").cast("string")), "PASTE_REPEAT": text("%s paste events", n("paste")),
        "SLOW_FILL": text("Filled across %ss", seconds(F.col("input_change_last.ms") - F.col("input_change_first.ms"))),
        "MENU_THRASH": text("Toggled menu %s times", n("menu")), "TOOLTIP_HOVER_REPEAT": text("Read the same tooltip %s times", n("tip")),
        "ERROR_DISMISS": text("Dismissed the same error %s times", n("dismiss")), "RETRY_LOOP": text("Hit retry %s times", n("retry")),
    }


def session_texts() -> dict[str, Column]:
    n = lambda name: F.col(f"{name}_n").cast("string")
    return {
        "VALIDATION_LOOP": text("%s submits, %s failed attempts", n("submit"), F.greatest("errors_n", "invalid_n").cast("string")),
        "PASSWORD_RETRY": text("%s login failures", n("login")), "BACK_THRASH": text("%s back nav events", n("back")),
        "CIRCULAR_NAV": text("Bouncing between %s routes", (F.col("cycles") + 1).cast("string")),
        "SCROLL_OVERSHOOT": text("%s scroll-direction reversals", F.col("turns").cast("string")),
        "TAB_HOPPING": text("Switched tabs %s times", n("tab")), "LOCKED_OUT": text("%s login failures - likely locked out", n("login")),
    }


def row_rules(r: dict) -> list[tuple[str, Column, Column]]:
    """Detections of single events with by_time()."""
    t, c = F.col("event_type"), F.col
    click, submit, nav, error = t == "CLICK", t == "SUBMIT", t == "NAVIGATION", t == "VALIDATION_ERROR"
    flags = F.arrays_overlap(F.split(c("el_validity"), ","), F.array(*[F.lit(x) for x in FORMAT_FLAGS]))
    hunt = (c("ms") - c("hunt.ms") <= r["hunt_ms"]) & (c("hunt.next_click").isNull() | (c("hunt.next_click") >= c("ms") + r["hunt_click_ms"]))
    silent = c("ms").isNotNull() & (c("next_ms").isNull() | (c("next_ms") - c("ms") > r["silent_ms"]))
    return [
        detection(click & (c("ms") - c("click1.ms") <= r["mis_ms"]) & ~c("click1.element_id").eqNullSafe(c("element_id")), "MIS_CLICK", "element_id", 0.5, "ms"),
        detection(click & (c("el_disabled") | c("m_disabled")), "INVALID_CLICK", "element_id", 0.6, "ms"),
        detection(click & (c("el_dead") | c("m_dead")), "DEAD_CLICK", "element_id", 0.6, "ms"),
        detection((error & (c("m_kind") == "required")) | c("el_validity").contains("valueMissing"), "REQUIRED_MISSED", "element_id", 0.4, "ms"),
        detection((error & (c("m_kind") == "format")) | flags, "FORMAT_ERROR", "element_id", 0.5, "ms"),
        detection(submit & silent, "SILENT_FAIL", "element_id", 0.7, "ms"),
        detection(nav & (c("nav1.route") != c("route")) & (c("ms") - c("nav1.ms") <= r["bounce_ms"]), "QUICK_BOUNCE", None, 0.4, "ms", True),
        detection((t == "HOVER") & hunt & (c("nth") >= c("hunt_from")), "HOVER_HUNT", "element_id", 0.4, "ms", True),
        detection((t == "DWELL") & (c("m_ms") >= c("dwell_from")), "LONG_DWELL", "element_id", 0.3, "ms"),
        detection((t == "SCROLL") & (c("ms") - c("scroll_back.ms") <= r["scroll_ms"]), "RAPID_SCROLL", None, 0.4, "ms", True),
        detection(submit & (c("m_kind") == "search") & c("m_empty"), "EMPTY_SEARCH", "element_id", 0.3, "ms"),
        detection(submit & (c("m_kind") == "search") & (c("m_results") == 0), "ZERO_RESULTS", "element_id", 0.55, "ms"),
        detection(submit & (c("m_kind") == "filter") & (c("m_results") == 0), "FAILED_FILTER", "element_id", 0.5, "ms"),
        detection(nav & (c("next_nav") - c("ms") <= r["missing_ms"]) & c("route").rlike(NOT_FOUND), "NOT_FOUND_BOUNCE", None, 0.6, "ms", True),
        detection(t == "JS_ERROR", "JS_ERROR", "element_id", 0.7, "ms"),
        detection(error & (c("m_kind") == "login"), "LOGIN_FAILURE", "element_id", 0.5, "ms"),
        detection((t == "COPY") & (c("next_nav") - c("ms") <= r["copy_ms"]), "COPY_BOUNCE", "element_id", 0.35, "ms"),
        detection(click & ((c("el_role") == "HELP") | (c("m_role") == "help")), "HELP_HUNT", "element_id", 0.4, "ms"),
    ]


def neighbour_rules(r: dict) -> list[tuple[str, Column, Column]]:
    """Detections of single events with by_element(). RAGE_CLICK has a threshold by element where there are baselines: see raging()."""
    t, c = F.col("event_type"), F.col
    return [
        detection((t == "CLICK") & (c("ms") - c("rage_back.ms") <= r["rage_ms"]), "RAGE_CLICK", "element_id", rage_severity(), "ms"),
        detection((t == "INPUT_CHANGE") & c("element_id").isNotNull() & (c("ms") - c("thrash_back.ms") <= r["thrash_ms"]), "THRASH", "element_id", capped(c("of_element"), 2 * r["thrash_n"]), "ms"),
        detection((t == "FOCUS") & (c("element_next_type") == "BLUR") & (c("element_next_ms") - c("ms") < r["lost_focus_ms"]), "KEYBOARD_LOST_FOCUS", "element_id", 0.3, "ms"),
    ]


def rage_severity() -> Column:
    return F.least(F.lit(1.0), F.col("of_element") / (F.lit(2.0) * F.col("rage_from")))


class Group:
    """Conditional aggregates of one subset of a group's events, under a short name."""

    def __init__(self, name: str, when: Column) -> None:
        at = F.struct("ms", "seq")
        last = F.struct("ms", "seq", "element_id")
        self.columns = {
            f"{name}_n": F.count_if(F.coalesce(when, F.lit(False))),
            f"{name}_first": F.min(F.when(when, at)),
            f"{name}_last": F.max(F.when(when, last)),
        }
        self.n, self.first, self.last = F.col(f"{name}_n"), F.col(f"{name}_first"), F.col(f"{name}_last")
        self.span = self.last["ms"] - self.first["ms"]

    def found(self, when: Column, kind: str, element, severity, once: bool = False) -> tuple[str, Column, Column]:
        element = self.last["element_id"] if element == "last" else element
        return detection(when, kind, element, severity, self.last["ms"], once, (self.first["ms"], self.first["seq"]))


def columns_of(groups: tuple[Group, ...]) -> dict[str, Column]:
    return {name: column for g in groups for name, column in g.columns.items()}


def element_rules(r: dict) -> tuple[dict[str, Column], list[tuple[str, Column, Column]]]:
    """Aggregates of (session, element), and the detections over them."""
    t, c = F.col("event_type"), F.col
    click = t == "CLICK"
    inputs, focus, blur, submit, paste = (Group(k.lower(), t == k) for k in ("INPUT_CHANGE", "FOCUS", "BLUR", "SUBMIT", "PASTE"))
    menu = Group("menu", click & ((c("el_role") == "MENU") | (c("m_role") == "menu")))
    tip = Group("tip", (t == "HOVER") & c("m_tooltip"))
    dismiss = Group("dismiss", click & (c("el_role").isin("DISMISS") | c("m_role").isin("dismiss")))
    retry = Group("retry", click & (c("el_role").isin("RETRY") | c("m_role").isin("retry")))
    more = {"flips": F.count_if(c("grow") * c("grow1") < 0)}
    groups = (inputs, focus, blur, submit, paste, menu, tip, dismiss, retry)
    idle = c("session_end") - inputs.last["ms"] >= r["abandon_ms"]
    named = c("element_id").isNotNull() & (c("element_id") != "")
    return columns_of(groups) | more, [
        inputs.found((inputs.n >= r["backtrack_n"]) & (c("flips") >= r["backtrack_flips"]) & (inputs.span <= r["backtrack_ms"]), "BACKTRACK", "last", 0.55),
        inputs.found(named & (focus.n > 0) & (inputs.n > 0) & (blur.n == 0) & (submit.n == 0) & idle, "ABANDONED_FIELD", "last", 0.5),
        paste.found((paste.n >= r["paste_n"]) & (paste.span <= r["paste_ms"]), "PASTE_REPEAT", "last", 0.5),
        inputs.found((inputs.n >= r["slow_n"]) & inputs.span.between(r["slow_min_ms"], r["slow_max_ms"]), "SLOW_FILL", "last", 0.35),
        menu.found((menu.n >= r["menu_n"]) & (menu.span <= r["menu_ms"]), "MENU_THRASH", "last", 0.45),
        tip.found(tip.n >= r["tooltip_n"], "TOOLTIP_HOVER_REPEAT", "last", 0.4),
        dismiss.found(dismiss.n >= r["dismiss_n"], "ERROR_DISMISS", "last", 0.5),
        retry.found(retry.n >= r["retry_n"], "RETRY_LOOP", "last", 0.55),
    ]


def session_rules(r: dict) -> tuple[dict[str, Column], list[tuple[str, Column, Column]]]:
    """Aggregates of the session, and the detections over them."""
    t, c = F.col("event_type"), F.col
    submits, errors = Group("submit", t == "SUBMIT"), Group("errors", t == "VALIDATION_ERROR")
    invalid = Group("invalid", (t == "SUBMIT") & ~c("el_form_valid"))
    login = Group("login", (t == "VALIDATION_ERROR") & (c("m_kind") == "login"))
    backs = Group("back", (t == "NAVIGATION") & (c("m_trigger") == "popstate"))
    nav, scroll = Group("nav", t == "NAVIGATION"), Group("scroll", t == "SCROLL")
    tab = Group("tab", t.isin("BLUR", "FOCUS") & (c("m_target") == "window"))
    more = {
        "cycles": F.count_if((t == "NAVIGATION") & (c("route") == c("nav2.route")) & (c("nav1.route") == c("nav3.route")) & (c("route") != c("nav1.route"))),
        "turns": F.count_if(c("turn") * c("turn1") < 0),
    }
    failed = F.greatest(errors.n, invalid.n)
    return columns_of((submits, errors, invalid, login, backs, nav, scroll, tab)) | more, [
        submits.found((submits.n >= r["validation_n"]) & (failed >= r["validation_n"]), "VALIDATION_LOOP", "last", capped(failed, 3 * r["validation_n"])),
        login.found(login.n >= r["password_n"], "PASSWORD_RETRY", "last", capped(login.n, 4)),
        backs.found((backs.n >= r["back_n"]) & (backs.span <= r["back_ms"]), "BACK_THRASH", None, 0.5),
        nav.found(c("cycles") >= r["circular_n"], "CIRCULAR_NAV", None, 0.55),
        scroll.found((scroll.n >= r["overshoot_n"]) & (c("turns") >= r["overshoot_turns"]) & (scroll.span <= r["overshoot_ms"]), "SCROLL_OVERSHOOT", None, 0.4),
        tab.found((tab.n >= r["tab_n"]) & (tab.span <= r["tab_ms"]), "TAB_HOPPING", None, 0.4),
        login.found(login.n >= r["locked_n"], "LOCKED_OUT", "last", 0.85),
    ]


def found_in(rules: list[tuple[str, Column, Column]], only: set[str] | None = None, said: dict[str, Column] | None = None) -> Column | None:
    """The detections that there are, as an array; None if no rule is asked for. said: what types say, where asked for."""
    rules = [(kind, when, made) for kind, when, made in rules if only is None or kind in only]
    if said is not None:
        rules = [(kind, when, made.withField("summary", F.coalesce(said.get(kind, F.lit(None).cast("string")), F.lit(SAID.get(kind))))) for kind, when, made in rules]
    return F.concat(*[F.when(when, F.array(made)).otherwise(F.array().cast(f"array<{KIND if said is None else SAYING}>")) for _, when, made in rules]) if rules else None


def emitted(rows: DataFrame, found: Column | None) -> DataFrame | None:
    """A row for each detection that was found; None if none is asked for."""
    if found is None:
        return None
    return rows.select("session_id", found.alias("found")).select("session_id", F.explode("found").alias("d")).select("session_id", "d.*")


def at_end(e: DataFrame, of: list[str], columns: dict[str, Column], end: str, found: Column | None, name: str) -> DataFrame:
    """e with what was found (name) in the whole of each group, at its last event; others have an empty array."""
    if found is None:
        return e
    kept = e.columns
    e = e.select("*", *[column.over(Window.partitionBy(*of)).alias(c) for c, column in columns.items()])
    return e.select(*kept, F.when(F.col(end), found).alias(name))


def raging(e: DataFrame, r: dict) -> DataFrame:
    """Clicks that are RAGE_CLICK at thresholds which differ by element: the click N back is found by its number."""
    of = Window.partitionBy("session_id", "element_id")
    clicks = e.where("event_type = 'CLICK'").select("*", F.row_number().over(We()).alias("nth_of_element"), F.count("*").over(of).alias("of_element"))
    first = clicks.select(F.col("session_id").alias("s"), F.col("element_id").alias("el"), F.col("nth_of_element").alias("n"), F.col("ms").alias("back_ms"))
    same = (F.col("session_id") == F.col("s")) & F.col("element_id").eqNullSafe(F.col("el")) & (F.col("nth_of_element") - F.col("rage_from").cast("long") + 1 == F.col("n"))
    return clicks.join(first, same).where(F.col("ms") - F.col("back_ms") <= r["rage_ms"])


def as_of_rules(e: DataFrame, as_of: Column, r: dict, only: set[str] | None = None, said: dict | None = None) -> DataFrame | None:
    """DEAD_END and IDLE_AFTER_LOAD with idleness measured to a clock that is given; by event times alone they cannot fire."""
    nav = F.col("event_type") == "NAVIGATION"
    g = e.groupBy("session_id").agg(F.max(F.struct("ms", "seq", "event_type", "m_trigger", "route")).alias("last"), F.count("*").alias("n"), F.min(F.when(nav, F.struct("ms", "seq"))).alias("first"))
    last, idle = F.col("last"), as_of - F.col("last.ms")
    on_nav = last["event_type"] == "NAVIGATION"
    order = (F.col("first.ms"), F.col("first.seq"))
    said = None if said is None else {"DEAD_END": text("Idle on %s for %ss", last["route"], seconds(idle))}
    return emitted(g, found_in([
        detection(on_nav & (idle >= r["dead_end_ms"]), "DEAD_END", None, 0.45, last["ms"], True, order),
        detection(on_nav & (last["m_trigger"] == "initial") & (idle >= r["idle_load_ms"]), "IDLE_AFTER_LOAD", None, 0.45, last["ms"], True, order),
    ], only, said))


def detect(events: DataFrame, rules: dict | None = None, baselines: DataFrame | None = None, as_of: int | None = None, only: set[str] | None = None, summaries: bool = False) -> DataFrame:
    """session_id, element_id, type, severity, ts_ms: the first detection of each (session, element, type).

    events: EVENT_COLUMNS. baselines: element_id, p95_clicks_per_sec, p95_dwell_ms, p95_hovers_before_click, sample_size,
    one row an element; they raise the thresholds of RAGE_CLICK, LONG_DWELL and HOVER_HUNT. as_of: see as_of_rules(). only: types to look for. summaries:
    with `summary`, a sentence on each detection."""
    r = RULES | (rules or {})
    e = events
    if baselines is not None:
        b = baselines.select(F.col("element_id").alias("of"), "p95_clicks_per_sec", "p95_dwell_ms", "p95_hovers_before_click", "sample_size")
        e = e.join(b, F.col("element_id") == F.col("of"), "left").drop("of")
        n = F.coalesce("sample_size", F.lit(0))
        factor = r["baseline_factor"]
        e = e.withColumn("rage_from", adapted(r["rage_n"], "p95_clicks_per_sec", n, factor, r["rage_ms"] / 1000)).withColumn("dwell_from", adapted(r["dwell_ms"], "p95_dwell_ms", n, factor)).withColumn("hunt_from", adapted(r["hunt_n"], "p95_hovers_before_click", n, factor))
    else:
        e = e.withColumn("rage_from", F.lit(float(r["rage_n"]))).withColumn("dwell_from", F.lit(float(r["dwell_ms"]))).withColumn("hunt_from", F.lit(float(r["hunt_n"])))
    # after the baselines, which would move the events once more; with a number, so that tasks aren't merged: each sorts its
    # part several times, and the memory of the sorts adds up
    e = e.repartition(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), "session_id")
    said = lambda texts: texts if summaries else None
    parts = []
    # repeated routes and queries: once for a session or element, the group that was there first
    loop, kind = Group("loop", F.lit(True)), F.col("event_type")
    of = F.when(kind == "NAVIGATION", F.col("route")).otherwise(F.coalesce("m_query", F.lit("")))
    again = found_in([
        loop.found((kind == "NAVIGATION") & (loop.n >= r["loop_n"]), "LOOP", None, capped(loop.n, 2 * r["loop_n"]), True),
        loop.found((kind == "SUBMIT") & (loop.n > r["search_n"]), "REPEAT_SEARCH", "last", 0.5),
    ], only, said({"LOOP": text("Visited %s %s times", F.col("of"), loop.n.cast("string")), "REPEAT_SEARCH": text("Searched the same query %s times", loop.n.cast("string"))}))
    loops = e.where("event_type = 'NAVIGATION' or event_type = 'SUBMIT' and m_kind = 'search'").groupBy("session_id", "event_type", of.alias("of"))
    parts.append(emitted(loops.agg(*[x.alias(n) for n, x in loop.columns.items()]), again))
    if baselines is not None:
        rage = detection(F.lit(True), "RAGE_CLICK", "element_id", rage_severity(), "ms")
        parts.append(emitted(raging(e, r), found_in([rage], only, said(row_texts(r)))))
    if as_of is not None:
        parts.append(as_of_rules(e, F.lit(as_of), r, only, said({})))
    e = by_time(e, r)
    if summaries:
        of_type = lambda t: F.count_if(kind == t).over(Window.partitionBy("session_id"))
        e = e.withColumn("of_type", F.when(kind == "HOVER", of_type("HOVER")).when(kind == "SCROLL", of_type("SCROLL")))
    # what one order gives goes into an array before the next, so that the second sort carries few columns
    found = found_in(row_rules(r), only, said(row_texts(r)))
    columns, rules = session_rules(r)
    e = at_end(e, ["session_id"], columns, "ends_session", found_in(rules, only, said(session_texts())), "found_of_session")
    e = e if found is None else e.withColumn("found_by_time", found)
    e = by_element(e, r)
    rules = [x for x in neighbour_rules(r) if baselines is None or x[0] != "RAGE_CLICK"]
    found = found_in(rules, only, said(row_texts(r)))
    e = e if found is None else e.withColumn("found_by_element", found)
    columns, rules = element_rules(r)
    e = at_end(e, ["session_id", "element_id"], columns, "ends_element", found_in(rules, only, said(group_texts())), "found_of_element")
    arrays = [F.coalesce(c, F.array()) for c in e.columns if c.startswith("found_")]
    parts.append(emitted(e, F.concat(*arrays) if arrays else None))
    out, *rest = [p for p in parts if p is not None]
    for p in rest:
        out = out.unionByName(p)
    first = Window.partitionBy("session_id", "scope", "type").orderBy("o1", "o2")
    return out.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("session_id", "element_id", "type", "severity", "ts_ms", *["summary"] * summaries)
