"""Queries on events as JSON text, with their SQL. The text is made of the driver's events by expressions that both engines
read, each event with one field that may break a constraint."""

from __future__ import annotations

from pyspark.sql import functions as F

from friction.operators.detect import detect
from friction.schema import EVENT_TYPES
from friction.sources import wire

#: Fields of a valid event, as SQL that makes their JSON.
FIELDS = {
    "schemaVersion": "'3'", "idempotencyKey": "'\"k' || event_id || '\"'", "sessionId": "'\"s' || user_id || '\"'", "userIdHash": "'null'",
    "elementId": "'\"sh_0123456789abcdef0123456789abcde' || (event_id % 10) || '\"'", "route": "'\"/r' || (event_id % 4) || '\"'",
    "eventType": "CASE WHEN event_type = 'click' THEN '\"CLICK\"' WHEN event_type = 'view' THEN '\"NAVIGATION\"' ELSE '\"SUBMIT\"' END",
    "ts": "'\"2026-01-02T03:04:05.' || lpad(CAST(event_id % 1000 AS STRING), 3, '0') || 'Z\"'",
    "meta": "'{\"kind\":\"search\",\"results\":' || (event_id % 3) || ',\"empty\":false,\"none\":null}'",
    "page": "'{\"title\":\"T\",\"viewportW\":800,\"formFactor\":\"tablet\",\"more\":[1]}'",
    "element": "'{\"label\":\"L\",\"disabled\":false,\"valueLength\":4}'",
}
_text = lambda n: f"'\"' || repeat('x', {n}) || '\"'"
_in = lambda c, value: f"'{{\"{c}\":' || {value} || '}}'"
#: (field, SQL of another JSON for it; None: the field is left out). Both sides of every limit.
CHANGES = [
    ("schemaVersion", "'4'"), ("schemaVersion", "'\"3\"'"), ("schemaVersion", "'2.0'"), ("schemaVersion", None),
    ("idempotencyKey", "'\"\"'"), ("idempotencyKey", _text(128)), ("idempotencyKey", _text(129)), ("idempotencyKey", "'7'"),
    ("sessionId", "'\"\"'"), ("sessionId", _text(129)), ("sessionId", "'null'"), ("userIdHash", None), ("userIdHash", "'\"h\"'"), ("userIdHash", "'5'"),
    ("elementId", "'null'"), ("elementId", "'\"sh_0123\"'"), ("elementId", "'\"sh_0123456789ABCDEF0123456789abcdef\"'"), ("elementId", None),
    ("route", "'\"\"'"), ("route", _text(2048)), ("route", _text(2049)), ("eventType", "'\"WINK\"'"), ("eventType", "'\"click\"'"), ("eventType", "'1'"),
    ("ts", "'\"2026-01-02\"'"), ("ts", "'\"2026-01-02T25:00:00Z\"'"), ("ts", "'\"2026-02-31T05:00:00Z\"'"), ("ts", "'\"2026-01-02T03:04:05+01:00\"'"), ("ts", "'1767323045'"), ("ts", "'\"2026-01-02T03:04:05Z\"'"),
    ("meta", None), ("meta", "'null'"), ("meta", "'[1]'"), ("meta", "'{\"a\":{\"b\":1}}'"), ("meta", "'{\"a\":[1]}'"), ("meta", "'{}'"), ("meta", "'{\"a\":1.5,\"b\":\"x\",\"c\":true,\"d\":null}'"),
    ("page", None), ("page", "'null'"), ("page", "'\"x\"'"), ("page", "'{}'"), ("element", None), ("element", "'null'"), ("element", "'{}'"),
    *[("page", _in(c, f)) for c, n in wire.PAGE_TEXTS.items() for f in (_text(n), _text(n + 1), "'9'")],
    *[("page", _in(c, f"'{f}'")) for c in wire.PAGE_COUNTS for f in ("0", "7.0", "-1", "1.5", '"9"', "null")],
    *[("page", _in("formFactor", f"'{f}'")) for f in ('"mobile"', '"watch"', "3")],
    *[("element", _in(c, f)) for c, n in wire.ELEMENT_TEXTS.items() for f in (_text(n), _text(n + 1), "'false'")],
    *[("element", _in(c, f"'{f}'")) for c in wire.ELEMENT_FLAGS for f in ("true", '"true"', "1", "null")],
    *[("element", _in("valueLength", f"'{f}'")) for f in ("0", "-2", "2.5", '"4"')],
]
#: Meta whose values are of the wrong type for the rules that ask for them, and of the right one.
METAS = ("{}", '{"kind":"search","results":0}', '{"kind":"search","results":"0"}', '{"kind":"filter","results":0}', '{"kind":"filter","results":false}', '{"kind":"filter","results":null}', '{"disabled":true}', '{"disabled":"true"}', '{"disabled":1}', '{"dead":true}', '{"dead":"yes"}', '{"kind":"search","empty":true}', '{"kind":"search","empty":"true"}', '{"kind":"search","results":0.0}')


def payload() -> str:
    """SQL of an event's text: event_id chooses which field changes, and how; some are no JSON."""
    n = len(CHANGES)
    parts = []
    for f, plain in FIELDS.items():
        mine = [(i, s) for i, (g, s) in enumerate(CHANGES) if g == f]
        cases = " ".join(f"WHEN {i} THEN {'NULL' if s is None else s}" for i, s in mine)
        parts.append(f"CASE event_id % {n + 2} {cases} ELSE {plain} END")
    whole = " || ".join(f"coalesce('\"{f}\":' || ({p}) || ',', '')" for f, p in zip(FIELDS, parts))
    return f"CASE WHEN event_id % {n + 2} = {n} THEN '{{\"schemaVersion\":3,' ELSE '{{' || {whole} || '\"extra\":1}}' END"


def typed_payload() -> str:
    cases = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(METAS))
    fields = {**FIELDS, "meta": f"CASE event_id % {len(METAS)} {cases} END", "element": "CASE WHEN event_id % 5 = 0 THEN '{\"disabled\":\"true\",\"dead\":\"true\"}' WHEN event_id % 35 = 1 THEN '{\"disabled\":true}' ELSE '{}' END"}
    return "'{' || " + " || ',' || ".join(f"'\"{f}\":' || {p}" for f, p in fields.items()) + " || '}'"


def raw(s, d, made: str):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(made).alias("payload"))


def wire_events(s, d):
    """Every event with the constraints that it breaks, and the fields of those that break none."""
    rows = wire.parsed(raw(s, d, payload()))
    fine, v = F.size("reasons") == 0, F.col("event")
    shown = {"session_id": wire.text(v, "$.sessionId"), "ms": F.unix_millis(F.try_to_timestamp(wire.text(v, "$.ts"))), "results": wire.number(v, "$.meta.results"), "title": wire.text(v, "$.page.title"), "disabled": wire.flag(v, "$.element.disabled")}
    return rows.select("event_id", F.array_join("reasons", ",").alias("reasons"), *[F.when(fine, c).alias(k) for k, c in shown.items()])


def quarantine_reasons(s, d):
    """How many events break each constraint."""
    _, bad = wire.split(wire.parsed(raw(s, d, payload())))
    return bad.select(F.explode("reasons").alias("reason"), "event_id").groupBy("reason").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def typed_rules(s, d):
    """The rules that ask for a value's type, over JSON meta: wrong types don't fire."""
    good, _ = wire.split(wire.parsed(raw(s, d, typed_payload())))
    found = detect(wire.rule_events(good, "event_id"), only={"INVALID_CLICK", "DEAD_CLICK", "ZERO_RESULTS", "FAILED_FILTER", "EMPTY_SEARCH"})
    return found.select("session_id", "element_id", "type", "severity", "ts_ms")


def queries() -> dict:
    return {"wire_events": wire_events, "wire_quarantine": quarantine_reasons, "wire_typed_rules": typed_rules}


def oracle_sql() -> dict[str, str]:
    made = payload()
    j = lambda p: f"json_type(j, '$.{p}')"
    s = lambda p: f"CASE WHEN {j(p)} = 'VARCHAR' THEN json_extract_string(j, '$.{p}') END"
    n = lambda p: f"CASE WHEN {j(p)} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(j, '$.{p}') AS DOUBLE) END"
    long = lambda p, low, high: f"length({s(p)}) BETWEEN {low} AND {high}"
    count = lambda p: f"({n(p)} >= 0 AND {n(p)} = floor({n(p)}))"
    absent = lambda p: f"{j(p)} IS NULL"
    types = ", ".join(f"'{t}'" for t in EVENT_TYPES)
    holds = {
        "schemaVersion": f"{n('schemaVersion')} IN (1, 2, 3)", "idempotencyKey": long("idempotencyKey", 1, 128), "sessionId": long("sessionId", 1, 128),
        "userIdHash": f"{j('userIdHash')} IN ('VARCHAR', 'NULL')", "elementId": f"(regexp_matches({s('elementId')}, '^sh_[0-9a-f]{{32}}$') OR {j('elementId')} = 'NULL')",
        "route": long("route", 1, 2048), "eventType": f"{s('eventType')} IN ({types})",
        "ts": f"(regexp_matches({s('ts')}, '{wire.TIME}') AND try_cast(substr({s('ts')}, 1, 10) AS DATE) IS NOT NULL)",
        "meta": f"({absent('meta')} OR {j('meta')} = 'OBJECT' AND NOT coalesce(list_bool_or(list_transform(json_extract(j, '$.meta.*'), lambda x: json_type(x) IN ('OBJECT', 'ARRAY'))), false))",
        "page": f"({absent('page')} OR {j('page')} = 'OBJECT')", "element": f"({absent('element')} OR {j('element')} = 'OBJECT')",
        "page.formFactor": f"({absent('page.formFactor')} OR {s('page.formFactor')} IN ('mobile', 'tablet', 'desktop'))",
        "element.valueLength": f"({absent('element.valueLength')} OR {count('element.valueLength')})",
    }
    holds |= {f"page.{c}": f"({absent('page.' + c)} OR {long('page.' + c, 0, k)})" for c, k in wire.PAGE_TEXTS.items()}
    holds |= {f"page.{c}": f"({absent('page.' + c)} OR {count('page.' + c)})" for c in wire.PAGE_COUNTS}
    holds |= {f"element.{c}": f"({absent('element.' + c)} OR {long('element.' + c, 0, k)})" for c, k in wire.ELEMENT_TEXTS.items()}
    holds |= {f"element.{c}": f"({absent('element.' + c)} OR {j('element.' + c)} = 'BOOLEAN')" for c in wire.ELEMENT_FLAGS}
    broken = ", ".join(f"CASE WHEN NOT coalesce({h}, false) THEN '{name}' END" for name, h in sorted(holds.items()))
    base = f"""WITH p AS MATERIALIZED (SELECT event_id, {made} AS payload FROM events),
      w AS MATERIALIZED (SELECT event_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM p),
      r AS MATERIALIZED (SELECT event_id, j, CASE WHEN j IS NULL THEN ['json'] ELSE list_filter([{broken}], lambda x: x IS NOT NULL) END AS reasons FROM w)"""
    b = lambda p: f"CASE WHEN {j(p)} = 'BOOLEAN' THEN CAST(json_extract(j, '$.{p}') AS BOOLEAN) END"
    shown = {"session_id": s("sessionId"), "ms": f"epoch_ms(CAST(replace({s('ts')}, 'Z', '') AS TIMESTAMP))", "results": n("meta.results"), "title": s("page.title"), "disabled": b("element.disabled")}
    rules = {
        "INVALID_CLICK": (0.6, f"et = 'CLICK' AND (coalesce({b('element.disabled')}, false) OR coalesce({b('meta.disabled')}, false))"),
        "DEAD_CLICK": (0.6, f"et = 'CLICK' AND (coalesce({b('element.dead')}, false) OR coalesce({b('meta.dead')}, false))"),
        "ZERO_RESULTS": (0.55, f"et = 'SUBMIT' AND {s('meta.kind')} = 'search' AND {n('meta.results')} = 0"),
        "EMPTY_SEARCH": (0.3, f"et = 'SUBMIT' AND {s('meta.kind')} = 'search' AND coalesce({b('meta.empty')}, false)"),
        "FAILED_FILTER": (0.5, f"et = 'SUBMIT' AND {s('meta.kind')} = 'filter' AND {n('meta.results')} = 0"),
    }
    fired = " UNION ALL ".join(f"SELECT session_id, element_id, '{k}' AS type, CAST({sev} AS DOUBLE) AS severity, ms AS ts_ms, event_id FROM t WHERE {cond}" for k, (sev, cond) in rules.items())
    typed = f"""WITH w AS MATERIALIZED (SELECT event_id, CAST({typed_payload()} AS JSON) AS j FROM events),
      t AS MATERIALIZED (SELECT event_id, j, {s('sessionId')} AS session_id, {s('elementId')} AS element_id, {s('eventType')} AS et, epoch_ms(CAST(replace({s('ts')}, 'Z', '') AS TIMESTAMP)) AS ms FROM w
        WHERE coalesce({j('element.disabled')}, 'BOOLEAN') = 'BOOLEAN' AND coalesce({j('element.dead')}, 'BOOLEAN') = 'BOOLEAN'),
      f AS ({fired})
      SELECT session_id, element_id, type, severity, ts_ms FROM f QUALIFY row_number() OVER (PARTITION BY session_id, element_id, type ORDER BY ts_ms, event_id) = 1"""
    return {
        "wire_events": base + " SELECT event_id, array_to_string(reasons, ',') AS reasons, " + ", ".join(f"CASE WHEN len(reasons) = 0 THEN {c} END AS {k}" for k, c in shown.items()) + " FROM r",
        "wire_quarantine": base + " SELECT reason, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, unnest(reasons) AS reason FROM r) GROUP BY 1",
        "wire_typed_rules": typed,
    }
