"""Events as they come over the wire: JSON text, parsed to VARIANT, held against every constraint of the protocol, and cast to
the columns that the rules read.

A value is used only in its own type: "0" is no number and "true" no boolean. An event keeps all the constraints that it
breaks, so that quarantine says everything at once; a text that is no JSON breaks `json` alone. Lengths are in characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from friction.functions.tables import spread
from friction.schema import EVENT_COLUMNS, EVENT_TYPES

#: Protocol versions, and the most characters of each text.
VERSIONS = (1, 2, 3)
PAGE_TEXTS = {"title": 500, "h1": 500, "referrer": 2048}
PAGE_COUNTS = ("viewportW", "viewportH", "ageMs")
FORM_FACTORS = ("mobile", "tablet", "desktop")
ELEMENT_TEXTS = {"label": 500, "role": 40, "formId": 120, "validity": 200}
ELEMENT_FLAGS = ("formValid", "touched", "dirty", "disabled", "dead")
TIME = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?Z$"
NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def kind(v: Column, path: str) -> Column:
    """The type of what is at a path: null where there is nothing, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text(v: Column, path: str) -> Column:
    """The string at a path, null for any other type."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def number(v: Column, path: str) -> Column:
    return F.when(kind(v, path).rlike(NUMBER), F.try_variant_get(v, path, "double"))


def flag(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def constraints(v: Column) -> dict[str, Column]:
    """What holds of a valid event; null counts as broken."""
    absent = lambda p: kind(v, p).isNull()
    null = lambda p: F.coalesce(kind(v, p) == "VOID", F.lit(False))
    long = lambda p, low, high: F.length(text(v, p)).between(low, high)
    count = lambda p: (number(v, p) >= 0) & (number(v, p) == F.floor(number(v, p)))
    thing = lambda p: F.startswith(kind(v, p), F.lit("OBJECT"))
    day = F.try_to_timestamp(F.substring(text(v, "$.ts"), 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    plain = F.forall(F.map_values(F.try_variant_get(v, "$.meta", "map<string,variant>")), lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")).rlike(NUMBER + "|^(STRING|BOOLEAN|VOID)$"))
    out = {
        "schemaVersion": number(v, "$.schemaVersion").isin(*map(float, VERSIONS)),
        "idempotencyKey": long("$.idempotencyKey", 1, 128),
        "sessionId": long("$.sessionId", 1, 128),
        "userIdHash": (kind(v, "$.userIdHash") == "STRING") | null("$.userIdHash"),
        "elementId": text(v, "$.elementId").rlike("^sh_[0-9a-f]{32}$") | null("$.elementId"),
        "route": long("$.route", 1, 2048),
        "eventType": text(v, "$.eventType").isin(*EVENT_TYPES),
        "ts": text(v, "$.ts").rlike(TIME) & day,
        "meta": absent("$.meta") | (thing("$.meta") & plain),
        "page": absent("$.page") | thing("$.page"),
        "element": absent("$.element") | thing("$.element"),
        "page.formFactor": absent("$.page.formFactor") | text(v, "$.page.formFactor").isin(*FORM_FACTORS),
        "element.valueLength": absent("$.element.valueLength") | count("$.element.valueLength"),
    }
    out |= {f"page.{c}": absent(f"$.page.{c}") | long(f"$.page.{c}", 0, n) for c, n in PAGE_TEXTS.items()}
    out |= {f"page.{c}": absent(f"$.page.{c}") | count(f"$.page.{c}") for c in PAGE_COUNTS}
    out |= {f"element.{c}": absent(f"$.element.{c}") | long(f"$.element.{c}", 0, n) for c, n in ELEMENT_TEXTS.items()}
    out |= {f"element.{c}": absent(f"$.element.{c}") | (kind(v, f"$.element.{c}") == "BOOLEAN") for c in ELEMENT_FLAGS}
    return out


def parsed(events: DataFrame, payload: str = "payload") -> DataFrame:
    """events with `event` (VARIANT, null if the text is no JSON) and `reasons`: the constraints that it breaks, sorted."""

    def held(v: Column) -> Column:
        broken = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in sorted(constraints(v).items())]
        return F.struct(v.alias("event"), F.when(v.isNull(), F.array(F.lit("json"))).otherwise(F.array_compact(F.array(*broken))).alias("reasons"))

    # one value of a function, so that no filter on the reasons parses the text once for each of them
    whole = F.transform(F.array(F.try_parse_json(payload)), held)
    return spread(events).withColumn("_wire", F.explode(whole)).select(*events.columns, "_wire.event", "_wire.reasons")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events and the others, of parsed()."""
    good = F.size("reasons") == 0
    return rows.where(good).drop("reasons"), rows.where(~good)


def batch_reasons(batch: Column, most: int = 500) -> Column:
    """What a batch (VARIANT) itself breaks: its version, its clock, or the number of its events."""
    n = F.size(F.try_variant_get(batch, "$.events", "array<variant>"))
    holds = {"schemaVersion": number(batch, "$.schemaVersion").isin(*map(float, VERSIONS)), "clockOffsetMs": number(batch, "$.clockOffsetMs").isNotNull(), "events": (n >= 0) & (n <= most)}
    broken = [F.when(~F.coalesce(h, F.lit(False)), F.lit(name)) for name, h in sorted(holds.items())]
    return F.when(batch.isNull(), F.array(F.lit("json"))).otherwise(F.array_compact(F.array(*broken)))


def rule_columns(v: Column, seq: Column) -> list[Column]:
    """EVENT_COLUMNS of a valid event. What is not of the type that a rule asks for is null to it."""
    m, el = (lambda f, c: f(v, f"$.meta.{c}")), (lambda f, c: f(v, f"$.element.{c}"))
    query = F.try_variant_get(v, "$.meta.query", "string")  # any type counts by its text
    column = {
        "session_id": text(v, "$.sessionId"), "element_id": text(v, "$.elementId"), "route": text(v, "$.route"), "event_type": text(v, "$.eventType"),
        "ms": F.unix_millis(F.try_to_timestamp(text(v, "$.ts"))), "seq": seq, "m_query": query, "el_validity": el(text, "validity"), "el_role": el(text, "role"),
        "el_disabled": el(flag, "disabled"), "el_dead": el(flag, "dead"), "el_form_valid": el(flag, "formValid"),
    }
    column |= {f"m_{c}": m(text, c) for c in ("kind", "role", "trigger", "target", "message")}
    column |= {f"m_{c}": m(flag, c) for c in ("disabled", "dead", "empty", "tooltip")}
    column |= {f"m_{c}": m(number, c) for c in ("results", "ms", "length", "dy")}
    return [column[c].cast(t).alias(c) for c, t in EVENT_COLUMNS.items()]


def rule_events(valid: DataFrame, seq: str = "seq") -> DataFrame:
    """The events that the rules read, of valid ones."""
    return valid.select(*rule_columns(F.col("event"), F.col(seq)))


def any_of(names: list[str]) -> Column:
    """Whether an event of parsed() breaks one of the constraints."""
    return reduce(lambda a, b: a | b, [F.array_contains("reasons", n) for n in names])
