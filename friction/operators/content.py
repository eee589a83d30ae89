"""What an intervention says: pools of variants, copy with its places filled, hints on validation, related elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of intervention that can be shown.
RENDERABLE = ("OVERLAY", "HIGHLIGHT", "TOOLTIP", "MODAL", "BANNER", "INLINE_HINT", "CONFIRM", "ANNOUNCE")
PLACES = ("label", "route", "intent", "pageTitle", "validation", "routePurpose", "journeyStage")


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """template with each {place} replaced, literally. Without a label `this` stands; without an intent the label, else
    `continue`; other places are left blank."""
    null = F.lit(None).cast("string")
    label = values.get("label", null)
    fallback = {"label": F.lit("this"), "intent": F.coalesce(label, F.lit("continue"))}
    for place in PLACES:
        template = F.replace(template, F.lit("{" + place + "}"), F.coalesce(values.get(place, null), fallback.get(place, F.lit(""))))
    return template


def validation_hint(v: dict[str, Column]) -> Column:
    """A sentence on the rules of a field: required, inputType, min, max, minLength, maxLength, pattern; '' without any."""
    null = F.lit(None).cast("string")
    at = lambda k: v.get(k, null)
    kind, low, high = at("inputType"), at("min").cast("string"), at("max").cast("string")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    between = F.coalesce(said("between ", low, " and ", high), said("at least ", low), said("at most ", high))
    by_kind = F.when(kind == "email", "valid email").when(kind == "url", "valid URL").when(kind == "tel", "valid phone number").when(kind == "number", between)
    length = lambda k, word: F.when(at(k).cast("long") > 0, said(word, at(k).cast("string"), " characters"))
    form = F.when((F.coalesce(at("pattern"), F.lit("")) != "") & (F.coalesce(kind, F.lit("")) == ""), "a valid format")
    parts = F.array_compact(F.array(F.when(at("required").cast("boolean"), "required"), by_kind, length("minLength", "at least "), length("maxLength", "at most "), form))
    return F.when(F.size(parts) > 0, F.concat(F.lit("needs "), F.array_join(parts, ", "))).otherwise("")


def variant_pools(detections: DataFrame, cached: DataFrame, templates: DataFrame) -> DataFrame:
    """detections with `pool`: the cached variants (element_id, type, variant_index, copy) in order, else the templates of the type.

    Gaps in the cached numbers close up. Both sides are grouped before they are joined, so a pool is joined once."""
    pool = lambda t, keys, name: t.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("variant_index", "copy"))), lambda x: x["copy"]).alias(name))
    own = pool(cached.withColumnRenamed("element_id", "el"), ["el", "type"], "own")
    general = pool(templates, ["type"], "general")
    out = detections.join(own.withColumnRenamed("type", "t"), F.col("element_id").eqNullSafe(F.col("el")) & (F.col("type") == F.col("t")), "left").drop("el", "t")
    out = out.join(general, "type", "left")
    return out.select(*detections.columns, F.coalesce("own", "general", F.array().cast("array<string>")).alias("pool"))


def related_elements(actions: DataFrame, labels: DataFrame, considered: int = 5, most: int = 3) -> DataFrame:
    """element_id, related: ids of up to three elements that the first five alternative actions name, in their order.

    actions: element_id, actions (array of labels); labels: element_id, label. Of equal labels the largest id is taken."""
    name = lambda c: F.trim(F.lower(c))
    index = labels.groupBy(name(F.col("label")).alias("name")).agg(F.max("element_id").alias("target"))
    rows = actions.select("element_id", F.posexplode(F.slice("actions", 1, considered)).alias("at", "action"))
    rows = rows.select("element_id", "at", name(F.col("action")).alias("name")).join(index, "name")
    first = rows.groupBy("element_id", "target").agg(F.min("at").alias("at"))
    return first.groupBy("element_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "target"))), lambda x: x["target"]), 1, most).alias("related"))


def valid_variants(proposed: DataFrame, most: int = 2) -> DataFrame:
    """Proposed variants (element_id, type, place, kind, copy) that can be shown: of each pair's first `most` those of a
    renderable kind with a copy, numbered anew."""
    array = F.slice(F.array_sort(F.collect_list(F.struct("place", "kind", F.trim("copy").alias("copy")))), 1, most)
    g = proposed.groupBy("element_id", "type").agg(array.alias("v"))
    good = F.filter("v", lambda x: x["kind"].isin(*RENDERABLE) & (F.coalesce(x["copy"], F.lit("")) != ""))
    return g.select("element_id", "type", F.posexplode(good).alias("variant_index", "v")).select("element_id", "type", "variant_index", "v.kind", "v.copy")
