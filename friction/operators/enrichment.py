"""Which elements and routes still need a description, in batches for a model, and how its answers are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Types whose interventions are prepared ahead.
PREPARED = ("RAGE_CLICK", "DEAD_CLICK", "INVALID_CLICK", "THRASH", "VALIDATION_LOOP", "REQUIRED_MISSED", "FORMAT_ERROR", "LOOP", "SILENT_FAIL", "BACK_THRASH", "HOVER_HUNT", "LONG_DWELL", "JS_ERROR", "LOGIN_FAILURE")


def pairs_to_prepare(elements: DataFrame, cached: DataFrame, types: tuple[str, ...] = PREPARED) -> DataFrame:
    """element_id, type, context of each described element (element_id, context) and type that the cache (element_id,
    type, context) does not hold in this context."""
    wanted = elements.where("context is not null").withColumn("type", F.explode(F.array(*[F.lit(t) for t in types])))
    return wanted.join(cached.select("element_id", "type", "context"), ["element_id", "type", "context"], "left_anti").select("element_id", "type", "context")


def in_batches(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """rows with `batch`: consecutive numbers of up to `size` rows of each `by`."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("batch", F.floor((nth - 1) / size).cast("int"))


def undescribed(elements: DataFrame, described: DataFrame, routes: DataFrame) -> DataFrame:
    """Elements (element_id, route, ...) without a description, with the title of their route (route, title)."""
    return elements.join(described.select("element_id"), "element_id", "left_anti").join(routes.select("route", F.col("title").alias("route_title")), "route", "left")


def upserted(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """table with the rows of new, which win over old ones of the same key."""
    return table.join(new.select(*key), key, "left_anti").select(*new.columns).unionByName(new)


def inserted(table: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """Interventions (row_id, element_id, ...) to add: not in table yet, and of an element that is known or none."""
    fresh = new.dropDuplicates(["row_id"]).join(table.select("row_id"), "row_id", "left_anti")
    return fresh.where("element_id is null").unionByName(fresh.where("element_id is not null").join(known.select("element_id"), "element_id", "left_semi").select(*fresh.columns))


def route_signatures(elements: DataFrame) -> DataFrame:
    """route, members, signature: SHA-256 over the sorted id:name of a route's described elements (element_id, name, route)."""
    member = F.concat_ws(":", "element_id", "name")
    return elements.where("route is not null").groupBy("route").agg(F.count("*").alias("members"), F.sha2(F.array_join(F.array_sort(F.collect_list(member)), "|"), 256).alias("signature"))


def changed_routes(signatures: DataFrame, stored: DataFrame) -> DataFrame:
    """Routes whose signature (route, signature) is not the stored one."""
    return signatures.join(stored.select("route", "signature"), ["route", "signature"], "left_anti")
