"""A Parquet table with one row for each key, whose batches are applied once, however often they are tried.

Keys are dealt to buckets by hash. A version of a bucket is a folder of its own, bucket=<b>/version=<v>; a batch writes
the next version of the buckets that its keys fall into, and no other. A version counts once its marker is written, after all
of its buckets. A batch that is tried again replaces its own folders and starts from the versions before it, so increments are
not added twice; one that was committed changes nothing. Readers see the last committed version of each bucket."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from friction.functions.tables import listed, removed, touched

#: Combines the rows of the touched buckets (first) with those of the batch (second).
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def replaced(key: list[str]) -> Merge:
    """Rows of the batch take the place of those with their key; others are kept."""
    return lambda old, new: old.join(new.select(*key), key, "left_anti").select(*new.columns).unionByName(new)


def added(key: list[str], counters: list[str]) -> Merge:
    """Counters of the batch are added to those of its key; new keys come in. Nulls add nothing."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in counters]
    return lambda old, new: old.select(*key, *counters).unionByName(new.select(*key, *counters)).groupBy(*key).agg(*sums)


def owned(group: list[str], key: list[str]) -> Merge:
    """All rows of the groups in the batch go, its own come in, a key once; other groups stay. The table is keyed by group."""
    return lambda old, new: old.join(new.select(*group).distinct(), group, "left_anti").select(*new.columns).unionByName(new.dropDuplicates([*group, *key]))


class KeyedTable:
    """key: the columns that are hashed to buckets; they may not be null."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        return sorted(int(n) for n in listed(self.spark, f"{self.path}/_committed"))

    def folders(self, before: int | None = None) -> dict[int, str]:
        """The folder of the last committed version of each bucket, of those before a version."""
        committed, out = {v for v in self.versions() if before is None or v < before}, {}
        for b in listed(self.spark, self.path):
            if of := re.fullmatch(r"bucket=(\d+)", b):
                mine = [int(v[8:]) for v in listed(self.spark, f"{self.path}/{b}") if v.startswith("version=") and int(v[8:]) in committed]
                if mine:
                    out[int(of[1])] = f"{self.path}/{b}/version={max(mine)}"
        return out

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table; only: some of its buckets."""
        folders = [f for b, f in self.folders(before).items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, version: int, merge: Merge) -> bool:
        """Write the buckets of a batch as a version. False if that version or a later one was committed before: nothing changes."""
        if any(v >= version for v in self.versions()):
            return False
        rows = batch.withColumn("bucket", self.bucket())
        touched_buckets = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        names = self.spark.createDataFrame([], self.schema).columns
        after = merge(self.read(version, touched_buckets), batch).select(*names).withColumn("bucket", self.bucket()).withColumn("version", F.lit(version))
        for b in touched_buckets:  # of a try that broke off
            removed(self.spark, f"{self.path}/bucket={b}/version={version}")
        if touched_buckets:
            dealt = after.repartition(min(len(touched_buckets), self.buckets), "bucket")
            dealt.write.mode("append").partitionBy("bucket", "version").parquet(self.path)
        touched(self.spark, f"{self.path}/_committed/{version}")
        return True

    def vacuum(self) -> None:
        """Delete the versions that no reader needs: all before the last committed one of a bucket."""
        for b, folder in self.folders().items():
            last = int(folder.rsplit("=", 1)[1])
            for v in listed(self.spark, f"{self.path}/bucket={b}"):
                if v.startswith("version=") and int(v[8:]) < last:
                    removed(self.spark, f"{self.path}/bucket={b}/{v}")
