"""Storing a stream of events once: a batch looks up its keys in the filters of stored batches, and reads only those that may
hold one of them.

A batch of the stream has a partition of its own, stored_batch=<number>, which a retry overwrites. Beside it lie its filters:
of each slot of keys a Bloom filter, BITS for a key. A new batch tests its keys against the filters of all slots they fall
into, joins the few stored batches that remain, and compares whole keys there. What it reads of the table is bounded by its
duplicates, not by how long the table has been growing; the filters are two bytes a stored key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from friction.functions.tables import listed, removed, written
from friction.operators.ingest import first_by_key, new_rows, storable

PARTITION, SLOTS, BITS, PROBES = "stored_batch", 16, 16, 8


def digests(rows: DataFrame, key: list[str]) -> DataFrame:
    """slot, digest of each whole key; keys with a null never conflict."""
    rows = rows.dropna(subset=key).select(F.xxhash64(*key).alias("digest")).distinct()
    return rows.select(F.pmod("digest", F.lit(SLOTS)).cast("int").alias("slot"), "digest")


def places(digest: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each digest, by double hashing with both halves of its mixture: the digests of a slot have equal low bits."""
    h = digest.view(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h = h ^ (h >> np.uint64(31))
    first, step = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (first[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def filters(keys: DataFrame) -> DataFrame:
    """slot, bits, filter: of each slot's keys."""

    def build(slot, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = max(64, -(-len(pdf) * BITS // 64) * 64)
        held = np.zeros(bits, bool)
        held[places(pdf["digest"].to_numpy(np.int64), bits).ravel()] = True
        return pd.DataFrame({"slot": [slot[0]], "bits": [bits], "filter": [np.packbits(held).tobytes()]})

    return keys.groupBy("slot").applyInPandas(build, "slot int, bits long, filter binary")


def possible(keys: DataFrame, index: DataFrame) -> DataFrame:
    """stored_batch: the batches whose filters (slot, bits, filter, stored_batch) may hold one of the keys (slot, digest)."""

    def test(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        digest, out = mine["digest"].to_numpy(np.int64), []
        for r in held.itertuples():
            p = places(digest, r.bits).astype(np.int64)
            data = np.frombuffer(r.filter, np.uint8)
            if ((data[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(1).any():
                out.append(getattr(r, PARTITION))
        return pd.DataFrame({PARTITION: out}, dtype="int64")

    return keys.groupBy("slot").cogroup(index.groupBy("slot")).applyInPandas(test, f"{PARTITION} long").distinct()


def stored_of(spark: SparkSession, table: str, keys: DataFrame, schema, number: int) -> DataFrame:
    """The stored events of other batches that may hold one of the keys."""
    there = listed(spark, f"{table}_filters")
    if not any(n.startswith(PARTITION) for n in there):
        return spark.createDataFrame([], schema)
    index = spark.read.schema(f"slot int, bits long, filter binary, {PARTITION} long").parquet(f"{table}_filters")
    batches = [r[0] for r in possible(keys, index.where(F.col(PARTITION) != number)).collect()]  # numbers of batches with a duplicate
    folders = [f"{table}/{PARTITION}={b}" for b in sorted(batches)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def store_batch(batch: DataFrame, number: int, table: str, key: list[str], order: list[str]) -> None:
    """Store what of a batch the table does not hold yet. A retry of the batch replaces what it stored."""
    if PARTITION in batch.columns:
        raise ValueError(f"events have a column {PARTITION}, the name of the table's partitions")
    rows = written(first_by_key(storable(batch), key, order), "batch")  # read for its digests and for what is new
    new = new_rows(rows, stored_of(batch.sparkSession, table, digests(rows, key), batch.schema, number), key)
    at = f"{table}/{PARTITION}={number}"
    new.write.mode("overwrite").parquet(at)
    # the filters come last: a batch without them is one that a retry writes again
    filters(digests(batch.sparkSession.read.schema(batch.schema).parquet(at), key)).write.mode("overwrite").parquet(f"{table}_filters/{PARTITION}={number}")
    removed(batch.sparkSession, rows.written_at)


def store_once(events: DataFrame, table: str, checkpoint: str, key: list[str], order: list[str]):
    """Start a query that appends to a Parquet table what it does not hold yet, by key; rows with a null in the key are stored
    as they come. On a stream with a watermark repeats within its delay are dropped before."""

    def write(batch: DataFrame, number: int) -> None:
        store_batch(batch, number, table, key, order)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(events: DataFrame, key: list[str]) -> DataFrame:
    """A stream of timed() events without the repeats of a key that come within the watermark's delay."""
    return events.dropDuplicatesWithinWatermark(key)


def stored(spark: SparkSession, table: str, schema) -> DataFrame:
    """The events of the table, with the batch that stored them."""
    return spark.read.schema(schema.add(PARTITION, "long") if not isinstance(schema, str) else f"{schema}, {PARTITION} long").parquet(table)
