"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Every task of the scan turns its rows into one run: (digest, smallest doc_id, rows), a digest once. Runs are then merged
in rounds, `fan` neighbours into one: an exchange by run and digest range brings them together, one sort puts their rows
in the order of the digest and the id, and the first row of each digest goes on with the rows of all. Each round writes
its sorted runs to the shared folder, so a round that loses executors starts from the table of the round before. A run is
no larger than its distinct digests, however many copies a text has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.llm.common import SPACE, dropped, lookup, without, written

#: SHA-256 names a text; length and a second hash are compared along with it at every level.
KEY = ["sha", "size", "xx"]


def digest_of_text() -> list:
    """KEY, of the column text."""
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    return [F.unhex(F.sha2(norm, 256)).alias("sha"), F.octet_length(norm).alias("size"), F.xxhash64(norm).alias("xx")]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the normalised text, and the run (input task) of the row."""
    return docs.select("doc_id", *digest_of_text(), F.spark_partition_id().alias("run"))


def first_runs(rows: DataFrame) -> DataFrame:
    """One sorted run for each input task; what a task has of one digest is combined before anything moves."""
    at = F.conv(F.hex(F.substring("sha", 1, 2)), 16, 10).cast("int").alias("range")
    runs = rows.groupBy("run", at, *KEY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return written(runs.sortWithinPartitions("run", "range", *KEY), "runs")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Runs of one number become one sorted run: of each verified digest the smallest id and the rows."""
    order = ["run", "range", *KEY, F.col("keep_id").asc_nulls_last()]
    ordered = runs.repartition("run", "range").sortWithinPartitions(*order)
    same = Window.partitionBy("run", "range", *KEY).orderBy(F.col("keep_id").asc_nulls_last())
    rows = F.sum("group_size").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = ordered.withColumn("place", F.row_number().over(same)).withColumn("group_size", rows).where("place = 1")
    return written(first.select(*runs.columns), "runs")


def tree_merge(rows: DataFrame, fan: int = 8) -> DataFrame:
    """The last run of all: one row for each distinct text. rows: of digests()."""
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    runs = first_runs(rows)
    while left > 1:
        before, left = runs, -(-left // fan)
        runs = merge_runs(before.withColumn("run", F.floor(F.col("run") / F.lit(fan)).cast("int")))
        dropped(before)
    return runs.drop("run", "range")


def with_groups(docs: DataFrame, fan: int) -> DataFrame:
    """doc_id, key (struct of KEY), keep_id, group_size and `grouped` of each row; the last three null for single texts."""
    rows = written(digests(docs), "digests")
    groups = tree_merge(rows, fan).where("group_size > 1")
    groups = groups.select(F.struct(*KEY).alias("key"), "keep_id", "group_size", F.lit(True).alias("grouped"))
    return lookup(rows.select("doc_id", F.struct(*KEY).alias("key")), groups, "key", "group_size", rows.count())


def exact_dedup(docs: DataFrame, fan: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs (columns doc_id, text; others ignored).

    Null texts count as empty; a null doc_id is never a keep_id unless all ids of its text are null. Rows that repeat
    a doc_id with one text are one document: they share the verdict. An empty table gives an empty result. Texts of any
    length pass whole through one hash."""
    out = with_groups(docs, fan)
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("key.sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, fan: int = 8) -> DataFrame:
    """docs (doc_id, text; all columns kept) with exactly one row of each normalised text: one with the smallest doc_id.

    The verdict is of the row, doc_id and text: another text under a repeated id has its own. Null ids stay only where a
    text has no other; null texts are empty ones. Of equal rows one stays. Columns may have any names. An empty table
    gives an empty result."""
    rows = with_groups(docs, fan).where("grouped").select("doc_id", "key.*", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("first"))
    rows = rows.groupBy("doc_id", *KEY, "first").count().where("not first or count > 1")
    gone = written(rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(["doc_id", *KEY])], F.col("first").alias("one_stays")), "gone")
    return without(docs, [F.col("doc_id"), *digest_of_text()], gone)


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""
