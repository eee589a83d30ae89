"""What the operators of this subpackage share: tables in the shared folder, and a join that a hot key cannot stall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from friction.functions.tables import shared_dir, written

__all__ = ["SPACE", "WORD", "deleted", "dropped", "joined", "lookup", "read_table", "row_of", "shared_dir", "without", "words_in", "written"]

#: The white space of the contracts, as a Java and Python character class, and a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    deleted(df.sparkSession, df.written_at)


def deleted(spark: SparkSession, at: str) -> None:
    """Delete a folder in the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words_in(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, share: int = 1000) -> DataFrame:
    """rows left-joined to table, which has one row for each key and the number of rows with it in `weight`.

    Keys that hold 1/share of all rows or more number at most `share`: they alone are broadcast, and their rows stay
    where they are. All other rows are joined by a shuffle in which no key is heavier than 1/share. rows is read for each
    of the two, so it should be a narrow table that is written."""
    values = [c for c in table.columns if c != key]
    is_hot = F.col(weight) * F.lit(share) >= F.lit(total)
    hot = F.broadcast(table.where(is_hot).select(F.col(key).alias("hot_key"), *[F.col(c).alias(f"its_{c}") for c in values]))
    cold = table.where(~is_hot).select(F.col(key).alias("cold_key"), *[F.col(c).alias(f"its_{c}") for c in values])
    out = [*rows.columns, *[F.col(f"its_{c}").alias(c) for c in values]]
    served = rows.join(hot, F.col(key) == F.col("hot_key")).select(*out)
    rest = rows.join(hot.select("hot_key"), F.col(key) == F.col("hot_key"), "left_anti")
    return served.unionByName(rest.join(cold, F.col(key) == F.col("cold_key"), "left").select(*out))


def joined(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, few: bool) -> DataFrame:
    """lookup(), or one broadcast of the table if it has few rows."""
    if not few:
        return lookup(rows, table, key, weight, total)
    its = F.broadcast(table.withColumnRenamed(key, "few_key"))
    return rows.join(its, F.col(key) == F.col("few_key"), "left").drop("few_key")


def row_of(docs: DataFrame, key: list[Column]) -> DataFrame:
    """Each row of docs as one struct `row`, with its key in k0, k1, ...: no column of docs can clash with another's."""
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(whole.alias("row"), *[c.alias(f"k{i}") for i, c in enumerate(key)])


def without(docs: DataFrame, key: list[Column], gone: DataFrame) -> DataFrame:
    """docs without the rows whose key is in gone (k0, k1, ..., one_stays; each key once, nulls equal). Where one_stays is
    true, one of the rows of that key stays. Decisions reach exactly the rows of their key."""
    names = [f"k{i}" for i in range(len(key))]
    rows = row_of(docs, key)
    gone = gone.select(*[F.col(k).alias(f"gone_{k}") for k in names], "one_stays")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in names])
    left = rows.join(gone, same, "left_anti").select("row.*")
    repeated = gone.where("one_stays")
    if repeated.isEmpty():
        return left
    one = rows.join(repeated, same, "left_semi").groupBy(*names).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return left.unionByName(one.select("row.*"))
