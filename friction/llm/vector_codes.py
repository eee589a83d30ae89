"""Product codes of vectors, with Exponion search in integers.

Every vector is cut into PARTS consecutive parts, each of which has a codebook of its own. A part starts at the entry it had
before, at distance u. An entry that is as near as the best one found so far, at distance b, lies within u + b of the start
(triangle inequality), so a task scans the start's list of other entries by ascending distance only up to that radius, a
block at a time, while b shrinks. Squared distances are integers; the radius is compared with slack for its rounding, so no
entry that could win or tie is passed over.

A round reads the rows of the round before, assigns, and writes rows with their new codes; sums and counts of each entry
are aggregated where the rows are. Only the codebooks, ENTRIES integer vectors a part, go through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from friction.llm.common import dropped, lookup, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Neighbours that a step of a scan looks at, and vectors that are scanned together.
BLOCK, TOGETHER = 8, 16_384


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: all entries by ascending distance from it (ties by index), and those distances."""
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.sqrt(np.take_along_axis(apart, order, 1).astype(np.float64))


def nearest(x: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row of x (ties to the lower index), and its squared distance."""
    order, far = lists
    k = len(book)
    best, least = start.astype(np.int64), ((x - book[start]) ** 2).sum(1)
    u = np.sqrt(least.astype(np.float64))
    going, at = np.arange(len(x)), 0
    while len(going) and at < k:
        reach = (u[going] + np.sqrt(least[going].astype(np.float64))) * (1 + 1e-9) + 1e-6
        going = going[far[start[going], at] <= reach]
        entries = order[start[going], at : at + BLOCK]
        d = ((x[going, None, :] - book[entries]) ** 2).sum(2)
        low = d.min(1, initial=np.iinfo(np.int64).max)
        index = np.where(d == low[:, None], entries, k).min(1, initial=k)
        better = (low < least[going]) | ((low == least[going]) & (index < best[going]))
        best[going[better]], least[going[better]] = index[better], low[better]
        at += BLOCK
    return best, least


def assigner(books: list[np.ndarray]):
    """Rows (..., v, codes) with the codes of the nearest entries and the sum of their squared distances."""

    def assign(batches):
        lists = [neighbour_lists(b) for b in books]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(n, PARTS)
            wide = v.shape[1] // PARTS
            new, error = np.zeros((n, PARTS), np.int32), np.zeros(n, np.int64)
            for a in range(0, n, TOGETHER):
                for p, book in enumerate(books):
                    s = slice(a, a + TOGETHER)
                    new[s, p], d = nearest(v[s, p * wide : (p + 1) * wide], book, lists[p], codes[s, p])
                    error[s] += d
            ends = pa.array(np.arange(0, n * PARTS + 1, PARTS, dtype=np.int32))
            kept = {c: batch.column(c) for c in batch.schema.names if c not in ("codes", "error")}
            yield pa.RecordBatch.from_pydict({**kept, "codes": pa.ListArray.from_arrays(ends, pa.array(new.ravel())), "error": pa.array(error)})

    return assign


def integer_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v: floor(SCALE x) of each component, filled up with zeros to one length that PARTS divides."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull()).where(fine)
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = max(PARTS, -(-dims // PARTS) * PARTS)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    v = F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("embedding")))
    return rows.select("vec_id", F.struct(F.col("label").alias("of")).alias("label"), v.alias("v"))


def first_books(rows: DataFrame) -> list[np.ndarray]:
    """The parts of the ENTRIES rows with the smallest vec_id; of equal ids the smaller vector first, null ids last."""
    first = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()]
    whole = np.array(first, np.int64)
    return [np.ascontiguousarray(b) for b in np.split(whole, PARTS, axis=1)]


def moved(books: list[np.ndarray], rows: DataFrame) -> list[np.ndarray]:
    """The codebooks after each entry became the floor of the mean of its parts; entries without any stay."""
    wide = books[0].shape[1]
    part = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.struct(p.alias("part"), F.get("codes", p).alias("entry"), F.slice("v", p * wide + 1, wide).alias("x"))))
    sums = rows.select(part.alias("r")).select("r.*").groupBy("part", "entry").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(wide)])
    out = [b.copy() for b in books]
    for r in sums.collect():  # at most PARTS x ENTRIES rows
        out[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(wide)]
    return out


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each row of vectors (vec_id, embedding, label; others
    ignored) that has a vector without null or non-finite components.

    Vectors are filled up with zeros to the greatest length, rounded up to a multiple of PARTS; empty ones are zeros. Fewer
    rows than ENTRIES make as many entries. Repeated rows and null ids are coded each; null ids sort last. Components count
    exactly up to 2**26, 1024 times as much and their squared distances being longs. An empty table gives an empty result."""
    kept = vectors.columns
    vectors = vectors.select("vec_id", "embedding", "label" if "label" in kept else F.lit(None).cast("string").alias("label"))
    rows = written(integer_rows(vectors).withColumn("codes", F.array_repeat(F.lit(0), PARTS)).withColumn("error", F.lit(0).cast("long")), "vectors")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    if rows.isEmpty():
        books = []
    else:
        books = first_books(rows)
        for last in [False] * ROUNDS + [True]:
            before = rows
            rows = written(before.mapInArrow(assigner(books), kind), "assigned")
            dropped(before)
            if not last:
                books = moved(books, rows)
    digest = hashlib.sha256(",".join(str(c) for b in books for entry in b.tolist() for c in entry).encode()).hexdigest()
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = lookup(rows.select("vec_id", "label", "codes", "error"), by_label, "label", "n", rows.count())
    code = F.concat(*[F.lpad(F.lower(F.hex(F.get("codes", F.lit(p)))), 2, "0") for p in range(PARTS)])
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """SQL of the whole: every part against every entry, in each round."""
    a = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM k, range({PARTS}) r(part)),
b0 AS MATERIALIZED (
  SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k) USING (vec_id) WHERE entry < {ENTRIES})"""
    for i in range(ROUNDS + 1):
        a += f""",
a{i} AS MATERIALIZED (
  SELECT p.vec_id, p.part, min(p.x) AS x, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS error
  FROM p JOIN (SELECT *, list_inner_product(x, x) AS xx FROM b{i}) b USING (part),
       LATERAL (SELECT list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + b.xx AS d) GROUP BY p.vec_id, p.part)"""
        if i < ROUNDS:
            a += f""",
m{i} AS MATERIALIZED (
  SELECT part, entry, list(c ORDER BY pos) AS x FROM (
    SELECT part, entry, pos, floor(sum(x[pos]) / count(*)) AS c FROM a{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS pos) GROUP BY part, entry, pos)
  GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{i}.x, b{i}.x) AS x FROM b{i} LEFT JOIN m{i} USING (part, entry))"""
    return a + f""",
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN k USING (vec_id), digest
"""


ORACLE_SQL = _oracle()
