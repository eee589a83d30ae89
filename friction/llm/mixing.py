"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source with target / size = r is taken floor(r) times, and once more with probability r - floor(r). The
cube method draws the second part: it moves the probabilities along directions that leave the source's totals of tokens
and of documents unchanged until they are 0 or 1. It works in blocks of bounded size that a hash of the row deals out, so
a source of any size is many tasks; the few undecided documents of all blocks form the blocks of the next round, and the
last of a source are decided by trying all their subsets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.llm.common import lookup, row_of, words_in, written

#: Documents in a block, and undecided ones that a block leaves at most.
BLOCK, LANDING = 2048, 16
#: A row is named by its id (0 and a mark for null), the hash of what it holds, and a number among equal rows.
NAME = ["doc_id", "no_id", "held", "nth"]
ROW = "doc_id long, no_id boolean, held long, nth long, size long, rank int, source_size long, target double, base long, p double, blocks long"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """rank, source, n, source_size, target: one row a source. Weights go to sources by code point, null last. sizes: source,
    size, and in n how many documents have them.

    Filling in the order of cap / weight finds at once where resharing the excess ends: a source is at its cap exactly if
    the level that the rest would get, had all before it been capped, is above its own."""
    s = sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    s = s.withColumn("level", (total - full) / rest).withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("cap") / F.col("w"))).over(Window.partitionBy())
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w")))
    return s.select("rank", "source", "n", "source_size", target.alias("target"))


def flight(p: np.ndarray, x: np.ndarray, leave: int, rng: np.random.Generator) -> np.ndarray:
    """Move p along null-space directions of (x, 1) until at most `leave` entries are fractional; sums of p and of p * x stay."""
    p, xs = p.tolist(), x.astype(float).tolist()
    queue = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
    left, at, trio = len(queue), 0, []
    draws, d = rng.random(len(queue) + 1).tolist(), 0
    while left > max(leave, 2):
        while len(trio) < 3:
            trio.append(queue[at])
            at += 1
        i, j, k = trio
        u = (xs[j] - xs[k], xs[k] - xs[i], xs[i] - xs[j])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for m, v in zip(trio, u):
            if v > 0:
                up, down = min(up, (1 - p[m]) / v), min(down, p[m] / v)
            elif v < 0:
                up, down = min(up, -p[m] / v), min(down, (p[m] - 1) / v)
        step = up if draws[d] * (up + down) < down else -down
        d += 1
        for m, v in zip(trio, u):
            q = p[m] + step * v
            p[m] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
        trio = [m for m in trio if 0.0 < p[m] < 1.0]
        left = len(trio) + len(queue) - at
    return np.array(p)


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Decide the last entries: of all their subsets the one that keeps p * x best, then the sum of p."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_) == 0:
        return p
    bits = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
    tokens = np.abs(bits @ x[open_] - p[open_] @ x[open_])
    documents = np.abs(bits.sum(1) - p[open_].sum())
    out = p.copy()
    out[open_] = bits[np.lexsort((documents, tokens))[0]]
    return out


def move_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of one source: flight, and the landing if it is the source's last block.

    Draws and the order of the walk follow from the rows. A random order leaves documents of all sizes to the landing,
    whose subsets then come close to any total."""
    pdf = pdf.sort_values([*NAME], ignore_index=True)
    seed = [int(pdf["rank"].iloc[0]), len(pdf), int(pdf["size"].sum()), int(pdf["doc_id"].sum()) & (2**63 - 1)]
    rng = np.random.default_rng(seed)
    pdf = pdf.iloc[rng.permutation(len(pdf))].reset_index(drop=True)
    x, p = pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy()
    p = flight(p, x, LANDING, rng)
    if int(pdf["blocks"].iloc[0]) <= 1:
        p = landing(p, x)
    pdf["p"] = p
    return pdf


def decided(docs: DataFrame, held: Column, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """doc_id, held, nth, size, source_size, target, copies of each row of docs; held is a hash of what counts in a row.

    Equal rows are counted before they move and numbered afterwards, so no id, text or source puts its rows in one block."""
    sizes = docs.select("doc_id", "source", held.alias("held"), words_in(F.col("text")).alias("size"))
    sizes = written(sizes.groupBy("doc_id", "source", "held", "size").agg(F.count("*").alias("n")), "sizes")
    of = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("of")
    targets = written(source_targets(sizes, weights, share, cap).select(of, "rank", F.col("n").alias("source_n"), "source_size", "target"), "targets")
    total, most = targets.agg(F.coalesce(F.sum("source_n"), F.lit(0)), F.coalesce(F.max("source_n"), F.lit(0))).first()
    named = sizes.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "held", "size", "n", of)
    rows = lookup(named, targets, "of", "source_n", total).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.select(*NAME, "size", "rank", "source_size", "target", F.floor(ratio).cast("long").alias("base"), (ratio - F.floor(ratio)).alias("p"), F.ceil(F.col("source_n") / BLOCK).cast("long").alias("blocks"))
    whole = (F.col("size") == 0) | (F.col("p") <= 1e-9)
    done = [rows.where(whole).withColumn("p", F.lit(0.0))]
    rows = rows.where(~whole)
    while True:
        last = most <= BLOCK
        block = F.pmod(F.xxhash64(*NAME, F.lit(most)), F.col("blocks"))
        moved = written(rows.groupBy("rank", block.alias("block")).applyInPandas(move_block, ROW), "moved")
        done.append(moved.where("p = 0 or p = 1"))
        if last:
            break
        most = -(-most // BLOCK) * LANDING
        rows = moved.where("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") * F.lit(LANDING) / F.lit(BLOCK)).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("p").cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "held", "nth", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row for each row of docs (doc_id, text, source; others ignored).

    size: words of the text (null: 0). taken = copies * size. A source's taken words miss its target by what the last
    documents of the landing leave. Documents without words are never copied; null sources form a source of their own;
    repeated rows are documents of their own; an empty table gives an empty result. All draws follow from the rows, so
    reruns agree."""
    rows = decided(docs, F.xxhash64("text"), weights, share, cap)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of docs (doc_id, text, source; all columns kept), each as often as the mix takes it.

    Decisions are of the row: rows that share an id, or have none, have their own. Of rows that are equal in every column
    the copies of all come out together. Columns may have any names. Rows without words are never taken, so nulls in text
    go; an empty table gives an empty result."""
    held = F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    plan = decided(docs, held, weights, share, cap).groupBy("doc_id", "held").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    plan = written(plan.where("copies > 0").select(F.col("doc_id").alias("plan_id"), F.col("held").alias("plan_held"), "copies", "n"), "plan")
    rows, same = row_of(docs, [F.col("doc_id"), held]), F.col("k0").eqNullSafe(F.col("plan_id")) & (F.col("k1") == F.col("plan_held"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    out = rows.join(plan.where("n = 1"), same).select("row", each).select("row.*")
    several = plan.where("n > 1")
    if several.isEmpty():
        return out
    one = rows.join(several, same).groupBy("k0", "k1").agg(F.any_value("row").alias("row"), F.max("copies").alias("copies"))
    return out.unionByName(one.select("row", each).select("row.*"))
