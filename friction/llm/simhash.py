"""SimHash near-dedup with BK-trees.

Equal fingerprints meet first, by an aggregation. The bits are cut into m blocks; two fingerprints within r bits agree in
full on at least m - r of them. A shard is the set of fingerprints that agree on one choice of m - r blocks: its BK-tree
gets there by one shuffle instead of a broadcast, for which the corpus sets no bound. m is the least for which a shard of
random fingerprints stays small. Shards are packed into tasks by the hundred; a task builds their trees as one forest and
follows only edges within the radius. A shard beyond SHARD fingerprints is cut into chunks, and each pair of chunks is a
task of its own. Tasks return a star for each local component, never pairs; the stars are joined to components by
alternating large-star and small-star steps.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from friction.llm.common import dropped, joined, lookup, without, written

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a task, pairs of query and node that it looks at together, fingerprints that a shard has on average.
TASK_ROWS, FRONTIER, SHARD = 20_000, 500_000, 4096
#: Edges whose nodes are broadcast instead of shuffled.
FEW = 50_000


def fingerprint(text: str | None) -> int:
    """64 majority bits of the XXH64 of all word shingles, as a signed integer; 0 without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # of bytes: both know ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - SHINGLE + 1)
    counts, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 65_536):  # of a very long text one block after the other
        till = min(n, at + 65_536)
        last = np.minimum(np.arange(at, till) + SHINGLE - 1, len(words) - 1)
        hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts[at:till].tolist(), (ends[last] - 1).tolist())], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint, na_action=None).astype("int64")


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints of one word, or of several in a row each."""
    d = np.bitwise_count(a ^ b).astype(np.int64)
    return d if d.ndim == 1 else d.sum(1)


def bk_forest(shard: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards at once: each item's root, and the edges as sorted keys node * (bits + 1) + distance with the
    child. points: one word an item, or a row of several.

    Items are sorted by shard, and differ within one. All items below a node reach it in the same round; of those at one
    distance the first becomes the child, the others go on to it."""
    first = np.concatenate(([True], shard[1:] != shard[:-1]))
    root = np.flatnonzero(first)[np.cumsum(first) - 1]
    going, node = np.flatnonzero(~first), root[~first]
    keys, kids, span = [], [], 64 * (points.size // max(1, len(points))) + 1
    while len(going):
        key = node * span + bits_apart(points[going], points[node])
        edge, at, which = np.unique(key, return_index=True, return_inverse=True)
        keys.append(edge)
        kids.append(going[at])
        node = going[at][which]
        on = node != going
        going, node = going[on], node[on]
    keys, kids = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*kids, np.zeros(0, np.int64)])
    order = np.argsort(keys, kind="stable")
    return root, keys[order], kids[order]


def near(root: np.ndarray, keys: np.ndarray, kids: np.ndarray, points: np.ndarray, radius: int):
    """Yield pairs (item, node) within the radius; an item's search follows the edges at its distance ± radius."""
    stack, bits = [(np.arange(len(points)), root)], 64 * (points.size // max(1, len(points)))
    while stack:
        item, node = stack.pop()
        if len(item) > FRONTIER:
            stack += [(item[a : a + FRONTIER], node[a : a + FRONTIER]) for a in range(0, len(item), FRONTIER)]
            continue
        d = bits_apart(points[item], points[node])
        hit = (d <= radius) & (item > node)
        if hit.any():
            yield item[hit], node[hit]
        lo = np.searchsorted(keys, node * (bits + 1) + np.maximum(d - radius, 0), "left")
        n = np.searchsorted(keys, node * (bits + 1) + np.minimum(d + radius, bits), "right") - lo
        if total := int(n.sum()):
            place = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
            stack.append((np.repeat(item, n), kids[place]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a to b; a label is the smallest index of its component so far."""
    while True:
        x, y = label[a], label[b]
        if not (x != y).any():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def link_task(radius: int):
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """Stars (fingerprint, smallest of its local component) of the shards of one task."""
        pdf = pdf.drop_duplicates(["band", "value", "fp"]).sort_values(["band", "value", "fp"], ignore_index=True)
        shard = pdf.groupby(["band", "value"], sort=False).ngroup().to_numpy()
        points = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        root, keys, kids = bk_forest(shard, points)
        label = np.arange(len(points))
        for a, b in near(root, keys, kids, points, radius):
            label = unite(label, a, b)
        fp = pdf["fp"].to_numpy(np.int64)
        moved = label != np.arange(len(label))
        return pd.DataFrame({"u": fp[moved], "v": fp[label[moved]]}).drop_duplicates()

    return link


def masks(total: int, radius: int) -> list[int]:
    """Bits that a shard's fingerprints agree on, for each choice of blocks."""
    for m in range(radius + 1, 65):
        edges = [64 * i // m for i in range(m + 1)]
        if total >> (64 * (m - radius) // m) <= SHARD or m == 3 * (radius + 1):
            return [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in c) for c in combinations(range(m), m - radius)]
    return [2**64 - 1]


def links(points: DataFrame, total: int, radius: int = RADIUS) -> DataFrame:
    """u, v: stars whose components are those of all fingerprints within the radius. points: distinct fp; total: how many."""
    chosen = masks(total, radius)
    signed = np.array(chosen, np.uint64).view(np.int64).tolist()
    bands = [F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(w)).alias("value")) for i, w in enumerate(signed)]
    rows = points.select("fp", F.explode(F.array(*bands)).alias("b")).select("fp", "b.band", "b.value")
    # which shards are cut: few rows or many, so the join is left to the planner, which knows their size
    hot = rows.groupBy("band", "value").count().where(F.col("count") > TASK_ROWS)
    hot = hot.select(F.col("band").alias("hot_band"), F.col("value").alias("hot_value"), F.ceil(F.col("count") / (TASK_ROWS // 2)).alias("chunks"))
    rows = rows.join(written(hot, "hot"), (F.col("band") == F.col("hot_band")) & (F.col("value") == F.col("hot_value")), "left")
    tasks = max(1, -(-total * len(chosen) // TASK_ROWS))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    rows = rows.withColumn("task", F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("band", "value"), F.lit(tasks))).otherwise(F.xxhash64("band", "value")))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))))
    rows = rows.select("fp", "band", "value", "task", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return rows.groupBy("task", "low", "high").applyInPandas(link_task(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is linked to), for each node of the edges (u, v) but the roots themselves. A node
    that holds many edges meets its smallest neighbour by a broadcast of such nodes alone, so no task holds its star. Of up
    to FEW edges all are broadcast. It ends as soon as each node that has a smaller neighbour has no other one."""

    def lowest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))

    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(lowest(both), "low")
        twice, left = low.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when((F.col("low") < F.col("u")) & (F.col("high") > F.col("low")), 1))).first()
        if not left:
            dropped(edges)
            return low.where("low < u").select(F.col("u").alias("node"), F.col("low").alias("root"))
        few = twice <= 2 * FEW
        large = joined(both, low.select("u", "low", "n"), "u", "n", twice, few).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = written(large, "large")
        lower = lowest(large)
        small = joined(large, lower.select("u", "low", "n"), "u", "n", twice // 2, few)
        small = small.select("v", "low").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(lower.select("u", F.col("low").alias("v"))).distinct()
        small = written(small, "small")
        for gone in (edges, low, large):
            dropped(gone)
        edges = small


def with_components(docs: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp, component_id, first_fp of each row of docs; the last two are null and `found` too where it is alone."""
    prints = written(docs.select("doc_id", fingerprints("text").alias("fp")), "prints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "points")
    total, distinct = prints.count(), points.count()
    roots = components(links(points.select("fp"), distinct, radius))
    grouped = points.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("rep").isNull(), "rep", "fp"))
    best = grouped.groupBy(F.col("root").alias("of")).agg(first.alias("first"), F.sum("n").alias("members")).where("members > 1")
    best = best.select("of", F.col("first.rep").alias("component_id"), F.col("first.fp").alias("first_fp"))
    grouped = grouped.join(best, F.col("root") == F.col("of")).select("fp", "n", "component_id", "first_fp", F.lit(True).alias("found"))
    return lookup(prints, grouped, "fp", "n", total)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs (doc_id, text; others ignored).

    Null, empty and blank texts have fingerprint 0 and link like any other. component_id is the smallest doc_id of the
    component; null ids are passed over unless a component has no other. Repeated rows share their component. An empty
    table gives an empty result. All shingles of a text count, however long it is."""
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return with_components(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text; all columns kept) with exactly one row of each component of near_duplicates(): one with its
    component_id, of several those with the smallest fingerprint.

    The verdict is of the row, doc_id and fingerprint. Null ids stay only where a component has no other. Columns may have
    any names. An empty table gives an empty result."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("first_fp"))
    rows = with_components(docs, radius).where("found").groupBy("doc_id", "fp", stays.alias("one_stays")).count()
    gone = rows.where("not one_stays or count > 1").select(F.col("doc_id").alias("k0"), F.col("fp").alias("k1"), "one_stays")
    return without(docs, [F.col("doc_id"), fingerprints("text")], written(gone, "gone"))
