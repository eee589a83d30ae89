"""Sharding by a k-d tree over metadata, in DataFrame operations only.

Only the tree is built by the driver: at most shards - 1 splits. For each level, one aggregation gives every open node
the extent of its dimensions, and a few more find the weighted median along the widest by narrowing histograms, all nodes
of a level at once. A histogram has at most BUCKETS rows a node, whatever the input. Rows of one text are a group: they
share one source and language, and no cut parts them unless the group is larger than what a cut may miss by. Each row gets
its leaf by an expression once the tree is known, and its slot by one shuffle of the narrow columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.llm.common import lookup, written

BUCKETS = 4096
#: Bits of a position along a dimension; ties along it are ordered by the text's crc32, then by a hash of the text, or of
#: the doc_id in a group that may be cut.
POS, CRC = 31, 32


def category(c: Column) -> Column:
    """A position for a category: equal values meet, null is at 0."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(2**POS))).cast("long")


def points(docs: DataFrame, shards: int = 40, slack: float = 0.03) -> DataFrame:
    """doc_id, size, crc, tie, and keys k0..k2 (source, language, logarithm of the size), each with crc as its low bits.

    A group of equal texts has the smallest source and language of its rows, and one tie, unless its bytes exceed both
    `slack` of a shard and the largest document, by which cuts may miss in any case; then its rows have ties of their own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + F.lit(16)
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("crc"), F.unhex(F.sha2(text, 256)).alias("sha"), "source", "lang")
    rows = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("equal")), "texts")
    total, largest, count = rows.agg(F.coalesce(F.sum(F.col("size") * F.col("equal")), F.lit(0)), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("equal"), F.lit(0))).first()
    room = max(slack * total / shards, largest)
    groups = rows.groupBy("sha").agg(F.sum("equal").alias("n"), F.sum(F.col("size") * F.col("equal")).alias("bytes"), F.min("source").alias("its_source"), F.min("lang").alias("its_lang"), F.lit(True).alias("grouped"))
    rows = lookup(rows, groups.where("n > 1"), "sha", "n", count)
    own = lambda c: F.when(F.col("grouped"), F.col(f"its_{c}")).otherwise(F.col(c))
    at = [category(own("source")), category(own("lang")), (F.log2(F.col("size").cast("double")) * F.lit(2.0**25)).cast("long")]
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "equal")))
    tie = F.when(F.col("bytes") > room, F.xxhash64("doc_id", "nth")).otherwise(F.xxhash64("sha"))
    keys = [(p * F.lit(2**CRC) + F.col("crc")).alias(f"k{i}") for i, p in enumerate(at)]
    return rows.select("doc_id", "size", "crc", F.pmod(tie, F.lit(2**POS)).alias("tie"), *keys)


@dataclass
class Node:
    """leaves: number of shards below; a split node sends rows with (key, tie) below `cut` to the left."""

    leaves: int
    first: int
    dim: int = 0
    cut: tuple[int, int] | None = None
    kids: list[Node] = field(default_factory=list)

    def expr(self, value) -> Column:
        """value(node) of the node that a row is in."""
        if not self.kids:
            return F.lit(value(self))
        k, (key, tie) = F.col(f"k{self.dim}"), self.cut
        left = (k < F.lit(key)) | ((k == F.lit(key)) & (F.col("tie") < F.lit(tie)))
        return F.when(left, self.kids[0].expr(value)).otherwise(self.kids[1].expr(value))


def median_cuts(rows: DataFrame, nodes: list[Node], goals: list[float], slack: float) -> None:
    """Set each node's cut so that the size to its left is within slack of its goal, or as near as one row allows.

    rows: with the node's number in `node` (others: null). First the keys are narrowed, then, among rows of one key, the
    ties. Rows outside all ranges fall into one group that is ignored; a filter would repeat the tree's expression."""
    n = len(nodes)
    lo, hi, below = [0] * n, [2 ** (POS + CRC) - 1] * n, [0] * n
    held: list[int | None] = [None] * n  # the key whose ties are narrowed
    open_ = set(range(n))
    while open_:
        params = [(x.dim, -1 if held[i] is None else held[i], lo[i] if i in open_ else 1, hi[i] if i in open_ else 0, (hi[i] - lo[i]) // BUCKETS + 1) for i, x in enumerate(nodes)]
        names = ("dim", "held", "lo", "hi", "width")
        table = [F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(names, p)]) for p in params]
        part = rows.withColumn("p", F.get(F.array(*table), F.col("node")))
        part = part.select("node", "size", "tie", "p", F.get(F.array("k0", "k1", "k2"), F.col("p.dim").cast("int")).alias("key"))
        value = F.when(F.col("p.held") < 0, F.col("key")).when(F.col("p.held") == F.col("key"), F.col("tie"))
        part = part.select("node", "size", "p", value.alias("v"))
        bucket = F.when(F.col("v").between(F.col("p.lo"), F.col("p.hi")), F.floor((F.col("v") - F.col("p.lo")) / F.col("p.width")).cast("int"))
        part = part.select(F.when(bucket.isNotNull(), F.col("node")).alias("node"), "size", "v", bucket.alias("bucket"))
        found: dict[int, list] = {i: [] for i in open_}
        for r in part.groupBy("node", "bucket").agg(F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            if r["bucket"] is not None:
                found[r["node"]].append((r["lo"], r["hi"], r["w"]))
        for i, hist in found.items():
            at = below[i]
            for a, b, w in sorted(hist):
                if at + w > goals[i]:
                    break
                at += w
            near_low = goals[i] - at <= at + w - goals[i]
            if min(goals[i] - at, at + w - goals[i]) <= slack or a == b and held[i] is not None:
                cut = a if near_low else b + 1
                nodes[i].cut = (cut, 0) if held[i] is None else (held[i], cut)
                open_.discard(i)
            elif a == b:
                held[i], lo[i], hi[i], below[i] = a, 0, 2**POS - 1, at
            else:
                lo[i], hi[i], below[i] = a, b, at


def kd_tree(rows: DataFrame, shards: int, slack: float = 0.0005) -> Node:
    """Split rows (of points()) at weighted medians along the widest dimension until there are `shards` leaves of one
    target size. slack: by how much of a leaf a cut may miss."""
    root = Node(shards, 0)
    level, extent, leaf = [root], None, 0.0
    while level := [x for x in level if x.leaves > 1]:
        number = {id(x): i for i, x in enumerate(level)}
        inside = rows.withColumn("node", root.expr(lambda x: number.get(id(x))).cast("int"))
        wide = [(F.max(f"k{d}") / F.lit(2.0**CRC) - F.min(f"k{d}") / F.lit(2.0**CRC)).alias(f"w{d}") for d in range(3)]
        stats = {r["node"]: r for r in inside.groupBy("node").agg(F.sum("size").alias("w"), *wide).collect() if r["node"] is not None}
        if extent is None and stats:
            extent, leaf = [max(stats[0][f"w{d}"], 1.0) for d in range(3)], stats[0]["w"] / shards
        full = [x for x in level if number[id(x)] in stats]
        for x in level:
            x.cut = (0, 0)  # of a node without rows
        if full:
            for x in full:
                r = stats[number[id(x)]]
                x.dim = max(range(3), key=lambda d: r[f"w{d}"] / extent[d])
            place = {id(x): i for i, x in enumerate(full)}
            of_full = root.expr(lambda x: place.get(id(x))).cast("int")
            goals = [stats[number[id(x)]]["w"] * (x.leaves // 2) / x.leaves for x in full]
            median_cuts(rows.withColumn("node", of_full), full, goals, slack * leaf)
        for x in level:
            x.kids = [Node(x.leaves // 2, x.first), Node(x.leaves - x.leaves // 2, x.first + x.leaves // 2)]
        level = [k for x in level for k in x.kids]
    return root


def kd_shards(docs: DataFrame, shards: int = 40, rows_in_run: int = 20_000, slack: float = 0.03) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), for each row of docs (doc_id, text,
    source, lang; others ignored).

    Shards have near equal sizes; neither a document nor a group of equal texts of up to `slack` of a shard, or as large as
    the largest document, is split, so a shard misses the mean by about one of these. Only larger groups are cut, by a hash
    of the doc_id. A null text is an empty one, with 16 bytes and crc32 0; null source or lang is a category of its own.
    Repeated rows are separate documents. Fewer documents than shards leave shards empty; an empty table gives an empty
    result."""
    rows = written(points(docs, shards, slack), "points")
    root = kd_tree(rows, shards)
    runs = max(1, -(-rows.count() // (shards * rows_in_run)))
    rows = rows.select("doc_id", "size", "crc", "tie", root.expr(lambda x: x.first).cast("int").alias("shard")).withColumn("run", F.floor(F.col("tie") * F.lit(runs) / F.lit(2**POS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "run").count().select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    slot = F.row_number().over(Window.partitionBy("shard", "run").orderBy("tie", "doc_id", "crc", "size")) - F.lit(1)
    return (
        rows.withColumn("at", slot)
        .join(starts, ["shard", "run"])
        .select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
