"""An exact Jaccard join of shingle sets by PartEnum signatures.

Sets meet by bands of sizes. Two sets of a band with a similarity of PERCENT differ in at most k shingles, k a ninth of twice
the band's largest size. Hashing cuts the domain of shingles into k + 1 + e partitions, so such a pair agrees on at least
e + 1 of them. A signature is what a set has in one partition (the enumerated subsets are single partitions: of all choices
that miss no pair the one with the fewest signatures). A set near the upper end of its band takes part in the next one too.

Which shingles are partitioned is free, for a pair differs in at most k of any part of the domain. So shingles that many
documents share, of boilerplate, are left out first. An empty partition makes no signature: with at most e empty ones in
one of its two sets, a pair still shares one that holds something. A set with more than e has signatures of all its
shingles as well, and if these too leave more than e empty, one for each that is: every pair is caught at some level.

Signatures travel packed, by bucket. A bucket's task finds those that several sets share; where many have the same members,
once. Those of common shingles alone may be shared by any number of sets: they are cut into slices and pass through.

Linked sets agree on all partitions but k, so a set that shares fewer signatures of a band than that has no partner in it and
goes. The others that share one are candidates. Each is first compared with the set at the centre of such a group, and linked
sets become components; a group within one component has nothing left to compare. In the others, members of the largest
component meet the rest, in cells of bounded size. A link is always the similarity of the whole sets. Tasks return stars.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.llm.common import joined, lookup, written
from friction.llm.near_copies import SEED, SHINGLE, text_key
from friction.llm.simhash import components

#: A link: PERCENT * union <= 100 * intersection. Sets that differ need together nine shingles for each that they differ in.
PERCENT, NINTH = 80, 9
#: Ratio of a band's sizes; spare partitions for each one that may differ; sets below LEAST link only with equal ones.
RATIO, SPARE, LEAST = 1.4, 0.15, 4
#: Part of the documents that share a common shingle, and how many such are left out at most.
OFTEN, COMMON = 1 / 500, 1_000_000
#: Shingles or signatures that a task holds before it hands them over, signatures in a bucket, sets in a slice, rows and
#: bytes of shingles on a side of a cell, bytes of a task, sets that one is compared with at a time, and bytes of a
#: text that are hashed together.
HELD, BUCKET, SLICE, CELL, CELL_BYTES, TASK_BYTES, STEP, STEP_BYTES = 2_000_000, 1_500_000, 1_000_000, 4096, 32 << 20, 64 << 20, 512, 1 << 20
#: Rounds in which sets with too few shared signatures go; rounds of stars at most before the rest is compared in cells, the
#: part of what is outside of the largest components that a round may leave for another to follow, members of all groups and
#: pairs left for each of them for which there is none; rows of the groups of a task.
PEELS, STARS, STALLS, SMALL, MEET, GROUPED = 2, 5, 0.7, 20_000, 200, 32_768
#: Groups that are broadcast instead of shuffled.
FEW = 20_000

EDGES = [LEAST]
while EDGES[-1] < 1 << 40:
    EDGES.append(int(EDGES[-1] * RATIO) + 1)
#: A set in a band: fp, shingles, band, signatures that it shares with each partner.
ENTRY = np.dtype([("fp", "<i8"), ("n", "<i4"), ("tag", "<i2"), ("need", "<i4")])
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h + np.uint64(salt * int(_M3) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word: the sum of the hashes of its bytes with their places."""
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    out, before = np.zeros(len(starts), np.uint64), -1
    for a in range(0, len(b) if len(starts) else 0, STEP_BYTES):  # of a very long text, or word, one block after the other
        here = slice(a, a + STEP_BYTES)
        word = np.cumsum(begins[here]) + before
        before = int(word[-1])
        place = np.arange(a, a + len(word)) - starts[np.maximum(word, 0)]
        h = mixed((b[here].astype(np.int64) + (place << 8)).view(np.uint64), 11)
        h[space[here]] = 0
        edges = np.flatnonzero(begins[here])
        if (not len(edges) or edges[0]) and word[0] >= 0:
            edges = np.concatenate(([0], edges))
        if len(edges):
            out[word[edges]] += np.add.reduceat(h, edges)
    return out


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of all word shingles; a text of fewer words is one shingle, one without words has none."""
    h = word_hashes(text.encode("utf-8", "replace").lower()) if text else np.zeros(0, np.uint64)  # bytes: lower() knows ASCII only
    if not len(h):
        return h
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * _M1 + h[i : i + n]
    out = np.sort(mixed(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def partitions(tag: int) -> tuple[int, int]:
    """How many partitions the pairs of a band have, and how many of them may hold nothing."""
    most = 2 * (EDGES[tag + 1] - 1) // NINTH
    spare = int(SPARE * (most + 1)) + 1
    return most + 1 + spare, spare


def bands_of(n: int) -> list[int]:
    """The bands that a set of n shingles takes part in: its own, and the next one if it can reach a set there."""
    own = bisect_right(EDGES, n) - 1
    return [own, own + 1] if 5 * n >= 4 * EDGES[own + 1] else [own]


def contents(s: np.ndarray, common: np.ndarray, tag: int, n1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partitions that hold something, a hash of what, and whether all of it is common."""
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    h = mixed(s, tag + 1)
    part = (h >> np.uint64(32)).astype(np.int64) % n1
    order = np.argsort(part, kind="stable")
    held = part[order]
    starts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    return held[starts], np.add.reduceat(mixed(h, 7)[order], starts), np.minimum.reduceat(common[order], starts)


def signatures(s: np.ndarray, common: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of a sorted set, for each of its bands: the band, how many signatures it shares with each set that it is linked with
    there, the signatures, and whether each is of common shingles alone. common: sorted."""
    if len(s) < LEAST:
        return []
    at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
    often = common[at] == s if len(common) else np.zeros(len(s), bool)
    rare, out = s[~often], []
    for tag in bands_of(len(s)):
        n1, spare = partitions(tag)
        parts, held, _ = contents(rare, np.zeros(len(rare), bool), tag, n1)
        sigs, hot, need = [mixed(held + parts.astype(np.uint64) * _M1, tag + 1)], [np.zeros(len(parts), bool)], 1
        if n1 - len(parts) <= spare:
            # linked sets differ in so many shingles at most; they agree on all other partitions, of which these are not empty
            differ = (len(s) + min(5 * len(s) // 4, EDGES[tag + 1] - 1)) // NINTH
            need = len(parts) - differ
        else:
            parts, held, all_common = contents(s, often, tag, n1)
            sigs.append(mixed(held + parts.astype(np.uint64) * _M1, tag + 1))
            hot.append(all_common)
            if n1 - len(parts) > spare:
                empty = np.setdiff1d(np.arange(n1), parts).astype(np.uint64)
                sigs.append(mixed(empty * _M1, tag + 1))
                hot.append(np.ones(len(empty), bool))
        found, first = np.unique(np.concatenate(sigs), return_index=True)
        out.append((tag, need, found, np.concatenate(hot)[first]))
    return out


def name_of(s: np.ndarray) -> int:
    """A hash of a set, 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)) if len(s) else 0


def named(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text_hash, text_size, fp, n), and of each task those of shingles (fp) that many of
    its different sets share (n: how many), where `counts` is true."""

    def frequent(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= max(2, OFTEN * len(held))
        return h[often].view(np.int64), n[often]

    def run(batches):
        seen, held, size = set(), [], 0
        ids = None
        for batch in batches:
            ids = batch.column("doc_id")
            fps, ns = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text")):
                s = shingles(text.as_py())
                fps[i], ns[i] = name_of(s), len(s)
                if len(s) and fps[i] not in seen:
                    seen.add(fps[i])
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("doc_id", "text_hash", "text_size")}, "fp": fps, "n": ns, "counts": np.zeros(len(fps), bool)})
            if size > HELD or (ids is not None and len(held) > 100_000):
                yield counted(*frequent(held), ids.type)
                held, size = [], 0
        if held:
            yield counted(*frequent(held), ids.type)

    def counted(h, n, kind):
        none = pa.nulls(len(h))
        return pa.RecordBatch.from_pydict({"doc_id": none.cast(kind), "text_hash": none.cast(pa.int64()), "text_size": none.cast(pa.int32()), "fp": h, "n": n.astype(np.int64), "counts": np.ones(len(h), bool)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *text_key()).mapInArrow(run, f"doc_id {kind}, text_hash long, text_size int, fp long, n long, counts boolean")


def common_shingles(prints: DataFrame, sets: int) -> np.ndarray:
    """Shingles that some OFTEN of all different sets share, the most frequent first to be kept, sorted by hash."""
    many = prints.where("counts").groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= max(4, OFTEN * sets / 2))
    rows = many.orderBy(F.desc("n"), "fp").limit(COMMON).select("fp").toArrow()
    return np.sort(rows.column("fp").to_numpy().view(np.uint64))


def packed_signatures(docs: DataFrame, common, buckets: int, slices: int) -> DataFrame:
    """bucket, sigs, at, sets, hot: signatures of a bucket, the place in `sets` (fp, size, band, need) of the set that has
    each, and which are common."""

    def pack(held) -> list:
        sets = np.array([h[:4] for h in held], ENTRY)
        sigs, hot = np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held])
        at = np.repeat(np.arange(len(held), dtype=np.int32), [len(h[4]) for h in held])
        piece = np.where(hot, sets["fp"][at].astype(np.uint64) % np.uint64(slices), 0).astype(np.uint64)
        bucket = (mixed(sigs + piece * _M3, 3) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = order[a:b]
            used, place = np.unique(at[own], return_inverse=True)
            wide = np.int32 if len(used) > 65_536 else np.uint16
            out.append((int(bucket[own[0]]), sigs[own].tobytes(), place.astype(wide).tobytes(), sets[used].tobytes(), np.packbits(hot[own]).tobytes()))
        return out

    def run(batches):
        seen, held, size, often = set(), [], 0, common.value
        names = ["bucket", "sigs", "at", "sets", "hot"]
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*pack(held)))], names)
        for batch in batches:
            for text in batch.column("text"):
                s = shingles(text.as_py())
                fp = name_of(s)
                if len(s) < LEAST or fp in seen:
                    continue
                seen.add(fp)
                for tag, need, sigs, hot in signatures(s, often):
                    held.append((fp, len(s), tag, need, sigs, hot))
                    size += len(sigs)
                if size > HELD:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    return docs.select("text").mapInArrow(run, "bucket long, sigs binary, at binary, sets binary, hot binary")


def shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """shard, fp, n, tag, need, times: the sets that share signatures of one bucket; those with the same members once, with how
    many they are."""
    sigs, tables, places, hot, held = [], [], [], [], 0
    for r in pdf.itertuples():
        own, table = np.frombuffer(r.sigs, np.uint64), np.frombuffer(r.sets, ENTRY)
        sigs.append(own)
        tables.append(table)
        places.append(np.frombuffer(r.at, np.int32 if len(table) > 65_536 else np.uint16).astype(np.int32) + np.int32(held))
        hot.append(np.unpackbits(np.frombuffer(r.hot, np.uint8), count=len(own)).astype(bool))
        held += len(table)
    table = np.concatenate(tables)
    _, rank = np.unique(table["fp"], return_inverse=True)  # of each set, that copies in other tasks have too
    rank = rank.astype(np.int32)
    sig, at, hot = np.concatenate(sigs), np.concatenate(places), np.concatenate(hot)
    order = np.lexsort((rank[at], sig))
    sig, at, hot = sig[order], at[order], hot[order]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (rank[at[1:]] != rank[at[:-1]])))
    sig, at, hot = sig[new], at[new], hot[new]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.concatenate((starts, [len(sig)])))
    named = mixed(table["fp"].astype(np.uint64), 5)
    members = mixed(np.add.reduceat(named[at], starts) + table["tag"][at[starts]].astype(np.uint64), 1) ^ size.astype(np.uint64)
    cold, common = np.flatnonzero((size > 1) & ~hot[starts]), np.flatnonzero(hot[starts])
    _, first, same = np.unique(members[cold], return_index=True, return_counts=True)
    chosen, times = np.concatenate((cold[first], common)), np.concatenate((same, np.ones(len(common), np.int64)))
    shard = np.where(hot[starts], sig[starts], members)[chosen].view(np.int64)
    begin = np.cumsum(size[chosen]) - size[chosen]
    rows = at[np.repeat(starts[chosen] - begin, size[chosen]) + np.arange(int(size[chosen].sum()))]
    out = {c: table[c][rows].astype(np.int64) for c in ENTRY.names}
    return pd.DataFrame({"shard": np.repeat(shard, size[chosen]), **out, "times": np.repeat(times, size[chosen])})


def peeled(found: DataFrame) -> DataFrame:
    """shard, fp, n: the groups of found without the sets that share fewer signatures of a band, with all others together, than
    with any one that they are linked with. What goes may leave others with too few, so this is done PEELS times."""
    for _ in range(PEELS):
        groups = found.groupBy("shard").agg(F.count("*").alias("members")).where("members > 1")
        mine = Window.partitionBy("fp", "tag")
        found = lookup(found, written(groups, "groups"), "shard", "members", found.count()).where("members is not null").drop("members")
        found = written(found.withColumn("has", F.sum("times").over(mine)).where("has >= need").drop("has"), "found")
    return found.select("shard", "fp", "n")


def compare(cells: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """u, v: stars of the linked sets of one task. cells: shard, fp, label, a, b; of a shard those with `a` meet those with
    `b`, unless their labels are the same. sets: fp, shingles."""
    sets = sets.drop_duplicates("fp")
    arrays = [np.frombuffer(x, np.uint64) for x in sets["shingles"]]
    if not arrays:
        return pd.DataFrame({"u": [], "v": []}).astype("int64")
    ids = np.unique(np.concatenate(arrays), return_inverse=True)[1]
    size = np.array([len(x) for x in arrays], np.int64)
    start = np.cumsum(size) - size
    place = pd.Series(np.arange(len(sets)), index=sets["fp"].to_numpy())
    fps, parent, mark = sets["fp"].to_numpy(), list(range(len(sets))), np.zeros(int(ids.max()) + 1, np.int64)

    def first(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    cells = cells.assign(at=place[cells["fp"]].to_numpy())
    label = np.zeros(len(sets), np.int64)
    label[cells["at"]] = cells["label"]
    groups = {g: x["at"].to_numpy() for g, x in cells[cells["a"]].groupby("shard", sort=False)}
    for i, mine in cells[cells["b"]].groupby("at", sort=True):
        # those of all its groups here, each once
        left = np.unique(np.concatenate([groups[g] for g in mine["shard"] if g in groups] or [np.zeros(0, np.int64)]))
        left = left[label[left] != label[i]]
        for at in range(0, len(left), STEP):
            with_whom = left[at : at + STEP]
            with_whom = with_whom[100 * np.minimum(size[with_whom], size[i]) >= PERCENT * np.maximum(size[with_whom], size[i])]
            if not len(with_whom):
                continue
            mine = ids[start[i] : start[i] + size[i]]
            mark[mine] = 1
            begin = np.cumsum(size[with_whom]) - size[with_whom]
            theirs = ids[np.repeat(start[with_whom] - begin, size[with_whom]) + np.arange(int(size[with_whom].sum()))]
            both = np.add.reduceat(mark[theirs], begin)
            mark[mine] = 0
            for j in with_whom[100 * both >= PERCENT * (size[with_whom] + size[i] - both)].tolist():
                x, y = first(i), first(j)
                parent[max(x, y)] = min(x, y)
    label = np.array([first(i) for i in range(len(parent))], np.int64)
    moved = label != np.arange(len(label))
    return pd.DataFrame({"u": fps[moved], "v": fps[label[moved]]})


def linked(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Stars of all cells. cells: alone, task, part (the key of a task), shard, fp, label, a, b."""
    key = ["alone", "task", "part"]
    cells = written(cells, "cells")
    wanted = cells.select(*[F.col(k).alias(f"of_{k}") for k in key], F.col("fp").alias("of")).distinct()
    theirs = wanted.join(sets, F.col("of") == F.col("fp")).drop("of")
    tasks = cells.groupBy(*key).cogroup(theirs.groupBy(*[f"of_{k}" for k in key]))
    return written(tasks.applyInPandas(compare, "u long, v long"), "stars")


def chunks(rows: Column, size: Column) -> Column:
    """In how many chunks so many sets with so many shingles are cut."""
    return F.greatest(F.ceil(rows / CELL), F.ceil(size * 8 / CELL_BYTES), F.lit(1)).cast("long")


def tasks_for(rows: int | None, size: int | None) -> int:
    """Tasks for so many members of groups with so many shingles; most sets are in several groups of a task."""
    return max(1, -(-(rows or 0) // GROUPED), -(-8 * (size or 0) // TASK_BYTES))


def star_cells(members: DataFrame) -> DataFrame:
    """Each set against the centre it shares most groups with, and both sets of a group of two. members: shard, fp, n, label,
    members, hub, hub_n, hub_label."""
    pairs = members.where("fp <> hub and label <> hub_label").where(100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n"))
    pairs = pairs.repartition("fp").groupBy("fp", "n", "label", "hub", "hub_n", "hub_label").agg(F.count("*").alias("times"), F.min("members").alias("least"))
    best = F.max(F.struct("times", "hub")).over(Window.partitionBy("fp")).getField("hub")
    pairs = written(pairs.withColumn("best", best).where("least = 2 or hub = best"), "pairs")
    hubs = pairs.groupBy("hub").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), F.any_value("hub_n").alias("hub_n"), F.any_value("hub_label").alias("hub_label"))
    hubs = written(hubs.select("hub", "rows", "size", "hub_n", "hub_label", chunks(F.col("rows"), F.col("size")).alias("cut")), "hubs")
    total = hubs.agg(F.sum("size") + F.sum("hub_n"), F.sum("rows")).first()
    one = F.pmod(F.xxhash64("hub"), F.lit(tasks_for(total[1], total[0])))
    key = [(F.col("cut") > 1).alias("alone"), F.when(F.col("cut") > 1, F.col("hub")).otherwise(one).alias("task")]
    left = lookup(pairs.select("fp", "label", "hub"), hubs.select("hub", "rows", "cut"), "hub", "rows", total[1] or 0)
    left = left.select(*key, F.pmod(F.xxhash64("fp"), F.col("cut")).alias("part"), F.col("hub").alias("shard"), "fp", "label", F.lit(True).alias("a"), F.lit(False).alias("b"))
    right = hubs.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)).alias("part"), F.col("hub").alias("shard"), F.col("hub").alias("fp"), F.col("hub_label").alias("label"), F.lit(False).alias("a"), F.lit(True).alias("b"))
    return left.unionByName(right)


def rest_cells(members: DataFrame, tasks: int) -> DataFrame:
    """All pairs of different labels in each group: its sets in `cut` chunks against those outside its largest component in
    `cut_b` ones. members: shard, fp, n, label, main, low, cut, cut_b. tasks: for the groups of one cell."""
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    other = F.col("label") != F.col("main")
    alone = (F.col("cut") > 1) | (F.col("cut_b") > 1)
    key = [alone.alias("alone"), F.when(alone, F.col("shard")).otherwise(F.pmod(F.xxhash64("low"), F.lit(tasks))).alias("task")]
    a = F.pmod(F.xxhash64("fp"), F.col("cut"))
    b = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cut_b"))
    left = members.select("*", number(F.col("cut_b")).alias("j")).select(*key, (a * F.col("cut_b") + F.col("j")).alias("part"), "shard", "fp", "label", F.lit(True).alias("a"), F.lit(False).alias("b"))
    right = members.where(other).select("*", number(F.col("cut")).alias("i")).select(*key, (F.col("i") * F.col("cut_b") + b).alias("part"), "shard", "fp", "label", F.lit(False).alias("a"), F.lit(True).alias("b"))
    return left.unionByName(right)


def apart(groups: DataFrame) -> DataFrame:
    """groups with `low` as the key of a task: groups with the same smallest set stay together, in pieces if they are large."""
    large = groups.groupBy(F.col("low").alias("of_low")).agg(F.greatest(F.ceil(F.sum("members") / GROUPED), F.ceil(F.sum("size") * 8 / TASK_BYTES)).cast("long").alias("pieces"))
    groups = groups.join(F.broadcast(large.where("pieces > 1")), F.col("low") == F.col("of_low"), "left")
    piece = F.pmod(F.xxhash64("shard"), F.coalesce("pieces", F.lit(1).cast("long"))).alias("piece")
    return written(groups.withColumn("low", F.struct("low", piece)).drop("of_low", "pieces"), "groups")


def roots_of(found: DataFrame, sets: DataFrame) -> DataFrame:
    """node, root of the sets that are linked with a smaller one. found: shard, fp, n of groups that share a signature."""
    roots, turn, before = None, 0, 0
    while True:
        if roots is None:
            rows = found.withColumn("label", F.col("fp"))
        else:
            rows = found.join(roots, F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("root", "fp")).drop("node", "root")
        rank = F.xxhash64("fp", F.lit(turn)) if turn else F.count("*").over(Window.partitionBy("fp"))
        rows = written(rows.withColumn("rank", rank), "rows")
        by_label = rows.groupBy("shard", "label").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.max(F.struct("rank", "fp", "n", "label")).alias("hub"), F.min("fp").alias("low"))
        groups = by_label.groupBy("shard").agg(
            F.sum("m").alias("members"), F.sum("size").alias("size"), F.max("hub").alias("hub"), F.min("low").alias("low"), F.count("*").alias("labels"),
            F.max(F.struct("m", "label", "size")).alias("main"),
        ).where("labels > 1")
        if turn:
            groups = groups.where("members > 2")  # both sets of a pair have met
        others, size_b = F.col("members") - F.col("main.m"), F.col("size") - F.col("main.size")
        groups = groups.select("shard", "members", "size", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.label").alias("hub_label"), F.col("main.label").alias("main"), "low", chunks(F.col("members"), F.col("size")).alias("cut"), chunks(others, size_b).alias("cut_b"), others.alias("others"))
        groups = written(groups, "groups")
        m, left, size, meet, count = groups.agg(F.sum("members"), F.sum("others"), F.sum("size"), F.sum(F.col("members").cast("double") * F.col("others")), F.count("*")).first()
        if not m:
            return roots if roots is not None else found.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0)
        last = turn > 0 and (turn >= STARS or left > STALLS * before or m <= SMALL or meet <= MEET * m)
        before = left
        members = joined(rows, apart(groups) if last else groups, "shard", "members", m, count <= FEW).where("hub is not null")
        more = linked(rest_cells(members, tasks_for(m, size)) if last else star_cells(members), sets)
        edges = more if roots is None else more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = written(components(edges), "roots")
        if last:
            return roots
        found = written(members.where("members > 2").select("shard", "fp", "n"), "found")
        turn += 1


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs (doc_id, text; others ignored).

    Texts without words, null ones too, have no shingle and are linked with nothing: component_id is their own doc_id. A text
    of fewer than five words is one shingle. component_id is the smallest doc_id of the component; null ids are passed over
    unless it has no other. Repeated rows share theirs. An empty table gives an empty result. All shingles of a text count,
    however long it is. Sets are told apart by a hash of 64 bits of their shingles, which are hashes of 64 bits."""
    spark = docs.sparkSession
    prints = written(named(docs), "named")
    rows = prints.where("not counts").drop("counts")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "text_size")).alias("best")
    points = written(rows.where("n > 0").groupBy("fp", "n").agg(best, F.count("*").alias("rows")), "points")
    distinct, size = points.agg(F.count("*"), F.sum("n")).first()
    common = spark.sparkContext.broadcast(common_shingles(prints, distinct))
    buckets = max(1, -(-(size or 0) * 6 // 10 // BUCKET))
    packed = packed_signatures(docs, common, buckets, max(1, -(-distinct // SLICE)))
    found = packed.groupBy("bucket").applyInPandas(lambda pdf: shared(pdf), "shard long, fp long, n long, tag long, need long, times long")
    found = peeled(written(found.groupBy("shard", "fp", "n", "tag", "need").agg(F.sum("times").alias("times")), "found"))
    wanted = points.join(found.select(F.col("fp").alias("in_group")).distinct(), F.col("fp") == F.col("in_group"), "left_semi")
    wanted = wanted.select("fp", F.col("best.doc_id").alias("of"), F.col("best.text_hash").alias("of_hash"), F.col("best.text_size").alias("of_size"))
    texts = docs.select("doc_id", "text", *text_key())
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")) & (F.col("text_size") == F.col("of_size")))
    sets = written(texts.select("fp", "text").mapInArrow(sets_once, "fp long, shingles binary"), "sets")
    roots = roots_of(found, sets)
    of = points.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    first = of.groupBy(F.col("root").alias("of")).agg(F.min(F.struct("best.no_id", "best.doc_id")).alias("first"))
    of = of.join(first, F.col("root") == F.col("of")).select("fp", "rows", F.col("first.doc_id").alias("component_id"))
    out = lookup(rows, of, "fp", "rows", rows.count())
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def sets_once(batches):
    """fp, shingles of each set that a task sees."""
    seen = set()
    for batch in batches:
        fps, out = [], []
        for fp, text in zip(batch.column("fp").to_pylist(), batch.column("text")):
            if fp not in seen:
                seen.add(fp)
                fps.append(fp)
                out.append(shingles(text.as_py()).tobytes())
        yield pa.RecordBatch.from_pydict({"fp": pa.array(fps, pa.int64()), "shingles": pa.array(out, pa.binary())})
