"""Near copies by the rule of the stages: SimHash and BK-trees for sets of five-word shingles with a similarity of 0.8.

At that similarity 64 bits, and a radius that a shuffle can serve exactly, miss most pairs: fingerprints of a pair differ in
15 % of their bits. So the fingerprint is 256 bits wide, the radius is RADIUS of them, and the shards that a BK-tree is built
of are texts that agree in all ROWS minimum hashes of one of BANDS bands; at a similarity of 0.8 a pair shares no shard
with probability (1 - 0.8**ROWS)**BANDS = 0.0007, above it with less. No pair within the radius is believed: a link needs
the similarity of the whole sets, however long the texts are. Texts of one set meet first, by an aggregation. Shards with
the same members are one; they are packed into tasks, and a large one is cut into chunks of which each pair is a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from friction.llm.common import lookup, without, written
from friction.llm.simhash import bk_forest, components, near

SHINGLE, SEED, SIMILAR = 5, 42, 0.8
BANDS, ROWS = 24, 6
#: Words of 64 bits in a fingerprint, and the radius. Pairs at 0.8 are some 39 bits apart, of the smallest sets 48: five
#: standard deviations below 80; texts that share nothing are 128 apart.
WIDE, RADIUS = 4, 80
#: Texts in a task that compares.
TEXTS = 1000

_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of all word shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - SHINGLE + 1)
    last = np.minimum(np.arange(n) + SHINGLE - 1, len(words) - 1)
    return np.unique(np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[last] - 1).tolist())), np.uint64, n))


def wide_fingerprint(s: np.ndarray) -> bytes:
    """256 majority bits of a set of hashes: its own 64 bits, and three mixtures of them."""
    out = np.zeros((WIDE, 64), np.int64)
    for at in range(0, len(s), 65_536):
        h = s[at : at + 65_536]
        for k in range(WIDE):
            if k:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            out[k] += np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * out > len(s), axis=1, bitorder="little").tobytes()


def sketch(text: str | None) -> tuple[int, list[int], bytes]:
    """A hash of the set of shingles (0: empty), one of the minimum hashes of each band, and the fingerprint."""
    s = shingles(text)
    if not len(s):
        return 0, [], bytes(8 * WIDE)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (s[at : at + 4096, None] * _A + _B).min(0))
    bands = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(BANDS, ROWS))]
    signed = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED), *bands], np.uint64).view(np.int64).tolist()
    return signed[0], signed[1:], wide_fingerprint(s)


@F.pandas_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("print", T.BinaryType())]))
def sketches(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sketch(t) for t in texts], columns=["fp", "bands", "print"])


@F.pandas_udf(T.BinaryType())
def shingle_sets(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: shingles(t).tobytes(), na_action=None)


def link(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stars (fp, first of its component) of the shards of one task: BK-trees find the pairs within the radius, and those
    that are not joined yet are compared."""
    pdf = pdf.drop_duplicates(["shard", "fp"]).sort_values(["shard", "fp"], ignore_index=True)
    shard, fp = pdf["shard"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64)
    points = np.frombuffer(b"".join(pdf["print"]), np.uint64).reshape(len(pdf), WIDE)
    sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
    parent = list(range(len(pdf)))

    def first(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in near(*bk_forest(shard, points), points, RADIUS):
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = first(i), first(j)
            n, m = len(sets[i]), len(sets[j])
            if x != y and min(n, m) >= SIMILAR * max(n, m):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= SIMILAR * (n + m - both):
                    parent[max(x, y)] = min(x, y)
    label = np.array([first(i) for i in range(len(pdf))], np.int64)
    moved = label != np.arange(len(label))
    return pd.DataFrame({"u": fp[moved], "v": fp[label[moved]]}).drop_duplicates()


def links(docs: DataFrame, points: DataFrame, distinct: int) -> DataFrame:
    """u, v: stars whose components are those of all texts of points (fp, bands, print, text_hash, text_size)."""
    rows = points.select("fp", F.explode("bands").alias("band"))
    shards = rows.groupBy("band").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("fp")).alias("all")).where("members > 1")
    shards = shards.select("band", "members", F.xxhash64("all", "members").alias("shard"))
    found = lookup(rows, shards, "band", "members", distinct * BANDS).where("shard is not null")
    found = written(found.select("shard", "fp", "members").distinct(), "shards")
    wanted = points.join(found.select("fp").distinct(), "fp", "left_semi").select(F.col("fp").alias("set_fp"), "print", "text_hash", "text_size")
    texts = docs.select("text", *text_key()).join(wanted, ["text_hash", "text_size"])
    sets = texts.groupBy("set_fp").agg(F.any_value("text").alias("text"), F.any_value("print").alias("print"))
    sets = written(sets.select("set_fp", "print", shingle_sets("text").alias("shingles")), "shingles")
    chunks = F.when(F.col("members") > TEXTS, F.ceil(F.col("members") * 2 / TEXTS).cast("long")).otherwise(F.lit(1).cast("long"))
    rows = found.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    tasks = max(1, -(-found.count() // TEXTS))
    task = F.when(F.col("chunks") == 1, F.pmod(F.col("shard"), F.lit(tasks))).otherwise(F.col("shard"))
    rows = rows.select("shard", "fp", (F.col("chunks") > 1).alias("cut"), task.alias("task"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    rows = rows.join(sets, F.col("fp") == F.col("set_fp")).drop("set_fp")
    return rows.groupBy("cut", "task", "low", "high").applyInPandas(link, "u long, v long")


def text_key() -> list:
    """Columns that name a text: its hash and its size."""
    return [F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("text_size")]


def drop_similar(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; all columns kept) with exactly one row of each component of near copies: the smallest doc_id.

    The verdict is of the row, doc_id and text: another text under a repeated id has its own. Null ids are passed over
    unless a component has no other; of equal rows one stays. Texts without words, null ones too, are copies of each other.
    Columns may have any names. An empty table gives an empty result."""
    prints = docs.select("doc_id", *text_key(), sketches("text").alias("sketch"))
    prints = written(prints.select("doc_id", "text_hash", "text_size", "sketch.*"), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "text_size")
    points = prints.groupBy("fp").agg(F.min(row).alias("best"), F.any_value("bands").alias("bands"), F.any_value("print").alias("print"), F.count("*").alias("n"))
    points = written(points.select("fp", "best", "best.text_hash", "best.text_size", "bands", "print", "n"), "points")
    roots = components(links(docs, points, points.count()))
    of = points.select("fp", "best", "n").join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    kept = of.groupBy(F.col("root").alias("kept_of")).agg(F.min("best").alias("kept"), F.sum("n").alias("members")).where("members > 1")
    of = of.join(kept, F.col("root") == F.col("kept_of")).select("fp", "n", "kept")
    rows = lookup(prints.select("doc_id", "text_hash", "text_size", "fp"), of, "fp", "n", prints.count()).where("kept is not null")
    rows = rows.groupBy("doc_id", "text_hash", "text_size", (row == F.col("kept")).alias("one_stays")).count().where("not one_stays or count > 1")
    gone = written(rows.select(F.col("doc_id").alias("k0"), F.col("text_hash").alias("k1"), F.col("text_size").alias("k2"), "one_stays"), "gone")
    return without(docs, [F.col("doc_id"), *text_key()], gone)
