"""A Merkle manifest of a dataset, level by level in DataFrames.

A row's leaf is the digest of its fields. The leaves of a source, in the order of their ids, are numbered without gaps; those
of one quotient by FANOUT are the children of one parent, whose digest is that of its sorted child array, and so on until a
source has one node, its subroot. The subroots are the leaves of one more tree. A level is a grouped table of its own in the
shared folder, a third as large as the one below it.

Proofs go down again: a parent hands each child its own siblings and all that it was handed itself, so what moves for a leaf
is a third of one path. A row folds its leaf, tampered with or not, and its siblings back into a root.

Numbers are row_number() within ranges of the sorted rows, and a broadcast of where each range begins in its source, one
row a range: a source of any size, and a row that repeats any number of times, is spread over as many tasks as it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.llm.common import written

FANOUT = 3
#: Rows of a range that is numbered in one task.
RANGE = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_of(values: dict[str, Column]) -> Column:
    """Digest of the fields, each with its length, so that no two rows share an encoding."""
    said = [v.cast("string") for v in values.values()]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said])


def leaves(docs: DataFrame, tampered: Column, change) -> DataFrame:
    """tree, id, digest, now: one row for each row of docs. now: the leaf after `change` of the text where it was tampered
    with, null elsewhere. Trees sort as sources do: null first, then by bytes."""
    values = {c: F.col(c) for c in FIELDS}
    now = F.when(F.coalesce(tampered, F.lit(False)) & (change(F.col("text")) != F.col("text")), leaf_of(values | {"text": change(F.col("text"))}))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    return docs.select(tree.alias("tree"), F.col("doc_id").alias("id"), leaf_of(values).alias("digest"), now.alias("now"))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with `idx`, their place in their tree by `order` from 0, and how many rows the largest tree has."""
    order = [F.col(c).asc_nulls_last() for c in order]
    ranges = max(1, -(-rows.count() // RANGE))
    spread = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))  # else a row that repeats is one range
    spread = spread.repartitionByRange(ranges, "tree", *order, "tie").sortWithinPartitions("tree", *order, "tie")
    spread = written(spread.withColumn("range", F.spark_partition_id()), "ranges")
    counts = written(spread.groupBy("tree", "range").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # ranges follow each other, so only the first tree of a range can have begun before it
    begins = counts.withColumn("begins", before).where("begins > 0").select(F.col("tree").alias("begin_tree"), F.col("range").alias("begin_range"), "begins")
    at = F.row_number().over(Window.partitionBy("range", "tree").orderBy(*order, "tie")) - 1
    out = spread.withColumn("idx", at).join(F.broadcast(begins), (F.col("tree") == F.col("begin_tree")) & (F.col("range") == F.col("begin_range")), "left")
    largest = counts.groupBy("tree").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    return out.withColumn("idx", F.col("idx") + F.coalesce("begins", F.lit(0))).drop("tie", "range", "begin_tree", "begin_range", "begins"), largest


def levels(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The grouped tables from the leaves up: tree, idx, kids (sorted children), digest of the parent. A tree of one node is
    done: at the level above it stands as parent 0 of a single child."""
    out = []
    while True:
        kids = F.array_sort(F.collect_list(F.struct("idx", *[c for c in nodes.columns if c not in ("tree", "idx")])))
        groups = nodes.groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("parent")).agg(kids.alias("kids"))
        said = F.array_join(F.transform("kids", lambda k: as_hex(k["digest"])), "")
        out.append(written(groups.select("tree", F.col("parent").alias("idx"), "kids", digest(said).alias("digest")), "level"))
        if largest <= 1:
            return out
        nodes, largest = out[-1].where(~done()).select("tree", "idx", "digest"), -(-largest // FANOUT)


def done() -> Column:
    """Whether a parent is of a tree that ended below."""
    return (F.col("idx") == 0) & (F.size("kids") == 1)


def tops(tree: list[DataFrame]) -> DataFrame:
    """tree, height, digest of each tree's last node."""
    ended = [t.where(done()).select("tree", F.lit(i).alias("height"), F.col("kids")[0]["digest"].alias("digest")) for i, t in enumerate(tree)]
    return reduce(DataFrame.unionByName, ended)


def with_paths(tree: list[DataFrame], heads: DataFrame, keep: list[str]) -> DataFrame:
    """The leaves (tree, kid, path and the columns `keep` of heads). heads: tree, height, path, ... of each tree's last node.
    path: what stands left and right of the node in each run, from its own level up."""
    step = "array<struct<before:array<binary>,after:array<binary>>>"
    paths = None
    for height in range(len(tree) - 1, -1, -1):
        parents = tree[height].select("tree", "idx", "kids")
        ends = heads.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("idx"), F.col("path").cast(step).alias("path"), *keep)
        # a tree that ends here hands its path on to its only node as it is
        single = parents.where(done()).join(ends, ["tree", "idx"]).select("tree", F.col("kids")[0].alias("kid"), "path", *keep)
        children = single
        if paths is not None:
            inner = parents.where(~done()).join(paths, ["tree", "idx"])
            inner = inner.select("tree", "kids", "path", *keep, F.posexplode("kids").alias("pos", "kid"))
            others = F.transform("kids", lambda k: k["digest"])
            own = F.struct(F.slice(others, F.lit(1), F.col("pos")).alias("before"), F.slice(others, F.col("pos") + 2, F.lit(FANOUT)).alias("after"))
            children = single.unionByName(inner.select("tree", "kid", F.concat(F.array(own), F.col("path")).alias("path"), *keep))
        paths = children.select("tree", F.col("kid.idx").alias("idx"), "path", *keep)
    return children


def joined_hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, as_hex), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda d, s: digest(joined_hex(s["before"]), as_hex(d), joined_hex(s["after"])))


def merkle_manifest(docs: DataFrame, tampered: Column, change) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of docs (doc_id, source, lang,
    n_chars, text; others ignored). tampered, change: which rows change after the manifest was made, and how their text does.

    Null fields have an encoding of their own. Leaves ascend by doc_id, null ids last; rows with one id by their digests, and
    equal rows are a leaf each. A source of one row is its subroot, and a lone subroot the root; a row without siblings has
    the proof of no digests. An empty table gives an empty result. Texts of any length pass whole through the hash."""
    rows, largest = numbered(written(leaves(docs, tampered, change), "leaves"), ["id", "digest"])
    tree = levels(rows.select("tree", "idx", "digest", "now", "id"), largest)
    heads = written(tops(tree), "subroots")
    above, sources = numbered(heads.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "height", "digest"), ["of"])
    top = levels(above, sources)
    root = tops(top).select("tree", "height", F.array().alias("path"), F.col("digest").alias("root"))
    subroots = with_paths(top, root, ["root"]).select(F.col("kid.of").alias("tree"), F.col("kid.height").alias("height"), "path", F.col("kid.digest").alias("subroot"), "root")
    out = with_paths(tree, written(subroots, "subroots"), ["subroot", "root"])
    proof = joined_hex(F.flatten(F.transform("path", lambda s: F.concat(s["before"], s["after"]))))
    again = folded(F.coalesce("kid.now", "kid.digest"), F.col("path"))
    return out.select(
        F.col("kid.id").alias("doc_id"),
        as_hex(F.col("kid.digest")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"),
        as_hex(F.col("root")).alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"),
        as_hex(again).alias("folded_root"),
        (again == F.col("root")).alias("verified"),
    )


def manifest_check(docs: DataFrame) -> DataFrame:
    """merkle_manifest() where the texts of half of the ids, by CRC-32, lose their newlines."""
    return merkle_manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, lambda t: F.replace(t, F.lit("\n"), F.lit("")))


ORACLE_SQL = r"""
WITH RECURSIVE
bits AS (
  SELECT i, 0 AS step, i AS v FROM range(256) r(i)
  UNION ALL SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
crc AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS pos, 4294967295 AS c FROM documents
  UNION ALL SELECT doc_id, s, pos + 1, xor(c >> 8, bits.v) FROM crc JOIN bits ON bits.step = 8 AND bits.i = (xor(c, ascii(s[pos])) & 255) WHERE pos <= length(s)),
odd AS (SELECT doc_id, xor(c, 4294967295) % 2 = 0 AS tampered FROM crc WHERE pos > length(s)),
d AS (
  SELECT d.*, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS now FROM documents d LEFT JOIN odd USING (doc_id)),
e AS (
  SELECT doc_id, source, concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(now) || ':' || now, '-') AS body_now FROM d),
l AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256(head || body) AS leaf, sha256(head || body_now) AS leaf_now FROM e),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS LAST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l),
low AS (
  SELECT tree, 0 AS lvl, idx, leaf AS digest, n FROM leaves
  UNION ALL SELECT tree, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, lvl, idx // 3, n),
subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS trees FROM low WHERE n = 1),
high AS (
  SELECT 'root' AS tree, 0 AS lvl, place AS idx, subroot AS digest, trees AS n FROM subroots
  UNION ALL SELECT tree, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY tree, lvl, idx // 3, n),
runs AS MATERIALIZED (
  SELECT part, tree, lvl, idx // 3 AS parent, list(digest ORDER BY idx) AS kids
  FROM (SELECT 0 AS part, * FROM low UNION ALL SELECT 1, * FROM high) WHERE n > 1 GROUP BY ALL),
start AS (
  SELECT leaves.*, subroot, place FROM leaves JOIN subroots USING (tree)),
walk AS (
  SELECT doc_id, leaf, 0 AS part, tree, 0 AS lvl, idx, leaf_now AS cur, '' AS siblings, subroot, place FROM start
  UNION ALL
  SELECT w.doc_id, w.leaf, coalesce(r.part, 1), CASE WHEN r.part IS NULL THEN 'root' ELSE w.tree END, CASE WHEN r.part IS NULL THEN 0 ELSE w.lvl + 1 END,
    CASE WHEN r.part IS NULL THEN w.place ELSE w.idx // 3 END,
    CASE WHEN r.part IS NULL THEN w.cur ELSE sha256(array_to_string(kids[:w.idx % 3], '') || w.cur || array_to_string(kids[w.idx % 3 + 2:], '')) END,
    w.siblings || CASE WHEN r.part IS NULL THEN '' ELSE array_to_string(kids[:w.idx % 3], '') || array_to_string(kids[w.idx % 3 + 2:], '') END, subroot, place
  FROM walk w LEFT JOIN runs r ON r.part = w.part AND r.tree = w.tree AND r.lvl = w.lvl AND r.parent = w.idx // 3
  WHERE r.part IS NOT NULL OR w.part = 0)
SELECT doc_id, leaf, subroot, digest AS root, sha256(siblings) AS proof_sha256, cur AS folded_root, cur = digest AS verified
FROM walk, (SELECT digest FROM high WHERE n = 1)
WHERE part = 1 AND NOT EXISTS (FROM runs r WHERE r.part = 1 AND r.lvl = walk.lvl)
"""
