import zlib
from collections import defaultdict

from friction.llm.common import read_table
from friction.llm.kd_shards import kd_shards, kd_tree, points


def held(rows, got, shards):
    """The contract's laws that hold whatever the tree."""
    want = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_odd_rows(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    held(rows, kd_shards(make_docs(rows), 5, rows_in_run=10).collect(), 5)
    assert kd_shards(make_docs([])).count() == 0
    assert kd_shards(make_docs(odd_rows), 40).count() == len(odd_rows)


def test_sizes_are_near_equal_even_of_copies(make_docs):
    rows = [(i, "same" * 5 if i % 3 else "y" * (i % 200), "en", "a") for i in range(4000)]
    got = kd_shards(make_docs(rows), 40).collect()
    held(rows, got, 40)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and all(abs(s - mean) < 250 for s in sizes.values())


def test_each_split_is_a_weighted_median_along_the_widest_dimension(spark, sf):
    rows = points(read_table(spark, sf, "documents")).cache()
    data = [r.asDict() for r in rows.collect()]
    root = kd_tree(rows, 8)
    extent = [max(r[f"k{d}"] for r in data) - min(r[f"k{d}"] for r in data) for d in range(3)]

    def check(node, part):
        if not node.kids:
            return
        wide = [(max(r[f"k{d}"] for r in part) - min(r[f"k{d}"] for r in part)) / extent[d] for d in range(3)]
        assert wide[node.dim] >= max(wide) - 1e-6
        left = [r for r in part if (r[f"k{node.dim}"], r["tie"]) < node.cut]
        goal = sum(r["size"] for r in part) * node.kids[0].leaves / node.leaves
        assert abs(sum(r["size"] for r in left) - goal) <= max(r["size"] for r in part) / 2 + 100
        ids = {r["doc_id"] for r in left}
        check(node.kids[0], left)
        check(node.kids[1], [r for r in part if r["doc_id"] not in ids])

    check(root, data)


def test_reruns_agree(spark, sf):
    docs = read_table(spark, sf, "documents")
    assert kd_shards(docs, 7).exceptAll(kd_shards(docs.repartition(5), 7)).count() == 0


def parted(rows, got):
    """Groups of equal texts with several rows, and those of them that lie in several shards, with their bytes."""
    shard, groups = {r.doc_id: r.shard for r in got}, defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    groups = {t: ids for t, ids in groups.items() if len(ids) > 1}
    return len(groups), [len(ids) * (len(t.encode()) + 16) for t, ids in groups.items() if len({shard[i] for i in ids}) > 1]


def test_equal_texts_stay_together(spark, sf):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    got = kd_shards(read_table(spark, sf, "documents")).collect()
    groups, cut = parted(rows, got)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r["size"]
    mean, largest = sum(sizes.values()) / 40, max(len((t or "").encode()) + 16 for _, t in rows)
    assert groups == 62 and len(cut) <= 1 and all(n > max(0.03 * mean, largest) for n in cut)
    assert all(abs(s - mean) <= largest for s in sizes.values())


def test_only_large_groups_are_cut(make_docs):
    """Copies across sources and languages; one text has a third of all rows, and one id is in all rows of another."""
    rows = [(i, "the one text" if i % 3 == 0 else f"text {i // 6}", "en" if i % 2 else "de", "abc"[i % 3 - 1]) for i in range(6000)]
    rows += [(None, "no id", "en", "a")] * 900
    got = kd_shards(make_docs(rows), 20).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 20
    assert len(sizes) == 20 and all(abs(s - mean) <= 0.03 * mean + 30 for s in sizes.values())
    groups, cut = parted([r for r in rows if r[0] is not None], got)
    assert groups > 900 and len(cut) == 1
