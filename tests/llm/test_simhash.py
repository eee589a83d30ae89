import random
import re

import numpy as np
import xxhash

from friction.llm import simhash
from friction.llm.common import read_table
from friction.llm.simhash import components, drop_near_copies, fingerprint, near_duplicates


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[find(i)] = min(best.get(find(i), r[0]), r[0])
    return sorted(((r[0], f"{fps[i]:016x}", best.get(find(i))) for i, r in enumerate(rows)), key=str)


def near_rows():
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(500)]
    rows = []
    for i in range(300):
        w = list(base) if i % 2 else [f"v{rnd.randrange(10**6)}" for _ in range(40)]
        if i % 2:
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(500)] = f"x{rnd.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w), "en", "a"))
    return rows


def test_odd_rows(make_docs, odd_rows):
    assert sorted(map(tuple, near_duplicates(make_docs(odd_rows)).collect()), key=str) == brute(odd_rows)
    assert near_duplicates(make_docs([])).count() == 0


def test_near_copies_and_cut_shards(make_docs, monkeypatch):
    rows = near_rows()
    want = brute(rows)
    assert len({c for *_, c in want}) < 290
    assert sorted(map(tuple, near_duplicates(make_docs(rows)).collect()), key=str) == want
    monkeypatch.setattr(simhash, "TASK_ROWS", 8)  # a hot value is cut into pairs of chunks
    assert sorted(map(tuple, near_duplicates(make_docs(rows)).collect()), key=str) == want


def test_documents(spark, sf):
    docs = read_table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_duplicates(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == got.select("component_id").distinct().count()


def test_forest_finds_every_pair():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    points = np.unique(centres[rng.integers(0, 20, 800)] ^ (np.uint64(1) << rng.integers(0, 20, 800).astype(np.uint64)))
    shard = np.sort(rng.integers(0, 3, len(points)))
    pairs = {(int(a), int(b)) for x in simhash.near(*simhash.bk_forest(shard, points), points, 4) for a, b in zip(*x)}
    want = {(i, j) for i in range(len(points)) for j in range(i) if shard[i] == shard[j] and int(points[i] ^ points[j]).bit_count() <= 4}
    assert pairs == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(1, 61)} | {101: 100}


def test_long_texts_are_counted_whole():
    text = " ".join(f"w{i % 977}" for i in range(70_003))
    assert fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


def test_drop_near_copies_decides_by_row(make_docs, repeats, rows_of):
    docs = make_docs(repeats)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = [(1, "T " * 9), (2, "the one U text"), (3, "V and more"), (4, ""), (None, "of no id")]
    assert rows_of(kept) == sorted(want, key=str)
    assert drop_near_copies(make_docs([])).count() == 0


def test_more_blocks_for_more_fingerprints_find_the_same(make_docs, monkeypatch):
    assert [len(simhash.masks(n, 4)) for n in (10**6, 10**9, 10**11)] == [5, 15, 35]
    rows = near_rows()
    wide = simhash.masks(10**9, 4)
    monkeypatch.setattr(simhash, "masks", lambda total, radius: wide)
    assert sorted(map(tuple, near_duplicates(make_docs(rows)).collect()), key=str) == brute(rows)


def test_components_of_a_hub(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(i, i + 10_000) for i in range(1, 3000)], "u long, v long")
    got = components(edges.repartition(8))
    assert got.count() == 5998 and {r.root for r in got.select("root").distinct().collect()} == {0}


def test_components_of_stars_take_one_pass(spark, monkeypatch):
    """Of stars no round is needed, and none to see that the last one changed nothing."""
    tables = []
    monkeypatch.setattr(simhash, "written", lambda df, name, f=simhash.written: tables.append(name) or f(df, name))
    edges = [(10 * i + j, 10 * i) for i in range(20) for j in range(1, 10)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict(edges) and "small" not in tables
    components(spark.createDataFrame([(1, 2), (1, 3), (4, 3)], "u long, v long"))
    assert tables.count("small") == 1


def test_components_of_any_edges(spark, monkeypatch):
    """Broadcast and shuffled, against a plain union."""
    rnd = random.Random(8)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(7, 500 + i) for i in range(50)] + [(3, 3)]
    label = {x: x for e in edges for x in e}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for u, v in edges:
        a, b = find(u), find(v)
        label[max(a, b)] = min(a, b)
    for few in (simhash.FEW, 0):
        monkeypatch.setattr(simhash, "FEW", few)
        rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert sorted(map(tuple, rows)) == sorted((i, find(i)) for i in label if find(i) != i)
