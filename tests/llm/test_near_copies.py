import random

import numpy as np

import corpus_pipeline
from friction.llm import near_copies
from friction.llm.common import read_table


def shingles(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Rows that stay by single links of similarity 0.8 between all pairs."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return sorted((r for i, r in enumerate(rows) if label[i] == i), key=str)


def stay(spark, docs):
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, None).collect()), key=str)


def text(seed, n=200, changed=()):
    w = [f"w{seed}x{i}" for i in range(n)]
    for i in changed:
        w[i] += "y"
    return " ".join(w)


def test_the_stage_links_at_a_similarity_of_0_8(spark, make_docs):
    """Three changed words leave 181 of 211 shingles; six leave 166 of 226, below the rule."""
    rows = [(1, text(1)), (2, text(1, changed=(30, 90, 150))), (3, text(2)), (4, text(2, changed=(20, 50, 80, 110, 140, 170))), (5, "three words only"), (6, "Three  words ONLY")]
    assert stay(spark, make_docs([(i, t, "en", "a") for i, t in rows])) == [(1, rows[0][1]), (3, rows[2][1]), (4, rows[3][1]), (5, rows[4][1])]


def test_repeated_and_null_ids(spark, make_docs):
    """Another text under the id of a copy stays, and null ids go only where another stands for them."""
    near = text(1, changed=(30,))
    rows = [(1, text(1)), (2, near), (2, text(3)), (None, near), (None, text(4)), (None, text(5))]
    want = sorted([(1, text(1)), (2, text(3)), (None, text(4)), (None, text(5))], key=str)
    assert stay(spark, make_docs([(i, t, "en", "a") for i, t in rows])) == want


def test_documents(spark, sf):
    docs = read_table(spark, sf, "documents")
    assert stay(spark, docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_cut_into_chunks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(near_copies, "TEXTS", 8)
    rnd = random.Random(3)
    rows = [(i, text(i % 2, changed=rnd.sample(range(200), rnd.randint(0, 4)))) for i in range(60)]
    assert stay(spark, make_docs([(i, t, "en", "a") for i, t in rows])) == brute(rows)


def test_repeats_and_clashing_columns(spark, make_docs, repeats, rows_of):
    docs = make_docs(repeats)
    kept = near_copies.drop_similar(docs)
    assert kept.columns == docs.columns
    want = [(1, "T " * 9), (2, "the one U text"), (3, "V and more"), (4, ""), (None, "of no id")]
    assert rows_of(kept) == sorted(want, key=str)
    assert near_copies.drop_similar(make_docs([])).count() == 0


def test_pairs_at_the_limit_are_within_the_radius():
    """Sets of 4 to 400 shingles that share just 0.8: how far apart their fingerprints are."""
    rng = np.random.default_rng(1)
    for n in (4, 8, 40, 400):
        for _ in range(200):
            s = rng.integers(0, 2**64, n + n // 4, dtype=np.uint64)
            a, b = (np.frombuffer(near_copies.wide_fingerprint(x), np.uint64) for x in (s[:n], s))
            assert np.bitwise_count(a ^ b).sum() <= near_copies.RADIUS
