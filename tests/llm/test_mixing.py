import re

import numpy as np
import pytest

from friction.llm.common import read_table
from friction.llm.mixing import BLOCK, flight, landing, mix, mixed_documents


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Reshare the excess by weight until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s] + 1e-9}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def check(docs, rows, near):
    got = mix(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets(sizes)
    assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted((i, words(t)) for i, t, *_ in rows if i is not None)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert {round(r.target, 3) for r in got} == {round(v, 3) for k, v in want.items()}
    for target, n in taken.values():
        assert abs(n - target) <= near, (n, target)
    return got


def test_targets_and_totals(spark, sf):
    docs = read_table(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    check(docs, rows, 40)


def test_odd_rows(make_docs, odd_rows):
    got = check(make_docs(odd_rows), odd_rows, 60_000)
    assert len(got) == len(odd_rows)
    assert mix(make_docs([])).count() == 0


def test_several_rounds_and_reruns(make_docs):
    rows = [(i, "w " * (1 + i % 17), "en", "a" if i % 3 else "b") for i in range(4 * BLOCK)]
    docs = make_docs(rows)
    got = check(docs, rows, 4)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs.repartition(6)).collect()))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    p, x = np.full(500, 0.3), rng.integers(1, 100, 500).astype(float)
    q = flight(p, x, 12, rng)
    assert ((q > 0) & (q < 1)).sum() <= 12
    assert q.sum() == pytest.approx(p.sum()) and (q * x).sum() == pytest.approx((p * x).sum())
    r = landing(q, x)
    assert set(r) <= {0.0, 1.0} and abs((r * x).sum() - (p * x).sum()) <= x.max()


def test_inclusion_follows_probability():
    rng, hits = np.random.default_rng(5), np.zeros(40)
    x = np.arange(1.0, 41.0)
    for _ in range(400):
        hits += landing(flight(np.full(40, 0.25), x, 2, rng), x)
    assert abs(hits.mean() / 400 - 0.25) < 0.02 and hits.min() > 40 and hits.max() < 180


def test_the_mix_repeats_rows(spark, sf):
    docs = read_table(spark, sf, "documents")
    out, want = mixed_documents(docs), mix(docs)
    assert out.columns == docs.columns and out.count() == want.agg({"copies": "sum"}).first()[0]


def test_the_mix_decides_by_row(make_docs, repeats, rows_of):
    """Each row as often as its own decision says: one id with two texts, rows without an id, equal rows."""
    docs = make_docs(repeats)
    out, want = mixed_documents(docs), mix(docs).collect()
    assert out.columns == docs.columns
    got, words = {}, {}
    for i, t in rows_of(out):
        got[i, len(t.split())] = got.get((i, len(t.split())), 0) + 1
    for r in want:
        if r.copies:
            words[r.doc_id, r["size"]] = words.get((r.doc_id, r["size"]), 0) + r.copies
    assert got == words and sum(got.values()) > 5
    assert mixed_documents(make_docs([])).count() == 0


def test_blocks_of_one_repeated_id_stay_bounded(make_docs):
    rows = [(7 if i % 2 else None, "w " * (1 + i % 11), "en", "a" if i % 3 else "b") for i in range(3 * BLOCK)]
    check(make_docs(rows), rows, 4)
