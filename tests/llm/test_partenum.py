import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from friction.llm import partenum
from friction.llm.partenum import bands_of, jaccard_components, partitions, shingles, signatures


def slow(rows):
    """Components of rows (doc_id, text) by the counts of all shingles."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent, holders = list(range(len(rows))), defaultdict(list)

    def first(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j, n in Counter(j for g in x for j in holders[g]).items():
            if 100 * n >= 80 * (len(x) + len(sets[j]) - n):
                a, b = first(i), first(j)
                parent[max(a, b)] = min(a, b)
        for g in x:
            holders[g].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[first(i)] = min(least.get(first(i), (True, 0)), (doc_id is None, doc_id or 0))
    named = lambda i: None if least[first(i)][0] else least[first(i)][1]
    return sorted(((d, len(sets[i]), named(i) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(docs):
    return sorted(map(tuple, jaccard_components(docs).collect()), key=str)


def text_rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def test_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(docs) == slow(text_rows(docs))


def test_odd_and_repeated_rows(make_docs, odd_rows, repeats):
    for rows in (odd_rows, repeats, []):
        docs = make_docs(rows)
        assert got(docs) == slow(text_rows(docs))


@pytest.mark.parametrize("often, cell", [(1 / 500, 512), (0.01, 7)])
def test_hot_groups(make_docs, monkeypatch, often, cell):
    """A third of the rows is one text, another third are near copies in a chain, all share a line: small cells and slices."""
    monkeypatch.setattr(partenum, "OFTEN", often)
    monkeypatch.setattr(partenum, "CELL", cell)
    monkeypatch.setattr(partenum, "SLICE", 20)
    rnd = random.Random(5)
    line, base = " ".join(words(rnd, 12)), words(rnd, 90)
    rows = [(i, " ".join(base[:60]), "en", "a") for i in range(100)]
    for i in range(100, 200):  # each a step further from the first
        for _ in range(2):
            base[rnd.randrange(len(base))] = "".join(words(rnd, 1))
        rows.append((i, " ".join(base), "en", "a"))
    rows += [(200 + i, line + " " + " ".join(words(rnd, rnd.randint(0, 40))), "en", "b") for i in range(100)]
    rnd.shuffle(rows)
    docs = make_docs(rows)
    assert got(docs) == slow(text_rows(docs))


def test_rounds_of_stars_end_where_few_pairs_are_left(make_docs, monkeypatch):
    """Copies of a few bases that share most of their words: the same components after any number of rounds, broadcast or shuffled."""
    rnd, turns = random.Random(6), []
    monkeypatch.setattr(partenum, "SMALL", 0)
    monkeypatch.setattr(partenum, "star_cells", lambda m, f=partenum.star_cells: turns.append(1) or f(m))
    bases = [words(rnd, 60)]
    for _ in range(3):
        bases.append([*bases[0][:35], *words(rnd, 25)])
    rows = []
    for i in range(120):
        w = list(bases[i % 4])
        w[rnd.randrange(40, 60)] = words(rnd, 1)[0]
        rows.append((i, " ".join(w), "en", "a"))
    docs = make_docs(rows)
    wanted = slow(text_rows(docs))
    assert got(docs) == wanted and len(turns) == 1
    monkeypatch.setattr(partenum, "MEET", 0)
    monkeypatch.setattr(partenum, "FEW", 0)
    assert got(docs) == wanted and len(turns) > 2


def test_similar_sets_share_a_signature():
    """Pairs at exactly the bound, of all sizes, whatever is common."""
    rng = np.random.default_rng(1)
    for n in [4, 5, 6, 8, 9, 10, 20, 45, 100, 333, 1000]:
        for _ in range(30):
            both = 8 * n // 9 if n > 5 else 4
            pool = np.unique(rng.integers(0, 2**64, 3 * n, dtype=np.uint64))
            rng.shuffle(pool)
            a, b = pool[:n], np.concatenate((pool[:both], pool[n : n + max(1, int(both / 0.8) - n)]))
            if 100 * both < 80 * (len(a) + len(b) - both):
                b = np.concatenate((pool[:both], pool[n : n + max(0, int(both / 0.8) - n)]))
            assert 100 * both >= 80 * (len(a) + len(b) - both)
            common = np.sort(rng.choice(pool[:n], rng.integers(0, n + 1), replace=False))
            x, y = ({t: (need, dict(zip(g.tolist(), h.tolist()))) for t, need, g, h in signatures(np.sort(p), common)} for p in (a, b))
            band = max(bands_of(len(a))[0], bands_of(len(b))[0])
            both = x[band][1].keys() & y[band][1].keys()
            assert len(both) >= max(x[band][0], y[band][0], 1)
            assert all(x[band][1][g] == y[band][1][g] for g in both)


def test_bands_and_partitions():
    for n in [4, 5, 7, 50, 999, 10**6]:
        own = bands_of(n)[0]
        assert partenum.EDGES[own] <= n < partenum.EDGES[own + 1]
        for m in range(n, int(n / 0.8) + 1):
            assert bands_of(m)[0] in bands_of(n)
            n1, spare = partitions(bands_of(m)[0])
            assert n1 - spare > (n + m) // 9 or n > 999


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 20])
def test_words_across_blocks(monkeypatch, block):
    text = b"  one two\tthree one\n\n a  bb ab ba " + b"long" * 20 + b" one"
    whole = partenum.word_hashes(text).tolist()
    monkeypatch.setattr(partenum, "STEP_BYTES", block)
    assert partenum.word_hashes(text).tolist() == whole
    words = text.split()
    assert len(whole) == len(words) and len(set(whole)) == len(set(words))
    assert all((x == y) == (u == v) for x, u in zip(whole, words) for y, v in zip(whole, words))


def test_shingles_are_of_whole_words():
    assert len(shingles("a b c d e a b c d e a b c d e")) == 5
    assert len(shingles("a  b\tc")) == 1 and (shingles("a b c") == shingles("A B\nC")).all()
    assert len({int(shingles(t)[0]) for t in ("a", "a a", "a a a", "a a a a", "b a", "a b", "ab")}) == 7
    assert len(shingles(" \n")) == len(shingles(None)) == len(shingles("")) == 0
