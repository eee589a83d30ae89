import hashlib
import math
import random

import numpy as np
import pytest

from friction.llm.vector_codes import ENTRIES, PARTS, ROUNDS, nearest, neighbour_lists, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, error string, v string, of string, n string"


def slow(rows):
    """Every part against every entry, with Python's integers. rows: (vec_id, embedding, label)."""
    kept = [(i, v, lb) for i, v, lb in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wide = -(-max(1, max((len(v) for _, v, _ in kept), default=0)) // PARTS)
    cut = lambda v: [tuple(([math.floor(1024 * float(np.float32(x))) for x in v] + [0] * wide * PARTS)[p * wide : (p + 1) * wide]) for p in range(PARTS)]
    parts = sorted(((i, cut(v), lb) for i, v, lb in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[r[1][p] for r in parts[:ENTRIES]] for p in range(PARTS)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min((apart(r[1][p], e), k) for k, e in enumerate(books[p])) for p in range(PARTS)] for r in parts]
    for _ in range(ROUNDS):
        found = near()
        for p in range(PARTS):
            for k in range(len(books[p])):
                mine = [r[1][p] for r, f in zip(parts, found) if f[p][1] == k]
                if mine:
                    books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = [(r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), r[2]) for r, f in zip(parts, near())]
    return sorted(((i, c, e, sum(x[2] for x in coded if x[3] == lb), digest) for i, c, e, lb in coded), key=str)


def got(spark, rows):
    return sorted(map(tuple, vector_codes(spark.createDataFrame([(*r, *("",) * 5) for r in rows], SCHEMA)).collect()), key=str)


def test_equals_a_slow_version(spark):
    rnd = random.Random(3)
    rows = [(i * 3 % 331, [rnd.choice([-1, 1]) * rnd.random() for _ in range(8)], rnd.choice([None, 1, 1, 2])) for i in range(330)]
    rows += [(7, [0.25] * 8, 1)] * 40 + [(900 + i, [0.25] * 8, None) for i in range(40)]  # ties: repeated rows and equal vectors
    assert got(spark, rows) == slow(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan")] * 4, 1), (4, [float("inf")] * 4, None)],
        [(1, [], None)],
        [(None, [0.5, -0.5], None), (None, [0.5, -0.5], None), (3, [1.0], 2), (3, [1.0, 2.0, 3.0, 4.0, -5.0], 2), (2, [-0.001] * 3, 2)],
    ],
)
def test_odd_rows(spark, rows):
    assert got(spark, rows) == slow(rows)


def test_an_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("spread", [0, 1, 2, 40, 100_000])
def test_search_from_any_start_finds_the_nearest(spread):
    """Ties abound where the spread is small, equal entries among them."""
    rng = np.random.default_rng(spread)
    book, x = rng.integers(-spread, spread + 1, (97, 3)), rng.integers(-spread, spread + 1, (500, 3))
    best, least = nearest(x, book, neighbour_lists(book), rng.integers(0, 97, 500))
    d = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (least == d.min(1)).all()
