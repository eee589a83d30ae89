import math
import random

import pytest

from friction.llm import top_k as module
from friction.llm.top_k import top_k

V = "vec_id long, embedding array<float>, label int, v string, shard string, wave string"


def brute(rows, every=50, k=5):
    ok = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    ok = sorted({(i, tuple(e)) for i, e in ok})
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        e = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(e, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, None, None, None) for i, e in rows], V)


@pytest.mark.parametrize("shard", [6000, 70])
def test_against_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(module, "SHARD", shard)
    monkeypatch.setattr(module, "QUERIES", 3)
    monkeypatch.setattr(module, "WAVE", 2)
    rnd = random.Random(3)
    f = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f(rnd.gauss(0, 0.3)) for _ in range(16)]) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(40)]  # ties
    rows += [(None, rows[0][1]), (500, None), (501, [None] * 16), (502, [float("nan")] * 16), (503, [float("inf")] + [0.0] * 15), (504, []), (550, [1.0]), (600, [0.0] * 16), rows[3], (50, rows[9][1])]
    assert sorted(map(tuple, top_k(frame(spark, rows)).collect())) == brute(rows)


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.0])]
    assert sorted(map(tuple, top_k(frame(spark, rows)).collect())) == brute(rows)
    assert top_k(frame(spark, [])).count() == 0
    assert top_k(frame(spark, [(7, [1.0])])).count() == 0
