from collections import defaultdict

import numpy as np
import pytest

from friction.llm import packing, registry, token_counts
from friction.llm.common import read_table
from friction.llm.packing import CAPACITIES, best_fit, id_type, pack, sequences
from friction.llm.token_counts import MANY_BLANKS, VOCABULARY, encoded, encoding


def check(rows, got):
    size = {t: len(encoded(t, VOCABULARY)) for t in {t for _, t, *_ in rows if t}}
    covered, bins = defaultdict(list), defaultdict(list)
    for r in got:
        covered[r.doc_id].append((r.start, r.length))
        bins[r.bin_id].append(r)
    want = defaultdict(int)
    for i, t, *_ in rows:
        want[i] += size.get(t, 0)
    assert {k: sum(n for _, n in v) for k, v in covered.items()} == dict(want)
    for b in bins.values():
        b.sort(key=lambda r: r.bin_offset)
        used = sum(r.length for r in b)
        assert all(r.bin_used == used and r.capacity == b[0].capacity for r in b)
        assert b[0].capacity == min(c for c in CAPACITIES if c >= used)
        assert [r.bin_offset for r in b] == [sum(x.length for x in b[:i]) for i in range(len(b))]
    return sum(b[0].capacity for b in bins.values()), sum(want.values())


def decoded(got):
    """The text of each document by its pieces; ids occur once."""
    encoder, _ = encoding(VOCABULARY)
    by = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.token_ids, id_type(VOCABULARY)).tolist()
        assert len(ids) == r.length
        by[r.doc_id].append((r.start, ids))
    return {i: encoder.decode([t for _, ids in sorted(p) for t in ids]) for i, p in by.items()}


def test_documents(spark, sf):
    docs = read_table(spark, sf, "documents")
    rows, got = [(r.doc_id, r.text) for r in docs.collect()], sequences(docs).collect()
    held, tokens = check(rows, got)
    assert tokens / held > 0.97
    assert decoded(got) == {i: t or "" for i, t in rows}


def test_tokens_of_odd_rows(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(packing, "HANDED", 400)  # handed over often
    rows = [r for r in odd_rows if r[0] not in (None, 6)]
    got = sequences(make_docs(rows)).collect()
    assert decoded(got) == {i: t or "" for i, t, *_ in rows}


def test_the_query_returns_what_it_packs(spark, sf):
    got = registry.queries()["op4_best_fit_packing"](spark, sf).collect()
    assert decoded(got) == {r.doc_id: r.text or "" for r in read_table(spark, sf, "documents").collect()}


@pytest.mark.parametrize("limit", [1, 2, 3, 1000])
def test_rows_of_blanks_are_encoded_as_in_the_whole(monkeypatch, limit):
    monkeypatch.setattr(token_counts, "MANY_BLANKS", limit)
    encoder, _ = encoding(VOCABULARY)
    for blank in (" ", "\n", "\t", " \n", "\r\n", "\u3000", "\xa0 ", "\x1c", "\u200b"):
        for n in (1, 2, 3, 999, 1000, 1001, 20_000):
            for text in (blank * n, "a" + blank * n, blank * n + "b's", f"x{blank * n}y\n\n  1,{blank * n}"):
                assert encoded(text, VOCABULARY).tolist() == encoder.encode_ordinary(text)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n\t\r"])
def test_millions_of_blanks(make_docs, blank):
    text = "before" + blank * (5_000_000 // len(blank)) + "after it"
    assert MANY_BLANKS < 5_000_000
    got = sequences(make_docs([(1, text, "en", "a"), (2, text + blank * 1_000_000, "en", "a")])).collect()
    assert decoded(got) == {1: text, 2: text + blank * 1_000_000}


def test_no_id_is_changed(make_docs):
    """Ids beyond 2**53 beside a null."""
    rows = [(2**53 + 1, "one", "en", "a"), (2**62 + 3, "two", "en", "a"), (None, "three", "en", "a")]
    assert {r.doc_id for r in pack(make_docs(rows)).collect()} == {r[0] for r in rows}


def test_odd_rows(make_docs, odd_rows):
    check(odd_rows, pack(make_docs(odd_rows)).collect())
    assert pack(make_docs([])).count() == 0


def test_rounds_of_cells_lose_nothing(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 60)
    rows = [(i, "w " * (1 + i * 37 % 700), "en", "a") for i in range(900)]
    held, words = check(rows, pack(make_docs(rows)).collect())
    assert words / held > 0.9


def test_best_fit_takes_the_tightest_bin_and_the_cheapest_size():
    bins, caps, used = best_fit(np.array([90, 60, 40, 10]), (50, 100), 5)
    assert bins.tolist() == [0, 1, 1, 0] and caps.tolist() == [100, 100]
    bins, caps, used = best_fit(np.array([30, 30, 30]), (50, 100), 5)  # 100 for 90 costs less a token than 50 for 30
    assert caps.tolist() == [100] and used.tolist() == [90]
    bins, caps, used = best_fit(np.array([30]), (50, 100), 5)
    assert caps.tolist() == [50]


def test_not_worse_than_the_best_partition_of_small_cases():
    rng = np.random.default_rng(0)
    for _ in range(30):
        x = np.sort(rng.integers(1, 100, 6))[::-1]
        best = min(cost for cost in partitions(x.tolist(), (50, 100), 5))
        bins, caps, used = best_fit(x, (50, 100), 5)
        assert sum(caps + 5) <= 1.5 * best


def partitions(x, capacities, overhead, open_=()):
    if not x:
        yield sum(min(c for c in capacities if c >= u) + overhead for u in open_)
        return
    for i, u in enumerate(open_):
        if u + x[0] <= max(capacities):
            yield from partitions(x[1:], capacities, overhead, (*open_[:i], u + x[0], *open_[i + 1 :]))
    yield from partitions(x[1:], capacities, overhead, (*open_, x[0]))


def test_cells_stay_bounded_where_nothing_can_be_combined(spark, make_docs, monkeypatch, tmp_path):
    """Two pieces of 1100 to 1900 words never share a bin, and none of them fills one."""
    monkeypatch.setattr(packing, "CELL", 60)
    seen = str(tmp_path / "cells")
    one = packing.packer

    def noted(*args):
        pack_cell = one(*args)

        def run(key, pdf):
            with open(seen, "a") as f:
                f.write(f"{len(pdf)}\n")
            return pack_cell(key, pdf)

        return run

    monkeypatch.setattr(packing, "packer", noted)
    rows = [(i, "w " * (1100 + i * 37 % 800), "en", "a") for i in range(900)]
    check(rows, pack(make_docs(rows)).collect())
    sizes = [int(n) for n in open(seen)]
    assert max(sizes) < 2 * 60 and sum(sizes) <= 3 * 900
