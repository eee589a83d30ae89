import hashlib
import re
from collections import defaultdict

from friction.llm.common import read_table
from friction.llm.exact_dedup import drop_copies, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for i, t, *_ in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(make_docs, odd_rows):
    got = exact_dedup(make_docs(odd_rows).repartition(7), fan=2)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(odd_rows)


def test_a_group_of_a_third_of_all_rows(make_docs):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i // 2}", "en", "a") for i in range(3000)]
    assert sorted(map(tuple, exact_dedup(make_docs(rows).repartition(40)).collect()), key=str) == brute(rows)


def test_empty(make_docs):
    assert exact_dedup(make_docs([])).count() == 0


def test_drop_copies_keeps_columns_and_one_of_each(spark, sf):
    docs = read_table(spark, sf, "documents")
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == exact_dedup(docs).where("kept").count() < docs.count()


def test_drop_copies_decides_by_row(make_docs, repeats, rows_of):
    docs = make_docs(repeats)
    kept = drop_copies(docs.repartition(5), fan=2)
    assert kept.columns == docs.columns
    want = [(1, "T " * 9), (2, "the one U text"), (3, "V and more"), (4, ""), (None, "of no id")]
    assert rows_of(kept) == sorted(want, key=str)
    assert drop_copies(make_docs([])).count() == 0
