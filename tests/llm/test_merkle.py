import hashlib
import zlib
from collections import defaultdict

import pytest

from friction.llm import merkle
from friction.llm.merkle import FIELDS, manifest_check


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def built(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 3 * 3
        out.append((nodes[a:i], nodes[i + 1 : a + 3]))
        i //= 3
    return out


def slow(rows):
    """The manifest of rows (doc_id, source, lang, n_chars, text), with lists."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        now = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            now = text.replace("\n", "")
        head = "".join(map(field, (doc_id, source, lang, n_chars)))
        by[source].append((digest(head, field(text)), digest(head, field(now)), doc_id))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for leaves in by.values():
        leaves.sort(key=lambda x: (x[2] is None, x[2] or 0, x[0]))
    trees = {s: built([x[0] for x in by[s]]) for s in order}
    top, out = built([trees[s][-1][0] for s in order]), []
    for j, s in enumerate(order):
        for i, (leaf, now, doc_id) in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, j)
            for before, after in steps:
                now = digest(*before, now, *after)
            root = top[-1][0]
            out.append((doc_id, leaf, trees[s][-1][0], root, digest(*[x for a, b in steps for x in a + b]), now, now == root))
    return sorted(out, key=str)


def got(docs):
    return sorted(map(tuple, manifest_check(docs).collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select(*FIELDS).collect()]


@pytest.fixture()
def narrow(monkeypatch):
    """Ranges of few rows, so that a source spans several."""
    monkeypatch.setattr(merkle, "RANGE", 40)


def test_equals_a_slow_version_over_odd_rows(make_docs, odd_rows, narrow):
    docs = make_docs(odd_rows + [(500 + i, f"line {i}\nline\n{i}", "en", f"source {i % 40}") for i in range(80)] + [(900, "once\nmore", "en", "b")] * 100)
    result = got(docs)
    assert result == slow(rows_of(docs))
    assert {r[-1] for r in result} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 27, 28])
def test_trees_of_any_size(make_docs, n):
    docs = make_docs([(i, f"text\n{i}", None, "a") for i in range(n)])
    assert got(docs) == slow(rows_of(docs))


def test_sources_alone(make_docs):
    docs = make_docs([(i, None if i % 2 else "a\nb", "en", None if i == 3 else ["Z", "a", "é", "￿", "𐀀"][i]) for i in range(5)])
    assert got(docs) == slow(rows_of(docs))


def test_repeated_rows(make_docs, repeats, narrow):
    docs = make_docs(repeats)
    assert got(docs) == slow(rows_of(docs))


def test_tampered_rows_are_found(spark, make_docs):
    docs = make_docs([(i, f"some\ntext {i}" if i % 3 else f"text {i}", "en", "a") for i in range(60)])
    for r in got(docs):
        changed = r[0] % 3 != 0 and zlib.crc32(str(r[0]).encode()) % 2 == 0
        assert r[-1] != changed
