import random

import pytest

#: Names that operators use inside: documents may have columns of the same names.
EXTRA = "size, run, key, fp, n, node, p, v, shard, slot, rank, block, copy, piece, length, words, held, mid, sha, spread, of, low, row, k0, gone_k0, gone_id, copies, held_out, nth, one_stays, _chain_scores, print, fingerprint"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA.split(", "))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text, lang, source) as documents that also have clashing columns."""

    def make(rows):
        extra = (None,) * len(EXTRA.split(", "))
        return spark.createDataFrame([(i, t, lang, s, len(t or ""), *extra) for i, t, lang, s in rows], DOCUMENT)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    long = " ".join(word() for _ in range(60_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, long, "en", "b"), (5, long, "en", None), (None, "the null id", "en", "a")]
    rows += [(6, "one word twice", "en", "a"), (6, "one word twice", "en", "a"), (7, "one  word\ntwice", "de", "c"), (8, "1234 !!! 5", "en", "a"), (9, "x" * 30_000, "en", "c"), (10, "Éà ñ ß", None, "é"), (12, "a run" + " \n" * 600_000 + "of blanks\t", "en", "b")]
    rows += [(20 + i, " ".join(word() for _ in range(rnd.randint(1, 60))), rnd.choice(["en", "de"]), rnd.choice(["a", "b", "z"])) for i in range(150)]
    return rows


#: One id with two texts, equal rows, copies without an id.
REPEATS = [(1, "T " * 9, "en", "a"), (2, "T " * 9, "en", "a"), (2, "the one U text", "en", "a"), (3, "V and more", "de", "b"), (3, "V and more", "de", "b"), (None, "T " * 9, "en", "a"), (None, None, None, None), (None, "of no id", "en", None), (4, "", "en", "a")]


@pytest.fixture(scope="session")
def repeats():
    return REPEATS


@pytest.fixture(scope="session")
def rows_of():
    """(doc_id, text) of a result, in order."""
    return lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
