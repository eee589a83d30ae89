import itertools
import random
import zlib

import numpy as np
import pytest

from friction.llm.common import read_table
from friction.llm import language_id
from friction.llm.language_id import fit, identify, marginals_of_chains, predict, sums_of_marginals, training_sample, words_of


@pytest.fixture(scope="module")
def data(spark, sf):
    docs = read_table(spark, sf, "documents")
    model = fit(*training_sample(docs))
    return docs, model, [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(data):
    docs, model, rows = data
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    rest = [(got[i], lang) for i, t, lang in rows if held_out(i)]
    assert all(got[i].held_out == held_out(i) for i, *_ in rows)
    assert sum(r.lang_pred == lang for r, lang in rest) / len(rest) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_words_of_switched_texts(data):
    """Word marginals of texts spliced from held-out spans of two languages."""
    _, model, rows = data
    rnd, right, total = random.Random(1), 0, 0
    by = {}
    for i, t, lang in rows:
        if held_out(i):
            by.setdefault(lang, []).extend(t.split()[:60])
    for _ in range(20):
        a, b = rnd.sample(sorted(by), 2)
        i, j = rnd.randrange(len(by[a]) - 30), rnd.randrange(len(by[b]) - 30)
        w = words_of([" ".join(by[a][i : i + 30]).lower() + " | " + " ".join(by[b][j : j + 30]).lower()])
        first = len(words_of([" ".join(by[a][i : i + 30]).lower()]).text)
        m, _ = marginals_of_chains(model.scores(w)[None].astype(float), model.transitions)
        gold = np.where(np.arange(len(w.text)) < first, model.labels.index(a), model.labels.index(b))
        right, total = right + (m[0].argmax(1) == gold).sum(), total + len(gold)
    assert right / total > 0.9


def test_training_rows_are_not_held_out(data):
    docs, _, rows = data
    texts, langs = training_sample(docs)
    allowed = {(t, lang) for i, t, lang in rows if not held_out(i)}
    assert texts and set(zip(texts, langs)) <= allowed


def test_blocks_equal_enumeration():
    rng = np.random.default_rng(0)
    trans = rng.normal(size=(2, 2))
    for n in (1, 2, 7):
        e = rng.normal(size=(n, 2))
        want, total = np.zeros(2), 0.0
        for y in itertools.product(range(2), repeat=n):
            p = np.exp(sum(e[i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += p
            want += p * np.bincount(y, minlength=2)
        assert np.allclose(sums_of_marginals(e, np.zeros(n, int), 1, trans)[0], want / total)


def test_blocks_equal_the_plain_recursion():
    rng = np.random.default_rng(1)
    lengths = [1, 32, 33, 64, 0, 200, 31, 97]
    e, trans = rng.normal(size=(sum(lengths), 3)) * 3, rng.normal(size=(3, 3))
    got = sums_of_marginals(e, np.repeat(np.arange(len(lengths)), lengths), len(lengths), trans)
    at = 0
    for i, n in enumerate(lengths):
        want = marginals_of_chains(e[None, at : at + n], trans)[0][0].sum(0) if n else np.zeros(3)
        assert np.allclose(got[i], want)
        at += n


def test_words_and_features_do_not_depend_on_neighbours():
    one, two = words_of(["naïve über-cool"]), words_of(["x", "naïve über-cool", ""])
    assert one.text.tolist() == [0, 0, 0] and two.text.tolist() == [0, 1, 1, 1]
    assert (two.hash[1:] == one.hash).all() and (two.affixes[1:] == one.affixes).all()
    assert (two.grams[two.at[1] :] == one.grams).all()


def test_odd_rows(make_docs, odd_rows, data):
    got = {r.doc_id: r for r in identify(make_docs(odd_rows), data[1]).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1, 2, 3, 8))
    assert got[4].words == 60_000 and got[9].words == 1
    assert not got[None].held_out
    assert identify(make_docs([])).count() == 0
    assert {r.lang_pred for r in identify(make_docs([(1, "abc", None, None)])).collect()} == {"und"}
    assert identify(make_docs(odd_rows)).count() == len(odd_rows)


def test_long_texts_are_scored_in_pieces_like_whole_ones(data, monkeypatch):
    texts = [t for _, t, _ in data[2][:30]] + ["a" * 3000, None]
    want = predict(data[1], texts)
    monkeypatch.setattr("friction.llm.language_id.CHARS", 700)
    for a, b in zip(predict(data[1], texts), want):
        assert a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-5


def test_every_language_is_learned(make_docs):
    """Forty languages, each of its own letters; the rarest are beyond the 32 most frequent."""
    def text(k, i):
        rnd = random.Random(k * 1000 + i)
        return " ".join("".join(rnd.choice([chr(0x4E00 + 12 * k + c) for c in range(12)]) for _ in range(4)) for _ in range(12))

    rows = [(k * 100 + i, text(k, i), f"l{k:02}", "a") for k in range(40) for i in range(60 - k)]
    got = {r.doc_id: r.lang_pred for r in identify(make_docs(rows)).collect()}
    right = [(lang, got[i] == lang) for i, _, lang, _ in rows if held_out(i)]
    assert sum(ok for _, ok in right) > 0.95 * len(right)
    assert {lang for lang, ok in right if ok} == {lang for lang, _ in right}


def test_one_long_text_is_not_its_whole_language(make_docs):
    ids = [i for i in range(200) if not held_out(i)][:60]
    rows = [(i, " ".join(f"{'abcdefghij'[n % 10]}{'klmnopqrst'[i % 10]}{'uvwxyz'[i // 10 % 6]}" for n in range(200 if k else 40_000)), "en", "a") for k, i in enumerate(ids)]
    texts, langs = language_id.training_spans(make_docs(rows))
    assert len(texts) == len(langs) == 60 and max(len(t.split()) for t in texts) <= 2 * language_id.WORDS // 60
    whole = [t for _, t, *_ in rows]
    w = words_of(whole)
    used = language_id.spread(np.arange(len(w.text)), w.text, language_id.WORDS)
    assert len(np.unique(w.text[used])) == 60 and len(used) <= language_id.WORDS


def test_spans_are_of_rows_that_are_not_held_out_and_learn_as_well(data):
    docs, _, rows = data
    texts, langs = language_id.training_spans(docs)
    allowed = {}
    for i, t, lang in rows:
        if not held_out(i) and t:
            allowed.setdefault(lang, []).append(" ".join(t.split()))
    assert all(any(t.strip() in x for x in allowed[lang]) for t, lang in zip(texts, langs))
    rest = [(t, lang) for i, t, lang in rows if held_out(i) and t]
    got = predict(fit(texts, langs), [t for t, _ in rest])
    assert sum(g[0] == lang for g, (_, lang) in zip(got, rest)) / len(rest) > 0.97


def test_the_sample_of_a_repeated_id_is_bounded(spark):
    """100,000 equal rows are one; of 100,000 rows of one id as few are sampled as of any."""
    free = next(i for i in range(100) if not held_out(i))
    ids = [i for i in range(2000) if not held_out(i)][:400]
    rows = spark.createDataFrame([(i, f"word{i} and others", "en") for i in ids], "doc_id long, text string, lang string")
    same = spark.range(100_000).selectExpr(f"cast({free} as long) doc_id", "'the same text' text", "'en' lang")
    own = spark.range(100_000).selectExpr(f"cast({free} as long) doc_id", "concat('id', id, ' of one id') text", "'de' lang")
    texts, langs = language_id.training_spans(rows.unionByName(same).unionByName(own))
    assert texts.count("the same text") <= 1 and langs.count("de") < 2 * language_id.DOCS and langs.count("en") > 200


def test_ids_beyond_floating_point_stay(make_docs):
    rows = [(2**53 + 1, "one text", "en", "a"), (None, "no id", "en", "a")]
    assert {r.doc_id for r in identify(make_docs(rows)).collect()} == {2**53 + 1, None}
