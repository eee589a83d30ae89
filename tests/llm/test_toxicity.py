import random

import numpy as np

from friction.llm.common import read_table
from friction.llm.toxicity import Chain, drop_toxic, fit, fit_chain, toxicity

#: What a chain learns of the 29 toxic documents of the small tables, at least.
RECALL, PRECISION = 0.5, 0.7


def test_held_out_accuracy(spark, sf):
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    learn, rest = labels.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 = 1")
    got = toxicity(docs, learn).join(rest.select("doc_id", (rest.toxic == 1).alias("gold")), "doc_id").collect()
    # 29 toxic documents in four languages to learn from; on the check tables, with 1,600 of them, 5,126 of 5,128 are right
    assert sum(r.toxic == r.gold for r in got) / len(got) > 0.92
    caught, rejected = sum(r.toxic and r.gold for r in got), sum(r.toxic for r in got)
    assert caught >= RECALL * sum(r.gold for r in got) and caught >= PRECISION * rejected
    clean = [r for r in got if not r.gold]
    assert sum(r.toxic for r in clean) <= 0.04 * len(clean)


def test_odd_rows(spark, make_docs, odd_rows):
    rnd = random.Random(2)
    more = [(1000 + i, " ".join(rnd.choices("red green blue grey".split(), k=8)) + (" vilest" if i % 4 == 0 else ""), "en", "a") for i in range(400)]
    docs = make_docs(odd_rows + more)
    labels = spark.createDataFrame([(1000 + i, i % 2, int(i % 4 == 0)) for i in range(300)] + [(1, None, None), (None, 1, 1), (1001, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == len({r[0] for r in odd_rows + more})
    assert all(got[1000 + i].toxic == (i % 4 == 0) for i in range(400))
    assert not any(got[i].toxic for i in (1, 2, 3, 4, 8))
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows) + 300


def test_no_labels_or_documents(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in toxicity(make_docs(odd_rows), none).collect())
    one = spark.createDataFrame([(20, 1, 0)], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in toxicity(make_docs(odd_rows), one).collect())
    assert toxicity(make_docs([]), one).count() == 0


def test_later_models_learn_from_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2, 600)
    rows = [[int(x)] for x in a]
    y = np.stack([a, a], 1).astype(float)
    chain = fit_chain(Chain(["one", "two"], {"f0": 0, "f1": 1}), rows, y, np.arange(600) % 4)
    assert len(chain.weights[0]) == 3 and len(chain.weights[1]) == 4
    assert chain.weights[1][2] > 1  # the earlier category's probability counts
    assert ((chain.predict(rows) > 0.5) == y).all()


def slow_fit(x, y, rounds=80):
    """The penalised regression of fit_linear() with whole matrices and one loop."""
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) + 1e-4 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def test_a_chain_equals_a_slow_one():
    """Dense matrices, fold by fold: the later model is fitted on probabilities of models that did not see the row."""
    rng = np.random.default_rng(4)
    rows = [sorted(rng.choice(12, rng.integers(1, 6), replace=False).tolist()) for _ in range(300)]
    y = np.stack([[float(0 in r) for r in rows], [float(0 in r and 1 in r or 5 in r) for r in rows], rng.integers(0, 2, 300).astype(float)], 1)
    fold = rng.integers(0, 4, 300)
    chain = fit_chain(Chain(["a", "b", "c"], {f"f{i}": i for i in range(12)}), rows, y, fold)
    x = np.zeros((300, 12))
    for i, r in enumerate(rows):
        x[i, r] = 1
    earlier, whole, p = np.zeros((300, 0)), [], np.zeros((300, 0))
    for k in range(3):
        dense = np.column_stack([x, earlier, np.ones(300)])
        whole.append(slow_fit(dense, y[:, k]))
        p = np.column_stack([p, 1 / (1 + np.exp(-np.column_stack([x, p, np.ones(300)]) @ whole[k]))])
        out = np.zeros(300)
        for f in range(4):
            out[fold == f] = 1 / (1 + np.exp(-dense[fold == f] @ slow_fit(dense[fold != f], y[fold != f, k])))
        earlier = np.column_stack([earlier, out])
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(chain.weights, whole))
    assert np.allclose(chain.predict(rows), p, atol=1e-6)


def test_a_repeated_id_is_one_labelled_document(spark):
    docs = spark.range(30_000).selectExpr("id % 10 doc_id", "concat('text ', id) text")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    assert toxicity(docs, labels).count() == 30_000
    chain = fit(docs, labels, folds=2)
    assert len(chain.names) == 3


def test_drop_toxic_with_repeats_and_clashing_columns(spark, make_docs, repeats, rows_of):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(repeats)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and rows_of(kept) == rows_of(docs)
    assert drop_toxic(make_docs([]), labels).count() == 0
