"""Toxicity by classifier chains.

Categories are predicted one after the other; a later linear model sees the probabilities of the earlier ones. Those it
learns from are out-of-fold: each labelled document gets them from models fitted without its fold. The labels come from
a bounded sample of labelled documents. Features are words and word beginnings that a distributed count over the sample
finds to depend on a category, so the fitted model has a fixed size.
"""

from __future__ import annotations

import math
import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from friction.llm.common import row_of, written

#: Bounds and defaults of fit(): labelled documents, features, folds; a feature's least chi-square and part of the labelled
#: documents (three at least). REJECT: the probability that rejects.
LABELLED, FEATURES, FOLDS, LEAST, PART, REJECT = 12_000, 2048, 4, 15.0, 0.001, 0.5
WORD = re.compile(r"[^\W\d_]+")


def categories() -> dict[str, Column]:
    return {
        "low_quality": F.col("quality") == 0,
        "toxic": F.col("toxic") == 1,
        "toxic_low_quality": (F.col("toxic") == 1) & (F.col("quality") == 0),
    }


def parts(word: str) -> tuple[str, ...]:
    """A word and its beginnings of 4 to 6 letters."""
    return (word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k))


@dataclass
class Chain:
    names: list[str]
    index: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)  # features, earlier probabilities, bias
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def features(self, text: str | None) -> list[int]:
        """Numbers of the features that a text holds."""
        if len(self.seen) > 500_000:
            self.seen.clear()
        got: set[int] = set()
        for w in set(WORD.findall(text.lower())) if text else ():
            f = self.seen.get(w)
            if f is None:
                f = self.seen[w] = tuple(i for p in parts(w) if (i := self.index.get(p)) is not None)
            if f:
                got.update(f)
        return sorted(got)

    def predict(self, rows: list[list[int]]) -> np.ndarray:
        """Rows by categories."""
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.array([i for r in rows for i in r], np.int64)
        p = np.zeros((len(rows), 0))
        for w in self.weights:
            p = np.column_stack([p, proba(w, row, col, p, len(self.index))])
        return p


def proba(w: np.ndarray, row: np.ndarray, col: np.ndarray, earlier: np.ndarray, n: int) -> np.ndarray:
    z = np.bincount(row, w[col], len(earlier)) + earlier @ w[n:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(row: np.ndarray, col: np.ndarray, earlier: np.ndarray, y: np.ndarray, n: int, rounds: int = 80) -> np.ndarray:
    """Logistic regression with an L2 penalty, both classes of equal weight, by Adam over all rows."""
    w, first, second = np.zeros(n + earlier.shape[1] + 1), 0.0, 0.0
    pos = y.sum()
    if pos == 0 or pos == len(y):
        w[-1] = math.log((pos + 0.5) / (len(y) - pos + 0.5))
        return w
    weight = np.where(y == 1, 0.5 / pos, 0.5 / (len(y) - pos))
    for t in range(1, rounds + 1):
        miss = (proba(w, row, col, earlier, n) - y) * weight
        g = np.concatenate([np.bincount(col, miss[row], n), earlier.T @ miss, [miss.sum()]]) + 1e-4 * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - 0.2 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return w


def fit_chain(chain: Chain, rows: list[list[int]], y: np.ndarray, fold: np.ndarray) -> Chain:
    """Fit the models in order. Each sees out-of-fold probabilities of the categories before it."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], np.int64)
    n, earlier = len(chain.index), np.zeros((len(rows), 0))

    def part(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.cumsum(keep) - 1
        return new[row[keep[row]]], col[keep[row]]

    for k in range(y.shape[1]):
        chain.weights.append(fit_linear(row, col, earlier, y[:, k], n))
        out = np.zeros(len(rows))
        for f in np.unique(fold):
            learn, rest = fold != f, fold == f
            w = fit_linear(*part(learn), earlier[learn], y[learn, k], n)
            out[rest] = proba(w, *part(rest), earlier[rest], n)
        earlier = np.column_stack([earlier, out])
    return chain


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, features: int = FEATURES, folds: int = FOLDS, least: float = LEAST, part: float = PART) -> Chain:
    """A chain fitted on at most `labelled` labelled documents, chosen by a hash of doc_id, with at most `features` words and
    word beginnings: those whose chi-square with a category is at least `least`, and which are in `part` of the documents.

    An id that several rows have is one document, with the smallest of their texts, so `labelled` bounds the rows too."""
    named = categories()
    y = [F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in named.items()]
    sample = labels.where("doc_id is not null").groupBy("doc_id").agg(*y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", *named).agg(F.min("text").alias("text"))
    joined = written(texts, "labelled")
    names = list(named)
    n_y = ", ".join(f"{k} long" for k in names)

    def count(batches):
        """Documents that hold each feature, in all and of each category: one row a feature and task."""
        counts: dict[str, np.ndarray] = {}
        for pdf in batches:
            for text, *cats in pdf[["text", *names]].itertuples(index=False, name=None):
                one = np.array([1, *cats])
                for p in {p for w in set(WORD.findall(text.lower())) for p in parts(w)} if text else ():
                    if p in counts:
                        counts[p] += one
                    else:
                        counts[p] = one.copy()
        keys = list(counts)
        for a in range(0, len(keys), 50_000):
            k = keys[a : a + 50_000]
            yield pd.DataFrame(np.array([counts[x] for x in k]), columns=["n", *names]).assign(feature=k)

    found = joined.mapInPandas(count, f"n long, {n_y}, feature string").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ["n", *names]])
    base = joined.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    total, chi = base["n"], []
    for c in names:
        pos = base[c] or 0
        if 0 < pos < total:
            off = F.abs(F.col(c) * F.lit(float(total)) - F.col("n") * F.lit(float(pos))) - F.lit(total / 2.0)
            off = F.greatest(off, F.lit(0.0))
            chi.append(off * off * total / (F.col("n") * (F.lit(total) - F.col("n") + F.lit(1)) * F.lit(float(pos) * (total - pos))))
    if not chi:
        return fit_chain(Chain(names, {}), [[] for _ in range(total)], np.array([[(base[c] or 0) > 0 for c in names]] * total, float).reshape(total, len(names)), np.arange(total) % folds) if total else Chain(names, {}, [np.array([0.0] * k + [-30.0]) for k in range(len(names))])
    best = found.withColumn("chi", F.greatest(*chi) if len(chi) > 1 else chi[0]).where((F.col("chi") >= least) & (F.col("n") >= max(3.0, part * total)))
    best = [r["feature"] for r in best.orderBy(F.desc("chi"), "feature").limit(features).select("feature").collect()]
    chain = Chain(names, {f: i for i, f in enumerate(sorted(best))})
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain))

    def rows(batches):
        chain = pickle.loads(packed.value)
        for pdf in batches:
            yield pdf[["doc_id", *names]].assign(held=[chain.features(t) for t in pdf["text"]])

    got = sorted(tuple(r) for r in joined.mapInPandas(rows, f"doc_id long, {n_y}, held array<int>").collect())
    y = np.array([r[1 : 1 + len(names)] for r in got], float)
    return fit_chain(chain, [list(r[-1]) for r in got], y, np.array([r[0] % folds for r in got]))


def scores(docs: DataFrame, chain: Chain):
    """A struct of p_<category> for each category, of the column text."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain))
    names = chain.names

    @F.pandas_udf(", ".join(f"p_{k} double" for k in names))
    def run(batches: pd.Series) -> pd.DataFrame:
        global _CHAIN
        if _CHAIN[0] is not packed.value:
            _CHAIN = (packed.value, pickle.loads(packed.value))
        return pd.DataFrame(_CHAIN[1].predict([_CHAIN[1].features(t) for t in batches]), columns=[f"p_{k}" for k in names])

    return run("text")


_CHAIN: tuple = (None, None)


def toxicity(docs: DataFrame, labels: DataFrame, reject: float = REJECT, **bounds) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, p_toxic_low_quality, toxic: one row for each row of docs (doc_id, text; others
    ignored). labels: doc_id, quality, toxic; rows with a null in one of them count as not of the category. bounds: of fit().

    toxic: p_toxic is `reject` or more. Null and empty texts hold no feature: all but the bias and the chain is 0. Whole
    texts count, each feature once. Without labelled documents every probability is about 0. Repeated rows get equal
    results; a doc_id labelled twice is of a category if one label says so. An empty table gives an empty result."""
    p = scores(docs, fit(docs, labels, **bounds))
    return docs.select("doc_id", p.alias("p")).select("doc_id", "p.*").withColumn("toxic", F.col("p_toxic") >= reject)


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT, **bounds) -> DataFrame:
    """docs (doc_id, text; all columns kept) without the rows that toxicity() finds toxic; none is moved.

    Null and empty texts stay, equal rows share their fate, an empty table gives an empty result. Columns may have any names."""
    p = scores(docs, fit(docs, labels, **bounds))
    return row_of(docs, [p]).where(F.col("k0.p_toxic") < reject).select("row.*")
