"""Language identification by a linear-chain conditional random field over words.

The words of a text form a chain whose labels are languages, so a text may switch between them. A word's score for a
language sums learned weights of its affixes, of its character n-grams and of the lexicon it is in; learned transition
weights join neighbours; forward-backward gives each word's marginal. The model is fitted on the driver on a bounded
sample of labelled texts of every language, spliced into chains that switch; it is then a table that goes to every task,
whose size does not depend on the rows but grows with the number of languages.
Scores of a whole batch of texts are array operations: n-grams are hashed by position, and chains are cut into blocks
whose transfer matrices are multiplied side by side before the exact recursions run within all blocks at once.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from friction.llm.common import SPACE

#: Bounds of the sample, and parameters of training_spans() and fit(): documents and words of each language. Every language
#: is learned; beyond LANGUAGES of them all share what these have.
DOCS, WORDS, LANGUAGES = 300, 15_000, 32
FEW = 20  # texts that a language has of the sample at least, if there are as many
BITS = 18  # of the hashed feature table
BLOCK = 32  # words that one step-by-step recursion covers
CHARS = 400_000  # characters that are scored together
CHAIN = 48  # words of a training chain

_LETTER = np.zeros(0x110000, bool)


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER.any():
        for at in range(0, 0x110000, 4096):
            block = [chr(c).isalpha() for c in range(at, at + 4096)]
            _LETTER[at : at + 4096] = block
    return _LETTER


def mix(h: np.ndarray, kind: int) -> np.ndarray:
    """Feature numbers of hashes, another set of them for each kind of feature."""
    h = (h + np.uint64(kind * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Words:
    """The words of some texts: the text of each, its hash, features of the whole word, and features of its characters
    (those of word i begin at `at[i]`)."""

    text: np.ndarray
    hash: np.ndarray
    affixes: np.ndarray
    at: np.ndarray
    grams: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Runs of letters of lower-cased texts. Prefixes of 1 to 3 and suffixes of 1 to 4, 2- and 3-grams with word ends."""
    joined = "\n".join(texts)
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    c = np.concatenate(([10], c, [10, 10])).astype(np.uint64)
    is_letter = letters()[c]
    step = np.diff(is_letter.astype(np.int8))
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    bounds = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(bounds, start - 1, "right")
    c = np.where(is_letter, c, np.uint64(1))  # all word ends look alike
    p, q = np.uint64(0x100000001B3), np.uint64(0x9E3779B1)
    two = c[:-1] * q + c[1:]
    # grams at positions start-1 .. end-1: each begins at the letter or at the boundary before it
    size = end - start + 1
    at = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    place = np.repeat(start - 1 - at, size) + np.arange(int(size.sum()))
    third = np.where(is_letter[place + 1], c[place + 2], np.uint64(1))  # no gram reads beyond the word's end
    grams = np.stack([mix(two[place], 1), mix(two[place] * q + third, 2)], 1)
    length = end - start
    affixes, h = [], np.zeros(len(start), np.uint64)
    for k in range(3):
        h = np.where(length > k, (h + c[np.minimum(start + k, end - 1)]) * p, h)
        affixes.append(mix(h, 3))
    h = np.zeros(len(start), np.uint64)
    for k in range(4):
        h = np.where(length > k, (h + c[np.maximum(end - 1 - k, start)]) * p, h)
        affixes.append(mix(h, 4))
    # the whole word: a polynomial hash, summed over its letters
    inner = place - np.repeat(start, size)
    value = np.where(inner >= 0, (c[place] + np.uint64(7)) * POWERS[np.clip(inner, 0, len(POWERS) - 1)], np.uint64(0))
    whole = np.add.reduceat(value, at) if len(at) else np.zeros(0, np.uint64)
    return Words(text, whole, np.stack(affixes, 1) if len(start) else np.zeros((0, 7), np.int32), at, grams)


POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # 2**BITS by labels
    transitions: np.ndarray
    lexicon: np.ndarray  # sorted hashes of words that are one language's
    of: np.ndarray  # whose
    lexicon_weights: np.ndarray  # (labels + 1) by labels; the last row: in no lexicon

    def entries(self, w: Words) -> np.ndarray:
        """The language in whose lexicon each word is, or the number of languages."""
        if not len(self.lexicon):
            return np.full(len(w.hash), len(self.labels))
        i = np.minimum(np.searchsorted(self.lexicon, w.hash), len(self.lexicon) - 1)
        return np.where(self.lexicon[i] == w.hash, self.of[i], len(self.labels))

    def scores(self, w: Words) -> np.ndarray:
        """Words by labels."""
        out = np.zeros((len(w.text), len(self.labels)), np.float32)
        if not len(out):
            return out
        grams = self.weights[w.grams[:, 0]] + self.weights[w.grams[:, 1]]
        np.add.reduceat(grams, w.at, axis=0, out=out)
        for k in range(w.affixes.shape[1]):
            out += self.weights[w.affixes[:, k]]
        return out + self.lexicon_weights[self.entries(w)]


def marginals_of_chains(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of chains of equal length (chains, words, labels), and the expected counts of transitions."""
    e = np.exp(scores - scores.max(-1, keepdims=True))
    a = np.exp(transitions)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(-1, keepdims=True)
    for t in range(1, e.shape[1]):
        x = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = x / x.sum(-1, keepdims=True)
    for t in range(e.shape[1] - 2, -1, -1):
        x = (e[:, t + 1] * beta[:, t + 1]) @ a.T
        beta[:, t] = x / x.sum(-1, keepdims=True)
    m = alpha * beta
    pair = np.einsum("stk,kl,stl->stkl", alpha[:, :-1], a, e[:, 1:] * beta[:, 1:])
    pair /= pair.sum((-1, -2), keepdims=True)
    return m / m.sum(-1, keepdims=True), pair.sum((0, 1))


def share_of_words(languages: int, words: int = WORDS) -> int:
    """Words of each language in the sample."""
    return max(CHAIN, min(words, words * LANGUAGES // max(1, languages)))


def spread(mine: np.ndarray, text: np.ndarray, words: int) -> np.ndarray:
    """At most about `words` of a language's word numbers (ascending): of each text the same number from its begin on, or
    all it has."""
    if len(mine) <= words:
        return mine
    _, first, which, count = np.unique(text[mine], return_index=True, return_inverse=True, return_counts=True)
    low, high = 1, int(count.max())
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if np.minimum(count, mid).sum() <= words else (low, mid - 1)
    return mine[np.arange(len(mine)) - first[which] < low][: max(words, len(count))]


def fit(texts: list[str], langs: list[str], rounds: int = 40, seed: int = 7, words: int = WORDS) -> Model | None:
    """A model of share_of_words() words of each language, spread over all its texts. Chains splice spans of several texts:
    that is where transitions between languages are learned."""
    labels = sorted(set(langs))
    if not labels:
        return None
    n, rng = len(labels), np.random.default_rng(seed)
    w = words_of(texts)
    label = np.array([labels.index(x) for x in langs], np.int64)[w.text] if len(w.text) else np.zeros(0, np.int64)
    pools = [spread(np.flatnonzero(label == k), w.text, share_of_words(n, words)) for k in range(n)]
    model = Model(labels, np.zeros((2**BITS, n), np.float32), np.eye(n) * 2.0, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((n + 1, n)))
    if not sum(map(len, pools)):
        return model
    used = np.concatenate(pools)
    # lexicons: words seen at least twice, nine times in ten in one language, each language's count taken by its share
    seen, which = np.unique(w.hash[used], return_inverse=True)
    counts = np.zeros((len(seen), n))
    np.add.at(counts, (which, label[used]), 1)
    share = counts / np.maximum(1, counts.sum(0))
    sure = (counts.sum(1) >= 2) & (share.max(1) >= 0.9 * share.sum(1))
    model.lexicon, model.of = seen[sure], share[sure].argmax(1)
    there = [k for k in range(n) if len(pools[k])]
    spans = []
    while sum(map(len, spans)) < len(used):
        k = there[rng.integers(len(there))]
        length = min(len(pools[k]), int(rng.geometric(1 / 16)))
        begin = int(rng.integers(len(pools[k]) - length + 1))
        spans.append(pools[k][begin : begin + length])
    chain = np.concatenate(spans)
    chain = chain[: max(1, len(chain) // CHAIN) * CHAIN]
    chain = np.resize(chain, (max(1, len(chain) // CHAIN), CHAIN))
    flat = chain.ravel()
    size = np.diff(np.concatenate((w.at, [len(w.grams)])))[flat]
    owner = np.repeat(np.arange(len(flat)), size)
    place = np.repeat(w.at[flat] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
    feature = np.concatenate([w.affixes[flat].ravel(), w.grams[place].ravel()])
    owner = np.concatenate([np.repeat(np.arange(len(flat)), w.affixes.shape[1]), np.repeat(owner, 2)])
    known, feature = np.unique(feature, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    begins = np.searchsorted(owner, np.arange(len(flat)))
    entry = model.entries(w)[flat]
    gold = np.eye(n)[label[flat]].reshape(*chain.shape, n)
    gold_pairs = np.einsum("stk,stl->kl", gold[:, :-1], gold[:, 1:])
    params = [np.zeros((len(known), n)), model.transitions, model.lexicon_weights]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        scores = np.add.reduceat(params[0][feature], begins, axis=0) + params[2][entry]
        m, pairs = marginals_of_chains(scores.reshape(*chain.shape, n), params[1])
        miss = (m - gold).reshape(-1, n)
        grad = [np.stack([np.bincount(feature, np.repeat(miss[:, k], np.diff(np.append(begins, len(feature)))), len(known)) for k in range(n)], 1)]
        grad += [pairs - gold_pairs, np.stack([np.bincount(entry, miss[:, k], n + 1) for k in range(n)], 1)]
        for p, g, f, s in zip(params, grad, first, second):
            g += 0.5 * p
            f += 0.1 * (g - f)
            s += 0.01 * (g * g - s)
            p -= 0.1 * (f / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    model.weights[known] = params[0]
    model.transitions, model.lexicon_weights = params[1], params[2]
    return model


def sums_of_marginals(scores: np.ndarray, text: np.ndarray, texts: int, transitions: np.ndarray) -> np.ndarray:
    """For each text the sum of its words' marginals; scores: of the words of all texts in order."""
    n = scores.shape[1]
    out = np.zeros((texts, n))
    if not len(scores):
        return out
    count = np.bincount(text, minlength=texts)
    blocks = -(-count // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    block, at = first_block[text] + within // BLOCK, within % BLOCK
    e, there = np.ones((total, BLOCK, n)), np.zeros((total, BLOCK), bool)
    e[block, at] = np.exp(scores - scores.max(1, keepdims=True))
    there[block, at] = True
    a = np.exp(transitions)
    begins = np.zeros(total, bool)
    begins[first_block[blocks > 0]] = True
    norm = lambda x, axis: x / np.maximum(x.sum(axis, keepdims=True), 1e-300)
    # transfer matrix of each block; the first word of a text has no transition before it
    m = np.where(begins[:, None, None], np.eye(n), a) * e[:, 0][:, None, :]
    for t in range(1, BLOCK):
        m = np.where(there[:, t, None, None], (m @ a) * e[:, t][:, None, :], m)
        if t % 8 == 0:
            m = norm(m, (1, 2))
    m = norm(m, (1, 2))
    # vectors that enter each block from the left and from the right, text by text side by side
    left, right = np.ones((total, n)) / n, np.ones((total, n)) / n
    owner = np.repeat(np.arange(texts), blocks)
    number = np.arange(total) - first_block[owner]
    longest = int(blocks.max())
    by_number = np.argsort(number, kind="stable")
    cut = np.searchsorted(number[by_number], np.arange(longest + 1))
    for k in range(1, longest):
        i = by_number[cut[k] : cut[k + 1]]
        left[i] = norm(np.einsum("bk,bkl->bl", left[i - 1], m[i - 1]), 1)
    for k in range(longest - 1, 0, -1):
        i = by_number[cut[k] : cut[k + 1]]
        right[i - 1] = norm(np.einsum("bkl,bl->bk", m[i], right[i]), 1)
    alpha = np.empty((BLOCK, total, n))
    x = np.where(begins[:, None], e[:, 0], (left @ a) * e[:, 0])
    alpha[0] = x = norm(x, 1)
    for t in range(1, BLOCK):
        alpha[t] = x = np.where(there[:, t, None], norm((x @ a) * e[:, t], 1), x)
    # a block's right vector already holds the transition into the next block's first word
    beta, sums = right, np.zeros((total, n))
    for t in range(BLOCK - 1, -1, -1):
        sums += np.where(there[:, t, None], norm(alpha[t] * beta, 1), 0.0)
        if t:
            beta = np.where(there[:, t, None], norm((e[:, t] * beta) @ a.T, 1), beta)
    np.add.at(out, owner, sums)
    return out


def pieces(text: str):
    """A lower-cased text in pieces of about CHARS characters that end between words."""
    text = text.lower()
    at = 0
    while len(text) - at > CHARS:
        end = at + CHARS
        while end > at and text[end].isalpha() and text[end - 1].isalpha():
            end -= 1
        if end == at:  # one word longer than a piece
            end = at + CHARS
            while end < len(text) and text[end].isalpha():
                end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, int]]:
    """Language, mean marginal of it, and words, for each text; `und`, 0.0 and 0 where there is no letter."""
    out: list[tuple[str, float, int]] = []
    group: list[str] = []

    def flush(part: list[str]) -> None:
        scores, owners = [], []
        batch, owner, chars = [], [], 0
        for i, t in enumerate([*part, None]):
            for p in pieces(t) if t else ():
                batch.append(p)
                owner.append(i)
                chars += len(p)
            if chars >= CHARS or t is None and i == len(part) and batch:
                w = words_of(batch)
                scores.append(model.scores(w))
                owners.append(np.array(owner)[w.text])
                batch, owner, chars = [], [], 0
        n = len(model.labels)
        scores = np.concatenate(scores) if scores else np.zeros((0, n), np.float32)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        sums = sums_of_marginals(scores.astype(np.float64), owners, len(part), model.transitions)
        words = np.bincount(owners, minlength=len(part))
        best = sums.argmax(1)
        for k, b, s in zip(words.tolist(), best.tolist(), sums.tolist()):
            out.append((model.labels[b], min(1.0, s[b] / k), k) if k else ("und", 0.0, 0))

    chars = 0
    for t in texts:
        group.append(t or "")
        chars += len(group[-1])
        if chars >= CHARS:
            flush(group)
            group, chars = [], 0
    if group:
        flush(group)
    return out


def held_out(c) -> F.Column:
    return F.pmod(F.crc32(F.encode(c.cast("string"), "UTF-8")), F.lit(3)) == 1


def sampled(docs: DataFrame, most: int = DOCS) -> tuple[DataFrame, int]:
    """Rows doc_id, text, lang, n of about `most` texts of every language that are not held out, chosen by a hash of the id,
    the text and the language, and the number of languages. n: how many of the language are expected. Equal rows are counted
    once, and an id that many rows share has no share of its own."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    rows = rows.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text", "lang").alias("one"))
    counts = [(r["lang"], r["n"]) for r in rows.groupBy("lang", "one").count().groupBy("lang").agg(F.count("*").alias("n")).collect()]
    most = max(FEW, min(most, most * LANGUAGES // max(1, len(counts))))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, most / max(1, n)) if n > most else 1.1, min(most, max(1, n))) for lang, n in counts], "of string, share double, n long")
    u = F.pmod(F.col("one"), F.lit(2**31)) / F.lit(2.0**31)
    return rows.join(F.broadcast(shares), (F.col("lang") == F.col("of")) & (u < F.col("share"))).drop("of", "share"), len(counts)


def training_sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Whole texts and languages of the sampled documents."""
    sample = sorted((r["doc_id"], r["text"], r["lang"]) for r in sampled(docs)[0].collect())
    return [r[1] for r in sample], [r[2] for r in sample]


def training_spans(docs: DataFrame, most: int = DOCS, words_of_each: int = WORDS) -> tuple[list[str], list[str]]:
    """A span of each sampled text and its language. Spans are cut in the tasks, at a place that a hash of the row draws, and
    equal rows are combined there; they are long enough to fill the language's share of words even if half of the texts are
    short. What comes to the driver is bounded: so many spans of each language, of so many characters."""
    rows, languages = sampled(docs, most)
    rows = rows.withColumn("span", F.ceil(F.lit(2 * share_of_words(languages, words_of_each)) / F.col("n")).cast("int"))
    words = F.split(F.trim("text"), SPACE)
    start = F.pmod(F.xxhash64("one", F.lit("span")), F.greatest(F.size("words") - F.col("span") + 1, F.lit(1))).cast("int") + 1
    rows = rows.withColumn("words", words).select("lang", "one", F.expr("span * 16").alias("chars"), F.array_join(F.slice("words", start, F.col("span")), " ").alias("text"))
    rows = rows.groupBy("lang", "one").agg(F.min(F.substring("text", F.lit(1), F.col("chars"))).alias("text"))
    # the shares hold on average; this bound always
    rows = rows.orderBy("one", "lang").limit(2 * most * max(1, languages))
    sample = sorted((r["one"], r["text"], r["lang"]) for r in rows.collect())
    return [r[1] for r in sample], [r[2] for r in sample]


def identify(docs: DataFrame, model: Model | None = None, most: int = DOCS, words_of_each: int = WORDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, words: one row for each row of docs (doc_id, text, lang; others ignored).

    Without a model, one is fitted on rows that are not held out: spans of about `most` texts and `words_of_each` words of
    each language. lang is read for that alone. Texts that are null, empty or without a letter, and all texts if nothing
    could be learned, are `und` with score 0. Rows with a null doc_id are predicted, not held out, and not learned from.
    Repeated rows get equal results. An empty table gives an empty result."""
    if model is None:
        model = fit(*training_spans(docs, most, words_of_each), words=words_of_each)
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # of a size that BITS and the number of languages fix

    @F.pandas_udf("lang_pred string, score double, words long")
    def run(texts: pd.Series) -> pd.DataFrame:
        global _MODEL
        if _MODEL[0] is not packed.value:
            _MODEL = (packed.value, pickle.loads(packed.value))
        model = _MODEL[1]
        got = predict(model, texts.tolist()) if model else [("und", 0.0, 0)] * len(texts)
        return pd.DataFrame(got, columns=["lang_pred", "score", "words"])

    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), run("text").alias("found"))
    return rows.select("doc_id", "held_out", "found.*")


_MODEL: tuple = (None, None)
