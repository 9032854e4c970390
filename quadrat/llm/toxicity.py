"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k | x) = sigmoid(theta_k - w.x): one weight vector is shared by all thresholds
theta_0 < theta_1 < ..., and the prediction is the expected grade. Features are the
presence of words and of word beginnings, chosen for their association with the grades.

The labels only say toxic or not, so grades are drawn from them and the labelled texts:
0 is not toxic; a toxic text is grade 1, or grade 2 if it holds more distinct indicative
words than the median toxic text. Indicative words occur in labelled texts of which
nearly all are toxic.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, the lowest hashes
of doc_id); every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE = 4_000
FEATURES = 4096
PREFIXES = (3, 4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
CACHED = 60_000


def word_features(word: str) -> list[str]:
    """The word and its beginnings of a few lengths."""
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature, and the thresholds in ascending order."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a column for each threshold."""
        return _sigmoid(scores[:, None] - np.array(self.thresholds)[None, :])

    def scorer(self):
        """A function from texts to scores, with a bounded memory of words."""
        weights = self.weights
        known: dict[str, tuple[str, ...]] = {}

        def scores(texts) -> np.ndarray:
            out = np.zeros(len(texts))
            if len(known) > CACHED:
                known.clear()
            for i, text in enumerate(texts):
                found = set()
                for w in text_words(text):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = tuple(f for f in word_features(w) if f in weights)
                    if got:
                        found.update(got)
                out[i] = sum(weights[f] for f in sorted(found))
            return out

        return scores


@dataclass(frozen=True)
class Corpus:
    """The sample in numbers: for each text the ids of its distinct words and features (flat, with lengths)."""

    names: list[str]
    features_of: list[np.ndarray]
    words: np.ndarray
    word_counts: np.ndarray
    features: np.ndarray
    feature_counts: np.ndarray


def numbered(words: Iterable[set[str]]) -> Corpus:
    """Numbers words and features in order of their first use; words of a text are taken in sorted order."""
    word_ids: dict[str, int] = {}
    ids: dict[str, int] = {}
    features_of: list[np.ndarray] = []
    flat, lengths, per_text, counts = [], [], [], []
    for found in words:
        own = []
        for w in sorted(found):
            k = word_ids.get(w)
            if k is None:
                k = word_ids[w] = len(features_of)
                features_of.append(np.array([ids.setdefault(f, len(ids)) for f in word_features(w)], np.int32))
            own.append(k)
        flat.append(np.array(own, np.int32))
        lengths.append(len(own))
        every = np.unique(np.concatenate([features_of[k] for k in own])) if own else np.zeros(0, np.int32)
        per_text.append(every)
        counts.append(len(every))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return Corpus(list(ids), features_of, join(flat), np.array(lengths, np.int64), join(per_text), np.array(counts, np.int64))


def _totals(corpus: Corpus, chosen: np.ndarray) -> np.ndarray:
    """In how many of the chosen texts each feature occurs."""
    return np.bincount(corpus.features[np.repeat(chosen, corpus.feature_counts)], minlength=len(corpus.names))


def draw_grades(corpus: Corpus, toxic: np.ndarray, least: int = 5, purity: float = 0.98) -> np.ndarray:
    """Grades 0, 1 and 2 as said above; only 0 and 1 if no word is indicative."""
    bad = _totals(corpus, toxic == 1)
    telling = (bad >= least) & (bad >= purity * _totals(corpus, toxic >= 0))
    word_tells = np.array([telling[f].any() for f in corpus.features_of], bool)
    text_of = np.repeat(np.arange(len(toxic)), corpus.word_counts)
    hits = np.bincount(text_of, word_tells[corpus.words], len(toxic)) if len(corpus.words) else np.zeros(len(toxic))
    median = np.median(hits[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 1, 1 + (hits > median), 0)


def choose_features(corpus: Corpus, grades: np.ndarray, most: int = FEATURES, least: int = 5) -> list[int]:
    """Up to ``most`` features of largest |z| in a comparison of their rates among grade 0 and above; ties by name."""
    n1 = max(int((grades > 0).sum()), 1)
    n0 = max(len(grades) - n1, 1)
    high, low = _totals(corpus, grades > 0), _totals(corpus, grades == 0)
    p = (high + low) / (n0 + n1)
    z = np.abs(high / n1 - low / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    good = np.flatnonzero((high + low >= least) & (z > 4))
    return sorted(good.tolist(), key=lambda i: (-z[i], corpus.names[i]))[:most]


def fit(texts: list[str | None], toxic: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> OrdinalModel:
    """Fits by full-gradient steps with momentum (Adam) on the mean log-likelihood with a ridge penalty."""
    corpus = numbered(map(text_words, texts))
    return fit_grades(corpus, draw_grades(corpus, np.asarray(toxic)), rounds, ridge)


def fit_grades(corpus: Corpus, grades: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> OrdinalModel:
    """``grades``: 0 to K. The first threshold is free, each further one adds exp(step), so they stay ordered."""
    top = int(grades.max()) if len(grades) else 0
    if top == 0:
        return OrdinalModel({}, (20.0,))
    chosen = choose_features(corpus, grades)
    place = np.full(len(corpus.names), -1)
    place[chosen] = np.arange(len(chosen))
    col = place[corpus.features]
    row = np.repeat(np.arange(len(grades)), corpus.feature_counts)[col >= 0]
    col = col[col >= 0]
    n, m = len(grades), len(chosen)
    w, free = np.zeros(m), np.concatenate(([2.0], np.zeros(top - 1)))
    state = [np.zeros(m + top), np.zeros(m + top)]
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
        score = np.bincount(row, w[col], n) if m else np.zeros(n)
        upper = np.concatenate((theta, [np.inf]))[grades]
        lower = np.concatenate(([-np.inf], theta))[grades]
        su, sl = _sigmoid(upper - score), _sigmoid(lower - score)
        p = np.maximum(su - sl, 1e-12)
        du, dl = su * (1 - su), sl * (1 - sl)
        dscore = (du - dl) / p / n
        dtheta = np.zeros(top + 2)
        np.add.at(dtheta, grades + 1, -du / p / n)
        np.add.at(dtheta, grades, dl / p / n)
        dtheta = dtheta[1 : top + 1]
        dfree = np.cumsum(dtheta[::-1])[::-1] * np.concatenate(([1.0], np.exp(free[1:])))
        dw = (np.bincount(col, dscore[row], m) if m else np.zeros(0)) + ridge * w
        g = np.concatenate((dw, dfree))
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = 0.05 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w, free = w - move[:m], free - move[m:]
    theta = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
    kept = {corpus.names[f]: float(w[i]) for i, f in enumerate(chosen) if abs(w[i]) > 1e-6}
    return OrdinalModel(kept, tuple(map(float, theta)))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> pd.DataFrame:
    """(text, toxic) of up to ``most`` labelled documents, those of the lowest hash of doc_id."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").toPandas()


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> OrdinalModel:
    """The model of a bounded labelled sample. Without toxic labels every text gets grade 0."""
    rows = labelled_sample(docs, labels, most)
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy(dtype=int))


def severity(model: OrdinalModel, text: Column) -> Column:
    """struct(severity, p_toxic): the expected grade and P(grade >= 1). Null and empty texts hold no feature."""

    @F.pandas_udf("severity double, p_toxic double")
    def score(texts: pd.Series) -> pd.DataFrame:
        p = model.probabilities(model.scorer()(texts.tolist()))
        return pd.DataFrame({"severity": p.sum(axis=1), "p_toxic": p[:, 0]})

    return score(text)


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic and toxic of every document; repeated rows alike."""
    scored = small_batches(docs).select("doc_id", severity(train(docs, labels), F.col("text")).alias("s"))
    return scored.select("doc_id", "s.severity", "s.p_toxic", (F.col("s.p_toxic") >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are more likely not toxic; all columns as they are."""
    return small_batches(docs).where(severity(train(docs, labels), F.col("text"))["p_toxic"] < threshold)
