"""Quality classifier: a generalised additive model with pairwise interactions.

Shape features of a whole text are put into quantile bins. Cyclic boosting visits the features in turn; each visit fits a
shallow tree of one feature to the gradient and adds a shrunken step to that feature's look-up table. Then the feature pairs
that explain most of what is left get tables of their own by the same boosting. A score is the sum of look-ups, put
through the logistic function.

The model is fitted on a bounded sample of labelled rows (FIT); scoring covers every row and the whole of every text. Defined
results: a null text counts as empty, an empty one has all features 0 and gets the score of that bin; without labels of both
kinds every score is the smoothed share of label 1; rows that repeat get the same score; very long texts have the same features; an empty
table has an empty result; of the table's columns only doc_id and text are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfield.llm.common import read
from pathfield.llm.labels import held_out, labelled_texts, training_labels

#: Labelled rows the model is fitted on, at most.
FIT = 20_000
FOLDS, FOLD = 4, 2
THRESHOLD = 0.7
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 60, 30, 6
RATE, REGULAR = 0.15, 5.0

FEATURES = ("chars", "words", "word_length", "distinct", "repeated", "line_repeats", "upper", "digits", "symbols", "marks", "per_mark", "spaces", "wide", "adjacent_bytes")
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS, _SPACES = b".,;:?'\"()-", b" \t\r\n\f\v"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _MARKS)
_WIDE = bytes(range(128, 256))


def features(text: str) -> tuple[float, ...]:
    """Shape of a whole text, in the order of FEATURES."""
    data, words, lines = text.encode(), text.split(), text.split("\n")
    n, w = len(data), len(words)
    if not w:
        return (0.0,) * len(FEATURES)
    share = lambda signs: (n - len(data.translate(None, signs))) / n
    marks = share(_MARKS)
    return (
        np.log1p(n), np.log1p(w), n / w, len(set(words)) / w, sum(map(eq, words, words[1:])) / w, 1 - len(set(lines)) / len(lines),
        share(_UPPER), share(_DIGITS), share(_SYMBOLS), marks, w / (1 + marks * n), share(_SPACES), share(_WIDE), len(set(data)) / min(n, 256),
    )


@dataclass
class AdditiveModel:
    """Look-up tables over bins; borders: of each feature, tables: of each feature, pairs: (i, j, coarse table)."""

    start: float
    borders: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, (border, table) in enumerate(zip(self.borders, self.tables, strict=True)):
            out += table[np.searchsorted(border, x[:, f], "right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + REGULAR)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Step of each bin: the bins are cut greedily into at most so many stretches by the gain of their sums."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gains = _gain(left_g, left_h) + _gain(g[a:b].sum() - left_g, h[a:b].sum() - left_h) - _gain(g[a:b].sum(), h[a:b].sum())
                if gains.max() > best[0]:
                    best = (gains.max(), a + 1 + int(gains.argmax()))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + REGULAR)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best cut of both axes into four cells."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    best, step = 0.0, np.zeros_like(g)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            cells = [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))]
            sums = [(c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b]) for c in (cg, ch)]
            gain = sum(_gain(x, y) for x, y in zip(*sums, strict=True)) - _gain(cg[-1, -1], ch[-1, -1])
            if gain > best:
                best, step = gain, np.zeros_like(g)
                for cell, x, y in zip(cells, *sums, strict=True):
                    step[cell] = x / (y + REGULAR)
    return best, step


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of main effects, then of the pairs with the largest gain on the rest."""
    n = x.shape[1] if len(x) else len(FEATURES)
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return AdditiveModel(start, [np.zeros(0)] * n, [np.zeros(1)] * n)
    quantiles = lambda f, bins: np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins))
    borders, coarse = [quantiles(f, BINS) for f in range(n)], [quantiles(f, COARSE) for f in range(n)]
    model = AdditiveModel(start, borders, [np.zeros(len(b) + 1) for b in borders], coarse)
    where = [np.searchsorted(b, x[:, f], "right") for f, b in enumerate(borders)]
    rough = [np.searchsorted(b, x[:, f], "right") for f, b in enumerate(coarse)]
    logit = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, (w, table) in enumerate(zip(where, model.tables, strict=True)):
            g, h = (np.bincount(w, s, len(table)) for s in slopes())
            step = RATE * _shallow_tree(g, h)
            table += step
            logit += step[w]

    def sums(i: int, j: int) -> list[np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return [np.bincount(rough[i] * shape[1] + rough[j], s, shape[0] * shape[1]).reshape(shape) for s in slopes()]

    ranked = sorted(((_pair_tree(*sums(i, j))[0], i, j) for i in range(n) for j in range(i)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in ranked if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * _pair_tree(*sums(i, j))[1]
            table += step
            logit += step[rough[i], rough[j]]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = FIT, folds: int = FOLDS, fold: int = FOLD) -> AdditiveModel:
    """Model from the labelled documents outside the held-out fold. Only features come to the driver, at most `most` rows."""
    chosen = training_labels(labels, column, folds, fold, most)
    values = F.pandas_udf(lambda s: pd.Series([list(features(t or "")) for t in s]), "array<double>")
    rows = labelled_texts(docs, chosen).select("doc_id", "y", values("text").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_additive(x, rows["y"].to_numpy(float))


def quality_score(model: AdditiveModel, text: Column) -> Column:
    """Score of a text, 0 to 1."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES))))

    return F.pandas_udf(score, "double")(text)


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the model accepts."""
    return docs.where(quality_score(model, F.col("text")) >= threshold)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Query: quality of every document."""
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))
