"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words. Each word enters as the sum of its own vector, if training knew it, and the mean
vector of its hashed character n-grams, so unseen spellings are read by their characters. Two gated recurrent networks run over a
window in both directions; attention weights their states into one, from which the window's logit comes. All windows
are scored; a text's logit is that of its highest window, calibrated to a probability.

Training is multiple-instance learning on a bounded sample of labelled texts (FIT): each step learns from the highest window of
every text. Scoring covers every row and the whole of every text. Defined results: null and empty texts, and those
of white space, score 0; a word of over PART characters is read as several; without labels of both kinds every other
text gets the smoothed share of label 1; rows that repeat get the same score; an empty table has an empty result; of the table's
columns only doc_id and text are read, so others may have any name. Labelled texts of over LONGEST characters are not learnt from, but scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfield.llm.common import read
from pathfield.llm.labels import held_out, labelled_texts, training_labels

#: Labelled texts trained on, at most, half of them of each label where there are so many; longest of them in characters.
FIT, LONGEST = 3_000, 20_000
FOLDS, FOLD = 3, 1
THRESHOLD = 0.7
#: Words of a window, words between two windows' starts.
WINDOW, STEP = 24, 16
#: Characters of a word read at once.
PART = 24
#: Vector size, states of each direction, buckets of character n-grams.
SIZE, STATES, GRAM_BITS = 8, 8, 15
EPOCHS, RATE = 10, 0.02
#: Texts of a step: a twentieth of all, within these.
BATCHES = 16, 100
#: Chance that a known word is read by its characters alone while training.
UNKNOWN = 0.3
#: Words a worker remembers; windows it scores at once.
KNOWN_WORDS, AT_ONCE = 250_000, 512


def words_of(text: str) -> list[str]:
    """Lower-case words, those of over PART characters in parts."""
    words = text.lower().split()
    if len(max(words, key=len, default="")) > PART:
        words = [w[i : i + PART] for w in words for i in range(0, len(w), PART)]
    return words


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 3-, 4- and 5-grams of the marked words, one word after the other, and how many each has."""
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    wide = int(sizes.max(initial=1)) + 2
    signs = np.zeros((n, wide), np.uint32)
    signs[:, 1:-1] = np.array(words, f"U{wide - 2}").view(np.uint32).reshape(n, wide - 2)
    signs[:, 0] = ord("<")
    signs[np.arange(n), sizes + 1] = ord(">")
    found, valid = [], []
    h = signs * np.uint32(0x9E3779B1)
    for k in range(1, 5):
        h = (h[:, :-1] ^ h[:, :-1] >> np.uint32(15)) * np.uint32(0x85EBCA77) + signs[:, k:]
        if k >= 2:
            found.append((h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - GRAM_BITS))
            valid.append(np.arange(wide - k) < (sizes + 2 - k)[:, None])
        if h.shape[1] <= 1:
            break
    valid = np.concatenate(valid, 1)
    return np.concatenate(found, 1)[valid], valid.sum(1)


def starts(n: int) -> np.ndarray:
    """First words of the windows over n words: every STEP, the last window ending with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW)


def windows(ids: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) of the ids; a short text's only window is filled with 0."""
    if len(ids) < WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)))[None]
    return ids[starts(len(ids))[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _recur(x: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States over time of a gated recurrent unit. x: (time, 3 * states, rows), the inputs' part of update, reset and candidate."""
    time, k, rows = x.shape[0], u.shape[0], x.shape[2]
    h, out, held, ut = np.zeros((k, rows), np.float32), np.empty((time, k, rows), np.float32), [], np.ascontiguousarray(u.T)
    for t in range(time):
        hu = ut @ h
        gates = x[t, : 2 * k] + hu[: 2 * k]
        gates *= 0.5
        np.tanh(gates, gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:k], gates[k:]
        c = r * hu[2 * k :]
        c += x[t, 2 * k :]
        np.tanh(c, c)
        if keep:
            held.append((h, hu, z, r, c))
        new = np.subtract(h, c, out[t])
        new *= z
        new += c
        h = new
    return out, held


def _recur_back(grad: np.ndarray, u: np.ndarray, held: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs' part and of u, from those of the states."""
    k = u.shape[0]
    dx, du, dh = np.empty((len(grad), 3 * k, grad.shape[2]), np.float32), np.zeros_like(u), np.zeros(grad.shape[1:], np.float32)
    for t in reversed(range(len(grad))):
        h, hu, z, r, c = held[t]
        dh = dh + grad[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * hu[2 * k :] * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dc])
        dhu = np.concatenate([dz, dr, dc * r])
        du += h @ dhu.T
        dh = dh * z + u @ dhu
    return dx, du


@dataclass
class Network:
    """Weights by name, the known words' rows, and the calibration (scale, shift)."""

    weights: dict[str, np.ndarray]
    known: dict[str, int]
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        """Both directions' input parts of word vectors: (..., 6 * states)."""
        return vectors @ self.weights["w"] + self.weights["wb"]

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. x: (time, rows, 6 * states); mask: (time, rows), whether a word stands there."""
        w, k = self.weights, 3 * STATES
        x = np.ascontiguousarray(x.transpose(0, 2, 1))
        ahead, held_ahead = _recur(x[:, :k], w["ua"], keep)
        back, held_back = _recur(x[::-1, k:], w["ub"], keep)
        h = np.concatenate([ahead, back[::-1]], 1)
        score = w["v"] @ h
        score[~mask] = -1e9
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tr,tkr->kr", weight, h)
        return w["o"] @ pooled + w["b"], (h, weight, pooled, held_ahead, held_back)

    def backward(self, grad: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights after the inputs, and of the inputs' part, (time, rows, 6 * states)."""
        w, (h, weight, pooled, held_ahead, held_back) = self.weights, kept
        out = {"o": pooled @ grad, "b": grad.sum(keepdims=True)}
        dpooled = w["o"][:, None] * grad
        dweight = (h * dpooled).sum(1)
        dscore = weight * (dweight - (weight * dweight).sum(0))
        dh = weight[:, None] * dpooled + dscore[:, None] * w["v"][:, None]
        out["v"] = np.einsum("tr,tkr->k", dscore, h)
        dxa, out["ua"] = _recur_back(dh[:, :STATES], w["ua"], held_ahead)
        dxb, out["ub"] = _recur_back(dh[::-1, STATES:], w["ub"], held_back)
        return out, np.concatenate([dxa, dxb[::-1]], 1).transpose(0, 2, 1)


class Speller:
    """Word ids and their vectors' parts, made once for each distinct word."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1, 6 * STATES), np.float32)
        self.table[0] = self.net.inputs(np.zeros((1, SIZE), np.float32))[0]

    def encode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of the words of each text, from 1; rows of the table."""
        if len(self.ids) > KNOWN_WORDS:
            self.clear()
        new = list(set().union(*texts) - self.ids.keys())
        if new:
            self.ids |= zip(new, range(len(self.ids) + 1, len(self.ids) + 1 + len(new)), strict=True)
            self.table = np.concatenate([self.table[: len(self.ids) + 1 - len(new)], self.net.inputs(vectors(self.net, new))])
        return [np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)) for words in texts]


def _means(table: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[flat], sizes.cumsum() - sizes) / sizes[:, None].astype(np.float32)


def vectors(net: Network, words: list[str]) -> np.ndarray:
    """Vectors of words: known ones' own, plus the mean of their n-grams'."""
    out = np.empty((len(words), SIZE), np.float32)
    for at in range(0, len(words), 10_000):
        part = words[at : at + 10_000]
        own = net.weights["words"][[net.known.get(w, 0) for w in part]]
        out[at : at + 10_000] = own + _means(net.weights["grams"], *grams_of(part))
    return out


def _odds(lists: list[np.ndarray], y: np.ndarray, n: int, least: int = 4) -> np.ndarray:
    """Smoothed log odds, of label 1, of each number below n by the lists it is in; 0 for those in fewer than `least`."""
    counts = np.stack([sum((np.bincount(x, minlength=n) for x, label in zip(lists, y, strict=True) if label == k), np.zeros(n)) for k in (0, 1)])
    total = np.bincount(y.astype(int), minlength=2)[:, None]
    odds = np.log((counts + 1) / (total + 2))
    return np.where(counts.sum(0) >= least, odds[1] - odds[0], 0)


def train(texts: list[str], y: np.ndarray, share: float, seed: int = 3) -> Network:
    """Network from labelled texts. share: that of label 1 among all labelled rows, for the calibration."""
    rng = np.random.default_rng(seed)
    k = STATES
    if not len(y) or y.min() == y.max():
        return Network({}, {}, constant=share)
    split = [words_of(t) for t in texts]
    kept = [i for i, s in enumerate(split) if s]
    y, split = y[kept], [split[i] for i in kept]
    fit = rng.random(len(y)) >= 0.2
    if not len(y) or min(np.ptp(y[fit]) if fit.any() else 0, np.ptp(y[~fit]) if not fit.all() else 0) == 0:
        fit = np.ones(len(y), bool)
    if not len(y) or np.ptp(y) == 0:
        return Network({}, {}, constant=share)
    lists = sorted(set().union(*split))
    ids = dict(zip(lists, range(1, len(lists) + 1), strict=True))
    texts_ids = [np.fromiter(map(ids.__getitem__, s), np.int64, len(s)) for s in split]
    flat, sizes = grams_of(lists)
    ends = np.concatenate([[0, 0], sizes.cumsum()])  # row 0 stands for no word
    sets = [np.unique(t) for t in texts_ids]
    seen = np.bincount(np.concatenate([s for s, f in zip(sets, fit, strict=True) if f]), minlength=len(lists) + 1)
    chosen = np.flatnonzero(seen >= 4)
    own = np.zeros(len(lists) + 1, np.int64)
    own[chosen] = np.arange(1, len(chosen) + 1)
    known = {lists[i - 1]: int(own[i]) for i in chosen}
    gram_sets = [np.unique(np.concatenate([flat[ends[i] : ends[i + 1]] for i in s])) for s in sets]
    of = lambda x: [s for s, f in zip(x, fit, strict=True) if f]
    normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    weights = {
        "words": 0.02 * normal(len(known) + 1, SIZE), "grams": 0.05 * normal(1 << GRAM_BITS, SIZE), "w": 0.4 * normal(SIZE, 6 * k), "wb": np.zeros(6 * k, np.float32),
        "ua": 0.3 * normal(k, 3 * k), "ub": 0.3 * normal(k, 3 * k), "v": 0.3 * normal(2 * k), "o": 0.3 * normal(2 * k), "b": np.zeros(1, np.float32),
    }
    # the first component starts from how a word, or n-gram, goes with the label
    weights["words"][0] = 0
    weights["words"][1:, 0] = _odds(of(sets), y[fit], len(lists) + 1)[chosen] / 3
    weights["grams"][:, 0] = _odds(of(gram_sets), y[fit], 1 << GRAM_BITS) / 3
    net = Network(weights, known)
    cut = [windows(t) for t in texts_ids]
    moments = {n: [np.zeros_like(w), np.zeros_like(w)] for n, w in weights.items()}
    step = 0

    def table() -> np.ndarray:
        means = _means(weights["grams"], flat, sizes)
        return np.concatenate([np.zeros((1, SIZE), np.float32), weights["words"][own[1:]] + means]).astype(np.float32)

    def highest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's highest window and its logit."""
        parts = net.inputs(table())
        sizes = np.array([len(cut[i]) for i in rows])
        allw = np.concatenate([cut[i] for i in rows])
        logits = np.concatenate([net.forward(parts[a.T], a.T > 0)[0] for a in np.array_split(allw, len(allw) // AT_ONCE + 1)])
        out = [allw[s][logits[s].argmax()] for s in (slice(e - n, e) for n, e in zip(sizes, sizes.cumsum(), strict=True))]
        return np.stack(out), np.maximum.reduceat(logits, sizes.cumsum() - sizes)

    rows = np.flatnonzero(fit)
    batch = min(max(len(rows) // 20, BATCHES[0]), BATCHES[1])
    for epoch in range(EPOCHS):
        top, _ = highest(rows)
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            mine = order[at : at + batch]
            a, target = top[mine].T, y[rows[mine]]
            distinct, place = np.unique(a, return_inverse=True)
            place = place.reshape(a.shape)
            unknown = rng.random(len(distinct)) < UNKNOWN
            rows_of = np.where(unknown, 0, own[distinct])
            spans = [np.arange(ends[i], ends[i + 1]) for i in distinct]
            gram_ids = flat[np.concatenate(spans)]
            lens = np.array([len(s) for s in spans])
            means = np.zeros((len(distinct), SIZE), np.float32)
            np.add.at(means, np.repeat(np.arange(len(distinct)), lens), weights["grams"][gram_ids])
            v = weights["words"][rows_of] + means / np.maximum(lens, 1)[:, None]
            x = net.inputs(v)[place]
            logit, kept_states = net.forward(x.astype(np.float32), a > 0, True)
            grad = ((_sigmoid(logit) - target) / len(mine)).astype(np.float32)
            grads, dx = net.backward(grad, kept_states)
            dparts = np.zeros((len(distinct), 6 * k), np.float32)
            np.add.at(dparts, place.ravel(), dx.reshape(-1, 6 * k))
            grads["w"], grads["wb"] = v.T @ dparts, dparts.sum(0)
            dv = dparts @ weights["w"].T
            grads["words"], grads["grams"] = np.zeros_like(weights["words"]), np.zeros_like(weights["grams"])
            np.add.at(grads["words"], rows_of, dv)
            grads["words"][0] = 0
            np.add.at(grads["grams"], gram_ids, np.repeat(dv / np.maximum(lens, 1)[:, None], lens, 0))
            step += 1
            for n, g in grads.items():
                m, s = moments[n]
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                weights[n] -= RATE * (1 - 0.8 * epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
    # calibration on the texts left out, weighted to the share of label 1 among all labelled rows
    test = np.flatnonzero(~fit) if not fit.all() else rows
    _, logits = highest(test)
    weight = np.where(y[test] == 1, share / max(1, (y[test] == 1).sum()), (1 - share) / max(1, (y[test] == 0).sum())) * len(test)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = _sigmoid(a * logits + b)
        g = weight * (p - y[test])
        h = weight * p * (1 - p)
        ga, gb = (g * logits).mean() + 0.01 * (a - 1), g.mean()
        haa, hab, hbb = (h * logits * logits).mean() + 0.01, (h * logits).mean(), h.mean() + 1e-4
        det = haa * hbb - hab * hab
        a, b = a - np.clip((hbb * ga - hab * gb) / det, -1, 1), b - np.clip((haa * gb - hab * ga) / det, -1, 1)
    net.scale, net.shift = float(max(a, 0.05)), float(b)
    return net


_spellers: dict[str, Speller] = {}


def _scorer(held, key: str):
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = held.value
        speller = None
        if net.constant is None:
            if key not in _spellers:
                _spellers.clear()
                _spellers[key] = Speller(net)
            speller = _spellers[key]
        for texts in series:
            out = np.zeros(len(texts))
            part: list[tuple[int, list[str]]] = []
            n = 0

            def score() -> None:
                nonlocal n
                if part:
                    cut = [windows(ids) for ids in speller.encode([w for _, w in part])]
                    sizes = np.array([len(c) for c in cut])
                    allw = np.concatenate(cut)
                    logits = np.concatenate([net.forward(speller.table[a.T], a.T > 0)[0] for a in np.array_split(allw, len(allw) // AT_ONCE + 1)])
                    top = np.maximum.reduceat(logits, sizes.cumsum() - sizes)
                    out[[i for i, _ in part]] = 1 / (1 + np.exp(-np.clip(net.scale * top.astype(float) + net.shift, -500, 500)))
                part.clear()
                n = 0

            for i, text in enumerate(texts):
                words = words_of(text or "")
                if not words:
                    continue
                if net.constant is not None:
                    out[i] = net.constant
                    continue
                part.append((i, words))
                n += len(words)
                if n >= 100_000:
                    score()
            score()
            yield pd.Series(out)

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = FIT, folds: int = FOLDS, fold: int = FOLD) -> Network:
    """Network from a bounded sample of labelled documents outside the held-out fold, each of at most LONGEST characters."""
    chosen = training_labels(labels, column, folds, fold, most, balanced=True)
    rows = labelled_texts(docs.where(F.length("text") <= LONGEST), chosen).toPandas().sort_values("doc_id")
    outside = labels.where(~held_out(F.col("doc_id"), folds, fold)).agg(F.avg(F.col(column).cast("double")).alias("share"), F.count(column).alias("n")).first()
    share = ((outside.share or 0.0) * outside.n + 1) / (outside.n + 2)
    return train(rows["text"].tolist(), rows["y"].to_numpy(float), share)


def toxicity_score(held, key: str, text: Column) -> Column:
    """Score of a text, 0 to 1. held: the broadcast network; key: a name for it, by which workers remember its words."""
    run = _scorer(held, key)

    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(series)

    return F.pandas_udf(score, "double")(text)


def score_toxicity(docs: DataFrame, net: Network, threshold: float = THRESHOLD, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    key = f"{docs.sparkSession.sparkContext.applicationId}-{held._jbroadcast.id() if held._jbroadcast else id(held)}"
    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), toxicity_score(held, key, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: toxicity of every document."""
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))
