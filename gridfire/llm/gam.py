"""Quality classifier: a generalised additive model with pairwise interactions over text features.

Shallow trees are boosted in turn on one feature at a time, then on the feature pairs with the strongest interaction
left. Trees over bins add up to lookup tables, so a score is a sum of looked-up numbers.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, text_of
from .labels import fold, training_sample

FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "stops", "symbols", "exclaim", "bars", "other", "repeats_next",
    "distinct", "most_common", "log_line", "repeated_lines", "short_words", "long_words", "upper_words", "symbol_words", "distinct_letters",
]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


UPPER, LOWER, DIGITS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
STOPS, SYMBOLS = _class(".,;:?"), _class("#%&*$@^~<>{}[]\\/+=_")
SYMBOL_ENDS = frozenset("#%&*$@^~<>{}[]\\/+=_|")


def features(text: str) -> list[float]:
    """The numbers named in ``FEATURES``; a text without words has zeros where a share has no base."""
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    n, w = max(1, len(raw)), max(1, len(words))
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, of[UPPER].sum() + of[LOWER].sum())
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sizes.sum() / w, of[UPPER].sum() / letters, of[DIGITS].sum() / n, of[STOPS].sum() / n,
        of[SYMBOLS].sum() / n, of[33] / n, of[124] / n, of[128:].sum() / n, sum(map(eq, words, words[1:])) / w,
        len(counts) / w, max(counts.values(), default=0) / w, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        (sizes <= 2).sum() / w, (sizes >= 12).sum() / w, sum(map(str.isupper, words)) / w, sum(x[-1] in SYMBOL_ENDS for x in words) / w, (of > 0).sum(),
    ]


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 different inner quantiles of a column."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def stump_values(g: np.ndarray, h: np.ndarray, cuts: int, l2: float) -> np.ndarray:
    """Values by bin of the tree that cuts the ordered bins where the gain is largest, up to ``cuts`` times."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    score = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    ends = [0, len(g)]
    for _ in range(cuts):
        best = (1e-9, None)
        for a, b in zip(ends, ends[1:], strict=False):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = score(a, at) + score(at, b) - score(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), int(at[gain.argmax()]))
        if best[1] is None:
            break
        ends = sorted([*ends, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(ends, ends[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The gain and values of the depth-two tree that cuts a table of two features once along each."""
    def corners(t):
        c = np.zeros((t.shape[0] + 1, t.shape[1] + 1))
        c[1:, 1:] = t.cumsum(0).cumsum(1)
        a = c[1:-1, 1:-1]
        left, top, all_ = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return np.stack([a, left - a, top - a, all_ - left - top + a])

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    cg, ch = corners(g), corners(h)
    gain = (cg**2 / (ch + l2)).sum(0) - g.sum() ** 2 / (h.sum() + l2)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = cg[:, i, j] / (ch[:, i, j] + l2)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


class AdditiveModel:
    """Lookup tables by feature and by feature pair; ``score`` adds what the bins of a row have in them."""

    def __init__(self, bins: int = 48, pair_bins: int = 12, rounds: int = 120, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.15, l2: float = 5.0):
        self.bins, self.pair_bins, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.l2 = bins, pair_bins, rounds, pair_rounds, pairs, rate, l2
        self.base, self.edges, self.tables, self.coarse, self.pairs = 0.5, [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """With no rows the score is 1/2; with one label only it is the smoothed share of that label."""
        self.base = float((y.sum() + 0.5) / (len(y) + 1))
        if len(y) < 10 or y.min() == y.max():
            return self
        raw = np.full(len(y), np.log(self.base / (1 - self.base)))
        self.edges = [edges_of(c, self.bins) for c in x.T]
        self.coarse = [edges_of(c, self.pair_bins) for c in x.T]
        at = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        for _ in range(self.rounds):
            for b, table in zip(at, self.tables, strict=True):
                p = sigmoid(raw)
                step = self.rate * stump_values(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)), 2, self.l2)
                table += step
                raw += step[b]
        low = [np.searchsorted(e, c, side="right") for e, c in zip(self.coarse, x.T, strict=True)]
        shape = lambda i, j: (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
        table_of = lambda i, j, v: np.bincount(low[i] * shape(i, j)[1] + low[j], v, np.prod(shape(i, j))).reshape(shape(i, j))
        p = sigmoid(raw)
        gains = {(i, j): quadrants(table_of(i, j, y - p), table_of(i, j, p * (1 - p)), self.l2)[0] for i in range(x.shape[1]) for j in range(i)}
        self.pairs = [(i, j, np.zeros(shape(i, j))) for i, j in sorted(gains, key=gains.get, reverse=True)[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, table in self.pairs:
                p = sigmoid(raw)
                step = self.rate * quadrants(table_of(i, j, y - p), table_of(i, j, p * (1 - p)), self.l2)[1]
                table += step
                raw += step[low[i], low[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), np.log(self.base / (1 - self.base)))
        for e, table, c in zip(self.edges, self.tables, x.T, strict=False):
            raw += table[np.searchsorted(e, c, side="right")]
        for i, j, table in self.pairs:
            raw += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return sigmoid(raw)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, rows: int = 20_000, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """A model of the label, fitted on a sample of at most ``rows`` labelled documents (``training_sample``).

    Tasks turn the sample's texts into features; the driver gets one short row of numbers for each.
    """
    sample = training_sample(docs, labels, label, train, rows, id_col, text_col)
    schema = T.StructType().add("x", T.ArrayType(T.DoubleType()))
    got = map_batches(sample, "text", lambda texts: {"x": [features(t) for t in texts]}, schema, keep=["y"]).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same in every run, however Spark orders the rows
    return AdditiveModel().fit(x[order], y[order])


def quality_scores(docs: DataFrame, model: AdditiveModel, text_col: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the score, 0 to 1, of the whole text; null text counts as empty."""
    (text,) = fresh(docs, "text_")
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn(text, text_of(text_col)).select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])])
    score = lambda texts: {name: shared.value.score(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES)))}
    return map_batches(rows, text, score, T.StructType().add(name, "double"), keep=keep)


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", rows: int = 20_000) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) of every row of ``docs``.

    Labels of documents with crc32(id as text) mod ``folds`` = ``held`` are never learned from. A null id is held
    out; repeated rows get equal scores; columns beyond id and text don't matter. No labels give the score 1/2.
    """
    held_out = F.coalesce(fold(id_col, folds) == held, F.lit(True))
    model = fit_quality(docs, labels, ~held_out, rows, id_col=id_col, text_col=text_col)
    scored = quality_scores(docs.select(f"`{id_col}`", f"`{text_col}`"), model, text_col, "score", keep=[id_col])
    return scored.select(f"`{id_col}`", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, in the columns it has, without the documents whose score is under ``threshold``."""
    model = fit_quality(docs, labels, F.coalesce(fold(id_col, 5) != 0, F.lit(False)), id_col=id_col, text_col=text_col)
    (score,) = fresh(docs, "score_")
    return quality_scores(docs, model, text_col, score).where(F.col(score) >= threshold).drop(score)
