"""Toxicity classifier: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, text_of, written
from .gam import DIGITS, LOWER, UPPER, edges_of, sigmoid
from .labels import fold, training_sample

#: Insults to start from; stems of others are learned from the labelled sample.
INSULTS = ["clown", "coward", "disgusting", "dumb", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
#: Words for the person spoken to, in four languages.
SECOND_PERSON = frozenset("you your yours yourself you're u ur du dich dir dein deine euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t", "|": "l"})
MARKS = ".,;:!?*#%$&\"'()[]{}<>|~_-…«»“”„’‘¡¿"
NOT_LETTERS = re.compile(r"[\W\d_]+")
STRETCHED = re.compile(r"(\w)\1\1+")
FEATURES = [
    "log_words", "insults", "insult_share", "learned_top", "learned", "learned_share", "learned_words", "near_you", "you_share",
    "disguised", "disguised_share", "odd_words", "stretched", "spelled", "upper", "upper_words", "exclaim", "question", "marks", "digits",
]


def plain(word: str) -> str:
    """A disguised word as letters: stand-ins replaced, other marks dropped, stretched letters shortened."""
    return STRETCHED.sub(r"\1", NOT_LETTERS.sub("", word.translate(DISGUISE)))


class Lexicon:
    """Stems (beginnings of words) with their log odds of being in a toxic document."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.sizes = stems, sorted({len(s) for s in stems})

    def stem(self, word: str) -> str | None:
        for n in self.sizes:
            if word[:n] in self.stems:
                return word[:n]
        return None


def features(text: str, lexicon: Lexicon, reach: int = 5) -> list[float]:
    """The numbers named in ``FEATURES``. An insult is disguised if it is one only after ``plain``."""
    words = text.lower().split()
    raw = np.frombuffer(text.encode(), np.uint8)
    of = np.bincount(raw, minlength=256)
    n, b = max(1, len(words)), max(1, len(raw))
    bare = {w: w.strip(MARKS) for w in set(words)}
    insults = {w for w, x in bare.items() if x in _INSULTS}
    known = {w: s for w, x in bare.items() if (s := lexicon.stem(x))}
    odd = [w for w, x in bare.items() if x and not x.isalpha()]
    triple = bool(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & _LETTERS[raw[2:]]).any()) if len(raw) > 2 else False
    stretched = [w for w in bare if STRETCHED.search(w)] if triple else []
    disguised = {w for w in {*odd, *stretched} if w not in insults and w not in known and ((x := plain(bare[w])) in _INSULTS or lexicon.stem(x))}
    singles = [i for i, w in enumerate(words) if len(bare[w]) == 1] if sum(len(x) == 1 for x in bare.values()) >= 3 else []
    spelled, k = 0, 0
    while k < len(singles):
        e = k
        while e + 1 < len(singles) and singles[e + 1] == singles[e] + 1:
            e += 1
        if e - k > 2:
            run = "".join(bare[words[i]] for i in singles[k : e + 1]).translate(DISGUISE)
            spelled += sum(w in run for w in INSULTS)
        k = e + 1
    bad = insults | disguised | set(known)
    hits = [i for i, w in enumerate(words) if w in bad] if bad else []
    you = [i for i, w in enumerate(words) if bare[w] in SECOND_PERSON]
    near = 0
    if hits and you:
        at, where = np.array(you), np.array(hits)
        near = int((np.searchsorted(at, where + reach, side="right") > np.searchsorted(at, where - reach)).sum())
    share = lambda some: sum(w in some for w in words) / n if some else 0.0
    odds = [lexicon.stems[s] for s in set(known.values())]
    return [
        np.log1p(len(words)), len(insults), share(insults), max(odds, default=0.0), sum(odds), share(known), len(known),
        near, len(you) / n, len(disguised), share(disguised), len(odd) / n, len(stretched) / n, spelled,
        of[UPPER].sum() / max(1, of[UPPER].sum() + of[LOWER].sum()), sum(map(str.isupper, text.split())) / n, of[33] / b, of[63] / b, of[_MARKS].sum() / b, of[DIGITS].sum() / b,
    ]


_INSULTS = frozenset(INSULTS)
_LETTERS = UPPER | LOWER
_MARKS = np.isin(np.arange(256), list(b".,;:*#%$&\"'()[]{}<>|~_-"))


class Trees:
    """Gradient-boosted trees on binned features for the log loss, and an isotonic map from margins to probabilities."""

    def __init__(self, rounds: int = 100, depth: int = 3, bins: int = 32, rate: float = 0.12, l2: float = 5.0, least: float = 2.0):
        self.rounds, self.depth, self.bins, self.rate, self.l2, self.least = rounds, depth, bins, rate, l2, least
        self.base, self.edges, self.trees, self.steps = 0.5, [], [], None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """With no rows the score is 1/2; with one label only it is the smoothed share of that label.

        Every fifth row is left out of the trees and calibrates them.
        """
        self.base = float((y.sum() + 0.5) / (len(y) + 1))
        if len(y) < 10 or y.min() == y.max():
            return self
        self.edges = [edges_of(c, self.bins) for c in x.T]
        fit = np.arange(len(y)) % 5 != 0
        b, t = self.binned(x), y
        b, t, rest, rest_y = b[fit], t[fit], b[~fit], y[~fit]
        raw, width = np.full(len(t), np.log(self.base / (1 - self.base))), max(map(len, self.edges)) + 1
        for _ in range(self.rounds):
            p = sigmoid(raw)
            tree = self.grow(b, t - p, p * (1 - p), width)
            self.trees.append(tree)
            raw += tree[2][self.leaf(tree, b)]
        self.steps = isotonic(self.margin(rest), rest_y)
        return self

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> tuple:
        """Feature and cut of each inner node in level order, and the leaves' values."""
        inner, node = 2**self.depth - 1, np.zeros(len(g), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for f in range(b.shape[1]):
                at = node * width + b[:, f]
                cg = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)
                ch = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)
                tg, th = cg[:, -1:], ch[:, -1:]
                gain = cg**2 / (ch + self.l2) + (tg - cg) ** 2 / (th - ch + self.l2) - tg**2 / (th + self.l2)
                gain[(ch < self.least) | (th - ch < self.least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better], feature[first:first + n][better], cut[first:first + n][better] = top[better], f, k[better]
            node = 2 * node + (b[np.arange(len(g)), feature[first + node]] > cut[first + node])
        leaves = 2**self.depth
        value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
        return feature, cut, value

    def leaf(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, _ = tree
        node, row = np.zeros(len(b), np.int64), np.arange(len(b))
        for level in range(self.depth):
            at = 2**level - 1 + node
            node = 2 * node + (b[row, feature[at]] > cut[at])
        return node

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), np.log(self.base / (1 - self.base)))
        for tree in self.trees:
            out += tree[2][self.leaf(tree, b)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a thousandth of the raw one keeps the order within a step."""
        if self.steps is None:
            return np.full(len(x), self.base)
        raw = self.margin(self.binned(x))
        return 0.999 * np.interp(raw, *self.steps) + 0.001 * sigmoid(raw)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising function nearest to y (pooled neighbours): the ends of each pool, and its mean."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], last]
    at = np.array([p for s, n, first, last in pools for p in (first, last)])
    return at, np.repeat([s / n for s, n, *_ in pools], 2)


def learn_lexicon(sample: DataFrame, stems: int = 64, least: int = 4, z: float = 5.0, odds: float = 1.5, sizes: tuple[int, int] = (3, 10)) -> dict[str, float]:
    """Stems in the sample (``y``, ``text``) that mark toxic documents, with log odds; ``stems`` of them at most.

    Beginnings of words are counted once for a document, by label: tasks add up their slices, Spark adds up the rest,
    and the driver gets those that pass. One passes if ``least`` toxic documents have it, the labels differ by ``z``
    standard errors, and the log odds are ``odds`` or more. Of stems that begin each other, the one that tells most
    stays; of equal ones the longest.
    """
    total = sample.agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("c")).first()
    if not total.t or not total.c:
        return {}
    schema = T.StructType().add("stem", "string").add("a", "long").add("b", "long")

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                by = {0: Counter(), 1: Counter()}
                for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
                    bare = {w.strip(MARKS) for w in set(text.lower().split())}
                    by[int(y == 1)].update({w[:n] for w in bare for n in range(sizes[0], min(len(w), sizes[1]) + 1)})
                found = list(by[0] | by[1])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([by[1][s] for s in found], pa.int64()), pa.array([by[0][s] for s in found], pa.int64())], names=["stem", "a", "b"])

    counts = sample.mapInArrow(count, schema).groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= least)
    p, q = F.col("a") / total.t, F.col("b") / total.c
    pooled = (F.col("a") + F.col("b")) / (total.t + total.c)
    counts = counts.withColumn("z", (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / total.t + 1 / total.c) + 1e-12))
    counts = counts.withColumn("odds", F.log((F.col("a") + 0.5) / (total.t + 1)) - F.log((F.col("b") + 0.5) / (total.c + 1)))
    ranked = counts.where((F.col("z") >= z) & (F.col("odds") >= odds)).orderBy(F.desc(F.round("z", 6)), F.desc(F.length("stem")), "stem").limit(50 * stems).collect()
    out: dict[str, float] = {}
    for r in ranked:
        if len(out) < stems and not any(r.stem.startswith(s) or s.startswith(r.stem) for s in out):
            out[r.stem] = float(r.odds)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, rows: int = 20_000, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> tuple[Trees, Lexicon]:
    """Trees and learned stems, fitted on a sample of at most ``rows`` labelled documents (``training_sample``)."""
    sample = written(training_sample(docs, labels, label, train, rows, id_col, text_col), "sample")
    learned = Lexicon(learn_lexicon(sample))
    schema = T.StructType().add("x", T.ArrayType(T.DoubleType()))
    got = map_batches(sample, "text", lambda texts: {"x": [features(t, learned) for t in texts]}, schema, keep=["y"]).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same in every run, however Spark orders the rows
    return Trees().fit(x[order], y[order]), learned


def toxicity_scores(docs: DataFrame, model: tuple[Trees, Lexicon], text_col: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the score, 0 to 1, of the whole text, in ``_name`` if the column is there already; null text counts as empty."""
    (text,) = fresh(docs, "text_")
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn(text, text_of(text_col)).select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])])

    def score(texts: list[str]) -> dict:
        trees, learned = shared.value
        return {name: trees.score(np.array([features(t, learned) for t in texts], float).reshape(-1, len(FEATURES)))}

    return map_batches(rows, text, score, T.StructType().add(name, "double"), keep=keep)


def classify_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", rows: int = 20_000) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) of every row of ``docs``.

    Labels of documents with crc32(id as text) mod ``folds`` = ``held`` are never learned from. A null id is held
    out; repeated rows get equal scores; columns beyond id and text don't matter. No labels give the score 1/2.
    """
    held_out = F.coalesce(fold(id_col, folds) == held, F.lit(True))
    model = fit_toxicity(docs, labels, ~held_out, rows, id_col=id_col, text_col=text_col)
    scored = toxicity_scores(docs.select(f"`{id_col}`", f"`{text_col}`"), model, text_col, "score", keep=[id_col])
    return scored.select(f"`{id_col}`", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
