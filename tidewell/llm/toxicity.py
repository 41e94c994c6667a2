"""Toxicity by a classifier chain of linear models.

Each category is a 0/1 label. The models are logistic regressions over the
presence of words and word beginnings (so that inflected forms count) and run
in the order of the chain: a later one also reads the probabilities that the
earlier ones give. In training those come out of folds, so that a later model
sees them with the errors they will have (Read, Pfahringer, Holmes, Frank,
"Classifier chains for multi-label classification", 2011).

The fit uses at most ``per_class`` labelled documents of each value of the
last category, the smallest by a hash of doc_id, and then shifts each
intercept to the share of the category among all labelled rows. A model says yes
from the probability on at which its F-score out of folds is best. Scoring reads
every text whole; what a word adds is looked up once a word and task.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import filter_texts, map_columns

#: Features are kept apart by this many bits of their hash.
BITS = 22
LETTERS = re.compile(r"[^\W\d_]+")


def word_features(token: str) -> set[int]:
    """Hashed features of one white-space token, whatever its case."""
    out = set()
    low = token.lower()
    for word in LETTERS.findall(low):
        out.add("w" + word)
        out |= {f"{n}{word[:n]}" for n in (3, 4, 5, 6) if n < len(word)}
    marks = LETTERS.sub("a", low)
    if marks != "a":
        out.add("m" + re.sub(r"\d+", "0", marks)[-4:])
    return {zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in out}


def text_features(text: str | None) -> np.ndarray:
    found: set[int] = set()
    for token in set((text or "").split()):
        found |= word_features(token)
    return np.fromiter(sorted(found), dtype=np.int32, count=len(found))


@dataclass
class Linear:
    """Weights by feature, of the earlier categories' probabilities, the intercept, and the probability from which on it says yes."""

    weights: dict[int, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)
    intercept: float = 0.0
    cut: float = 0.5


def fit_linear(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, keep: int = 512, penalty: float = 0.1) -> Linear:
    """Logistic regression on the features that tell the classes apart most.

    They are chosen by the likelihood ratio of their presence; the fit is
    Newton's method with an L2 penalty. With one class only, the model is
    its intercept.
    """
    n, pos = len(y), int(y.sum())
    prior = (pos + 0.5) / (n + 1.0)
    if pos in (0, n):
        return Linear({}, [0.0] * before.shape[1], float(np.log(prior / (1 - prior))))
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=1 << BITS)
    with_pos = np.bincount(flat, weights=y[owner], minlength=1 << BITS)
    use = np.flatnonzero(seen >= 4)
    a, c = with_pos[use], seen[use] - with_pos[use]
    gain = np.zeros(len(use))
    for part, whole, share in ((a, seen[use], pos / n), (c, seen[use], 1 - pos / n), (pos - a, n - seen[use], pos / n), (n - pos - c, n - seen[use], 1 - pos / n)):
        gain += np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / np.maximum(whole * share, 1e-9)), 0)
    chosen = use[np.argsort(-gain, kind="stable")[:keep]]
    chosen = chosen[np.sort(gain)[::-1][: len(chosen)] > 8.0]
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen) + before.shape[1] + 1))
    at = column[flat]
    x[owner[at >= 0], at[at >= 0]] = 1.0
    x[:, len(chosen) : -1], x[:, -1] = before, 1.0
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    k = len(chosen)
    return Linear(dict(zip(chosen.tolist(), w[:k].tolist(), strict=True)), w[k:-1].tolist(), float(w[-1]))


def raw_score(model: Linear, features, before) -> float:
    get = model.weights.get
    return model.intercept + sum(get(f, 0.0) for f in features) + sum(a * b for a, b in zip(model.earlier, before, strict=True))


def probability(score: float) -> float:
    return float(1 / (1 + np.exp(-min(max(score, -30.0), 30.0))))


def best_cut(p: np.ndarray, y: np.ndarray, share: float) -> float:
    """The probability above which the F-score is best, the classes weighted to the true share; of equals the highest.

    ``p`` are out of folds, so no row was seen by the model that judged it.
    """
    pos = int(y.sum())
    if pos in (0, len(y)):
        return 0.5
    order = np.argsort(-p, kind="stable")
    q = p[order]
    hit = np.cumsum(y[order]) * share / pos
    false = np.cumsum(1 - y[order]) * (1 - share) / (len(y) - pos)
    last = np.flatnonzero(np.append(q[:-1] > q[1:], True))  # rows of one probability are judged alike
    best = int(np.argmax((2 * hit / (hit + false + share))[last]))
    below = q[last[best] + 1] if last[best] + 1 < len(q) else 0.0
    return float(np.clip((q[last[best]] + below) / 2, 0.05, 0.95))


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, shares: list[float], folds: int = 3) -> list[Linear]:
    """One model a column of ``labels``; ``shares`` are the columns' true means."""
    n, before, models = len(rows), np.zeros((len(rows), 0)), []
    fold = np.arange(n) % folds
    for j in range(labels.shape[1]):
        y = labels[:, j].astype(float)
        out = np.zeros(n)
        for f in range(folds):
            train = np.flatnonzero(fold != f)
            part = fit_linear([rows[i] for i in train], before[train], y[train])
            for i in np.flatnonzero(fold == f):
                out[i] = probability(raw_score(part, rows[i].tolist(), before[i]))
        models.append(fit_linear(rows, before, y))
        before = np.column_stack([before, out])
        # Smoothed as the model of a single class is, so that a sample without one value isn't taken for proof.
        here, true = (y.sum() + 0.5) / (n + 1), (shares[j] * n + 0.5) / (n + 1)
        shift = float(np.log(true / (1 - true)) - np.log(here / (1 - here)))
        models[-1].intercept += shift
        with np.errstate(divide="ignore"):
            shifted = 1 / (1 + np.exp(-(np.log(out) - np.log1p(-out) + shift)))
        models[-1].cut = best_cut(shifted, y, true)
    return models


class Scorer(dict):
    """Chosen features of each token, looked up once; forgets when full."""

    def __init__(self, models: list[Linear], most: int = 300_000):
        super().__init__()
        self.models, self.most = models, most
        self.used = {f for m in models for f in m.weights}

    def __missing__(self, token: str) -> tuple:
        if len(self) >= self.most:
            self.clear()
        found = self[token] = tuple(word_features(token) & self.used)
        return found

    def scores(self, text: str | None) -> list[float]:
        """Probabilities of the categories, in the order of the chain."""
        features: set[int] = set()
        features.update(*map(self.__getitem__, set((text or "").split())))
        before: list[float] = []
        for model in self.models:
            before.append(probability(raw_score(model, features, before)))
        return before


#: The chain over the labels that the corpus has: text of low quality, then toxic text.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, per_class: int = 2500) -> list[Linear]:
    """Fit the chain on a bounded sample; no labels: all probabilities are 1/2 or less."""
    names = list(categories)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.expr(e), F.lit(False)).cast("int").alias(n) for n, e in categories.items())).where("doc_id is not null")
    marked = marked.groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))
    shares = marked.agg(*(F.avg(n) for n in names)).first()
    picked = None
    for value in (0, 1):
        part = marked.where(F.col(names[-1]) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * per_class rows of a few integers.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")

    def run(ids, texts, *ys):
        return {"doc_id": ids, "found": [text_features(t).tobytes() for t in texts]} | dict(zip(names, ys, strict=True))

    rows = map_columns(sample, ["doc_id", "text", *names], "doc_id long, found binary, " + ", ".join(f"{n} int" for n in names), run).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.found))
    if not rows:
        return [Linear({}, [0.0] * j, -1.0) for j in range(len(names))]
    return fit_chain([np.frombuffer(r.found, dtype=np.int32) for r in rows], np.array([[r[n] for n in names] for r in rows]), [s or 0.0 for s in shares])


def score(docs: DataFrame, models: list[Linear], names: list[str], threshold: float | None = None) -> DataFrame:
    """``(doc_id, p_<name>..., <last name>)``, one row per input row.

    A null or empty text has no features, a very long one is read whole. Repeated
    rows come back alike, rows without an id, too; other columns aren't read. A
    probability of just the threshold is in the category; without one it is the last model's own cut.
    """
    threshold = models[-1].cut if threshold is None else threshold
    held = docs.sparkSession.sparkContext.broadcast(models)

    kept: list[Scorer] = []  # one a task, not one a batch

    def run(ids, texts):
        scorer = kept[0] if kept else kept.append(Scorer(held.value)) or kept[0]
        found = [scorer.scores(t) for t in texts]
        return {"doc_id": ids, names[-1]: [f[-1] >= threshold for f in found]} | {f"p_{n}": [f[j] for f in found] for j, n in enumerate(names)}

    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + f", {names[-1]} boolean"
    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], schema, run)


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, per_class: int = 2500, threshold: float | None = None) -> DataFrame:
    """Train on the labelled documents, score all of them.

    A document labelled twice has a category if one of its labels has it; a
    null label counts as 0; labels of unknown documents are left out. Null, empty and very long texts,
    repeated rows and rows without an id are scored as ``score`` says; other columns, also such as
    ``labels`` has, play no part. An empty table gives no rows.
    """
    return score(docs, train(docs, labels, categories, per_class), list(categories), threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, per_class: int = 2500, threshold: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that the last model doesn't reject.

    Rows are judged by their text alone, repeated ones and those without an id
    alike; a null text is empty, a very long one is read whole. Other columns are passed on. Without labels all stay; an
    empty table stays empty.
    """
    models = train(docs, labels, categories, per_class)
    held = docs.sparkSession.sparkContext.broadcast(models)
    threshold = models[-1].cut if threshold is None else threshold

    def make():
        scorer = Scorer(held.value)
        return lambda text: scorer.scores(text)[-1] < threshold

    return filter_texts(docs, make)
