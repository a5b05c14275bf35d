"""Quality: Bradley-Terry strengths from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, map_batches, read, small_batches, texts

MARKS = [ord(c) for c in string.punctuation if c not in ".,;:'-"]
NAMES = ("chars", "words", "distinct", "word_length", "marks", "punctuation", "capitals", "digits", "top_word", "top_three", "runs", "lines", "short_lines", "line_repeats", "short_words", "long_words", "other_bytes", "pair_repeats", "edge_marks", "inner_marks")


def features(text: str) -> list[float]:
    """Shape of a text, in the order of NAMES; all 0 for a text without words. Whole texts, whatever their length."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n, counts = len(words), Counter(words)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size, top = max(1, int(raw.sum())), counts.most_common(3)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    weighed = [(w, k) for w, k in counts.items()]
    return [
        np.log1p(len(text)),
        np.log1p(n),
        len(counts) / n,
        sum(len(w) * k for w, k in weighed) / n,
        raw[MARKS].sum() / n,
        raw[[ord(c) for c in ".,;:"]].sum() / n,
        sum(k for w, k in weighed if len(w) > 1 and w.isupper()) / n,
        raw[48:58].sum() / size,
        top[0][1] / n,
        sum(k for _, k in top) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(lines) / n,
        sum(len(x) < 20 for x in lines) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(k for w, k in weighed if len(w) <= 3) / n,
        sum(k for w, k in weighed if len(w) >= 14) / n,
        raw[128:].sum() / size,
        1 - pairs / max(1, n - 1),
        sum(k for w, k in weighed if not w[-1].isalnum() and w[-1] not in ".,;:") / n,
        sum(k for w, k in weighed if not w[1:-1].isalnum() and len(w) > 2) / n,
    ]


def feature_rows(docs: DataFrame, *more: str) -> DataFrame:
    """``more`` columns of ``docs`` and ``features`` array<double>."""
    kept = ["doc_id", *more]

    def run(batches):
        for b in batches:
            yield {c: b[c] for c in kept} | {"features": [features(t) for t in b["text"]]}

    small_batches(docs.sparkSession)
    table = texts(docs, *more)
    types = dict(table.dtypes)
    return map_batches(table, run, ", ".join(f"{c} {types[c]}" for c in kept) + ", features array<double>")


@dataclass(frozen=True)
class Model:
    """Strength of a text is weights . basis(features); its score is 0.3, or ``at``, at the strength ``cut``."""

    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    at: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        """Scaled features, and for each the step functions at the edges of its bins."""
        x = np.asarray(x, float).reshape(-1, len(self.mean))
        return np.hstack([np.clip((x - self.mean) / self.scale, -5, 5), (x[:, :, None] > self.edges[None]).reshape(len(x), -1)])

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        odds = np.log(self.at / (1 - self.at)) + self.slope * (self.strengths(x) - self.cut)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _logistic(d: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights that minimise sum(log(1 + exp(-d w))) + ridge |w|^2 / 2, by Newton steps."""
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        grad = d.T @ p - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, at: float = 0.3, bins: int = 6, pairs: int = 40_000, ridge: float = 2.0) -> Model:
    """Bradley-Terry: in each of ``pairs`` drawn pairs the text labelled 1 is preferred to the one labelled 0.

    The cut is the score quantile at the labelled share of 0. With one label only, every text gets that label.
    """
    x, y = np.asarray(x, float).reshape(-1, len(NAMES)), np.asarray(y, int)
    if len(x) == 0:
        x, y = np.zeros((1, len(NAMES))), np.ones(1, int)
    edges = np.quantile(x, np.linspace(0, 1, bins + 2)[1:-1], axis=0).T
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    if len(bad):  # half of the edges where the rarer label lies
        edges = np.hstack([edges, np.quantile(x[bad], np.linspace(0, 1, bins + 2)[1:-1], axis=0).T])
    blank = Model(x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0), edges, np.zeros(0), 0.0, 1.0, at)
    width = blank.basis(x[:1]).shape[1]
    if not len(good) or not len(bad):
        return Model(blank.mean, blank.scale, edges, np.zeros(width), -5.0 if len(good) else 5.0, 1.0, at)
    rng = np.random.default_rng(1)
    basis = blank.basis(x)
    w = _logistic(basis[rng.choice(good, pairs)] - basis[rng.choice(bad, pairs)], ridge)
    s = basis @ w
    share = len(bad) / len(y)
    ordered = np.sort(s)
    at_rank = int(round(share * len(s)))
    cut = float((ordered[max(0, at_rank - 1)] + ordered[min(at_rank, len(s) - 1)]) / 2)
    # how far scores move from the cut with strength: one slope, by logistic loss on the single labels
    slope, offset = 1.0, np.log(at / (1 - at))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(offset + slope * (s - cut), -40, 40)))
        move = ((y - p) @ (s - cut) - 1e-3 * slope) / ((p * (1 - p)) @ (s - cut) ** 2 + 1e-3)
        slope = float(np.clip(slope + move, 0.05, 20))
    return Model(blank.mean, blank.scale, edges, w, cut, slope, at)


def train(docs: DataFrame, labels: DataFrame, at: float = 0.3, most: int = 20_000) -> Model:
    """Fit on at most ``most`` labelled rows, those least by a hash of doc_id. Rows with a null label are left out."""
    y = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    picked = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = feature_rows(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "quality").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit(np.array([r["features"] for r in rows]), np.array([r["quality"] for r in rows], int), at)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; empty and null texts are scored like any other."""

    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": model.scores([features(t) for t in b["text"]]) if b["text"] else []}

    small_batches(docs.sparkSession)
    return map_batches(texts(docs), run, "doc_id long, score double")


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document. Null and empty texts are scored like any other; repeated rows
    and rows without a doc_id each; of labels that share a doc_id the highest counts. No rows, no rows."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id", 5, 0)))
    scored = score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go; the others keep all their columns. Null and empty texts are scored like any other,
    repeated rows each; no rows, no rows."""
    model = train(docs, read(spark, sf_dir, "labels"))
    own = docs.columns

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            found = [t or "" for t in b.column(own.index("text")).to_pylist()]
            keep = model.scores([features(t) for t in found]) >= 0.3 if found else np.zeros(0, bool)
            yield b.filter(pc.cast(pa.array(keep), pa.bool_()))

    small_batches(spark)
    return docs.mapInArrow(run, docs.schema)
