"""Toxicity: nearest labelled examples by exact cosine of TF-IDF weights over a block-max inverted index, with weighted votes."""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, map_batches, materialize, read, small_batches, texts
from tidemark.llm.imatch import EDGES


def term_counts(text: str) -> dict[str, int]:
    """Counts of lower-cased words without the punctuation at their ends."""
    out: dict[str, int] = {}
    for w, n in Counter(text.lower().split()).items():
        w = w.strip(EDGES)
        if w:
            out[w] = out.get(w, 0) + n
    return out


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples as postings by term, in blocks of ``block`` examples with each term's largest weight.

    A query bounds every block by its terms' block maxima. It opens blocks in falling order of the bound, in
    waves that grow; blocks whose bound is under the k-th best cosine found stay closed: the k nearest are exact. Terms
    that a sixteenth of the examples or more hold have a full row of weights in place of postings; their sums are there
    before any block is opened, and a block's bound takes the largest.

    ``terms`` numbers the terms and ``idf`` weighs them; ``own`` holds each example's term numbers and counts, one
    example behind the other, ``sizes`` how many are whose. An index travels as these, compressed, and is built again
    where it arrives.
    """

    def __init__(self, terms: dict[str, int], idf: np.ndarray, docs, labels, own: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, block: int = 64):
        self.given = zlib.compress(pickle.dumps((list(terms), np.asarray(idf), np.asarray(docs), np.asarray(labels), tuple(np.asarray(x, np.int32) for x in own), np.asarray(sizes), block)), 1)
        self.terms, self.idf, n, sizes = terms, np.asarray(idf, float), len(docs), np.asarray(sizes, np.int64)
        term, count = np.asarray(own[0], np.int64), np.asarray(own[1], float)
        example = np.repeat(np.arange(n), sizes)
        weight = (1 + np.log(np.maximum(count, 1))) * self.idf[term]
        weight /= np.maximum(np.sqrt(np.bincount(example, weights=weight**2, minlength=n)), 1e-300)[example]
        top = np.lexsort((term, -weight, example))  # the heaviest term first: like examples share blocks
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        heaviest = np.where(sizes > 0, term[top[np.minimum(firsts, max(0, len(top) - 1))]], -1) if len(top) else np.full(n, -1)
        order = np.lexsort((docs, heaviest, labels))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.docs, self.labels = np.asarray(docs, np.int64)[order], np.asarray(labels, float)[order]
        self.block, self.blocks = block, max(1, -(-n // block))
        example = place[example]
        by_term = np.lexsort((example, term))
        term, example, weight = term[by_term], example[by_term], weight[by_term]
        frequent = np.bincount(term, minlength=len(self.idf)) * 16 >= max(1, n)
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.rows = np.zeros((int(frequent.sum()), self.blocks * block))
        full = frequent[term]
        self.rows[self.row[term[full]], example[full]] = weight[full]
        self.rows = self.rows.reshape(-1, self.blocks, block)
        # the other terms: postings in cells, a cell to a term and block
        term, self.example, self.weight = term[~full], example[~full].astype(np.int32), weight[~full]
        cell = term * self.blocks + self.example // block
        self.cell_starts = np.append(np.nonzero(np.diff(cell, prepend=-1))[0], len(cell))
        starts = self.cell_starts[:-1]
        self.cell_block = (self.example[starts] // block).astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.term_cells = np.searchsorted(term[starts], np.arange(len(self.idf) + 1))

    def __reduce__(self):
        return _arrived, (self.given,)

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Indices and weights, of length 1, over the terms known; empty where there is none."""
        at = np.fromiter((self.terms.get(t, -1) for t in counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), float, len(counts))[at >= 0]
        at = at[at >= 0]
        order = np.argsort(at)
        at, n = at[order], n[order]
        w = (1 + np.log(n)) * self.idf[at]
        return at, w / max(np.sqrt(w @ w), 1e-300)

    def nearest(self, counts: dict[str, int], k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine over 0, nearest first; ties by doc_id. ``without``: a doc_id left out."""
        return next(self.nearest_of([counts], k, [without]))

    def nearest_of(self, many: list[dict[str, int]], k: int, without: list | None = None, step: int = 64):
        """Yield what ``nearest`` gives for each of ``many``. The frequent terms' sums are one product for ``step`` queries."""
        for first in range(0, len(many), step):
            vectors = [self.vector(c) for c in many[first : first + step]]
            on = np.zeros((len(vectors), len(self.rows)))
            for i, (at, w) in enumerate(vectors):
                row = self.row[at]
                on[i, row[row >= 0]] = w[row >= 0]
            sums = on @ self.rows.reshape(len(self.rows), self.blocks * self.block)
            for i, (at, w) in enumerate(vectors):
                yield self._nearest(at, w, sums[i], k, without[first + i] if without else None)

    def _nearest(self, at: np.ndarray, w: np.ndarray, sums: np.ndarray, k: int, without: int | None):
        """``sums`` holds every example's cosine by the frequent terms alone."""
        if not len(at) or not len(self.docs):
            return np.zeros(0, np.int64), np.zeros(0)
        rare = self.row[at] < 0
        cells, factor = _ranges(self.term_cells[at[rare]], self.term_cells[at[rare] + 1], w[rare])
        block = self.cell_block[cells]
        bounds = np.bincount(block, weights=self.cell_max[cells] * factor, minlength=self.blocks) + sums.reshape(self.blocks, self.block).max(axis=1)
        best, cosines, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        rest, wave = np.argsort(-bounds, kind="stable"), -(-4 * k // self.block)
        while True:
            rest = rest[(bounds[rest] > 0) & (bounds[rest] >= kth - 1e-9)]
            if not len(rest):
                break
            opened = np.zeros(self.blocks, bool)
            opened[rest[:wave]] = True
            inside = opened[block]
            picked, w_picked = _ranges(self.cell_starts[cells[inside]], self.cell_starts[cells[inside] + 1], factor[inside])
            found = np.where(np.repeat(opened, self.block), sums, 0.0)
            found += np.bincount(self.example[picked], weights=self.weight[picked] * w_picked, minlength=len(found))
            hit = np.nonzero(found > 0)[0]
            if without is not None:
                hit = hit[self.docs[hit] != without]
            more, near = self._best(hit, found[hit], k)
            best, cosines = self._best(np.concatenate([best, more]), np.concatenate([cosines, near]), k)
            kth = cosines[-1] if len(best) == k else 0.0
            rest, wave = rest[wave:], wave * 64
        return best, cosines

    def _best(self, examples: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rounded = np.round(cosines, 12)
        if len(examples) > k:
            near = rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k]
            examples, cosines, rounded = examples[near], cosines[near], rounded[near]
        order = np.lexsort((self.docs[examples], -rounded))[:k]
        return examples[order], cosines[order]


def _arrived(given: bytes) -> BlockMaxIndex:
    terms, *rest = pickle.loads(zlib.decompress(given))
    return BlockMaxIndex({t: i for i, t in enumerate(terms)}, *rest)


def _ranges(first: np.ndarray, end: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [first, end), one range behind the other, and each range's factor beside them."""
    sizes = end - first
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(total), np.repeat(factor, sizes)


@dataclass(frozen=True)
class Model:
    shared: Broadcast  # of the index
    k: int
    calibration: tuple[float, float]
    base: float
    unknown: float
    shrink: float = 6.0
    rates: tuple[float, float] = (1.0, 1.0)  # labelled rows that one example of label 0, of label 1, stands for

    @property
    def index(self) -> BlockMaxIndex:
        return self.shared.value

    def votes(self, many: list[dict[str, int]], without: list | None = None):
        """Yield for each text the weighted share of toxic among the nearest (the weight grows as the distance falls), drawn towards the base
        rate as by ``shrink`` far examples, and the evidence. An example weighs as many labelled rows as it stands for,
        so that a bound on either label's examples leaves the labelled share as it is."""
        index = self.index
        for found, cosines in index.nearest_of(many, self.k, without):
            weights = np.where(index.labels[found] > 0, self.rates[1], self.rates[0]) / (1.1 - np.minimum(cosines, 1.0))
            share = (weights @ index.labels[found] + self.shrink * self.base) / (weights.sum() + self.shrink)
            yield float(share) if len(found) else None, found, cosines

    def calibrated(self, vote: float | None) -> float:
        if vote is None:
            return self.unknown
        a, b = self.calibration
        return float(1 / (1 + math.exp(-max(-40.0, min(40.0, a * (2 * vote - 1) + b)))))


def relevance(n0: np.ndarray, n1: np.ndarray, total0: int, total1: int, prior: float = 5.0, least: float = 0.05) -> np.ndarray:
    """Factor on a term's idf: ``least`` plus the squared log odds of toxic in labelled rows with the term against all of them.

    Counts are drawn towards the base rate by as many rows as hold ``prior`` of the rarer label, so that a term of few
    rows says little (one row alone less than ``least``); no term has the factor 0.
    """
    base = (total1 + 0.5) / (total0 + total1 + 1)
    rows = prior / min(base, 1 - base)
    return least + (np.log((n1 + rows * base) / (n0 + rows * (1 - base))) - np.log(base / (1 - base))) ** 2


def train(docs: DataFrame, labels: DataFrame, k: int = 31, examples: int = 2048) -> Model:
    """Index labelled examples by all of their terms, and calibrate their votes, each example without itself.

    Examples are at most ``examples`` labelled rows of either label, those least by a hash of doc_id; votes and calibration
    weigh them by the inverse of their label's share kept. The vocabulary is every term of the examples. A term weighs
    its idf over all documents times its ``relevance``, counted over all labelled rows. Equal texts are one row here, toxic
    where any of them is. Rows with a null label or a null doc_id are left out; no labelled rows, an index of none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = texts(docs).join(F.broadcast(y) if y.count() < 2_000_000 else y, "doc_id")
    kept = materialize(marked.groupBy(F.xxhash64("text").alias("key")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic"), "labelled")
    totals = {r["toxic"]: r["n"] for r in kept.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    base = (n1 + 0.5) / (n0 + n1 + 1)
    picked = [kept.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for label in (0, 1)]

    def counted(batches):
        for b in batches:
            counts = [term_counts(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "toxic": b["toxic"], "terms": [list(c) for c in counts], "counts": [list(c.values()) for c in counts]}

    chosen = texts(docs).join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    held = materialize(map_batches(chosen.select("doc_id", "text", "toxic"), counted, "doc_id long, toxic int, terms array<string>, counts array<int>").dropDuplicates(["doc_id"]), "examples")
    rows = held.orderBy("doc_id").toArrow().combine_chunks()
    words = pc.list_flatten(rows["terms"]).combine_chunks()
    words = words.dictionary_encode()
    names = words.dictionary.to_pylist() if len(words) else []
    found = _frequencies(docs, kept, names)
    idf = np.log((1 + docs.count()) / (1 + found[:, 0])) + 1
    sizes = pc.list_value_length(rows["terms"]).to_numpy().astype(np.int64)
    own = words.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int32), pc.list_flatten(rows["counts"]).to_numpy()
    toxic, ids = rows["toxic"].to_numpy(), rows["doc_id"].to_numpy()
    del words, rows
    index = BlockMaxIndex({t: i for i, t in enumerate(names)}, idf * relevance(found[:, 1], found[:, 2], n0, n1), ids, toxic, own, sizes)
    blank = sizes == 0
    unknown = float((toxic[blank].sum() + base) / (blank.sum() + 1))
    each = [totals.get(label, 0) / max(1, int((toxic == label).sum())) for label in (0, 1)]
    mean = (n0 + n1) / max(1, len(ids))
    model = Model(spark.sparkContext.broadcast(index), k, (8.0, 0.0), base, unknown, rates=tuple(x / mean for x in each) if n0 + n1 else (1.0, 1.0))
    return replace(model, calibration=_calibrate(model, held))


def _frequencies(docs: DataFrame, kept: DataFrame, terms: list[str]) -> np.ndarray:
    """A row a term: how many documents hold it, and how many of the labelled rows ``kept`` with label 0, with label 1.

    Tasks count into arrays as long as the vocabulary; what is shuffled are the terms seen, and their sums come back.
    """
    n, shared = len(terms), docs.sparkSession.sparkContext.broadcast(zlib.compress("\n".join(terms).encode(), 1))  # no term holds white space

    def run(batches):
        number = {t: i for i, t in enumerate(zlib.decompress(shared.value).decode().split("\n"))}
        sums = np.zeros((n, 3), np.int64)
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                at = [i for i in map(number.get, {w.strip(EDGES) for w in set(text.lower().split())}) if i is not None]
                sums[at, 0] += 1
                if toxic is not None:
                    sums[at, 1 + toxic] += 1
        seen = np.nonzero(sums[:, 0])[0]
        yield {"term": seen, "n": sums[seen, 0], "n0": sums[seen, 1], "n1": sums[seen, 2]}

    joined = texts(docs).join(F.broadcast(kept) if kept.count() < 2_000_000 else kept, "doc_id", "left").select("text", "toxic")
    out = np.zeros((n, 3))
    if n:
        sums = map_batches(joined, run, "term int, n long, n0 long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
        shared.unpersist()
        out[sums["term"].to_numpy()] = np.stack([sums[c].to_numpy() for c in ("n", "n0", "n1")], axis=1)
    return out


def _calibrate(model: Model, held: DataFrame) -> tuple[float, float]:
    """Slope and offset of the log odds in the vote, by weighted logistic loss on the votes of all examples, each without itself."""

    def run(batches):
        for b in batches:
            many = [dict(zip(t, n, strict=True)) for t, n in zip(b["terms"], b["counts"], strict=True)]
            yield {"doc_id": b["doc_id"], "vote": [v for v, *_ in model.votes(many, b["doc_id"])], "toxic": b["toxic"]}

    found = map_batches(held.repartition(max(8, len(model.index.docs) // 512)), run, "doc_id long, vote double, toxic int").where("vote is not null").collect()
    votes = [(r["vote"], r["toxic"]) for r in sorted(found, key=lambda r: r["doc_id"])]
    weight = np.array([model.rates[y > 0] for _, y in votes])
    if len({y for _, y in votes}) < 2:
        return 8.0, 0.0
    x, y = np.array([[2 * v - 1, 1.0] for v, _ in votes]), np.array([y for _, y in votes], float)
    w, prior = np.array([4.0, 0.0]), np.array([4.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (weight * (y - p)) - 0.05 * (w - prior))
    return (float(w[0]), float(w[1])) if w[0] > 0 else (8.0, 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence): evidence lists the nearest examples with cosine and label, nearest first.

    A text without a known term, such as a null or empty one, gets the labelled share of toxic among such texts and no
    evidence. Whole texts, whatever their length. Repeated rows and rows without a doc_id are scored each; no rows, no rows.
    """

    def run(batches):
        index = model.index
        for b in batches:
            scores, evidence = [], []
            for vote, found, cosines in model.votes([term_counts(t) for t in b["text"]]):
                scores.append(model.calibrated(vote))
                evidence.append([{"doc_id": int(index.docs[e]), "cosine": float(c), "toxic": int(index.labels[e])} for e, c in zip(found, cosines, strict=True)])
            yield {"doc_id": b["doc_id"], "score": scores, "evidence": evidence}

    small_batches(docs.sparkSession)
    return map_batches(texts(docs), run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def op4_toxicity_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every document; see ``train`` and ``score``."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id", 3, 1)))
    scored = score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the others keep all their columns.

    A null or empty text is scored as in ``score``; repeated rows each; no rows, no rows.
    """
    model = train(docs, read(spark, sf_dir, "labels"))
    own = docs.columns

    def run(batches):
        for b in batches:
            found = [t or "" for t in b.column(own.index("text")).to_pylist()]
            yield b.filter(pa.array([model.calibrated(v) < 0.7 for v, *_ in model.votes([term_counts(t) for t in found])], pa.bool_()))

    small_batches(spark)
    return docs.mapInArrow(run, docs.schema)
