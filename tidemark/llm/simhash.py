"""SimHash near-duplicates: fingerprints, vantage-point shards, exact pairs at a small Hamming distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, map_batches, materialize, read, small_batches, texts


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64-bit majority fingerprint of the word shingles of ``text``: A-Z lower-cased, words split at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # a very long text in pieces
        part = np.array(hashes[at : at + 65_536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long; null and empty texts have 0."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b["text"]], dtype=np.uint64)
            yield {"doc_id": b["doc_id"], "fp": fps.view(np.int64)}

    small_batches(docs.sparkSession)
    return map_batches(texts(docs), run, "doc_id long, fp long")


def _between(x: np.ndarray, y: np.ndarray, radius: int):
    """Index pairs of x and y at distance <= radius, in blocks of bounded size."""
    step = max(1, 4_000_000 // max(1, len(y)))
    for at in range(0, len(x), step):
        i, j = np.nonzero(np.bitwise_count(x[at : at + step, None] ^ y[None, :]) <= radius)
        yield i + at, j


def vp_pairs(points: np.ndarray, radius: int, leaf: int = 512):
    """Yield index arrays (i, j) that hold every pair of ``points`` at Hamming distance <= radius, by a vantage-point tree.

    A node splits its points at the median distance m from a vantage point. By the triangle inequality a pair across the
    split has both ends within ``radius`` of m, so only those two rims are compared.
    """
    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        p = points[own]
        d = np.bitwise_count(p ^ p[0]) if len(own) else None
        if len(own) <= leaf or (inside := d <= np.median(d)).all():
            for i, j in _between(p, p, radius):
                ok = i < j
                yield own[i[ok]], own[j[ok]]
            continue
        m = d[inside].max()
        a, b = np.nonzero(inside & (d > m - radius))[0], np.nonzero(~inside & (d <= m + radius))[0]
        for i, j in _between(p[a], p[b], radius):
            yield own[a[i]], own[b[j]]
        stack += [own[inside], own[~inside]]


def _roots(n: int, pairs) -> np.ndarray:
    """Smallest index of each point's component."""
    root = np.arange(n)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], dtype=np.int64)


def shard_codes(fps: np.ndarray, vantages: np.ndarray, radii: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) for every shard a fingerprint belongs to.

    Level i puts a fingerprint inside or outside the ball of ``radii[i]`` round ``vantages[i]``; one inside whose distance
    is within ``radius`` of the border goes outside too. Two fingerprints within ``radius`` therefore share a shard.
    """
    rows, codes = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    for v, r in zip(vantages, radii, strict=True):
        d = np.bitwise_count(fps[rows] ^ v).astype(np.int64)
        both = (d <= r) & (d > r - radius)
        codes = np.concatenate([2 * codes + (d > r), 2 * codes[both] + 1])
        rows = np.concatenate([rows, rows[both]])
    return rows, codes


def link_components(classes: DataFrame, radius: int = 2, shard_size: int = 1024, sample: int = 4096) -> DataFrame:
    """(id, component) of those ids of ``classes`` (id, fp; distinct fp) that link to another within ``radius`` bits.

    Vantage points and radii come from a bounded sample (``sample`` fingerprints) and only steer the dealing: every
    fingerprint is dealt and the links are exact for any vantage points. A shard emits a star per local component,
    never its pairs.
    """
    n = classes.count()
    picked = np.array([r.fp for r in classes.orderBy(F.xxhash64(F.lit(7), "fp"), "fp").limit(sample).collect()], dtype=np.int64).view(np.uint64)
    levels = max(5, math.ceil(math.log2(max(n, 1) / shard_size))) if n else 0
    vantages = np.random.default_rng(11).integers(0, 2**64, levels, dtype=np.uint64)
    radii = np.array([int(np.median(np.bitwise_count(picked ^ v))) for v in vantages], dtype=np.int64)

    def deal(batches):
        for b in batches:
            ids, fps = np.array(b["id"], np.int64), np.array(b["fp"], np.int64)
            rows, codes = shard_codes(fps.view(np.uint64), vantages, radii, radius)
            yield {"shard": codes, "id": ids[rows], "fp": fps[rows]}

    def links(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("id")
        ids = shard["id"].to_numpy()
        root = _roots(len(ids), vp_pairs(shard["fp"].to_numpy().view(np.uint64), radius))
        far = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[far], "b": ids[root[far]]})

    dealt = map_batches(classes.select("id", "fp"), deal, "shard long, id long, fp long")
    return connected_components(dealt.groupBy("shard").applyInPandas(links, "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link at ``radius`` or fewer bits, directly or by a chain.

    component_id is the smallest doc_id reachable. Null and empty texts have fingerprint 0 and link like any other. Equal
    fingerprints are one class, told apart again at the end; repeated rows come back as often as they are. Rows without a
    doc_id have a fingerprint, link with nothing and have no component. No rows, no rows.
    """
    fps = materialize(fingerprints(docs, width), "fingerprints")
    classes = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    joined = link_components(classes, radius)
    labelled = classes.join(joined, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    found = fps.join(labelled, "fp", "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; see ``near_duplicates``."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group stays; see ``near_duplicates``.

    Rows that share the doc_id that stays all stay, as do rows without a doc_id. No rows, no rows.
    """
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti").select(*docs.columns)
