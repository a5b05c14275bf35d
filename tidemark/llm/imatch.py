"""I-Match fingerprints: distinct terms of a document-frequency band, hashed over randomised lexicon subsets."""

from __future__ import annotations

import bisect
import hashlib
import string
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, read, small_batches, texts

EDGES = string.punctuation + "¡¿«»“”„‘’…–—"
#: Eight random orders of the lexicon; of each the subsets that keep a half, a quarter, ... of the one before.
SEEDS = np.random.default_rng(9).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
LIMITS = (2.0 ** (64 - np.arange(1, 12))).astype(np.uint64)


def terms(text: str) -> set[str]:
    """Distinct lower-cased words without the punctuation at their ends."""
    found = {w.strip(EDGES) for w in set(text.lower().split())}
    found.discard("")
    return found


def document_frequencies(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """(term, df) over all documents; counted within each task before the shuffle, in a table of bounded size."""

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(terms(t))
                if len(seen) > flush:
                    yield {"term": list(seen), "df": list(seen.values())}
                    seen = Counter()
        if seen:
            yield {"term": list(seen), "df": list(seen.values())}

    small_batches(docs.sparkSession)
    partial = map_batches(texts(docs).select("text"), run, "term string, df long")
    return partial.groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, low: float = 0.0005, high: float = 0.1) -> dict[str, int]:
    """Hashes of the terms whose share of the documents lies in [low, high], that is whose idf lies in [-ln high, -ln low].

    At most (mean number of distinct terms per document) / low terms pass, however many documents there are: the sum of
    all document frequencies is the documents times that mean.
    """
    n = docs.count()
    band = document_frequencies(docs).where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n)))
    return {r["term"]: xxhash.xxh3_64_intdigest(r["term"]) for r in band.select("term").collect()}


def signature(text: str, kept: dict[str, int]) -> list[tuple[int, int]]:
    """(terms, at most 255; hash of the sorted terms) for each lexicon subset. Of a text without a lexicon term all terms count."""
    found = terms(text)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([kept[t] for t in found if t in kept] or [digest(t) for t in found], np.uint64)
    out = []
    for seed in SEEDS:
        order = np.sort((hashes ^ seed) * np.uint64(0x9E3779B97F4A7C15))
        for n in [len(order), *np.searchsorted(order, LIMITS).tolist()]:
            out.append((min(n, 255), digest(order[:n].tobytes()) & 0xFFFF))
    return out


def likeness(a, b) -> float:
    """Weighted share of the lexicon subsets on which two fingerprints agree; 0 to 1, and 1 for equal fingerprints.

    A subset that neither text has a term of says nothing; else it counts the less, the more terms it has, as one
    changed term is enough to change its hash.
    """
    agree = total = 0.0
    for (n, x), (m, y) in zip(a, b, strict=True):
        if n or m:
            weight = 1 / max(n, m)
            total += weight
            agree += weight * (n == m and x == y)
    return agree / total if total else 1.0


def written(sig) -> str:
    return "".join(f"{n:02x}{x:04x}" for n, x in sig)


def fingerprint_documents(docs: DataFrame, kept: dict[str, int]) -> DataFrame:
    """(doc_id, fingerprint) of each text; equal texts have equal fingerprints, null and empty ones that of no terms."""

    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "fingerprint": [written(signature(t, kept)) for t in b["text"]]}

    small_batches(docs.sparkSession)
    return map_batches(texts(docs), run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, partitions: int):
    """Rows (bucket, peek, doc_id, text) such that, in order of (peek, doc_id, text), each row of a bucket is followed by
    its next document: buckets are ranges of doc_id, and the first row of each comes along, as ``peek``, to the bucket before.

    A doc_id that occurs often may hold one bucket alone; ids are unique in ``documents``.
    """
    ids = docs.select("doc_id")
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", list(np.linspace(0, 1, 4 * partitions + 1)[1:-1]), 0.0005)}) if partitions > 1 else []

    def deal(batches):
        for b in batches:
            yield b | {"bucket": [bisect.bisect_right(cuts, i) for i in b["doc_id"]]}

    dealt = map_batches(ids, deal, "doc_id long, bucket int")
    firsts = sorted((r["bucket"], r["first"]) for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())
    to = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}  # the first of all follows the last

    def rows(batches):
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                out.append((bisect.bisect_right(cuts, i), 0, i, t))
                if i in to:
                    out.append((to[i], 1, i, t))
            yield dict(zip(("bucket", "peek", "doc_id", "text"), map(list, zip(*out, strict=True)) if out else [[]] * 4, strict=True))

    return map_batches(docs, rows, "bucket int, peek int, doc_id long, text string").repartition(partitions, "bucket").sortWithinPartitions("bucket", "peek", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many (or all) of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compare_with_edit(docs: DataFrame, kept: dict[str, int], partitions: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness; see ``edited`` and ``likeness``.

    Texts are shuffled once, by ranges of doc_id, and streamed in order; a task holds one batch. One document alone is
    its own next one; of rows that share a doc_id the text decides the order. Rows without a doc_id have no place in the
    order: they come back with their fingerprint alone. No rows, no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def result(doc, following, sig, next_sig):
        changed = edited(doc[3], following)
        other = signature(changed, kept) if changed != doc[3] else sig
        return (doc[2], len(doc[3]), hashlib.sha256(changed.encode()).hexdigest(), written(sig), written(other), likeness(sig, other), likeness(sig, next_sig))

    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def run(batches):
        held = sig = None
        for b in batches:
            rows = []
            for row in zip(b["bucket"], b["peek"], b["doc_id"], b["text"], strict=True):
                own = signature(row[3], kept)
                if held and held[0] == row[0] and not held[1]:
                    rows.append(result(held, row[3], sig, own))
                held, sig = row, own
            yield dict(zip(names, map(list, zip(*rows, strict=True)) if rows else [[] for _ in names], strict=True))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    own = texts(docs)
    compared = map_batches(with_next(own.where("doc_id is not null"), partitions), run, schema)
    rest = own.where("doc_id is null")
    alone = map_batches(rest, lambda batches: ({"doc_id": b["doc_id"], "n_chars": [len(t) for t in b["text"]], "fingerprint": [written(signature(t, kept)) for t in b["text"]]} | {n: [None] * len(b["text"]) for n in ("edited_sha256", "edited_fingerprint", "near_edited", "near_next")} for b in batches), schema)
    return compared.union(alone)


def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text and both likenesses; see ``compare_with_edit``."""
    docs = read(spark, sf_dir, "documents")
    return compare_with_edit(docs, lexicon(docs))
