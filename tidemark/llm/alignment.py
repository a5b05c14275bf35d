"""Cross-tokenizer alignment: elementary intervals of two token sequences over the same bytes, and how common their links are."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import map_batches, materialize, read, small_batches, texts
from tidemark.llm.packing import token_ids

#: A link's key is the A id, shifted by so many bits, and the B id.
SHIFT = 32
SHARD = "shard long, pairs array<long>, freq array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, distinct array<int>, packed binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level_tokens(path: str) -> dict[int, bytes]:
    """The bytes of each id of a byte-level BPE file; an added token's are those of its string."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that such files write as themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in added} | added


def piece_tokens(model) -> dict[int, bytes]:
    """The bytes of each id of a sentencepiece model: U+2581 is a space, <0xHH> one byte; control and unknown ids have none."""
    out = {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out[i] = bytes([int(re.fullmatch("<0x([0-9A-F]{2})>", piece)[1], 16)])
        else:
            out[i] = b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode()
    return out


class Side:
    """A tokenizer as an encoder of texts, with the bytes of its tokens and their lengths."""

    def __init__(self, encode, tokens: dict[int, bytes]):
        self.encode = encode
        self.bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def written(self, last: str) -> list[bytes]:
        """Each id in decimal with a comma behind, then each with ``last`` behind."""
        return [f"{i}{mark}".encode() for mark in ("," + last) for i in range(len(self.bytes))]


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side, list[bytes]]:
    """A reads a space and the text by the file at ``path_a``, special strings as plain text; B the text by the model at
    ``path_b``. Also how A's ids and then B's are written within and at the end of a group."""
    import sentencepiece

    model, encode_a = sentencepiece.SentencePieceProcessor(model_file=path_b), token_ids(path_a, special=False)
    a = Side(lambda many: encode_a([f" {t}" for t in many]), byte_level_tokens(path_a))
    b = Side(lambda many: [model.encode(t) for t in many], piece_tokens(model))  # a list would start threads
    return a, b, a.written("|") + b.written(";")


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, place of the A token, place of the B token) of each elementary interval.

    Between two neighbouring ends of either side lies one interval, which one token of each side owns: it is the overlap
    of those two, and two tokens that overlap have one such interval. Ends are counted at every byte, not sorted.
    """
    size = int(max(ends_a[-1:].sum(), ends_b[-1:].sum())) + 1
    at_a, at_b = np.bincount(ends_a, minlength=size), np.bincount(ends_b, minlength=size)
    ends = np.flatnonzero(at_a | at_b)
    return ends, np.cumsum(at_a[ends]) - at_a[ends], np.cumsum(at_b[ends]) - at_b[ends]


def written_groups(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, size_a: int, size_b: int) -> np.ndarray:
    """Places in the table of ``sides`` for ``a1,a2|b1;a3|b2,b3;``: the groups' A and B ids in order.

    ``at_a`` and ``at_b`` say how many tokens end with each elementary interval; a group ends where tokens of both sides do.
    """
    shared = (at_a > 0) & (at_b > 0)
    upto_a, upto_b = np.cumsum(at_a), np.cumsum(at_b)
    first = np.zeros(len(at_a), np.int64)  # ends before, of those that close groups
    first[1:] = np.cumsum(shared)[:-1]
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.concatenate([[0], upto_b[shared]])[np.repeat(first, at_a)]] = a + np.repeat(shared, at_a) * size_a
    out[np.arange(len(b)) + upto_a[shared][np.repeat(first, at_b)]] = 2 * size_a + b + np.repeat(shared, at_b) * size_b
    return out


def align(texts_: list[str], side_a: Side, side_b: Side, table: list[bytes], chunk: int = 200_000):
    """Yield (n_a, n_b, n_groups, link keys, groups in writing) of each text, or None where it is empty or either side's
    bytes differ from a space and the text. Texts are laid side by side, ``chunk`` bytes at a time: their borders close groups."""
    held: list[tuple] = []
    size = 0

    def done():
        fine = [x for x in held if x]
        if fine:
            a, b = (np.fromiter(chain.from_iterable(x[k] for x in fine), np.int64) for k in (0, 1))
            ends_a, ends_b = np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b])
            ends, own_a, own_b = overlaps(ends_a, ends_b)
            at_a, at_b = np.diff(own_a, append=len(a)), np.diff(own_b, append=len(b))
            keys = (a[own_a] << SHIFT) | b[own_b]
            shared = ends[(at_a > 0) & (at_b > 0)]
            written = list(map(table.__getitem__, written_groups(a, b, at_a, at_b, len(side_a.bytes), len(side_b.bytes)).tolist()))
            border = np.cumsum([x[2] for x in fine])
            links, groups = (np.searchsorted(x, border, "right").tolist() for x in (ends, shared))
        token = link = group = k = 0
        for x in held:
            if x is None:
                yield None
                continue
            n = len(x[0]) + len(x[1])
            yield len(x[0]), len(x[1]), groups[k] - group, keys[link : links[k]], b"".join(written[token : token + n])[:-1]
            token, link, group, k = token + n, links[k], groups[k], k + 1

    for text in texts_:
        whole = b" " + text.encode()
        (a,), (b,) = side_a.encode([text]), side_b.encode([text])
        same = text and all(b"".join(map(side.bytes.__getitem__, ids)) == whole for side, ids in ((side_a, a), (side_b, b)))
        held.append((a, b, len(whole)) if same else None)
        size += len(whole)
        if size >= chunk:
            yield from done()
            held, size = [], 0
    yield from done()


def _ints(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _from_ints(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def aligned_shards(docs: DataFrame, path_a: str, path_b: str, shard_links: int = 6_000_000) -> DataFrame:
    """Rows of SHARD: documents side by side, of about ``shard_links`` links, under a dictionary of their distinct links.

    ``freq`` says how many of the shard's documents hold a link. Of each document ``packed`` keeps, for its ``distinct``
    links, the place in the dictionary (as steps) and how often it occurs.
    """
    out = to_arrow_schema(StructType.fromDDL(SHARD))

    def run(batches):
        side_a, side_b, table = sides(path_a, path_b)
        task = TaskContext.get()
        count, rows, keys, times, links = 0, [], [], [], 0

        def shard():
            nonlocal count, rows, keys, times, links
            sizes = np.array([len(k) for k in keys])
            pairs, place, freq = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            steps, first = np.diff(place, prepend=0), (np.cumsum(sizes) - sizes)[sizes > 0]
            steps[first] = place[first]
            packed = _ints(np.concatenate([steps, np.concatenate(times)]))
            number = (task.partitionId() << 24) + count if task else count
            columns = [list(c) for c in zip(*rows, strict=True)]
            values = [number, pairs, freq.astype(np.int32), *columns, sizes.astype(np.int32), packed]
            batch = pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for f, v in zip(out, values, strict=True)], schema=out)
            count, rows, keys, times, links = count + 1, [], [], [], 0
            return batch

        none = np.zeros(0, np.int64)
        for b in batches:
            for doc, found in zip(b.column("doc_id").to_pylist(), align(b.column("text").to_pylist(), side_a, side_b, table), strict=True):
                if found is None:
                    rows.append((doc, 0, 0, 0, 0, ""))
                    own, n = none, none
                else:
                    own, n = np.unique(found[3], return_counts=True)
                    rows.append((doc, *found[:3], len(found[3]), hashlib.sha256(found[4]).hexdigest()))
                keys.append(own)
                times.append(n)
                links += rows[-1][4]
                if links >= shard_links or len(rows) >= 50_000:
                    yield shard()
        if rows:
            yield shard()

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, SHARD)


def link_counts(shards: DataFrame) -> DataFrame:
    """(shard, place, key, count): of each link in a shard's dictionary, how many documents of all hold it."""
    held = shards.select("shard", F.posexplode(F.arrays_zip("pairs", "freq")).alias("place", "p")).select("shard", "place", F.col("p.pairs").alias("key"), F.col("p.freq").alias("freq"))
    return held.select("shard", "place", "key", F.sum("freq").over(Window.partitionBy("key")).alias("count"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, shard_links: int = 6_000_000) -> DataFrame:
    """Rows of RESULT, one a row of ``docs``: tokens, groups and links of both tokenizers, and how common the links are.

    ``n_best`` counts the links whose key is in as many documents as any of the same A id, ``count_sum`` adds up the
    documents that hold each link. Texts that are null, empty or not what either side's tokens say have zeros and an empty
    digest. Rows that repeat, or have no doc_id, are documents of their own. No rows, no rows.

    Texts are read once. Counts are summed by link and go back to the shards that hold it, so that a link has at most
    one row a shard, however common. The best count of each A id is as large a table as A's vocabulary.
    """
    shards = materialize(aligned_shards(docs, path_a, path_b, shard_links), "aligned")
    counted = materialize(link_counts(shards.select("shard", "pairs", "freq")), "links")
    token = F.shiftright("key", SHIFT)
    best = counted.groupBy(token.alias("a")).agg(F.max("count").alias("most"))  # a row an id of A
    marked = counted.join(F.broadcast(best), token == F.col("a")).select("shard", "place", (F.col("count") * 2 + (F.col("count") == F.col("most")).cast("long")).alias("c"))
    dictionary = marked.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: x["c"]).alias("counts"))
    joined = shards.drop("pairs", "freq").join(dictionary, "shard", "left")

    def run(batches):
        for b in batches:
            for row in range(len(b["shard"])):
                sizes, both = np.array(b["distinct"][row]), _from_ints(b["packed"][row]).astype(np.int64)
                steps, times = both[: len(both) // 2], both[len(both) // 2 :]
                doc, begun = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
                before = np.cumsum(steps) - steps
                counts = np.array(b["counts"][row] or [0], np.int64)[before + steps - before[begun]]
                n_best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                np.add.at(n_best, doc, times * (counts & 1))
                np.add.at(total, doc, times * (counts >> 1))
                yield {"n_best": n_best.tolist(), "count_sum": total.tolist()} | {n: b[n][row] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}

    return map_batches(joined, run, RESULT)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its alignment under the two public tokenizers; see ``align_documents``."""
    import public_tokenizers as p

    return align_documents(read(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))
