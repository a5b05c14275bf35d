"""Byte-level BPE: each merge is read off a segment tree over byte positions."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, read, small_batches, texts

NONE = np.int64(1) << 62


class Bpe:
    """Encoder and decoder for a file of ranks (base64 token, rank).

    Words of a call are encoded together, a tree to a word, words of like length side by side in one array.
    """

    def __init__(self, path: str, pattern: str, memo: int = 600_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = sorted((self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.keys, self.ids = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.memo, self.most = {}, memo

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that left and right make, NONE where they make none or right is missing (below 0)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((right >= 0) & (self.keys[at] == key), self.ids[at], NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of up to the same power of two of bytes.

        Leaf i of a word's tree holds rank << bits | i of the pair that begins at byte i, an inner node the least of its two
        children (bits: as many as the places need); so the root is the leftmost pair of least rank. A merge changes the pair's leaf, the leaf of its live
        left neighbour and the leaf of the token it takes in, each with the path above.
        """
        n, most = len(words), max(map(len, words))
        bits = max(1, (most - 1).bit_length())
        size = 1 << bits
        lengths, place = np.fromiter(map(len, words), np.int64, n)[:, None], np.arange(size)
        token = np.full((n, size + 1), -1, np.int64)
        token[:, :size][place < lengths] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        following = np.minimum(np.tile(place + 1, (n, 1)), lengths)
        before = np.tile(place - 1, (n, 1))
        rank = self.pair_rank(token[:, :-1], token[:, 1:])
        tree = np.full((n, 2 * size), NONE, np.int64)
        tree[:, size:] = np.where(rank < NONE, rank << bits | place, NONE)
        for level in range(size.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        live = np.nonzero(tree[:, 1] < NONE)[0]

        def put(rows, at, value):
            node = at + size
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while len(live):
            top = tree[live, 1]
            at, merged = top & (size - 1), top >> bits
            right = following[live, at]
            after = following[live, right]
            token[live, at] = merged
            token[live, right] = -2
            following[live, at] = after
            end = after < size
            before[live[end], after[end]] = at[end]
            put(live, right, NONE)
            rank = self.pair_rank(merged, token[live, after])
            put(live, at, np.where(rank < NONE, rank << bits | at, NONE))
            left = before[live, at]
            some = left >= 0
            if some.any():
                rows, left = live[some], left[some]
                rank = self.pair_rank(token[rows, left], merged[some])
                put(rows, left, np.where(rank < NONE, rank << bits | left, NONE))
            live = live[tree[live, 1] < NONE]
        ids, ends = token[token >= 0].tolist(), np.cumsum((token >= 0).sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words) -> None:
        """Put the words into the memo, a bounded table of what has been encoded already."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = list(words)
        lengths: dict[int, list] = {}
        for w in new:
            raw = w.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.memo[w] = [whole]
            else:
                lengths.setdefault((len(raw) - 1).bit_length(), []).append((w, raw))
        for bits, group in lengths.items():
            step = max(1, (1 << 19) >> bits)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                self.memo.update(zip((w for w, _ in part), self.merge([r for _, r in part]), strict=True))

    def encode(self, many: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(many), 512):
            split = [self.find(t) for t in many[at : at + 512]]
            self.learn(set().union(*split))
            memo = self.memo
            for words in split:
                ids: list[int] = []
                for w in words:
                    ids += memo[w]
                out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Bpe:
    """One for each Python worker."""
    return Bpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``; a null or empty text has no ids. Repeated rows are encoded each."""

    def run(batches):
        bpe = encoder(path, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": bpe.encode(b["text"])}

    small_batches(docs.sparkSession)
    return map_batches(texts(docs), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, content binary) of (doc_id, ids); null ids give empty content."""

    def run(batches):
        bpe = encoder(path, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "content": [bpe.decode(ids or []) for ids in b["ids"]]}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode the ids, in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches):
        bpe = encoder(path, pattern)
        for b in batches:
            ids = bpe.encode(b["text"])
            yield {
                "doc_id": b["doc_id"],
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            }

    small_batches(docs.sparkSession)
    return map_batches(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests. A null text is empty and has no ids; repeated rows and rows
    without a doc_id come back each; no rows, no rows."""
    import public_tokenizers as p

    return round_trip(read(spark, sf_dir, "documents"), p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)
