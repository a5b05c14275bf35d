"""Edit-aware token counts: a segment tree of pre-token runs per document; an edit re-encodes only what it touches."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, read, small_batches, texts

#: A match of the pattern may look at so many characters past its end (a contraction's two letters, the one after white space).
LOOK = 3
EDIT = "array<struct<start:long,removed:long,added:string>>"


class Counter:
    """Tokens of single pre-tokens, with a bounded memo."""

    def __init__(self, path: str, pattern: str, memo: int = 500_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.match = regex.compile(pattern).match
        self.findall = regex.compile(pattern).findall
        self.memo, self.most = {}, memo

    def count(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            n = self.memo[piece] = len(self.encode(piece))
        return n


class CountTree:
    """Pre-tokens of a text in runs of about ``run``; the tree holds each subtree's characters and tokens.

    The leaves are runs, so that an edit that makes more or fewer pre-tokens changes a leaf's list and the sums above it,
    not the tree's shape.
    """

    def __init__(self, text: str, counter: Counter, run: int = 32):
        self.counter, self.text = counter, text
        words = counter.findall(text)
        pairs = list(zip(map(len, words), map(counter.count, words), strict=True))
        self.runs = [pairs[i : i + run] for i in range(0, len(pairs), run)] or [[]]
        self.size = 1 << (len(self.runs) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        for k, r in enumerate(self.runs):
            self.sums[self.size + k] = self._sum(r)
        for k in range(self.size - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]
        self.reencoded = 0

    @staticmethod
    def _sum(run) -> tuple[int, int]:
        return sum(c for c, _ in run), sum(n for _, n in run)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def _leaf(self, position: int) -> tuple[int, int]:
        """(run, its first character) of the run that holds ``position``; the last run for the text's end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.size, len(self.runs) - 1), start

    def edit(self, start: int, removed: int, added: str) -> None:
        """Replace ``removed`` characters at ``start`` by ``added`` (both cut to the text); count again from the last
        boundary that cannot depend on them to the first old boundary that the new pre-tokens meet again."""
        start = max(0, min(start, len(self.text)))
        removed = max(0, min(removed, len(self.text) - start))
        shift = len(added) - removed
        self.text = self.text[:start] + added + self.text[start + removed :]
        first, at = self._leaf(max(0, start - LOOK))
        keep, position = [], at
        for size, n in self.runs[first]:
            if position + size + LOOK > start:
                break
            keep.append((size, n))
            position += size
        if not keep and first:  # the token before may reach into the edit
            first -= 1
            while first and not self.runs[first]:
                first -= 1
            at -= int(self.sums[self.size + first, 0])
            position = at
            for size, n in self.runs[first]:
                if position + size + LOOK > start:
                    break
                keep.append((size, n))
                position += size
        last, old = first, at  # old: boundary in the old text, run by run
        rest, boundary = list(self.runs[first]), at
        new, here = [], position
        while True:
            while boundary + shift < here or boundary < start + removed:  # old boundaries that are behind
                if rest:
                    boundary += rest.pop(0)[0]
                elif last + 1 < len(self.runs):
                    last += 1
                    rest = list(self.runs[last])
                else:
                    break
            if (boundary + shift == here and boundary >= start + removed) or here >= len(self.text):
                break
            piece = self.counter.match(self.text, here).group()
            new.append((len(piece), self.counter.count(piece)))
            here += len(piece)
            self.reencoded += 1
        if here >= len(self.text) and boundary + shift != here:
            rest = []
        for k in range(first, last + 1):
            self.runs[k] = []
        self.runs[first] = keep + new + (rest if last == first else [])
        if last != first:
            self.runs[last] = rest
        for k in {first, *range(first, last + 1)}:
            self._update(k)

    def _update(self, run: int) -> None:
        node = self.size + run
        self.sums[node] = self._sum(self.runs[run])
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """One for each Python worker."""
    return Counter(path, pattern)


def count_with_edits(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, n_edits, edited_tokens, reencoded, n_pretokens) for ``docs`` with a column ``edits``.

    ``edits`` is an array of (start, removed, added), in code points, applied one after the other, each to the text that
    the one before left. A null or empty text has 0 tokens; null edits are none; a null in an edit is 0 or ''; places
    beyond the text are cut to it. Repeated rows are counted each; no rows, no rows.
    """

    def run(batches):
        own = counter(path, pattern)
        for b in batches:
            rows = []
            for doc, text, edits in zip(b["doc_id"], b["text"], b["edits"], strict=True):
                tree = CountTree(text, own)
                n, pieces = tree.tokens, sum(map(len, tree.runs))
                for e in edits or []:
                    if e:
                        tree.edit(e["start"] or 0, e["removed"] or 0, e["added"] or "")
                rows.append((doc, n, len(edits or []), tree.tokens, tree.reencoded, pieces))
            names = ("doc_id", "n_tokens", "n_edits", "edited_tokens", "reencoded", "n_pretokens")
            yield dict(zip(names, map(list, zip(*rows, strict=True)) if rows else [[] for _ in names], strict=True))

    small_batches(docs.sparkSession)
    table = texts(docs, F.col("edits").cast(EDIT).alias("edits"))
    return map_batches(table, run, "doc_id long, n_tokens long, n_edits long, edited_tokens long, reencoded long, n_pretokens long")


def standard_edits(docs: DataFrame) -> DataFrame:
    """Every document with three edits: a heading put first, ten characters in the middle redacted, the last twenty cut."""
    n = F.length(F.coalesce("text", F.lit("")))
    heading = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit("\n"))

    def edit(start, removed, added):
        return F.struct(start.cast("long").alias("start"), removed.cast("long").alias("removed"), added.alias("added"))

    middle = F.length(heading) + F.floor(n / 2)
    redacted = F.length(heading) + n - F.least(F.lit(10), n - F.floor(n / 2)) + 10
    edits = F.array(edit(F.lit(0), F.lit(0), heading), edit(middle, F.lit(10), F.lit("[redacted]")), edit(F.greatest(redacted - 20, F.lit(0)), F.lit(20), F.lit("")))
    return docs.select("doc_id", "text", edits.alias("edits"))


def op10_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after ``standard_edits``; see ``count_with_edits``."""
    import public_tokenizers as p

    docs = standard_edits(read(spark, sf_dir, "documents"))
    return count_with_edits(docs, p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
