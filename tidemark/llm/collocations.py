"""Phrase collocations: compressed position bitmaps per word and shard, extended depth-first by shift, AND and popcount."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import map_batches, materialize, read, small_batches

#: Positions of a bitmap's word. Small words keep an AND from meeting words that stand elsewhere.
BITS = 16
SHARD = "shard long, lang string, words array<string>, counts array<int>, gaps binary"
#: Bytes that end a piece, and letters that are lower-cased.
ENDS, UPPER = b".,;:!?\n\x0b\x0c\r", bytes(range(65, 91))
FOLD = bytes.maketrans(UPPER + ENDS, UPPER.lower() + b"\xff" * len(ENDS))  # \xff is in no UTF-8 text


def tokens(text: bytes) -> list[bytes]:
    """The words of a text with b"\\xff" between pieces: A-Z lower-cased, split at the marks, then at spaces and tabs."""
    return text.translate(FOLD).replace(b"\xff", b" \xff ").split()


def word_bitmaps(docs: DataFrame, shard_words: int = 3_000_000) -> DataFrame:
    """Rows of SHARD: positions of one language's texts, under the distinct words that stand there. A task holds at most
    about ``shard_words`` positions; when it does, the language with the most of them is written.

    A word's bitmap is kept as the gaps between its set bits. Words of a piece stand side by side; between pieces lies a
    free position, so that no shift crosses it. A null lang is ``und``; a null text has no words.
    """
    out = to_arrow_schema(StructType.fromDDL(SHARD))

    def run(batches):
        task = TaskContext.get()
        number = (task.partitionId() << 24) if task else 0
        numbers: dict = defaultdict(lambda: defaultdict(count().__next__))
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        sizes: Counter = Counter()

        def shard(lang):
            nonlocal number
            ids, words = np.concatenate(held.pop(lang)), list(numbers.pop(lang))
            del sizes[lang]
            order = np.argsort(ids, kind="stable")
            gaps = np.diff(order, prepend=0)
            counts = np.bincount(ids, minlength=len(words))
            begun = np.cumsum(counts) - counts
            gaps[begun] = order[begun]
            data = gaps[counts[0] :].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # the mark between pieces has number 0
            values = [number, lang, [w.decode() for w in words[1:]], counts[1:].astype(np.int32), zstandard.ZstdCompressor(level=3).compress(data)]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for f, v in zip(out, values, strict=True)], schema=out)

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                number_of = numbers[lang]
                number_of[b"\xff"]
                found = tokens(text)
                found.append(b"\xff")
                held[lang].append(np.fromiter(map(number_of.__getitem__, found), np.int32, len(found)))
                sizes[lang] += len(found)
                if sizes.total() >= shard_words:
                    yield shard(max(sizes, key=sizes.get))
        for lang in list(held):
            yield shard(lang)

    small_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(run, SHARD)


class Bitmaps:
    """The bitmaps of a shard's kept words: entries (block, word, bits) sorted by block, absent where no bit is set."""

    def __init__(self, counts: np.ndarray, gaps: bytes, kept: np.ndarray):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(gaps), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
        upto = np.cumsum(data)
        begun = (np.cumsum(counts) - counts)[counts > 0]
        place = (upto - np.repeat(upto[begun] - data[begun], counts[counts > 0])).astype(np.int32)
        word = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.blocks = int(place.max(initial=0)) // BITS + 2
        word, place = word[kept[word]], place[kept[word]]
        self.word, self.block, self.bits = _merged(word, place // BITS, np.int32(1) << (place % BITS))
        self.start = np.searchsorted(self.block, np.arange(self.blocks + 1))

    def of(self, words: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries (prefix, block, bits) of single words, the prefix being the place in ``words``."""
        place = np.full(top, -1, np.int32)
        place[words] = np.arange(len(words))
        at = np.nonzero(place[self.word] >= 0)[0]
        return place[self.word[at]], self.block[at], self.bits[at]


def _merged(word, block, bits):
    """Entries sorted by (block, word), the bits of equal ones together."""
    key = block.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    order = np.argsort(key, kind="stable")
    word, block, bits = word[order], block[order], bits[order]
    first = np.nonzero(np.diff(key[order], prepend=-1))[0]
    return word[first], block[first], np.bitwise_or.reduceat(bits, first) if len(first) else bits


def extended(maps: Bitmaps, entries, last: np.ndarray, allowed: np.ndarray | None, top: int, chunk: int = 500_000):
    """All extensions of prefixes by one word: (prefix, word, times, entries of the longer phrases).

    The prefixes' bitmaps are shifted by one position, the bit that leaves a block going to the next, and meet by AND the
    bitmaps of the words in their block; set bits are counted. ``last`` is each prefix's last word; of the pairs (last word,
    next word) only those in ``allowed``, sorted keys, go on.
    """
    prefix, block, bits = entries
    moved = bits << 1
    low, high = moved & ((1 << BITS) - 1), moved >> BITS
    prefix, block, bits = np.concatenate([prefix[low > 0], prefix[high > 0]]), np.concatenate([block[low > 0], block[high > 0] + 1]), np.concatenate([low[low > 0], high[high > 0]])
    many = maps.start[block + 1] - maps.start[block]
    ends = np.cumsum(many)
    found = []
    at = 0
    while at < len(prefix):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
        n = many[at:upto]
        mine = np.repeat(np.arange(at, upto), n)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(maps.start[block[at:upto]], n)
        both = bits[mine] & maps.bits[other]
        hit = np.nonzero(both)[0]
        mine, other, both = mine[hit], other[hit], both[hit]
        if allowed is not None:
            pair = last[prefix[mine]].astype(np.int64) * top + maps.word[other]
            slot = np.minimum(np.searchsorted(allowed, pair), len(allowed) - 1)
            good = allowed[slot] == pair
            mine, other, both = mine[good], other[good], both[good]
        found.append((prefix[mine].astype(np.int64) * top + maps.word[other], block[mine], both))
        at = upto
    key, block, bits = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))
    phrases, number = np.unique(key, return_inverse=True)
    times = np.bincount(number, np.bitwise_count(bits), len(phrases)).astype(np.int64)
    return phrases // top, phrases % top, times, (number.astype(np.int32), block, bits)


def _batches(words: np.ndarray, counts: np.ndarray, most: int = 250_000):
    """``words`` in runs that hold about ``most`` positions together, so that a branch of the search is bounded."""
    upto = np.cumsum(counts[words]) // most
    return np.split(words, np.nonzero(np.diff(upto))[0] + 1) if len(words) else []


def _ids(row_counts: list[int], held: list | None) -> np.ndarray:
    """The global id of each word of a shard, -1 where it has none."""
    ids = np.full(len(row_counts), -1)
    if held:
        ids[[x["place"] for x in held]] = [x["id"] for x in held]
    return ids


def pair_counts(joined: DataFrame) -> DataFrame:
    """(shard, pair, n): how often one word follows another in the shard, of the words that are in ``ids`` (place, id); the
    pair is the first id, shifted by 32 bits, and the second."""

    def run(batches):
        for b in batches:
            for row in range(len(b["shard"])):
                counts, ids = np.array(b["counts"][row], np.int64), _ids(b["counts"][row], b["ids"][row])
                maps, top = Bitmaps(counts, b["gaps"][row], ids >= 0), len(counts)
                for words in _batches(np.nonzero(ids >= 0)[0], counts):
                    p, w, n, _ = extended(maps, maps.of(words, top), words, None, top)
                    yield {"shard": [b["shard"][row]] * len(p), "pair": ids[words[p]] << 32 | ids[w], "n": n}

    return map_batches(joined, run, "shard long, pair long, n long")


def longer_counts(joined: DataFrame, longest: int) -> DataFrame:
    """(phrase, n): the phrases of 3 to ``longest`` words in a shard all of whose neighbours are in its ``pairs``.

    Each batch of first words is followed to its longest phrases before the next one begins.
    """

    def run(batches):
        for b in batches:
            for row in range(len(b["shard"])):
                pairs = np.array(b["pairs"][row], np.int64)
                counts, ids = np.array(b["counts"][row], np.int64), _ids(b["counts"][row], b["ids"][row])
                order, top = np.argsort(ids), len(counts)
                first, second = (order[np.searchsorted(ids, x, sorter=order)] for x in (pairs >> 32, pairs & 0xFFFFFFFF))
                kept = np.zeros(top, bool)
                kept[first], kept[second] = True, True
                maps, allowed = Bitmaps(counts, b["gaps"][row], kept), np.sort(first * top + second)
                for words in _batches(np.unique(first), counts):
                    phrases, entries = words[:, None], maps.of(words, top)
                    while phrases.shape[1] < longest and len(phrases):
                        p, w, n, entries = extended(maps, entries, phrases[:, -1], allowed, top)
                        phrases = np.concatenate([phrases[p], w[:, None]], axis=1)
                        if phrases.shape[1] > 2:
                            yield {"phrase": ids[phrases].tolist(), "n": n}

    return map_batches(joined, run, "phrase array<int>, n long")


def frequent_words(shards: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n): all word occurrences; (id, lang, word, a): the words that occur ``least`` times; (shard, place, id): where."""
    held = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("shard", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    total = shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, v: s + v)).alias("n"))
    kept = held.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    words = numbered(materialize(kept.select(F.monotonically_increasing_id().alias("row"), "lang", "word", "a"), "words"))
    return total, words, held.select("shard", "lang", "place", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).select("shard", "place", "id")


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with ``id`` from 0, gapless, in place of ``row``, whose upper bits are a partition's number: the driver adds up a
    count a partition. Ids take 31 bits, so that two of them are one long."""
    part = F.shiftright("row", 33)
    counts = sorted((r["part"], r["n"]) for r in words.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    if before[-1] >= 2**31:
        raise ValueError("more than 2^31 frequent words; raise the least frequency")
    offsets = F.create_map(*[F.lit(x) for (p, _), b in zip(counts, before, strict=False) for x in (p, b)]) if counts else F.create_map(F.lit(0), F.lit(0))
    return words.select((offsets[part] + F.col("row").bitwiseAND((1 << 33) - 1)).cast("int").alias("id"), "lang", "word", "a")


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4, shard_words: int = 3_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n), the frequent words (id, lang, word, a), and the phrases of 2 to ``longest`` of them that occur ``least``
    times (phrase, a), the phrase as an array of ids.

    A phrase is as frequent as its rarest word at most, so only frequent words are extended, and then only along frequent
    pairs. What a shard needs to know of all shards comes to it by a join on the shard; a word or pair has one row a shard.
    """
    shards = materialize(word_bitmaps(docs, shard_words), "bitmaps")
    total, words, where = frequent_words(shards, least)
    ids = where.groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("ids"))
    lean = shards.select("shard", "counts", "gaps")
    pairs = pair_counts(lean.join(ids, "shard"))
    known = pairs.withColumn("all", F.sum("n").over(Window.partitionBy("pair"))).where(F.col("all") >= least)
    known = materialize(known.select("shard", "pair", "all"), "pairs")
    here = known.groupBy("shard").agg(F.collect_list("pair").alias("pairs"))
    longer = longer_counts(lean.join(ids, "shard").join(here, "shard"), longest).groupBy("phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    two = known.groupBy("pair").agg(F.max("all").alias("a")).select(F.array(F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")).alias("phrase"), "a")
    return total, words, materialize(two.union(longer), "phrases")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, absorbed: int = 80, most: int = 2000, shard_words: int = 3_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) for ``docs`` (lang, text): each language's first ``most`` collocations.

    The score of a cut after the first k words is floor(2000000 a / (l + r)), from the frequencies of the phrase and its
    two parts; the lowest-scoring cut counts, of equals the earliest. Phrases inside a longer one of at least ``absorbed``
    per cent of their frequency go. Sums are whole numbers. Null texts are empty, a null lang is ``und``; repeated rows
    count each; columns other than these two stay out. No rows, no rows.
    """
    total, words, phrases = phrase_counts(docs.select("lang", "text"), least, longest, shard_words)
    parts = phrases.union(words.select(F.array("id"), "a"))

    def inner(p: Column, k: int) -> Column:
        at = F.sequence(F.lit(1), F.size(p) - k + 1)
        return F.when(F.size(p) > k, F.transform(at, lambda i: F.slice(p, i, k))).otherwise(F.array().cast("array<array<int>>"))

    within = F.flatten(F.array(*[inner(F.col("phrase"), k) for k in range(2, longest)]))
    inside = phrases.where(F.size("phrase") > 2).select(F.explode(within).alias("phrase"), F.col("a").alias("over"))
    most_over = inside.groupBy("phrase").agg(F.max("over").alias("over"))
    kept = phrases.join(most_over, "phrase", "left").where(F.col("over").isNull() | (100 * F.col("over") < absorbed * F.col("a"))).select("phrase", "a")
    cut = kept.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cut = cut.select("phrase", "a", "k", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")).alias("right"))
    sided = cut.join(parts.select(F.col("phrase").alias("left"), F.col("a").alias("l")), "left").join(parts.select(F.col("phrase").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))")
    best = sided.groupBy("phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("phrase", "a", "c.l", "c.r", "c.score")
    named = best.select(F.monotonically_increasing_id().alias("row"), "*")
    named = materialize(named, "scored")
    spelt = named.select("row", F.posexplode("phrase").alias("at", "id")).join(words.select("id", "lang", "word"), "id").groupBy("row", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ready = named.drop("phrase").join(spelt, "row")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = ready.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)))  # a language's first rows are among the first of each part
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language of ``documents``; see ``collocations``."""
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, ws[i:i + k - 1] AS ws FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, any_value(ws) AS ws, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS over FROM (SELECT lang, ws, a, j, unnest(range(1, k - j + 2)) AS i FROM f CROSS JOIN (SELECT unnest([2, 3]) AS j) WHERE k > j) GROUP BY 1, 2),
c AS (SELECT f.lang, f.phrase, f.a, f.ws, k, unnest(range(1, k)) AS cut FROM f LEFT JOIN s ON s.lang = f.lang AND s.phrase = f.phrase WHERE k > 1 AND (over IS NULL OR 100 * over < 80 * f.a)),
x AS (SELECT c.lang, c.phrase, c.a, cut, le.a AS l, ri.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (le.a + ri.a) AS BIGINT) AS score FROM c JOIN f le ON le.lang = c.lang AND le.phrase = array_to_string(c.ws[1:cut], ' ') JOIN f ri ON ri.lang = c.lang AND ri.phrase = array_to_string(c.ws[cut + 1:c.k], ' ')),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM x) WHERE o = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN t ON t.lang = z.lang WHERE rank <= 2000
"""
