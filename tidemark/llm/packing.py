"""Best-fit packing: a configuration linear program over the length histogram, by multiplicative weights, then rounded."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, materialize, read, small_batches, texts


@lru_cache(maxsize=4)
def token_ids(path: str, special: bool = True):
    """A function from texts to lists of ids, as the tokenizer file at ``path`` gives without special tokens added.

    Special tokens' strings within a text are those tokens, or without ``special`` plain text. A plain byte-level BPE file
    (split by the usual pattern, nothing normalised) is read into the quicker of the two installed libraries, which gives
    the same ids; any other file goes to its own library.
    """
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
    plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    plain = plain and model["type"] == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")) and all(t["special"] for t in added)
    if not plain:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        return lambda many: [x.ids for x in tokenizer.encode_batch_fast(many, add_special_tokens=False)]

    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that such files write as themselves
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    named = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in named}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=named)
    if not special:
        return lambda many: [encoding.encode_ordinary(t) for t in many]
    return lambda many: [encoding.encode(t, allowed_special="all") for t in many]


def pieces(docs: DataFrame, path: str, capacity: int = 1024, eos: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of every text and ``eos``, cut into pieces of at most ``capacity``.

    Only the first piece of a longer document may be shorter. A null or empty text is the one id ``eos``.
    """

    def run(batches):
        encode = token_ids(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b["doc_id"], encode(b["text"]), strict=True):
                ids = np.array([*ids, eos], "<u4")
                ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                rows += [(doc, k, start := max(0, end - capacity), end - start, zlib.crc32(ids[start:end].tobytes())) for k, end in enumerate(ends)]
            yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True))

    small_batches(docs.sparkSession)
    return map_batches(texts(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_pattern(prices: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Counts a[l] that maximise sum(prices[l] * a[l]) with sum(l * a[l]) <= capacity: an unbounded knapsack by dynamic programming.

    ``room[l]`` is 0 where no item of length l is left.
    """
    capacity = len(prices) - 1
    value = np.where(room > 0, prices, -np.inf)
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gains = best[c - 1 :: -1] + value[1 : c + 1]
        k = int(gains.argmax())
        best[c], last[c] = (gains[k], k + 1) if gains[k] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        counts[last[c]] += last[c] > 0
        c -= max(1, int(last[c]))
    return counts


def cover(counts: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Patterns with fractional amounts that together hold exactly ``counts``, greedily: the start of the program.

    A length's price grows a little faster than the length, as long items are the harder to place, and falls with the share
    of it that is covered. A pattern is taken as often as its scarcest length allows, so rounds are at most the lengths.
    """
    lengths = np.arange(len(counts))
    wanted, covered, found = np.maximum(counts, 1e-9).astype(float), np.zeros(len(counts)), {}
    while (left := counts > covered + 1e-6)[1:].any():
        prices = (lengths / len(lengths)) ** 1.1 * (1 + np.exp(-3 * covered / wanted))
        pattern = best_pattern(prices, left)
        has = pattern > 0
        amount = ((counts - covered)[has] / pattern[has]).min()
        covered = covered + amount * pattern
        key = pattern.tobytes()
        found[key] = (pattern, found.get(key, (0, 0.0))[1] + amount)
    return list(found.values())


def program(counts: np.ndarray, gap: float = 0.01, step: float = 0.05, most: int = 20_000) -> tuple[list[tuple[np.ndarray, float]], float]:
    """The configuration program over ``counts``: patterns with amounts that cover every length, and a lower bound on the bins.

    Multiplicative weights: a length's weight falls by exp(-step x share of it covered) whenever a pattern takes it. The
    dearest pattern known is taken as often as its scarcest length allows; every so many steps the knapsack prices a new one,
    and sum(counts x price) over its worth bounds the program from below. The amounts taken, scaled to cover everything, are
    a solution. It ends when that is within ``gap`` of the bound, or after ``most`` steps: then the best so far is returned.
    """
    used = np.nonzero(counts)[0]
    best = cover(counts)
    if not len(used):
        return best, 0.0
    n, capacity = counts[used].astype(float), len(counts) - 1
    value, bound = sum(x for _, x in best), float(counts @ np.arange(capacity + 1)) / capacity
    known = {p.tobytes(): i for i, (p, _) in enumerate(best)}
    patterns = [p for p, _ in best]
    a = np.array([p[used] for p in patterns], float)
    logs, taken, covered = np.log(used / (n * capacity)) + np.log(n), np.zeros(len(patterns)), np.zeros(len(used))
    for i in range(most):
        if value <= bound * (1 + gap):
            break
        weight = np.exp(logs - logs.max()) / n  # the price of one item; all items of a length weigh exp(logs)
        if i % 50 == 0:
            prices = np.zeros(capacity + 1)
            prices[used] = weight
            new = best_pattern(prices, counts)
            bound = max(bound, float(weight @ n) / float(new @ prices))
            if new.tobytes() not in known:
                known[new.tobytes()] = len(patterns)
                patterns.append(new)
                a, taken = np.vstack([a, new[used]]), np.append(taken, 0.0)
            if covered.min() > 0 and taken.sum() / covered.min() < value:
                value = taken.sum() / covered.min()
                best = [(p, x) for p, x in zip(patterns, taken / covered.min(), strict=True) if x > 0]
        j = int((a @ weight).argmax())
        has = a[j] > 0
        times = (n[has] / a[j][has]).min()
        taken[j] += times
        covered += times * a[j] / n
        logs -= step * times * a[j] / n
    return best, bound


def corner(priced: list[tuple[np.ndarray, float]], counts: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """The solution nearest to ``priced`` that holds exactly ``counts`` by as many patterns as there are lengths, largest amounts
    first; nothing where those don't solve it, or where there are over 256 lengths."""
    used = np.nonzero(counts)[0]
    if not 0 < len(used) <= 256:
        return []
    chosen: list[np.ndarray] = []
    span = np.zeros((0, len(used)))
    for pattern, _ in sorted(priced, key=lambda r: -r[1]):
        rest = pattern[used].astype(float)
        rest = rest - span.T @ (span @ rest)
        rest = rest - span.T @ (span @ rest)
        if (size := np.linalg.norm(rest)) > 1e-6:
            chosen.append(pattern)
            span = np.vstack([span, rest / size])
    if len(chosen) < len(used):
        return []
    system, n = np.array([p[used] for p in chosen], float).T, counts[used].astype(float)
    amounts = np.linalg.lstsq(system, n)[0]
    solves = amounts.min() > -1e-6 and np.allclose(system @ amounts, n)
    return list(zip(chosen, amounts.tolist(), strict=True)) if solves else []


def best_fit(counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold exactly ``counts``: best fit, longest first.

    Bins that are alike are one entry with a number of times, and the items of a length go into all of them at once, so
    the work depends on the capacity and not on the counts.
    """
    capacity = len(counts) - 1
    rooms: list[list] = [[] for _ in range(capacity + 1)]  # (pattern, times) by the room left

    def put(pattern, times, length, n):
        """``n`` of ``length`` into as few of the bins as they fill; what is left of the bins stays as it was."""
        room = capacity - int(pattern @ np.arange(capacity + 1))
        each = room // length
        full = min(times, n // each)
        some = n - full * each if full < times else 0
        for k, many in ((each, full), (some, min(some, 1))):
            if many:
                more = pattern.copy()
                more[length] += k
                rooms[room - k * length].append((more, many))
        if times - full - min(some, 1):
            rooms[room].append((pattern, times - full - min(some, 1)))
        return n - full * each - some

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        for room in range(length, capacity):
            if not left:
                break
            held, rooms[room] = rooms[room], []
            for pattern, times in held:
                if left:
                    left = put(pattern, times, length, left)
                else:
                    rooms[room].append((pattern, times))
        if left:
            put(np.zeros(capacity + 1, np.int64), -(-left // (capacity // length)), length, left)
    return [bin_ for held in rooms for bin_ in held]


def rounded(priced: list[tuple[np.ndarray, float]], share: float, counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """``share`` of the amounts, rounded down and never more than there is, largest first; the rest by best fit."""
    left, out = counts.copy(), []
    for pattern, amount in sorted(priced, key=lambda r: -r[1]):
        has = pattern > 0
        times = min(int(share * amount + 1e-6), int((left[has] // pattern[has]).min()))
        if times > 0:
            out.append((pattern, times))
            left = left - times * pattern
    return out + best_fit(left)


def plan(counts: np.ndarray, shares: tuple = (1.0, 0.8, 0.6, 0.4, 0.2, 0.1, 0.05, 0.0)) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that use every item of the histogram ``counts`` (by length, index 0 unused) exactly once.

    The program's amounts, or the ``shares`` of them, are rounded down and what that leaves is best-fitted; of these
    roundings the one with the fewest bins is taken. The share 0 is best fit alone, so the plan is never worse.
    """
    counts, out = counts.copy(), []
    if counts[-1]:
        full = np.zeros(len(counts), np.int64)
        full[-1] = 1
        out.append((full, int(counts[-1])))
        counts[-1] = 0
    solved, bound = program(counts)
    best: list | None = None
    for priced, parts in ((corner(solved, counts), shares[:1]), (solved, shares)):
        for share in parts if priced or not counts.any() else ():
            made = rounded(priced, share, counts)
            if best is None or sum(t for _, t in made) < sum(t for _, t in best):
                best = made
            if sum(t for _, t in best) <= np.ceil(bound - 1e-6):
                return out + best
    return out + best


def slots(planned: list[tuple[np.ndarray, int]]) -> dict[str, list[int]]:
    """Where the items of each length go: those of rank first to first + times - 1 take ``offset`` in sequences from ``base``."""
    out: dict[str, list[int]] = {k: [] for k in ("length", "first", "times", "base", "offset")}
    used: dict[int, int] = {}
    base = 0
    for pattern, times in planned:
        offset = 0
        for length in np.nonzero(pattern)[0].tolist():
            for _ in range(int(pattern[length])):
                for k, v in (("length", length), ("first", used.get(length, 0)), ("times", times), ("base", base), ("offset", offset)):
                    out[k].append(v)
                used[length] = used.get(length, 0) + times
                offset += length
        base += times
    return out


def rank_within(df: DataFrame, key: str, order: list[str], salts: int) -> DataFrame:
    """``df`` with ``rank``, from 0 and gapless within ``key``. A hot key is ranked in ``salts`` parts that run side by side."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(key, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(key, "salt", before.alias("before"))
    within = F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order)) - 1
    ranked = salted.withColumn("within", within).join(starts, [key, "salt"])
    return ranked.withColumn("rank", (F.col("before") + F.col("within")).cast("long")).drop("salt", "within", "before")


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """``cut`` (doc_id, piece, length, ...) with sequence_id and offset, in as few sequences of ``capacity`` as it can.

    The driver sees the length histogram alone, of at most ``capacity`` entries, and the plan made from it, which is
    bounded by the capacity, not by the rows. Repeated rows are packed each. No rows, no rows.
    """
    spark = cut.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    table = slots(plan(counts))
    rows = list(zip(*table.values(), strict=True))
    where = spark.createDataFrame(rows, "length long, first long, times long, base long, offset long")
    ranked = rank_within(cut, "length", ["doc_id", "piece"], max(8, min(4096, int(counts.sum()) // 5_000)))
    fits = (ranked["length"] == where["length"]) & (ranked["rank"] >= where["first"]) & (ranked["rank"] < where["first"] + where["times"])
    placed = ranked.join(F.broadcast(where), fits).drop(where["length"])
    return placed.select(*cut.columns, (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, eos: int = 2) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece. Documents are tokenised once; the pieces' lengths are kept as a table."""
    return pack(materialize(pieces(docs, path, capacity, eos), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of every document, with its place; see ``pieces`` and ``pack``. Rows without a doc_id are packed too."""
    import public_tokenizers as p

    return pack_documents(read(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed: one row per piece. Null texts are empty, repeated rows are packed each; no rows, no rows."""
    import public_tokenizers as p

    return pack_documents(docs, p.path("byte_bpe_50k.json"))
