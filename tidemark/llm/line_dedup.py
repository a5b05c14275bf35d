"""Line dedup by winnowing over line hashes: DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read

#: A text is cut into lines behind each of these: line feeds, and the blank that follows a sentence's end.
LINE_ENDS = ("\n", ". ", "! ", "? ")
MARK = "\x01"


def lines_of(text: Column) -> Column:
    """Lines with their ends; together they are the text. A null or empty text has none.

    The cuts are marked and the text split at the mark, which is far quicker than a pattern; a text that holds the mark
    itself is split by the pattern that says the same.
    """
    text = F.coalesce(text, F.lit(""))
    marked = text
    for end in LINE_ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    pattern = "(?<=" + "|".join(f"[{e[0]}]{e[1:]}" for e in LINE_ENDS) + ")"
    parts = F.when(F.contains(text, F.lit(MARK)), F.split(text, pattern)).otherwise(F.split(marked, MARK))
    return F.filter(parts, lambda x: x != "")


def trimmed(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\r\n")))


def winnow(shape: DataFrame, min_chars: int, window: int = 3) -> DataFrame:
    """``shape`` (doc, version, h: line hashes, m: what each line counts) with ``picks``: the least hash of every ``window``
    lines in a row, and the lines that alone make up a share of ``min_chars``.

    A run of ``min_chars`` of fewer lines than the window has a line of that share, any other run holds a whole window: so
    two places that share a run share a pick in it, and no line of a run is ``window`` or more lines away from one.
    ``twice`` holds the hashes that a text has more than once. Each step is a column of its own, as a lambda that held the
    expression of the one before would compute it for every element.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - window, F.lit(0)))
    least = F.transform(starts, lambda i: F.array_min(F.slice("h", i + 1, window)))
    long = F.filter(F.zip_with("h", "m", lambda x, n: F.when(n * (window - 1) >= min_chars, x)), lambda x: x.isNotNull())
    ordered = shape.select("*", F.array_distinct(F.concat(least, long)).alias("picks"), F.sort_array("h").alias("ordered"))
    return ordered.withColumn("twice", F.filter("ordered", lambda x, i: x == F.get("ordered", i + 1))).drop("ordered")


def _repeated_picks(shape: DataFrame) -> DataFrame:
    """(doc, version, marks): the picks of each document that occur at another place too, in it or in another document."""
    picks = shape.select("doc", "version", F.explode("picks").alias("pick"))
    often = materialize(picks.groupBy("pick").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pick"), "picks")  # a join apart from the groups can be split
    within = shape.where(F.size("twice") > 0).select("doc", "version", F.explode(F.array_intersect("twice", "picks")).alias("pick"))
    both = picks.join(often, "pick").select("doc", "version", "pick").union(within)
    return both.groupBy("doc", "version").agg(F.collect_set("pick").alias("marks"))


def _windows(marked: DataFrame, min_chars: int, bits: int, window: int = 3) -> DataFrame:
    """(key, doc, version, code): windows of ``min_chars`` round the repeated picks, as first line << bits | lines.

    From each line that is near enough to a repeated pick to lie in a run with it, lines are added one way and the other
    till ``min_chars`` are reached; ``key`` is the hash of the window's line hashes. Where picks times lines are very many,
    all windows are taken, which costs rows and no result.
    """
    few = F.size("marks").cast("long") * F.size("h") <= 20_000_000
    told = F.when(few, F.transform("h", lambda x: F.array_contains("marks", x))).otherwise(F.array_repeat(F.lit(True), F.size("h")))
    repeated = marked.select("doc", "version", "h", "m", told.alias("r"))
    sides = repeated.select("doc", "version", "h", "m", F.transform("r", lambda r, i: r | reduce(lambda a, b: a | b, [F.coalesce(F.get("r", i + d), F.lit(False)) for d in range(1 - window, window) if d])).alias("on"))

    def code(first, lines):
        return F.shiftleft(first.cast("long"), bits) + lines

    # each start, moved on by min_chars, among the ends: the p-th of all, the i-th of its kind, has p - i of the other kind before it
    ends = _running_sums(sides, "m", "ends", ["doc", "version", "h", "on"])
    starts = F.transform(F.slice("ends", 1, F.size("h")), lambda x: 2 * (x + min_chars))
    merged = ends.select("doc", "version", "h", "on", F.sort_array(F.concat(starts, F.transform("ends", lambda x: 2 * x + 1))).alias("merged"))

    def places(kind):
        return F.filter(F.transform("merged", lambda x, p: F.when(x.bitwiseAND(F.lit(1)) == kind, p)), lambda p: p.isNotNull())

    ahead = F.transform(places(0), lambda p, i: F.when(F.get("on", i) & (p - i <= F.size("h")), code(i, p - 2 * i)))
    back = F.transform(places(1), lambda p, i: F.when(F.get("on", i - 1) & (p > i), code(p - i - 1, 2 * i - p + 1)))
    codes = merged.select("doc", "version", "h", F.array_distinct(F.concat(ahead, back)).alias("codes"))

    def keyed(c):
        return F.struct(F.xxhash64(F.slice("h", F.shiftright(c, bits).cast("int") + 1, c.bitwiseAND((1 << bits) - 1).cast("int"))).alias("key"), c.alias("code"))

    # keys before the rows: an exploded row with its document's hashes would copy them
    rows = codes.select("doc", "version", F.explode(F.transform(F.filter("codes", lambda c: c.isNotNull()), keyed)).alias("w"))
    return rows.select("w.key", "doc", "version", "w.code")


def repeated_lines(docs: DataFrame, min_chars: int = 120) -> DataFrame:
    """(doc, version, runs array<struct<first, last>>): lines, from 0, in any run of ``min_chars`` or more that was seen earlier.

    Earlier is in a document of lower doc_id (of rows that share one, in that of the lower text hash, ``version``), or
    further up in the same text. A run counts its lines' text without blanks at the ends, and one for each line.

    Winnowing (``winnow``) picks lines so that two places that share a run share a pick in it. A pick alone doesn't say
    which earlier place shares the run, as a common line may stand first in a third document; so the windows round
    repeated picks, extended both ways to ``min_chars``, are joined by the hash of their lines: each of them is a repeat at
    every place but its first. Each line of a repeated run lies in such a window within the run, hence no repeat is lost
    and nothing else goes.
    """
    some = docs.where(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    base = some.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("version"), trimmed(lines_of(F.col("text"))).alias("lines"))
    hashes, lengths = F.transform("lines", lambda x: F.xxhash64(x)), F.transform("lines", lambda x: F.length(x) + 1)
    shape = materialize(winnow(base.select("doc", "version", hashes.alias("h"), lengths.alias("m")), min_chars), "lines")
    bits = int(min_chars).bit_length()
    windows = materialize(_windows(shape.join(_repeated_picks(shape), ["doc", "version"]), min_chars, bits), "windows")
    firsts = windows.groupBy("key").agg(F.min(F.struct("doc", "version", "code")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("key", "first")
    firsts = materialize(firsts, "firsts")
    later = windows.join(firsts, "key").where(F.struct("doc", "version", "code") > F.col("first"))
    again = later.groupBy("doc", "version").agg(F.sort_array(F.collect_set("code")).alias("codes"))

    def merge(done, code):
        a = F.shiftright(code, bits).cast("int")
        b = a + code.bitwiseAND((1 << bits) - 1).cast("int") - 1
        run = F.struct(a.alias("first"), b.alias("last"))
        open_ = F.struct(done["open"]["first"].alias("first"), F.greatest(done["open"]["last"], b).alias("last"))
        joins = a <= done["open"]["last"] + 1
        return F.struct(F.when(joins, done["runs"]).otherwise(F.concat(done["runs"], F.array(done["open"]))).alias("runs"), F.when(joins, open_).otherwise(run).alias("open"))

    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("runs"), F.struct(F.lit(-2).alias("first"), F.lit(-2).alias("last")).alias("open"))
    runs = F.aggregate("codes", start, merge, lambda done: F.slice(F.concat(done["runs"], F.array(done["open"])), 2, F.size(done["runs"])))
    return again.select("doc", "version", runs.alias("runs"))


def _running_sums(df: DataFrame, n: str, name: str, keep: list[str], block: int = 32, levels: int = 3) -> DataFrame:
    """``keep`` and ``name``: 0 and the sums of the first 1, 2, ... of the numbers ``n``, of which there is one at least.

    Sums are made by blocks and the blocks' totals summed alike, as an array that grows by one is copied each time.
    """

    def grow(numbers):
        return F.aggregate(numbers, F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))

    if not levels:
        return df.select(*keep, grow(F.col(n)).alias(name))
    own, before = f"{name}_{levels}", f"{name}_before_{levels}"
    blocks = F.transform(F.sequence(F.lit(1), F.size(n), F.lit(block)), lambda i: grow(F.slice(n, i, block)))
    split = df.select(*keep, blocks.alias(own)).withColumn(n, F.transform(own, lambda b: F.element_at(b, -1)))
    summed = _running_sums(split, n, before, [*keep, own], block, levels - 1)
    moved = F.zip_with(own, F.slice(before, 1, F.size(own)), lambda b, x: F.transform(F.slice(b, 1, F.size(b) - 1), lambda y: y + x))
    return summed.select(*keep, F.concat(F.flatten(moved), F.slice(before, -1, 1)).alias(name))


def without_lines(text: Column, runs: Column) -> Column:
    """``text`` less the lines of ``runs``, which are sorted and apart."""

    def step(done, run):
        gap = F.array_join(F.slice(done["lines"], done["upto"] + 1, F.greatest(run["first"] - done["upto"], F.lit(0))), "")
        return F.struct((run["last"] + 1).alias("upto"), F.concat(done["kept"], gap).alias("kept"), done["lines"].alias("lines"))

    start = F.struct(F.lit(0).alias("upto"), F.lit("").alias("kept"), lines_of(text).alias("lines"))
    return F.aggregate(runs, start, step, lambda done: F.concat(done["kept"], F.array_join(F.slice(done["lines"], done["upto"] + 1, F.size(done["lines"])), "")))


def dedup_lines(docs: DataFrame, min_chars: int = 120) -> DataFrame:
    """``docs`` with ``text`` less its repeated runs (``repeated_lines``), and the count ``removed_chars`` under that name.

    The first place of a run stays, in the document with the least doc_id. Rows that share a doc_id are texts of their
    own; rows equal in doc_id and text are one document and come back alike. Rows without a doc_id stay as they are; null
    texts stay null; a document all of repeats becomes empty. A column of ``docs`` named removed_chars is replaced. No
    rows, no rows.
    """
    found = repeated_lines(docs, min_chars).select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("runs").alias("__runs"))
    joined = docs.join(found, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64("text") == F.col("__version")), "left")
    others = [c for c in docs.columns if c not in ("text", "removed_chars")]
    cut = F.when(F.col("__runs").isNotNull() & F.col("text").isNotNull(), without_lines(F.col("text"), F.col("__runs")))
    done = joined.select(*others, "text", cut.alias("__cut"))
    removed = F.when(F.col("__cut").isNull(), F.lit(0)).otherwise(F.length("text") - F.length("__cut"))
    return done.select(*others, F.coalesce("__cut", "text").alias("text"), removed.alias("removed_chars"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: what is left of its text."""
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "removed_chars", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from the texts; ``n_chars`` follows. No rows, no rows; see ``dedup_lines``."""
    out = dedup_lines(docs)
    return out.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])
