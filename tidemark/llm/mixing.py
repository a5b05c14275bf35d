"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read

WORD = r"[^\x20\x09-\x0D]+"
#: Sources of a plan that may be broadcast; a larger plan is joined by a shuffle, whose skew adaptive execution splits.
BROADCAST_SOURCES = 100_000


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, draw) of each row: words of the text (null: 0), and the row's place in a seeded order.

    ``draw`` is a digest of seed and doc_id, so that it doesn't depend on how rows are dealt; rows without a doc_id are
    drawn by their text. Rows that share a draw are taken or left together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary"))))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), draw.alias("draw"))


def water_filling(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], epochs: int) -> DataFrame:
    """(source, source_size, target) for ``sizes`` (source, source_size), a row a source.

    The sources, by code point with null last, weigh ``weights`` in turn and share ``share`` (numerator, denominator) of all
    sizes. In order of cap over weight, a source is clamped at ``epochs`` times its size when the level that the rest would
    get without it lies above; all the others get the last level times their weight. That is where clamping and sharing
    anew ends. Compared in whole numbers; only this table of a row a source is ordered in one place.
    """
    if share[0] > epochs * share[1]:
        raise ValueError("the budget is over what the sources hold at that many epochs")
    up, down = share
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    big = lambda c: c.cast("decimal(38,0)")
    own = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    filled = own.withColumn("left", up * total - down * before).withColumn("rest", rest)  # times ``down``
    clamped = filled.withColumn("clamped", big(F.col("cap")) * F.col("rest") * down < big(F.col("left")) * F.col("weight"))
    free = Window.partitionBy()
    first = F.min(F.when(~F.col("clamped"), F.struct(-F.col("rest"), "left"))).over(free)
    level = F.col("weight") * first["left"].cast("double") / (-first["col1"] * down)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(level)
    return clamped.select("source", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _by_source(rows: DataFrame, plan: DataFrame, more: Column | None = None) -> DataFrame:
    """``rows`` with the columns of ``plan`` of their source, null being one; ``plan`` is a row a source."""
    plan = plan.withColumnRenamed("source", "__source")
    on = _same(F.col("source"), F.col("__source"))
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(plan) if small else plan, on if more is None else on & more).drop("__source")


def mixture_plan(rows: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2, digits: int = 3, levels: int = 2) -> DataFrame:
    """(source, source_size, target, whole, cut) for ``rows`` (source, size, draw): what ``repetitions`` needs.

    A source's rows are taken ``whole`` times, and once more those whose draw is at most ``cut``: in order of draw, as long
    as the middle of a row lies within what is left of the target, so the words taken come within half a document of it.
    The cut is found by sums over the first ``digits`` of the draw, then over the next ones within the digits where it
    lies, and only what shares them is put in order.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    filled = water_filling(sizes, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = materialize(filled.withColumn("whole", whole.cast("int")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    cut = plan.select("source", "extra", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    upto = Window.partitionBy("source").orderBy("key")
    for level in range(levels + 1):
        last = level == levels
        within = F.col("draw").startswith(F.col("prefix"))
        key = F.col("draw") if last else F.substring("draw", 1, digits * (level + 1))
        sums = _by_source(rows, cut, within).groupBy("source", "extra", "before", "prefix", key.alias("key")).agg(F.sum("size").alias("size"))
        placed = sums.withColumn("upto", F.col("before") + F.sum("size").over(upto))
        if last:
            fits = 2 * F.col("upto") - F.col("size") <= 2 * F.col("extra")
            cuts = placed.groupBy("source").agg(F.coalesce(F.max(F.when(fits, F.col("key"))), F.max("prefix")).alias("cut"))
        else:
            crossed = placed.where(F.col("upto") > F.col("extra"))
            cut = materialize(crossed.groupBy("source").agg(F.min(F.struct("key", "extra", (F.col("upto") - F.col("size")).alias("before"))).alias("x")).select("source", "x.extra", F.col("x.key").alias("prefix"), "x.before"), "cuts")
    return plan.select("source", "source_size", "target", "whole").join(cuts.withColumnRenamed("source", "__source"), _same(F.col("source"), F.col("__source")), "left").drop("__source")


def repetitions(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with source_size, target, ``repeats`` (how often the mix takes a row) and ``taken`` (its words, repeats counted)."""
    repeats = F.col("whole") + F.coalesce((F.col("draw") <= F.col("cut")).cast("int"), F.lit(0))
    return _by_source(rows, plan).withColumn("repeats", repeats).withColumn("taken", F.col("size") * F.col("repeats")).drop("whole", "cut")


def mix_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2, seed: int = 13) -> DataFrame:
    """(doc_id, source, size, draw, source_size, target, repeats, taken) for every row of ``docs`` (doc_id, text, source).

    Null and empty texts have size 0 and are taken as their source's rows are. A null source is a source, and the last.
    Sources without words have target 0. Repeated rows are rows of their own with one draw; other columns, whatever their
    names, stay out. No rows, no rows. Texts are read once; what follows works on a table of sizes.
    """
    rows = materialize(measured(docs, seed), "sizes")
    return repetitions(rows, mixture_plan(rows, weights, share, epochs))


def mixed_texts(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The mix itself: ``docs`` (with a doc_id of its own a row), each row as often as ``mix`` takes it, with ``copy`` from 0."""
    often = mix.where("doc_id is not null and repeats > 0").select(F.col("doc_id").alias("__id"), "repeats")
    copies = docs.join(often, docs["doc_id"] == F.col("__id")).drop("__id")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1))).drop("repeats")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; see ``mix_documents``."""
    return mix_documents(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('13:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
c AS (SELECT *, CAST(cap AS HUGEINT) * rest * 2 < CAST(room AS HUGEINT) * weight AS clamped FROM l),
f AS (SELECT max(rest) AS rest, arg_max(room, rest) AS room FROM c WHERE NOT clamped),
t AS (SELECT c.source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), weight * CAST(f.room AS DOUBLE) / (f.rest * 2)) END AS target FROM c CROSS JOIN f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS extra,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.draw) AS tied
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * upto - tied <= 2 * extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM g
"""
