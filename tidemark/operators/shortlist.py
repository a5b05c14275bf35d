"""Strategies compared by their paths, reviewed by rules, and shortened to a few that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_digest(df: DataFrame, keys: list[str], order: str, value: str, chunk: int = 500) -> DataFrame:
    """(keys, digest): SHA-256 of each key's values in order. Equal digests are equal paths: the same values at the same sessions.

    Made in two steps, chunks of ``chunk`` sessions and then the chunks, so that no path is one row. ``order`` is a whole number,
    each of which a key has once; a null value is written as such.
    """
    said = F.concat_ws(":", F.col(order).cast("string"), F.coalesce(F.col(value).cast("string"), F.lit("null")))
    part = F.floor(F.col(order) / F.lit(chunk)).cast("long")

    def joined(at: str, what: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("o"), F.col(what).alias("t"))))
        return F.sha2(F.array_join(F.transform(rows, lambda r: r["t"]), ","), 256)

    chunks = df.select(*keys, part.alias("__part"), F.col(order).alias("__o"), said.alias("__t")).groupBy(*keys, "__part").agg(joined("__o", "__t").alias("__d"))
    return chunks.groupBy(*keys).agg(joined("__part", "__d").alias("digest"))


def reviewed(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``failures`` (names of the rules that don't hold, in order; one that is null doesn't) and ``eligible`` (there are none)."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("failures", failed).withColumn("eligible", F.size("failures") == 0)


def shortlist(df: DataFrame, model: str, digest: str, order: list[Column], most: int = 2) -> list:
    """The first ``most`` eligible rows in ``order``, each of another model and another path than those before it.

    A row is taken a round, by a top-1 over what doesn't clash with those taken; the driver sees the rows taken alone. A path that
    is null clashes with none. ``order`` should decide all ties.
    """
    taken: list = []
    left = df.where("eligible")
    while len(taken) < most and (row := left.orderBy(*order).limit(1).collect()):
        taken += row
        same = F.col(digest) == F.lit(row[0][digest])
        left = left.where(~F.col(model).eqNullSafe(F.lit(row[0][model])) & ~F.coalesce(same, F.lit(False)))
    return taken
