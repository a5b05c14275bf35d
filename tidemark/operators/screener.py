"""Screening of a window's candidates: figures, rules, and a set of survivors no two of which go together."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import ordered
from tidemark.operators.screen import doubled_ranks
from tidemark.operators.stats import correlation
from tidemark.sources.scratch import settled


def _rank_ic(rows: DataFrame, a: str, b: str, keys: list[str], name: str, least: int) -> DataFrame:
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.select(*keys, doubled_ranks(a, keys).alias("ra"), doubled_ranks(b, keys).alias("rb"))
    return ranked.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= least, correlation(F.col("ra"), F.col("rb"))).alias(name))


def candidate_figures(rows: DataFrame, window: list[str], item: str, order: str = "s", year: str = "year", block: int = 20, least: int = 60, min_years: int = 3, year_rows: int = 30, min_blocks: int = 6) -> DataFrame:
    """(window, item, ic, icir, mech, same, cov) for ``rows`` (window, item, order, year, x, y, level): one row an item and session of the
    window, y not null, x null where the item has no value.

    ic: rank correlation with y; mech: with the level itself; icir: mean over deviation of plain correlations inside blocks of
    ``block`` sessions in a row (half of them with values, 8 at least; ``min_blocks`` blocks); same: of the years with a
    correlation the share that have its sign, where the window has ``min_years`` years of ``year_rows`` sessions and
    the item as many correlations; cov: share of sessions with a value. Null where it can't be told.
    """
    keys = [*window, item]
    w = Window.partitionBy(*keys)
    at = rows.withColumns({"__b": F.floor((F.row_number().over(ordered(keys, order)) - 1) / block), "__n": F.count(F.lit(1)).over(w), "__y": F.count(F.lit(1)).over(Window.partitionBy(*keys, year))})
    cov = rows.groupBy(*keys).agg((F.count("x") / F.count(F.lit(1))).alias("cov"))
    ic, mech = _rank_ic(rows, "x", "y", keys, "ic", least), _rank_ic(rows, "x", "level", keys, "mech", least)
    blocks = at.where((F.col("__b") + 1) * block <= F.col("__n")).groupBy(*keys, "__b").agg(F.when(F.count("x") >= max(8, block // 2), correlation(F.col("x"), F.when(F.col("x").isNotNull(), F.col("y")))).alias("r"))
    sd = F.stddev_samp("r")
    icir = blocks.groupBy(*keys).agg(F.when((F.count(F.lit(1)) >= min_blocks) & (sd > 1e-12), F.avg("r") / sd).alias("icir"))
    years = _rank_ic(at.where(F.col("__y") >= year_rows), "x", "y", [*keys, year], "r", least)
    counted = at.where(F.col("__y") >= year_rows).groupBy(*keys).agg(F.count_distinct(year).alias("years"))
    signs = years.join(ic, keys).groupBy(*keys).agg(F.count_if(F.abs("r") > 1e-12).alias("good"), F.count_if((F.abs("r") > 1e-12) & (F.signum("r") == F.coalesce(F.signum("ic"), F.lit(0.0)))).alias("agree"))
    same = F.when((F.col("years") >= min_years) & (F.col("good") >= min_years), F.col("agree") / F.nullif(F.col("good"), F.lit(0)))
    out = cov
    for part in (ic, icir, mech, signs, counted):
        out = out.join(part, keys, "left")
    return out.select(*keys, "ic", "icir", "mech", same.alias("same"), "cov")


def correlated_pairs(rows: DataFrame, window: list[str], item: str, order: str = "s", cut: float = 0.7, least: int = 60, block: int = 64) -> DataFrame:
    """(window, a, b, rho): the pairs of items, a before b, whose rank correlation over the sessions that both have reaches
    ``cut`` in size; pairs with under ``least`` such sessions have none.

    An item is one row, its values in order; items are dealt into blocks, and each pair of blocks is a group of at most
    2 x ``block`` items on average, so that pairs are compared side by side and only those over the cut leave a task. Ranks
    belong to the sessions of a pair; where both items have all of the same sessions, an item is ranked once.
    """
    series = rows.where(F.col("x").isNotNull()).groupBy(*window, item).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("s"), F.col("x").cast("double").alias("x")))).alias("v"))
    series = series.select(*window, F.col(item).alias("item"), F.transform("v", lambda r: r["s"]).alias("s"), F.transform("v", lambda r: r["x"]).alias("x"))
    most = series.groupBy(*window).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, math.ceil(most / block))
    own = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = series.withColumn("own", own).withColumn("other", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")
    types = dict(series.dtypes)

    def ranked(v):
        return pd.Series(v).rank().to_numpy()

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item", kind="stable")
        held = [(it, np.asarray(s), np.asarray(x, float), ranked(x), b) for it, s, x, b in zip(group["item"], group["s"], group["x"], group["own"], strict=True)]
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        found = []
        for p, (a, sa, xa, ra, ba) in enumerate(held):
            for b, sb, xb, rb, bb in held[p + 1 :]:
                if i != j and ba == bb:
                    continue
                if len(sa) != len(sb) or (sa != sb).any():
                    both, at, to = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
                    u, v = (ranked(xa[at]), ranked(xb[to])) if len(both) >= least else (ra[:0], rb[:0])
                else:
                    u, v = ra, rb
                if len(u) >= least and u.std() > 0 and v.std() > 0:
                    rho = float(np.corrcoef(u, v)[0, 1])
                    if abs(rho) >= cut:
                        found.append((a, b, rho))
        out = pd.DataFrame(found, columns=["a", "b", "rho"])
        for c in window:
            out[c] = group[c].iloc[0]
        return out[[*window, "a", "b", "rho"]]

    schema = ", ".join(f"{c} {types[c]}" for c in window) + (", " if window else "") + f"a {types['item']}, b {types['item']}, rho double"
    return dealt.groupBy(*window, "i", "j").applyInPandas(compare, schema)


def independent_set(items: DataFrame, pairs: DataFrame, window: list[str], item: str, place: str = "place") -> DataFrame:
    """``items`` (window, item, place) with ``kept``: in order of place an item is kept unless it makes a pair with one kept before it.

    Each round decides, everywhere at once, the items whose earlier partners are all decided: those with a kept one go, those
    with none left stay. A round is two joins on the items; rounds are as many as the longest chain of partners.
    """
    own = items.select(*window, F.col(item).alias("item"), F.col(place).alias("place"))
    first, then = own.select(*window, F.col("item").alias("a"), F.col("place").alias("pa")), own.select(*window, F.col("item").alias("b"), F.col("place").alias("pb"))
    placed = pairs.select(*window, "a", "b").join(first, [*window, "a"]).join(then, [*window, "b"])
    before = F.col("pa") < F.col("pb")
    edges = settled(placed.select(*window, F.when(before, F.col("a")).otherwise(F.col("b")).alias("hi"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("item")), "partners")
    state = settled(own.withColumn("kept", F.lit(None).cast("boolean")), "kept")
    while state.where("kept is null").limit(1).count():
        known = edges.join(state.select(*window, F.col("item").alias("hi"), F.col("kept").alias("of")), [*window, "hi"])
        seen = known.groupBy(*window, "item").agg(F.max("of").alias("any"), F.count_if(F.col("of").isNull()).alias("open"))
        decided = F.when(F.col("any"), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        state = settled(state.join(seen, [*window, "item"], "left").withColumn("kept", F.coalesce("kept", decided)).select(*window, "item", "place", "kept"), "kept")
    return items.join(state.select(*window, F.col("item").alias(item), "kept"), [*window, item])


def screen_window(rows: DataFrame, window: list[str], item: str, group: str, order: str = "s", year: str = "year", mech_cut: float = 0.7, min_cov: float = 0.8, min_same: float = 0.8, quantile: float = 0.5, rho_cut: float = 0.7, least_group: int = 4, least: int = 60) -> DataFrame:
    """(window, item, group, ic, icir, mech, same, cov, alive, passed, place, kept) of every candidate of every window.

    alive: ic and icir there, not tied to the level by ``mech_cut``, ``min_cov`` of the sessions, and the sign of ``min_same`` of the
    years where that can be told. passed: alive and, in a group with ``least_group`` that are, |ic| and |icir| of the group's
    ``quantile`` or more. place: order of those by |icir|, then item. kept: of two that go together by ``rho_cut`` the first stays.
    ``rows`` as for ``candidate_figures``, with ``group`` fixed for an item. Windows are screened side by side. No rows, no rows.
    """
    names = rows.groupBy(*window, item).agg(F.min(group).alias(group))
    f = candidate_figures(rows, window, item, order, year, least=least).join(names, [*window, item])
    f = f.withColumns({c: F.round(c, 9) for c in ("ic", "icir", "mech")})
    alive = F.col("ic").isNotNull() & F.col("icir").isNotNull() & (F.coalesce(F.abs("mech"), F.lit(0.0)) < mech_cut) & (F.col("cov") >= min_cov) & (F.coalesce("same", F.lit(1.0)) >= min_same)
    f = settled(f.withColumn("alive", alive), "figures")
    edges = f.where("alive").groupBy(*window, group).agg(F.count(F.lit(1)).alias("m"), F.percentile(F.abs("ic"), F.lit(quantile)).alias("t1"), F.percentile(F.abs("icir"), F.lit(quantile)).alias("t2")).where(F.col("m") >= least_group)
    passed = F.col("alive") & F.coalesce((F.abs("ic") >= F.col("t1")) & (F.abs("icir") >= F.col("t2")), F.lit(False))
    f = f.join(edges, [*window, group], "left").withColumn("passed", passed).drop("m", "t1", "t2")
    by = Window.partitionBy(*window, "passed").orderBy(F.desc(F.abs("icir")), item)
    f = settled(f.withColumn("place", F.when(F.col("passed"), F.row_number().over(by))), "passed")
    some = f.where("passed").select(*window, item, "place")
    pairs = correlated_pairs(rows.join(some, [*window, item], "left_semi"), window, item, order, rho_cut, least)
    kept = independent_set(some, settled(pairs, "pairs"), window, item).select(*window, item, "kept")
    return f.join(kept, [*window, item], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
