"""Factor checkup: many figures for every test of a grid (factor x form x target x horizon) from one partitioning.

A test is a key; its rows are the sessions that have both the factor's value and the label. Rows are dealt once by the
test. All ranks, running sums and lags are windows of that partitioning, and the figures two aggregates over it, so that
fifty thousand tests cost what one scan, one shuffle and a few sorts cost.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import ordered
from tidemark.operators.screen import Z_CUTS, doubled_ranks, rejected
from tidemark.operators.stats import correlation, student_p, turned


def auto_lag(n: int) -> int:
    """Bartlett lags that a sample of n asks for."""
    return int(4 * (n / 100) ** (2 / 9))


def grid(factors: DataFrame, labels: DataFrame, order: str = "s") -> DataFrame:
    """Every factor and form against every target and horizon: rows of both tables that share a session and have values.

    ``factors`` holds x (and what else is wanted) by factor, form and session, ``labels`` y by target, horizon and session.
    A session has few rows on either side, and many sessions spread them.
    """
    return factors.where(F.col("x").isNotNull()).join(labels.where(F.col("y").isNotNull()), order)


def checkup(tests: DataFrame, keys: list[str], horizon: str, horizons: Iterable[int], longest: int, order: str = "s", least: int = 200, rolling: int = 60, on: float = 1.0, tail: float = 1.5) -> DataFrame:
    """One row a test of at least ``least`` rows of ``tests`` (keys, order, x, y, z), x and y not null; ``horizon`` is one of the keys, with values in ``horizons``.

    - n; ic, icp: rank and plain correlation; icir: mean over deviation of the correlations of ``rolling`` rows in a row (over
      10 of them); acf: lag-1 autocorrelation of x; kurt: its excess kurtosis
    - t: slope t with Bartlett weights over max(horizon - 1, ``auto_lag``) rows; m, ti, pind: slope t and p on every
      horizon-th row, so that labels don't overlap (15 rows or more); p: share of all turns of y that do as well as none
    - q1 to q5: mean y by ``Z_CUTS`` of z (20 rows or more), mono: 1 or -1 where they rise or fall all the way, qd: q5 - q1
    - win, wl, ws: hits of positions 1 over ``on`` and -1 under -``on`` (20 or more), pl, tail: mean gain over mean loss (5 of
      each), of all positions and of those with |z| over ``tail``; turn: share of rows on which the position changes

    A row without z has no position and no group. What can't be told is null. ``longest``, at least the number of rows of
    any test, and ``horizons`` say which lags can be asked for. No rows, no rows.
    """
    w, by = Window.partitionBy(*keys), ordered(keys, order)
    x, y, z = (F.col(c).cast("double") for c in ("x", "y", "z"))
    base = tests.select(*keys, order, x.alias("x"), y.alias("y"), z.alias("z"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") >= least)
    ranked = base.withColumns({"ra": doubled_ranks("x", keys), "rb": doubled_ranks("y", keys), "i": F.row_number().over(by) - 1, "a": F.col("x") - F.avg("x").over(w), "b": F.col("y") - F.avg("y").over(w)})
    position = F.when(F.col("z") > on, 1).when(F.col("z") < -on, -1).otherwise(0)
    frame = by.rowsBetween(1 - rolling, 0)
    fitted = ranked.withColumns({
        "sxx": F.sum(F.col("a") * F.col("a")).over(w), "sxy": F.sum(F.col("a") * F.col("b")).over(w), "before": F.lag("a").over(by), "pos": position,
        "rolled": F.when(F.col("i") >= rolling - 1, correlation(F.col("x"), F.col("y"), frame)),
        "lags": F.greatest(F.col(horizon) - 1, F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))), F.lit(1)).cast("int"),
    })
    slope = F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0))
    summed = fitted.withColumns({"beta": slope, "turned": (F.col("pos") != F.lag("pos").over(by)).cast("int"), "upto": F.sum(F.col("a") * (F.col("b") - slope * F.col("a"))).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    # Bartlett's sum over L lags is that of the squared sums of all L + 1 scores in a row, over L + 1
    asked = {max(h - 1, k, 1) for h in horizons for k in range(auto_lag(least), auto_lag(longest) + 1)}
    back = F.coalesce(*[F.when(F.col("lags") == k, F.lag("upto", k + 1, 0.0).over(by)) for k in sorted(asked)])
    scored = summed.withColumn("run", F.col("upto") - back)

    n = F.first("n")
    end = (F.col("i") >= F.col("n") - F.col("lags") - 1) & (F.col("i") <= F.col("n") - 2)
    v = (F.sum(F.col("run") * F.col("run")) + F.coalesce(F.sum(F.when(end, F.col("upto") * F.col("upto"))), F.lit(0.0))) / (F.first("lags") + 1)
    group = sum((F.col("z") > c).cast("int") for c in Z_CUTS)
    gain, side = F.col("pos") * F.col("y"), F.col("pos") != 0
    thin = F.col("i") % F.col(horizon) == 0
    tx, ty = F.when(thin, F.col("x")), F.when(thin, F.col("y"))
    rest = F.regr_syy(ty, tx) - F.regr_sxy(ty, tx) * F.regr_sxy(ty, tx) / F.nullif(F.regr_sxx(ty, tx), F.lit(0.0))

    def rate(where, hit):
        return F.when(F.count_if(where) >= 20, F.count_if(where & hit) / F.count_if(where))

    def payoff(where):
        up, down = where & (gain > 0), where & (gain < 0)
        return F.when((F.count_if(up) >= 5) & (F.count_if(down) >= 5), F.avg(F.when(up, gain)) / -F.avg(F.when(down, gain)))

    figures = {
        "n": n, "ic": correlation(F.col("ra"), F.col("rb")), "icp": correlation(F.col("x"), F.col("y")),
        "icir": F.when((F.count("rolled") > 10) & (F.stddev_samp("rolled") > 0), F.avg("rolled") / F.stddev_samp("rolled")),
        "t": F.when((F.first("sxx") > 0) & (v > 0), F.first("beta") * F.first("sxx") / F.sqrt(v)),
        "m": F.count_if(thin), "ti": F.when((F.count_if(thin) >= 15) & (F.regr_sxx(ty, tx) > 0) & (rest > 0), F.regr_sxy(ty, tx) / F.regr_sxx(ty, tx) / F.sqrt(rest / (F.count_if(thin) - 2) / F.regr_sxx(ty, tx))),
        **{f"q{k + 1}": F.when(F.count_if(group == k) >= 20, F.avg(F.when(group == k, F.col("y")))) for k in range(5)},
        "win": rate(side, gain > 0), "wl": rate(F.col("pos") > 0, F.col("y") > 0), "ws": rate(F.col("pos") < 0, F.col("y") < 0), "pl": payoff(side), "tail": payoff(side & (F.abs("z") > tail)),
        "turn": F.when(n > 2, F.avg("turned")), "kurt": F.when(F.min("x") < F.max("x"), F.kurtosis("x")), "acf": F.sum(F.col("a") * F.col("before")) / F.nullif(F.first("sxx"), F.lit(0.0)),
        "r": turned(F.col("i"), F.col("ra"), F.col("rb")),
    }
    r = F.col("r")
    out = scored.groupBy(*keys).agg(*[c.alias(name) for name, c in figures.items()])
    steps = sum((F.signum(F.col(f"q{k + 2}") - F.col(f"q{k + 1}")) for k in range(4)), F.lit(0.0))
    out = out.withColumns({"mono": F.when(steps == 4, 1).when(steps == -4, -1).otherwise(0), "qd": F.col("q5") - F.col("q1"), "pind": student_p(F.col("ti"), F.col("m") - 2), "p": r["as_good"] / F.col("n")})
    return out.drop("r")


def checkup_slices(tests: DataFrame, keys: list[str], slices: dict[str, Column], order: str = "s", least: int = 40, recent: int = 125) -> DataFrame:
    """(keys, slice, n, ic): rank correlation within parts of every test, null under ``least`` rows.

    ``slices`` maps a kind to a column that names the row's part of that kind, null for none (``year``: the year;
    ``trend``: up or down); a slice is ``kind:part``. ``recent:`` is a test's last ``recent`` rows, null where there are fewer.
    """
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))) <= recent
    names = [F.when(c.isNotNull(), F.concat(F.lit(f"{kind}:"), c.cast("string"))) for kind, c in slices.items()]
    named = tests.select(*keys, "x", "y", F.array(*names).alias("names"), F.when(last, F.lit("recent:")).alias("last"))
    rows = named.select(*keys, "x", "y", F.explode(F.array_compact(F.array_append("names", F.col("last")))).alias("slice"))
    part = [*keys, "slice"]
    ranked = rows.select(*part, doubled_ranks("x", part).alias("ra"), doubled_ranks("y", part).alias("rb"))
    n = F.count(F.lit(1))
    enough = n >= F.when(F.col("slice") == "recent:", recent).otherwise(least)
    return ranked.groupBy(*part).agg(n.alias("n"), F.when(enough, correlation(F.col("ra"), F.col("rb"))).alias("ic"))


def marked(figures: DataFrame, block: list[str], group: str, alpha: float = 0.05) -> DataFrame:
    """``figures`` with ``sig`` and ``sigp``: what Benjamini-Hochberg rejects by pind and by p, within each block and group."""
    by_p = rejected(figures, "pind", [*block, group], alpha).withColumnRenamed("rejected", "sig")
    return rejected(by_p, "p", [*block, group], alpha).withColumnRenamed("rejected", "sigp")
