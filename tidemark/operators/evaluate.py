"""Evaluation of forecasts, signals and trades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import ordered


def share(hit: Column, of: Column) -> Column:
    """Count of ``of`` that ``hit``, by the count of ``of``; null where there are none."""
    return F.count_if(of & hit) / F.nullif(F.count_if(of), F.lit(0))


def extended_metrics(pred: Column, actual: Column) -> dict[str, Column]:
    """Errors, bias, direction, recalls, precisions and the 2 x 3 confusion over rows that have both.

    Directions are counted where the actual isn't 0; a forecast of 0 counts as wrong there.
    """
    ok = pred.isNotNull() & actual.isNotNull()
    up, down, moved = ok & (actual > 0), ok & (actual < 0), ok & (actual != 0)
    error = F.when(ok, pred - actual)
    up_recall, down_recall = share(pred > 0, up), share(pred < 0, down)
    total = F.sum(F.when(ok, actual).cast("double"))
    spread = F.sum(F.when(ok, actual.cast("double") * actual)) - total * total / F.count_if(ok)
    out = {
        "n": F.count_if(ok), "mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)), "bias": F.avg(error),
        "r2": F.when(spread > 0, 1 - F.sum(error * error) / spread),
        "direction_n": F.count_if(moved), "direction_correct": F.count_if(moved & (F.signum(pred) == F.signum(actual))),
        "direction_accuracy": share(F.signum(pred) == F.signum(actual), moved),
        "up_recall": up_recall, "down_recall": down_recall, "balanced_accuracy": (up_recall + down_recall) / 2,
        "up_precision": share(actual > 0, moved & (pred > 0)), "down_precision": share(actual < 0, moved & (pred < 0)),
    }
    for a, side in ((-1, "down"), (1, "up")):
        for b, said in ((-1, "down"), (0, "flat"), (1, "up")):
            out[f"{side}_said_{said}"] = F.count_if(ok & (F.signum(actual) == a) & (F.signum(pred) == b))
    return out


def completed_rolling(df: DataFrame, pred: str, actual: str, keys: list[str], rows: int = 63, horizon: int = 6, order: str = "s") -> DataFrame:
    """(keys, order, direction_accuracy, mae) over the last ``rows`` rows whose actuals are all there, stamped ``horizon``
    rows later, when the last of those labels is complete."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    p, y = F.col(pred), F.col(actual)
    full = F.count(y).over(w) == rows
    moved = y.isNotNull() & p.isNotNull() & (y != 0)
    hit = F.count(F.when(moved & (F.signum(p) == F.signum(y)), 1)).over(w) / F.nullif(F.count(F.when(moved, 1)).over(w), F.lit(0))
    mae = F.sum(F.abs(p - y)).over(w) / F.count(p - y).over(w)
    now = df.select(*keys, order, F.when(full, hit).alias("hit"), F.when(full, mae).alias("err"))
    then = ordered(keys, order)
    return now.select(*keys, order, F.lag("hit", horizon).over(then).alias("direction_accuracy"), F.lag("err", horizon).over(then).alias("mae"))


def probability_metrics(p: Column, up: Column) -> dict[str, Column]:
    """Brier score, log loss (p kept off 0 and 1), accuracy and mean rates; ``up`` is 1 or 0."""
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return {"n": F.count(p), "brier": F.avg((p - up) * (p - up)), "log_loss": -F.avg(up * F.ln(q) + (1 - up) * F.ln(1 - q)), "accuracy": F.avg(((p >= 0.5) == (up == 1)).cast("double")), "mean_probability": F.avg(p), "up_rate": F.avg(up.cast("double"))}


def trade_figures(pnl: Column, closed: Column) -> dict[str, Column]:
    """Of closed trades: counts, rates, mean gain and loss, payoff ratio and profit factor; of open ones the floating profit."""
    win, loss = closed & (pnl > 0), closed & (pnl < 0)
    gain, lost = F.sum(F.when(win, pnl)), -F.sum(F.when(loss, pnl))
    mean_win, mean_loss = gain / F.count_if(win), lost / F.count_if(loss)
    return {
        "closed_n": F.count_if(closed), "open_n": F.count_if(~closed), "wins": F.count_if(win), "losses": F.count_if(loss),
        "win_rate": share(pnl > 0, closed), "mean_pnl": F.sum(F.when(closed, pnl)) / F.nullif(F.count_if(closed), F.lit(0)),
        "closed_pnl": F.coalesce(F.sum(F.when(closed, pnl)), F.lit(0)), "floating_pnl": F.coalesce(F.sum(F.when(~closed, pnl)), F.lit(0)),
        "average_win": mean_win, "average_loss": mean_loss, "payoff_ratio": mean_win / mean_loss, "profit_factor": gain / lost,
    }


def signal_outcomes(df: DataFrame, signal: str, target: str, keys: list[str]) -> DataFrame:
    """(keys, side, n, hit, mean) of the signed outcomes of signals that aren't 0; side null is both."""
    s, y = F.col(signal), F.col(target)
    out = df.where((s != 0) & y.isNotNull()).select(*keys, s.alias("side"), (s * y).alias("__o"))
    both = out.unionByName(out.withColumn("side", F.lit(None).cast(dict(out.dtypes)["side"])))
    return both.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("__o") > 0) / F.count(F.lit(1))).alias("hit"), (F.sum("__o") / F.count(F.lit(1))).alias("mean"))


def period_slices(df: DataFrame, period: str, keys: list[str], order: str = "s") -> DataFrame:
    """Per period of a path (position, daily_pnl): profit, deepest fall counted anew from 0, profit by side, sessions held,
    and whether the first session carries a position in."""
    w = Window.partitionBy(*keys, period).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = df.withColumn("__eq", F.sum("daily_pnl").over(w))
    m = e.withColumn("__dd", F.greatest(F.lit(0.0), F.max("__eq").over(w)) - F.col("__eq"))
    pos = F.col("position")
    return m.groupBy(*keys, period).agg(F.count(F.lit(1)).alias("n"), F.sum("daily_pnl").alias("total"), F.max("__dd").alias("max_drawdown"), F.coalesce(F.sum(F.when(pos == 1, F.col("daily_pnl"))), F.lit(0.0)).alias("long_pnl"), F.coalesce(F.sum(F.when(pos == -1, F.col("daily_pnl"))), F.lit(0.0)).alias("short_pnl"), F.count_if(pos != 0).alias("position_days"), (F.min_by(pos, order) != 0).alias("carried_in"))


def paired_correctness(df: DataFrame, a: str, b: str, actual: str) -> dict[str, Column]:
    """How often both forecasts have the direction, one alone, or none."""
    y = F.col(actual)
    right = {c: F.signum(F.col(c)) == F.signum(y) for c in (a, b)}
    ok = F.col(a).isNotNull() & F.col(b).isNotNull() & y.isNotNull() & (y != 0)
    return {"both": F.count_if(ok & right[a] & right[b]), "only_a": F.count_if(ok & right[a] & ~right[b]), "only_b": F.count_if(ok & ~right[a] & right[b]), "neither": F.count_if(ok & ~right[a] & ~right[b])}


def without_jumps(df: DataFrame, source: str, keys: list[str], share_: float = 0.99, before: int = 6, after: int = 5, order: str = "s") -> DataFrame:
    """``df`` less the rows from ``before`` before to ``after`` after a change of ``source`` over its own quantile."""
    step = df.withColumn("__d", F.abs(F.col(source) - F.lag(source).over(ordered(keys, order))))
    bound = step.groupBy(*keys).agg(F.percentile("__d", F.lit(share_)).alias("__bound"))
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(-after, before)
    marked = step.join(bound, keys).withColumn("__near", F.max((F.col("__d") > F.col("__bound")).cast("int")).over(near))
    return marked.where(F.coalesce("__near", F.lit(0)) == 0).drop("__d", "__bound", "__near")


def largest_changes(df: DataFrame, value: str, keys: list[str], most: int = 8, order: str = "s") -> DataFrame:
    """The ``most`` largest absolute one-row changes per key, with the value before; ties by order."""
    w = ordered(keys, order)
    step = df.withColumn("before", F.lag(value).over(w)).withColumn("change", F.col(value) - F.col("before")).where("change is not null")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("change")), order))
    return step.withColumn("place", place).where(F.col("place") <= most)


def histogram(df: DataFrame, value: str, keys: list[str], low: int = 14, high: int = 36) -> DataFrame:
    """(keys, bin, left, right, n): bins as wide as the quartile range over the cube root of n says, their number kept
    within ``low`` and ``high``; a little room at both ends, and none under 0."""
    x = F.col(value).cast("double")
    have = df.where(x.isNotNull())
    s = have.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.stddev_samp(x).alias("sd"))
    width = 2 * (F.col("q")[1] - F.col("q")[0]) / F.cbrt("n")
    width = F.when(width > 0, width).otherwise(3.49 * F.col("sd") / F.cbrt("n"))
    s = s.withColumn("bins", F.greatest(F.lit(low), F.least(F.lit(high), F.floor((F.col("hi") - F.col("lo")) / width + 0.5)))).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("bins"))
    s = s.withColumn("left0", F.greatest(F.lit(0.0), F.col("lo") - F.col("w") * 0.55)).withColumn("w", (F.col("hi") + F.col("w") * 0.55 - F.col("left0")) / F.col("bins"))
    at = F.least(F.col("bins") - 1, F.greatest(F.lit(0), F.floor((x - F.col("left0")) / F.col("w")))).cast("int")
    counts = have.join(s.select(*keys, "bins", "left0", "w"), keys).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = s.select(*keys, "left0", "w", F.explode(F.sequence(F.lit(0), F.col("bins").cast("int") - 1)).alias("bin"))
    left = F.col("left0") + F.col("bin") * F.col("w")
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", left.alias("left"), (left + F.col("w")).alias("right"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def density(df: DataFrame, value: str, keys: list[str], points: int = 141) -> DataFrame:
    """(keys, point, x, density): Gaussian kernel density on a grid from the least to the largest value; the bandwidth is
    0.9 min(sd, quartile range / 1.34) n^(-1/5). Values are counted first, so that ties cost nothing."""
    v = F.col(value).cast("double")
    have = df.where(v.isNotNull())
    s = have.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("sd"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    s = s.withColumn("h", 0.9 * F.least("sd", (F.col("q")[1] - F.col("q")[0]) / 1.34) * F.pow(F.col("n").cast("double"), F.lit(-0.2))).where("h > 0")
    grid = s.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1))
    each = have.groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    z = (F.col("x") - F.col("v")) / F.col("h")
    total = grid.join(each, keys).groupBy(*keys, "point", "x", "n", "h").agg(F.sum(F.col("c") * F.exp(-z * z / 2)).alias("t"))
    return total.select(*keys, "point", "x", (F.col("t") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def percentile_in_sample(x: Column, sample: str) -> Column:
    """Midrank of ``x`` among the values of the array column ``sample``, 0 to 100."""
    below, same = F.size(F.filter(sample, lambda v: v < x - 1e-9)), F.size(F.filter(sample, lambda v: F.abs(v - x) < 1e-9))
    return F.lit(100.0) * (below + same / 2) / F.size(sample)


#: Shares of p under 0.05, and medians, that a uniform sample may have; a share that says enriched.
UNIFORM_SHARE, UNIFORM_MEDIAN, ENRICHED_SHARE = (0.03, 0.09), (0.35, 0.65), 0.15


def p_verdict(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    """(keys, n, share, share10, median_p, verdict): shares of p under 0.05 and 0.1, the median, and what they say: ``uniform``,
    ``enriched`` or ``deviating``, which somebody should look at."""
    under, median = F.avg((F.col(p) < 0.05).cast("double")), F.percentile(p, F.lit(0.5))
    verdict = F.when(under.between(*UNIFORM_SHARE) & median.between(*UNIFORM_MEDIAN), "uniform").when(under > ENRICHED_SHARE, "enriched").otherwise("deviating")
    figures = {"n": F.count(F.lit(1)), "share": under, "share10": F.avg((F.col(p) < 0.1).cast("double")), "median_p": median, "verdict": verdict}
    return df.where(F.col(p).isNotNull()).groupBy(*keys).agg(*[c.alias(n) for n, c in figures.items()])
