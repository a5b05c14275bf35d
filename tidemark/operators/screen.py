"""Factor screening: distributions of a label by a factor's standing, robust statistics, rolling and blocked rank correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import average_rank, ordered
from tidemark.operators.stats import correlation, exact_correlation

#: Quintile borders of the standard normal distribution, and borders of the six percentile bins.
Z_CUTS = (-0.8416, -0.2533, 0.2533, 0.8416)
PERCENT_BINS = (0, 10, 25, 50, 75, 90, 100)


def doubled_ranks(x: str, keys: list[str]) -> Column:
    """Twice the average rank: a whole number, so that sums of it are exact."""
    return (2 * average_rank(F.col(x), keys)).cast("long")


def z_groups(df: DataFrame, z: str, y: str, keys: list[str], least: int = 20) -> DataFrame:
    """Mean of ``y`` in five groups by ``Z_CUTS`` (q1 to q5, null under ``least`` rows), whether they rise or fall all the
    way (``mono`` 1 or -1, else 0), and q5 - q1."""
    have = df.where(F.col(z).isNotNull() & F.col(y).isNotNull())
    group = sum((F.col(z) > c).cast("int") for c in Z_CUTS)
    means = have.groupBy(*keys).agg(*[F.when(F.count_if(group == i) >= least, F.sum(F.when(group == i, F.col(y))) / F.count_if(group == i)).alias(f"q{i + 1}") for i in range(5)])
    steps = [F.coalesce(F.signum(F.col(f"q{i + 2}") - F.col(f"q{i + 1}")), F.lit(0.0)) for i in range(4)]
    total = sum(steps, F.lit(0.0))
    return means.withColumn("mono", F.when(total == 4, 1).when(total == -4, -1).otherwise(0)).withColumn("spread", F.col("q5") - F.col("q1"))


def conditional_distribution(df: DataFrame, p: str, y: str, keys: list[str], least: int = 10) -> DataFrame:
    """(keys, bin, n, mean, median, sd, up, p05, p95) of ``y`` in six bins of the percentile ``p``; n is 0 and the rest
    null under ``least`` rows. Every key has all six bins."""
    have = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    bin_ = sum((F.col(p) >= c).cast("int") for c in PERCENT_BINS[1:-1]).alias("bin")
    v = F.col(y).cast("double")
    got = have.groupBy(*keys, bin_).agg(F.count(F.lit(1)).alias("__n"), F.avg(v).alias("mean"), F.percentile(v, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("__q"), F.stddev_samp(v).alias("sd"), (100 * F.avg((v > 0).cast("double"))).alias("up"))
    grid = have.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(PERCENT_BINS) - 2))))
    enough = F.col("__n") >= least
    figures = {"mean": (F.col("mean"), 3), "median": (F.col("__q")[1], 3), "sd": (F.col("sd"), 3), "up": (F.col("up"), 1), "p05": (F.col("__q")[0], 3), "p95": (F.col("__q")[2], 3)}
    return grid.join(got, [*keys, "bin"], "left").select(*keys, "bin", F.when(enough, F.col("__n")).otherwise(0).cast("long").alias("n"), *[F.when(enough, F.round(c, k)).alias(name) for name, (c, k) in figures.items()])


def bin_shape(cond: DataFrame, keys: list[str], least_bins: int = 4) -> DataFrame:
    """What the bins of ``conditional_distribution`` say beyond a line: range of the means and of the up shares, rank
    correlation of mean and bin, largest over smallest deviation, best upper over worst lower tail. Null under ``least_bins``."""
    full = cond.where("n >= 10 and mean is not null and sd is not null")
    ranked = full.withColumn("a", doubled_ranks("bin", keys)).withColumn("b", doubled_ranks("mean", keys))
    low, high, small = F.min("p05"), F.max("p95"), F.min("sd")
    figures = {"crange": F.max("mean") - F.min("mean"), "cprange": F.max("up") - F.min("up"), "cmono": exact_correlation(F.col("a"), F.col("b")), "cvr": F.when(small > 0, F.max("sd") / small), "tr": F.when((low < 0) & (high > 0), high / F.abs(low))}
    return ranked.groupBy(*keys).agg(*[F.when(F.count(F.lit(1)) >= least_bins, c).alias(n) for n, c in figures.items()])


def signal_figures(df: DataFrame, z: str, y: str, keys: list[str], order: str = "s", on: float = 1.0, tail: float = 2.0) -> DataFrame:
    """Of positions of 1 over ``on`` and -1 under -``on``: hit rates (all, long, short; null under 20), payoff and tail
    payoff (null under 5 gains or losses), and the share of rows on which the position changes."""
    have = df.where(F.col(z).isNotNull() & F.col(y).isNotNull())
    pos = F.when(F.col(z) > on, 1).when(F.col(z) < -on, -1).otherwise(0)
    m = have.withColumn("__p", pos).withColumn("__g", F.col("__p") * F.col(y))
    m = m.withColumn("__turn", (F.col("__p") != F.lag("__p").over(ordered(keys, order))).cast("int"))

    def rate(side, hit):
        return F.when(F.count_if(side) >= 20, F.count_if(side & hit) / F.count_if(side))

    def payoff(inside):
        gain, loss = inside & (F.col("__g") > 0), inside & (F.col("__g") < 0)
        ratio = (F.sum(F.when(gain, F.col("__g"))) / F.count_if(gain)) / -(F.sum(F.when(loss, F.col("__g"))) / F.count_if(loss))
        return F.when((F.count_if(gain) >= 5) & (F.count_if(loss) >= 5), ratio)

    p, g = F.col("__p"), F.col("__g")
    return m.groupBy(*keys).agg(rate(p != 0, g > 0).alias("win"), rate(p > 0, F.col(y) > 0).alias("win_long"), rate(p < 0, F.col(y) < 0).alias("win_short"), payoff(p != 0).alias("payoff"), payoff((F.abs(F.col(z)) > tail) & (p != 0)).alias("tail_payoff"), F.avg("__turn").alias("turnover"))


def hac_t(df: DataFrame, x: str, y: str, keys: list[str], lags: Column | int, order: str = "s", ranks: bool = False) -> DataFrame:
    """(keys, n, lag, t): t of the slope of y on x with Bartlett weights over ``lags`` sessions; a column may use ``n``.

    A session without both values is a score of 0 and keeps its slot. With ``ranks`` the slope is that of average ranks
    and the variance gets n / (n - 2). Null under 30 rows, or without spread.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(*keys)
    if ranks:
        both = both.select(*keys, F.col(order).alias("__s"), (doubled_ranks(x, keys) / F.lit(2.0)).alias("__x"), (doubled_ranks(y, keys) / F.lit(2.0)).alias("__y"))
    else:
        both = both.select(*keys, F.col(order).alias("__s"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    centred = both.select(*keys, "__s", (F.col("__x") - F.avg("__x").over(w)).alias("a"), (F.col("__y") - F.avg("__y").over(w)).alias("b"), F.count(F.lit(1)).over(w).alias("n"))
    fit = centred.withColumn("sxx", F.sum(F.col("a") * F.col("a")).over(w)).withColumn("beta", F.sum(F.col("a") * F.col("b")).over(w) / F.nullif(F.col("sxx"), F.lit(0.0)))
    u = fit.select(*keys, "__s", "n", "sxx", "beta", (F.col("a") * (F.col("b") - F.col("beta") * F.col("a"))).alias("u"))
    u = u.withColumn("lag", F.lit(lags).cast("int") if isinstance(lags, int) else lags.cast("int"))
    ahead = u.select(*keys, F.col("__s"), F.col("u").alias("v"))
    steps = u.select(*keys, "n", "sxx", "beta", "lag", "u", F.explode(F.sequence(F.lit(0), F.col("lag"))).alias("l"), "__s").withColumn("__s", F.col("__s") - F.col("l"))
    pairs = steps.join(ahead, [*keys, "__s"])
    weight = F.when(F.col("l") == 0, 1.0).otherwise(2 * (1 - F.col("l") / (F.col("lag") + 1.0)))
    v = F.sum(weight * F.col("u") * F.col("v"))
    if ranks:
        v = v * F.first("n") / (F.first("n") - 2)
    t = F.first("beta") * F.first("sxx") / F.sqrt(v)
    return pairs.groupBy(*keys).agg(F.first("n").alias("n"), F.first("lag").alias("lag"), F.when((F.first("n") >= 30) & (v > 0), t).alias("t"))


def rank_hac(df: DataFrame, x: str, y: str, keys: list[str], order: str = "s") -> DataFrame:
    """``hac_t`` of ranks with the lag max(5, floor(4 (n / 100)^(2/9)))."""
    return hac_t(df, x, y, keys, F.greatest(F.lit(5), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9)))), order, ranks=True)


def thinned_t(df: DataFrame, x: str, y: str, keys: list[str], stride: int, order: str = "s", least: int = 15) -> DataFrame:
    """(keys, m, t): plain slope t on every ``stride``-th row that has both values, so that labels don't overlap."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    some = both.withColumn("__i", F.row_number().over(ordered(keys, order)) - 1).where(F.col("__i") % stride == 0)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    m, sxx = F.count(F.lit(1)), F.regr_sxx(b, a)
    rest = F.regr_syy(b, a) - F.regr_sxy(b, a) * F.regr_sxy(b, a) / F.nullif(sxx, F.lit(0.0))
    return some.groupBy(*keys).agg(m.alias("m"), F.when((m >= least) & (sxx > 0) & (rest > 0), F.regr_sxy(b, a) / F.nullif(sxx, F.lit(0.0)) / F.sqrt(rest / (m - 2) / sxx)).alias("t"))


def rejected(df: DataFrame, p: str, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """``df`` with ``rejected`` by Benjamini-Hochberg within ``keys``; null p are never rejected and not counted."""
    own = Window.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last())
    group = Window.partitionBy(*keys)
    ranked = df.withColumn("__r", F.row_number().over(own)).withColumn("__m", F.count(p).over(group))
    last = F.max(F.when(F.col(p) <= alpha * F.col("__r") / F.col("__m"), F.col(p))).over(group)
    return ranked.withColumn("rejected", F.coalesce(F.col(p) <= last, F.lit(False))).drop("__r", "__m")


def reject_set(df: DataFrame, p: str, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """``rejected`` with the group's ``median_p``."""
    medians = df.groupBy(*keys).agg(F.percentile(p, F.lit(0.5)).alias("median_p"))
    return rejected(df, p, keys, alpha).join(medians, keys)


def rolling_correlation(x: str, y: str, keys: list[str], rows: int, order: str = "s") -> Column:
    """Correlation over the last ``rows`` rows, all with both values, which may be fractions; null without spread."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    full = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(w) == rows
    return F.when(full, correlation(F.col(x), F.col(y), w))


def _ranks(a: np.ndarray) -> np.ndarray:
    """Average ranks along the last axis; NaN stay out."""
    less = (a[..., None, :] < a[..., :, None]).sum(-1)
    same = (a[..., None, :] == a[..., :, None]).sum(-1)
    return less + (same + 1) / 2


def rolling_spearman(df: DataFrame, x: str, y: str, keys: list[str], rows: int = 60, least: int = 54, order: str = "s", span: int = 2048) -> DataFrame:
    """(keys, order, n, ic): rank correlation over the last ``rows`` session rows, gaps keeping their slot; null under
    ``least`` pairs or without spread.

    Ranks belong to their window, so each is ranked anew, in numpy. A series is cut into spans of ``span`` sessions, each
    with the rows before it, so that a task's work is bounded whatever the series' length.
    """
    at = (F.row_number().over(ordered(keys, order)) - 1).alias("__i")
    numbered = df.select(*keys, order, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), at)
    first, last = F.floor(F.col("__i") / span), F.floor((F.col("__i") + rows - 1) / span)
    spans = numbered.withColumn("__span", F.explode(F.sequence(first, last)))
    types = dict(df.dtypes)
    out = ", ".join(f"{c} {types[c]}" for c in (*keys, order)) + ", n long, ic double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__i")
        a, b = group["__x"].to_numpy(float), group["__y"].to_numpy(float)
        own = (group["__i"] // span == group["__span"]).to_numpy()
        ok = ~(np.isnan(a) | np.isnan(b))
        a, b = np.where(ok, a, np.nan), np.where(ok, b, np.nan)
        ic, n = np.full(len(a), np.nan), np.zeros(len(a), np.int64)
        for end in range(len(a)):
            n[end] = ok[max(0, end - rows + 1) : end + 1].sum()
        for first in range(rows - 1, len(a), 256):
            ends = np.arange(first, min(first + 256, len(a)))
            window = ends[:, None] + np.arange(1 - rows, 1)
            here = ok[window]
            p, q = (np.where(here, 2 * _ranks(v[window]), 0.0) for v in (a, b))
            m = here.sum(1)
            va, vb = m * (p * p).sum(1) - p.sum(1) ** 2, m * (q * q).sum(1) - q.sum(1) ** 2
            good = (m >= least) & (va > 0) & (vb > 0)
            ic[ends[good]] = ((m * (p * q).sum(1) - p.sum(1) * q.sum(1))[good]) / np.sqrt(va[good] * vb[good])
        return pd.DataFrame({**{c: group[c].to_numpy() for c in (*keys, order)}, "n": n, "ic": ic})[own]

    done = spans.groupBy(*keys, "__span").applyInPandas(run, out)
    return done.withColumn("ic", F.nanvl("ic", F.lit(None).cast("double")))


def icir(ics: DataFrame, ic: str, keys: list[str]) -> DataFrame:
    """(keys, icir, rolling_n): mean over sample deviation of a series of correlations; null under two or without spread."""
    sd = F.stddev_samp(ic)
    return ics.where(F.col(ic).isNotNull()).groupBy(*keys).agg(F.when(sd > 1e-12, F.avg(ic) / sd).alias("icir"), F.count(F.lit(1)).alias("rolling_n"))


def trailing_blocks(df: DataFrame, x: str, y: str, keys: list[str], blocks: int = 4, rows: int = 63, least: int = 54, order: str = "s") -> DataFrame:
    """(keys, block, n, ic) of the last ``blocks`` blocks of ``rows`` session rows, 0 the oldest: rank correlations by block."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))) - 1
    placed = df.withColumn("block", (F.lit(blocks - 1) - F.floor(back / rows)).cast("int")).where("block >= 0")
    both = placed.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*keys, "block", doubled_ranks(x, [*keys, "block"]).alias("a"), doubled_ranks(y, [*keys, "block"]).alias("b"))
    n = F.count(F.lit(1))
    return ranked.groupBy(*keys, "block").agg(n.alias("n"), F.when(n >= least, exact_correlation(F.col("a"), F.col("b"))).alias("ic"))


def global_percentile(df: DataFrame, value: str, eligible: str, name: str) -> DataFrame:
    """``df`` with the average-rank percentile of |value| among the eligible rows (0 to 100; one alone 50), else null.

    Ranks come from counts by distinct size, so that only a table of sizes is ordered in one place.
    """
    some = df.where(F.col(eligible)).select(F.abs(F.col(value)).alias("__v"))
    sizes = some.groupBy("__v").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = sizes.agg(F.sum("__c").alias("__m"))
    placed = sizes.withColumn("__b", before).crossJoin(total)
    rank = F.col("__b") + (F.col("__c") - 1) / 2.0
    pct = placed.select("__v", F.when(F.col("__m") == 1, 50.0).otherwise(100 * rank / (F.col("__m") - 1)).alias(name))
    joined = df.withColumn("__v", F.when(F.col(eligible), F.abs(F.col(value))))
    return joined.join(pct, "__v", "left").drop("__v")


def screen(df: DataFrame, x: str, y: str, keys: list[str], order: str = "s", min_obs: int = 300, coverage: float = 0.9, floor: float = 0.03, rank_cut: float = 60.0, same_blocks: int = 3, group_least: int = 20, most: int = 20, roll_least: int = 54, block_least: int = 54) -> DataFrame:
    """One row a factor with its figures, the eight conditions, what remains of it, and its place.

    Conditions: ``data`` (enough pairs and coverage, figures there), ``ic_floor``, ``ic_rank`` and ``icir_rank`` (standing
    among the eligible), ``sign_agree``, ``group_count`` and ``group_trend`` (quintiles), ``stability`` (trailing blocks).
    ``place`` orders those that pass all by score, |ic|, |icir| and key; the first ``most`` are selected, the rest capped.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    size = df.groupBy(*keys).agg(F.count_if(both).alias("n"), (F.count_if(both) / F.count(F.lit(1))).alias("coverage"))
    have = df.where(both)
    ranked = have.select(*keys, doubled_ranks(x, keys).alias("a"), doubled_ranks(y, keys).alias("b"))
    ic = ranked.groupBy(*keys).agg(F.round(exact_correlation(F.col("a"), F.col("b")), 9).alias("ic"))
    ir = icir(rolling_spearman(df, x, y, keys, least=roll_least, order=order), "ic", keys).withColumn("icir", F.round("icir", 7))
    blocks = trailing_blocks(df, x, y, keys, least=block_least, order=order)
    edges = have.groupBy(*keys).agg(F.percentile(x, F.array(*[F.lit(v) for v in (0.2, 0.4, 0.6, 0.8)])).alias("__q"))
    binned = have.join(edges, keys).withColumn("__b", F.size(F.filter("__q", lambda v: F.col(x) > v)))
    means = binned.groupBy(*keys).agg(*[F.count_if(F.col("__b") == i).alias(f"__n{i}") for i in range(5)], *[(F.sum(F.when(F.col("__b") == i, F.col(y))) / F.nullif(F.count_if(F.col("__b") == i), F.lit(0))).alias(f"__m{i}") for i in range(5)])
    figures = size.join(ic, keys, "left").join(ir, keys, "left").join(means, keys, "left")
    sign = F.coalesce(F.signum("ic"), F.lit(0.0))
    steps = sum((F.coalesce((F.col("sign") * (F.col(f"__m{i + 1}") - F.col(f"__m{i}")) > 0).cast("int"), F.lit(0)) for i in range(4)), F.lit(0))
    figures = figures.withColumn("sign", sign).withColumn("steps", steps)
    agreeing = blocks.join(figures.select(*keys, "sign"), keys).groupBy(*keys).agg(F.count_if(F.col("ic") * F.col("sign") > 0).alias("same_blocks"))
    figures = figures.join(agreeing, keys, "left").withColumn("same_blocks", F.coalesce("same_blocks", F.lit(0)))
    figures = figures.withColumn("data", (F.col("n") >= min_obs) & (F.col("coverage") >= coverage) & F.col("ic").isNotNull() & F.col("icir").isNotNull())
    figures = global_percentile(global_percentile(figures, "ic", "data", "ic_pct"), "icir", "data", "icir_pct")
    checks = {
        "data": F.col("data"),
        "ic_floor": F.abs("ic") >= floor,
        "ic_rank": F.col("ic_pct") >= rank_cut,
        "icir_rank": F.col("icir_pct") >= rank_cut,
        "sign_agree": F.col("ic") * F.col("icir") > 0,
        "group_count": F.least(*[F.col(f"__n{i}") for i in range(5)]) >= group_least,
        "group_trend": (F.col("sign") * (F.col("__m4") - F.col("__m0")) > 0) & (F.col("steps") >= 3),
        "stability": F.col("same_blocks") >= same_blocks,
    }
    passed = F.array(*[F.coalesce(c, F.lit(False)) for c in checks.values()])
    out = figures.withColumn("checks", passed).withColumn("passed", F.forall("checks", lambda c: c))
    out = out.withColumn("score", (F.col("ic_pct") + F.col("icir_pct")) / 2)
    best = Window.partitionBy("passed").orderBy(F.desc("score"), F.desc(F.abs("ic")), F.desc(F.abs("icir")), *keys)
    place = F.when(F.col("passed"), F.row_number().over(best))
    status = F.when(~F.col("data"), "insufficient").when(~F.col("passed"), "rejected").when(F.col("place") <= most, "selected").otherwise("capped")
    return out.withColumn("place", place).withColumn("status", status).select(*keys, "n", "coverage", "ic", "icir", "ic_pct", "icir_pct", "score", "steps", "same_blocks", "checks", "passed", "place", "status")


#: The conditions of ``screen`` in order.
CHECKS = ("data", "ic_floor", "ic_rank", "icir_rank", "sign_agree", "group_count", "group_trend", "stability")


def funnel(screened: DataFrame) -> DataFrame:
    """(stage, name, remaining): how many factors pass each condition and all those before it."""
    kept = [F.count_if(F.forall(F.slice("checks", 1, i + 1), lambda c: c)).alias(str(i)) for i in range(len(CHECKS))]
    rows = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(n).alias("name"), F.col(str(i)).alias("remaining")) for i, n in enumerate(CHECKS)])
    return screened.agg(*kept).select(F.explode(rows).alias("r")).select("r.*")
