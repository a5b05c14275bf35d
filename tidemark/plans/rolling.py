"""Rolling and cross-sectional queries on the gapped series and the gap-free level."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators.cross import concentration_index, consensus, cross_rank, side_difference
from tidemark.operators.session import forward_label
from tidemark.sources.sql import with_base
from tidemark.sources.tables import level, orders_by_day, series

def x_():
    return F.col("x")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def on_series(name, column, sql, keep=()):
    QUERIES[name] = lambda spark, sf: series(spark, sf).select("k", "s", *keep, column().alias(name))
    ORACLE_SQL[name] = with_base(f"SELECT k, s, {sql} AS {name} FROM ser")


def on_level(name, column, sql):
    QUERIES[name] = lambda spark, sf: level(spark, sf).select("s", column().alias(name))
    ORACLE_SQL[name] = with_base(f"SELECT s, {sql} AS {name} FROM lvl")


def _w(n, last=0, part="PARTITION BY k "):
    return f"OVER ({part}ORDER BY s ROWS BETWEEN {n - 1 - last} PRECEDING AND {'CURRENT ROW' if not last else f'{-last} PRECEDING'})"


def _mean(x, n, least, part="PARTITION BY k "):
    w = _w(n, part=part)
    return f"CASE WHEN count({x}) {w} >= {least} THEN CAST(sum({x}) {w} AS BIGINT) / count({x}) {w} END"


def _dev(x, n, least, ddof, part="PARTITION BY k "):
    w = _w(n, part=part)
    c, s, q = f"count({x}) {w}", f"CAST(sum({x}) {w} AS BIGINT)", f"CAST(sum({x}*{x}) {w} AS BIGINT)"
    return f"CASE WHEN {c} >= {least} AND {c} > {ddof} AND {c}*{q} > {s}*{s} THEN sqrt(CAST({c}*{q}-{s}*{s} AS DOUBLE)/CAST({c}*({c}-{ddof}) AS DOUBLE)) END"


def _z(x, n, least):
    w = _w(n)
    return f"CASE WHEN {x} IS NOT NULL THEN (CAST({x}*count({x}) {w} - CAST(sum({x}) {w} AS BIGINT) AS DOUBLE)/CAST(count({x}) {w} AS DOUBLE)) / ({_dev(x, n, least, 1)}) END"


def _vals(n, last=0):
    return f"list_filter(list(x) {_w(n, last)}, lambda v: v IS NOT NULL)"


K = ["k"]


def _full(n, sql, part="PARTITION BY k "):
    return f"CASE WHEN count(*) {_w(n, part=part)} = {n} THEN {sql} END"


def full(n, column, last=0):
    return R.full(R.frame(K, n, last=last), n, column)


on_series("ma_strict", lambda: R.mean_over(x_(), R.frame(K, 10), 10), _mean("x", 10, 10))
on_series("ma_min70", lambda: full(20, R.mean_over(x_(), R.frame(K, 20), R.least_share(20))), _full(20, _mean("x", 20, 14)))
on_series("ma_ceil70", lambda: full(15, R.mean_over(x_(), R.frame(K, 15), 11)), _full(15, _mean("x", 15, 11)))
on_series("rolling_abs_sum", lambda: full(20, R.mean_over(F.abs(x_() - 500000), R.frame(K, 20), R.least_share(20))), _full(20, _mean("abs(x - 500000)", 20, 14)))
on_series("rolling_sum_strict", lambda: R.sum_over(x_(), R.frame(K, 5), 5), f"CASE WHEN count(x) {_w(5)} = 5 THEN CAST(sum(x) {_w(5)} AS BIGINT) END")
on_series("rolling_z60", lambda: full(60, R.zscore_over(x_(), R.frame(K, 60), R.least_share(60))), _full(60, _z("x", 60, 42)))
on_series("rolling_z250", lambda: full(250, R.zscore_over(x_(), R.frame(K, 250), 2)), _full(250, _z("x", 250, 2)))
on_series("trailing_z", lambda: R.zscore_over(x_(), R.frame(K, 60), 60), _z("x", 60, 60))
on_series("rolling_min250", lambda: full(250, F.when(F.count(x_()).over(R.frame(K, 250)) >= 60, F.min(x_()).over(R.frame(K, 250)))), _full(250, f"CASE WHEN count(x) {_w(250)} >= 60 THEN min(x) {_w(250)} END"))
on_series("rolling_max250", lambda: full(250, F.when(F.count(x_()).over(R.frame(K, 250)) >= 60, F.max(x_()).over(R.frame(K, 250)))), _full(250, f"CASE WHEN count(x) {_w(250)} >= 60 THEN max(x) {_w(250)} END"))
on_series("positive_days_ratio", lambda: full(20, R.positive_share(x_() - 500000, R.frame(K, 20), R.least_share(20))), _full(20, f"CASE WHEN count(x) {_w(20)} >= 14 THEN 100 * count(CASE WHEN x > 500000 THEN 1 END) {_w(20)} / count(x) {_w(20)} END"))
on_series("pct_midrank", lambda: full(60, R.percentile_midrank(x_(), R.frame(K, 60), 1)), _full(60, f"CASE WHEN x IS NOT NULL THEN 50.0::DOUBLE * (2*len(list_filter({_vals(60)}, lambda v: v < x)) + len(list_filter({_vals(60)}, lambda v: v = x))) / len({_vals(60)}) END"))
on_series("pct_strict", lambda: R.percentile_strict(x_(), R.frame(K, 60), 40), f"CASE WHEN x IS NOT NULL AND len({_vals(60)}) >= 40 THEN 100.0::DOUBLE * len(list_filter({_vals(60)}, lambda v: v < x)) / (count(*) {_w(60)} - 1) END")
on_series("pct_le", lambda: R.percentile_at_most(x_(), R.frame(K, 250), 175), f"CASE WHEN x IS NOT NULL AND len({_vals(250)}) >= 175 THEN 100.0::DOUBLE * len(list_filter({_vals(250)}, lambda v: v <= x)) / len({_vals(250)}) END")
on_series("gate_signed", lambda: R.gate_signal(R.percentile_midrank(x_(), R.frame(K, 250, last=-1), 60), F.lit(1)), "")
ORACLE_SQL["gate_signed"] = with_base(f", g AS (SELECT k, s, CASE WHEN x IS NOT NULL AND len({_vals(250, -1)}) >= 60 THEN 50.0::DOUBLE * (2*len(list_filter({_vals(250, -1)}, lambda v: v < x)) + len(list_filter({_vals(250, -1)}, lambda v: v = x))) / len({_vals(250, -1)}) END AS p FROM ser) SELECT k, s, CAST(CASE WHEN p IS NULL THEN 0 WHEN p > 60 THEN 1 WHEN p < 40 THEN -1 ELSE 0 END AS INTEGER) AS gate_signed FROM g")
on_series("acceleration", lambda: full(5, R.mean_over(x_(), R.frame(K, 5), 4)) - full(20, R.mean_over(x_(), R.frame(K, 20), 14)), f"({_full(5, _mean('x', 5, 4))}) - ({_full(20, _mean('x', 20, 14))})")
on_series("cum_slope10", lambda: F.round(R.cumulative_slope(x_(), 10, K), 4), "round((" + " + ".join(f"lag(x, {9 - j}) OVER (PARTITION BY k ORDER BY s) * {sum(i - 4.5 for i in range(j, 10))}::DOUBLE" for j in range(10)) + ") / 82.5::DOUBLE, 4)")
on_series("lag_change5", lambda: x_() - F.lag(x_(), 5).over(R.ordered(K)), "x - lag(x, 5) OVER (PARTITION BY k ORDER BY s)")
on_series("cumulative_sum", lambda: F.sum(x_()).over(R.ordered(K).rowsBetween(Window.unboundedPreceding, 0)), "CAST(sum(x) OVER (PARTITION BY k ORDER BY s ROWS UNBOUNDED PRECEDING) AS BIGINT)")
on_series("cumulative_max", lambda: F.max(x_()).over(R.ordered(K).rowsBetween(Window.unboundedPreceding, 0)), "max(x) OVER (PARTITION BY k ORDER BY s ROWS UNBOUNDED PRECEDING)")


def _activity(spark, sf):
    """Mean size of the last 20 sessions against its own mean over 250."""
    a = series(spark, sf).select("k", "s", full(20, R.mean_over(F.abs(x_() - 500000), R.frame(K, 20), 14)).alias("x"))
    base = full(250, R.mean_over(x_(), R.frame(K, 250), R.least_share(250)))
    return a.select("k", "s", base.alias("base"), "x").select("k", "s", F.round(F.when(F.col("base") > 1e-9, x_() / F.col("base")), 9).alias("act_anomaly"))


QUERIES["act_anomaly"] = _activity
ORACLE_SQL["act_anomaly"] = with_base(f", a AS (SELECT k, s, {_full(20, _mean('abs(x - 500000)', 20, 14))} AS x FROM ser), b AS (SELECT k, s, x, CASE WHEN count(*) {_w(250)} = 250 AND count(x) {_w(250)} >= 175 THEN avg(x) {_w(250)} END AS base FROM a) SELECT k, s, round(CASE WHEN base > 1e-9 THEN x / base END, 9) AS act_anomaly FROM b")


def _range_position(spark, sf):
    """Where the running 20-session sum (mean times 20) stands in its range of 250 sessions."""
    c = series(spark, sf).select("k", "s", full(20, R.mean_over(x_() - 500000, R.frame(K, 20), 14) * 20).alias("x"))
    return c.select("k", "s", F.round(full(250, R.range_position(x_(), R.frame(K, 250), 60)), 7).alias("range_position"))


QUERIES["range_position"] = _range_position
ORACLE_SQL["range_position"] = with_base(f", c AS (SELECT k, s, {_full(20, '(' + _mean('(x - 500000)', 20, 14) + ') * 20')} AS x FROM ser) SELECT k, s, round(CASE WHEN count(*) {_w(250)} = 250 AND count(x) {_w(250)} >= 60 AND max(x) {_w(250)} > min(x) {_w(250)} THEN 100.0::DOUBLE * (x - min(x) {_w(250)}) / (max(x) {_w(250)} - min(x) {_w(250)}) END, 7) AS range_position FROM c")

L: list[str] = []
P = ""
on_level("momentum20", lambda: x_() / F.lag(x_(), 20).over(R.ordered(L)) - 1, "x / lag(x, 20) OVER (ORDER BY s) - 1")
on_level("forward_label", lambda: forward_label(x_(), 6, L), "lead(x, 6) OVER (ORDER BY s) - x")
on_level("bollinger", lambda: (x_() - R.mean_over(x_(), R.frame(L, 20), 14)) / (2 * R.deviation_over(x_(), R.frame(L, 20), 20, 0)), f"(x - ({_mean('x', 20, 14, P)})) / (2 * ({_dev('x', 20, 20, 0, P)}))")
on_level("drawdown_rolling", lambda: x_() / F.max(x_()).over(R.frame(L, 250)) - 1, f"x / max(x) {_w(250, part=P)} - 1")
QUERIES["spread_vol20"] = lambda spark, sf: level(spark, sf).withColumn("dx", x_() - F.lag(x_()).over(R.ordered([]))).select("s", R.deviation_over(F.col("dx"), R.frame([], 20), 20, 0).alias("spread_vol20"))
ORACLE_SQL["spread_vol20"] = with_base(f", c AS (SELECT s, x - lag(x) OVER (ORDER BY s) AS dx FROM lvl) SELECT s, {_dev('dx', 20, 20, 0, P)} AS spread_vol20 FROM c")


def _factor_chain(spark, sf):
    """Daily sum, strict MA10, percentile within the last 60 of its own rows, on the series' own dates."""
    base = level(spark, sf).select("d", "s", R.sum_over(x_(), R.frame([], 10), 10).alias("x"))
    return base.select("d", (x_() / F.lit(10)).alias("ma10"), R.percentile_strict(x_(), R.frame([], 60), 40).alias("pct60"))


QUERIES["factor_chain_pct60"] = _factor_chain
ORACLE_SQL["factor_chain_pct60"] = with_base(
    ", m AS (SELECT d, s, CASE WHEN count(x) OVER w = 10 THEN CAST(sum(x) OVER w AS BIGINT) END AS x FROM lvl WINDOW w AS (ORDER BY s ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),"
    " l AS (SELECT d, x, list_filter(list(x) OVER w, lambda v: v IS NOT NULL) AS h, count(*) OVER w AS n FROM m WINDOW w AS (ORDER BY s ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"
    " SELECT d, x / 10 AS ma10, CASE WHEN x IS NOT NULL AND len(h) >= 40 AND n > 1 THEN 100.0::DOUBLE * len(list_filter(h, lambda v: v < x)) / (n - 1) END AS pct60 FROM l")


def _ema(spark, sf):
    """EMA with alpha 2 / (span + 1), by a fold over each key's own values in order."""
    own = orders_by_day(spark, sf).groupBy("k", "d").agg(F.expr("sum(c) div 100").alias("x"))
    folded = own.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
    out = F.aggregate("v", F.array().cast("array<double>"), lambda a, r: F.array_append(a, F.when(F.size(a) == 0, r["x"].cast("double")).otherwise(F.element_at(a, F.greatest(F.size(a), F.lit(1))) * F.lit(11 / 13) + r["x"] * F.lit(2 / 13))))
    return folded.select("k", F.explode(F.arrays_zip(F.col("v.d").alias("d"), out.alias("e"))).alias("z")).select("k", "z.d", F.round("z.e", 4).alias("ema12"))


QUERIES["ema12"] = _ema
ORACLE_SQL["ema12"] = with_base(
    ", o AS (SELECT k, d, x, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM val)"
    " SELECT k, d, round(list_reduce(list_transform(list(x) OVER (PARTITION BY k ORDER BY i), lambda v: v::DOUBLE), lambda a, b: a * (11/13) + b * (2/13)), 4) AS ema12 FROM o")


MOMENTUM = f", v AS (SELECT k, s, {_full(20, _mean('(x - 500000)', 20, 14))} AS v FROM ser)"


def momentum(spark, sf):
    """(k, s, v): each key's mean over 20 sessions of its net value."""
    return series(spark, sf).select("k", "s", full(20, R.mean_over(x_() - 500000, R.frame(K, 20), 14)).alias("v"))


def _consensus(spark, sf):
    return consensus(momentum(spark, sf), "v", ["s"])


QUERIES["consensus"] = _consensus
ORACLE_SQL["consensus"] = with_base(MOMENTUM + ", u AS (SELECT s, count(v) AS n, count(CASE WHEN v > 0 THEN 1 END) AS up, count(CASE WHEN v < 0 THEN 1 END) AS dn FROM v GROUP BY s) SELECT s, CASE WHEN n >= 5 THEN 100 * (up - dn) / nullif(up + dn, 0) END AS consensus FROM u")


def _cross_rank(spark, sf):
    return cross_rank(momentum(spark, sf), "v", ["s"], "xs_rank_pct").select("k", "s", "xs_rank_pct")


QUERIES["xs_rank_pct"] = _cross_rank
ORACLE_SQL["xs_rank_pct"] = with_base(MOMENTUM + ", r AS (SELECT k, s, rank() OVER (PARTITION BY s ORDER BY v) + (count(*) OVER (PARTITION BY s, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY s) AS m FROM v WHERE v IS NOT NULL) SELECT k, s, CASE WHEN m >= 5 THEN 100 * (r - 1) / (m - 1) END AS xs_rank_pct FROM r")


def _hhi(spark, sf):
    return concentration_index(momentum(spark, sf), "v", ["s"]).withColumn("hhi", F.round("hhi", 9))


QUERIES["hhi"] = _hhi
ORACLE_SQL["hhi"] = with_base(MOMENTUM + ", t AS (SELECT s, count(v) AS n, sum(abs(v)) AS total FROM v GROUP BY s), q AS (SELECT v.s, any_value(n) AS n, any_value(total) AS total, sum((abs(v) / total) * (abs(v) / total)) AS q FROM v JOIN t ON v.s = t.s GROUP BY v.s) SELECT s, round(CASE WHEN n >= 5 AND total > 1e-9 THEN 100 * q END, 9) AS hhi FROM q")


def _sides(spark, sf):
    """Strict sum over one set of keys less that over another: null where any member lacks a value."""
    return side_difference(momentum(spark, sf), "k", "v", ["s"], ["1", "2"], ["4", "5"])


QUERIES["side_difference"] = _sides
ORACLE_SQL["side_difference"] = with_base(MOMENTUM + " SELECT s, round(CASE WHEN count(v) FILTER (k IN ('1','2')) = 2 AND count(v) FILTER (k IN ('4','5')) = 2 THEN sum(v) FILTER (k IN ('1','2')) - sum(v) FILTER (k IN ('4','5')) END, 6) AS side_difference FROM v GROUP BY s")


def _pair_difference(spark, sf):
    """Strict 5-session sums of two keys and their difference; null where either lacks one."""
    s = series(spark, sf).select("k", "s", R.sum_over(x_(), R.frame(["k"], 5), 5).alias("v"))
    a, b = s.where("k = '1'").select("s", F.col("v").alias("a")), s.where("k = '5'").select("s", F.col("v").alias("b"))
    return a.join(b, "s").select("s", (F.col("a") - F.col("b")).alias("tenor_diff"))


QUERIES["tenor_diff"] = _pair_difference
ORACLE_SQL["tenor_diff"] = with_base(f", v AS (SELECT k, s, CASE WHEN count(x) {_w(5)} = 5 THEN CAST(sum(x) {_w(5)} AS BIGINT) END AS v FROM ser) SELECT a.s, a.v - b.v AS tenor_diff FROM v a JOIN v b ON a.s = b.s WHERE a.k = '1' AND b.k = '5'")


def _cross_up(spark, sf):
    """Sessions on which the series rises over a level it wasn't over on the session before."""
    w = R.ordered(["k"])
    return series(spark, sf).withColumn("before", F.lag(x_()).over(w)).where("x > 800000 and before <= 800000").select("k", "s", "x")


QUERIES["cross_up"] = _cross_up
ORACLE_SQL["cross_up"] = with_base(", b AS (SELECT k, s, x, lag(x) OVER (PARTITION BY k ORDER BY s) AS before FROM ser) SELECT k, s, x FROM b WHERE x > 800000 AND before <= 800000")
