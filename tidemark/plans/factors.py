"""Factor screening queries: five series against the coming change of the level."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import screen as C
from tidemark.operators import stats as S
from tidemark.plans.rolling import _full, _vals, _z
from tidemark.plans.statistics import PAIRS
from tidemark.sources.sql import with_base
from tidemark.sources.tables import level, series, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
K = ["k"]


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def rounded(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def standing(spark, sf):
    """(k, s, x, y, z, p): each series on all sessions, the level's change over the next six, and the series' z and percentile over 60 sessions."""
    x = F.col("x")
    own = series(spark, sf).select("k", "s", "x", R.full(R.frame(K, 60), 60, R.zscore_over(x, R.frame(K, 60), 42)).alias("z"), R.full(R.frame(K, 60), 60, R.percentile_midrank(x, R.frame(K, 60), 1)).alias("p"))
    label = level(spark, sf).select("s", (F.lead("x", 6).over(R.ordered([])) - F.col("x")).alias("y"))
    return own.join(label, "s", "left")


PCT = f"CASE WHEN x IS NOT NULL THEN 50.0::DOUBLE * (2*len(list_filter({_vals(60)}, lambda v: v < x)) + len(list_filter({_vals(60)}, lambda v: v = x))) / len({_vals(60)}) END"
STANDING = f", lab AS (SELECT s, lead(x, 6) OVER (ORDER BY s) - x AS y FROM lvl), own AS (SELECT k, s, x, {_full(60, _z('x', 60, 42))} AS z, {_full(60, PCT)} AS p FROM ser), st AS (SELECT own.*, lab.y FROM own LEFT JOIN lab USING (s))"
HAVE = STANDING + ", hv AS (SELECT *, (CASE WHEN z > -0.8416 THEN 1 ELSE 0 END) + (CASE WHEN z > -0.2533 THEN 1 ELSE 0 END) + (CASE WHEN z > 0.2533 THEN 1 ELSE 0 END) + (CASE WHEN z > 0.8416 THEN 1 ELSE 0 END) AS g FROM st WHERE z IS NOT NULL AND y IS NOT NULL)"


@query("z_groups", with_base(HAVE + ", q AS (SELECT k, " + ", ".join(f"CASE WHEN count(*) FILTER (g = {i}) >= 20 THEN CAST(sum(y) FILTER (g = {i}) AS BIGINT) / count(*) FILTER (g = {i}) END AS q{i + 1}" for i in range(5)) + " FROM hv GROUP BY k) SELECT *, CASE WHEN q1 < q2 AND q2 < q3 AND q3 < q4 AND q4 < q5 THEN 1 WHEN q1 > q2 AND q2 > q3 AND q3 > q4 AND q4 > q5 THEN -1 ELSE 0 END AS mono, q5 - q1 AS spread FROM q"))
def z_groups(spark, sf):
    return C.z_groups(standing(spark, sf), "z", "y", K)


COND = STANDING + """, b AS (SELECT k, y::DOUBLE AS y, (CASE WHEN p >= 10 THEN 1 ELSE 0 END) + (CASE WHEN p >= 25 THEN 1 ELSE 0 END) + (CASE WHEN p >= 50 THEN 1 ELSE 0 END) + (CASE WHEN p >= 75 THEN 1 ELSE 0 END) + (CASE WHEN p >= 90 THEN 1 ELSE 0 END) AS bin FROM st WHERE p IS NOT NULL AND y IS NOT NULL),
a AS (SELECT k, bin, count(*) AS m, avg(y) AS mean, quantile_cont(y, 0.5) AS median, stddev_samp(y) AS sd, 100 * avg(CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0 END) AS up, quantile_cont(y, 0.05) AS p05, quantile_cont(y, 0.95) AS p95 FROM b GROUP BY k, bin),
cd AS (SELECT g.k, CAST(g.bin AS INTEGER) AS bin, CASE WHEN m >= 10 THEN m ELSE 0 END AS n, CASE WHEN m >= 10 THEN round(mean, 3) END AS mean, CASE WHEN m >= 10 THEN round(median, 3) END AS median, CASE WHEN m >= 10 THEN round(sd, 3) END AS sd, CASE WHEN m >= 10 THEN round(up, 1) END AS up, CASE WHEN m >= 10 THEN round(p05, 3) END AS p05, CASE WHEN m >= 10 THEN round(p95, 3) END AS p95 FROM (SELECT k, bin FROM (SELECT DISTINCT k FROM b) CROSS JOIN (SELECT unnest(range(6)) AS bin)) g LEFT JOIN a ON a.k = g.k AND a.bin = g.bin)"""


@query("conditional_distribution", with_base(COND + " SELECT * FROM cd"))
def conditional_distribution(spark, sf):
    return C.conditional_distribution(standing(spark, sf), "p", "y", K)


@query("bin_shape", with_base(COND + ", f AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY bin) AS a, rank() OVER (PARTITION BY k ORDER BY mean) + (count(*) OVER (PARTITION BY k, mean) - 1) / 2.0::DOUBLE AS b FROM cd WHERE n >= 10 AND sd IS NOT NULL) SELECT k, round(CASE WHEN count(*) >= 4 THEN max(mean) - min(mean) END, 6) AS crange, round(CASE WHEN count(*) >= 4 THEN max(up) - min(up) END, 6) AS cprange, round(CASE WHEN count(*) >= 4 THEN corr(a, b) END, 8) AS cmono, round(CASE WHEN count(*) >= 4 AND min(sd) > 0 THEN max(sd) / min(sd) END, 8) AS cvr, round(CASE WHEN count(*) >= 4 AND min(p05) < 0 AND max(p95) > 0 THEN max(p95) / abs(min(p05)) END, 8) AS tr FROM f GROUP BY k"))
def bin_shape(spark, sf):
    out = C.bin_shape(C.conditional_distribution(standing(spark, sf), "p", "y", K), K)
    return rounded(rounded(out, 6, "crange", "cprange"), 8, "cmono", "cvr", "tr")


def _payoff_sql(inside):
    gain, loss = f"({inside}) AND g > 0", f"({inside}) AND g < 0"
    return f"round(CASE WHEN count(*) FILTER ({gain}) >= 5 AND count(*) FILTER ({loss}) >= 5 THEN (CAST(sum(g) FILTER ({gain}) AS BIGINT) / count(*) FILTER ({gain})) / -(CAST(sum(g) FILTER ({loss}) AS BIGINT) / count(*) FILTER ({loss})) END, 9)"


def _rate_sql(side, hit):
    return f"CASE WHEN count(*) FILTER ({side}) >= 20 THEN count(*) FILTER ({side} AND {hit}) / count(*) FILTER ({side}) END"


@query("signal_figures", with_base(HAVE + f", ps AS (SELECT k, s, z, y, CASE WHEN z > 1 THEN 1 WHEN z < -1 THEN -1 ELSE 0 END AS pos FROM hv), m AS (SELECT *, pos * y AS g, CASE WHEN pos <> lag(pos) OVER (PARTITION BY k ORDER BY s) THEN 1.0::DOUBLE WHEN lag(pos) OVER (PARTITION BY k ORDER BY s) IS NOT NULL THEN 0 END AS turn FROM ps) SELECT k, {_rate_sql('pos <> 0', 'g > 0')} AS win, {_rate_sql('pos > 0', 'y > 0')} AS win_long, {_rate_sql('pos < 0', 'y < 0')} AS win_short, {_payoff_sql('pos <> 0')} AS payoff, {_payoff_sql('abs(z) > 2 AND pos <> 0')} AS tail_payoff, round(avg(turn), 10) AS turnover FROM m GROUP BY k"))
def signal_figures(spark, sf):
    out = C.signal_figures(standing(spark, sf), "z", "y", K)
    return rounded(rounded(out, 9, "payoff", "tail_payoff"), 10, "turnover")


def _hac_sql(ranks: bool, lag: str, name="fac"):
    x, y = ("rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0::DOUBLE", "rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0::DOUBLE") if ranks else ("x::DOUBLE", "y::DOUBLE")
    return f""", r AS (SELECT k, s, {x} AS a0, {y} AS b0 FROM {name}), o AS (SELECT k, s, a0 - avg(a0) OVER (PARTITION BY k) AS a, b0 - avg(b0) OVER (PARTITION BY k) AS b, count(*) OVER (PARTITION BY k) AS n FROM r),
f AS (SELECT *, sum(a*a) OVER (PARTITION BY k) AS sxx, sum(a*b) OVER (PARTITION BY k) / sum(a*a) OVER (PARTITION BY k) AS beta FROM o), u AS (SELECT k, s, n, sxx, beta, a * (b - beta * a) AS u, CAST({lag} AS INTEGER) AS lag FROM f),
e AS (SELECT u.*, unnest(range(0, lag + 1)) AS l FROM u), v AS (SELECT e.k, any_value(e.n) AS n, any_value(e.lag) AS lag, any_value(e.beta) AS beta, any_value(e.sxx) AS sxx, sum(CASE WHEN l = 0 THEN 1.0::DOUBLE ELSE 2 * (1 - l / (e.lag + 1.0::DOUBLE)) END * e.u * w.u){' * any_value(e.n) / (any_value(e.n) - 2)' if ranks else ''} AS v FROM e JOIN u w ON w.k = e.k AND w.s = e.s - l GROUP BY e.k)
SELECT k, n, lag, round(CASE WHEN n >= 30 AND v > 0 THEN beta * sxx / sqrt(v) END, 6) AS t FROM v"""


@query("rank_hac", with_base(PAIRS + _hac_sql(True, "greatest(5, floor(4 * pow(n / 100, 2 / 9)))")))
def rank_hac(spark, sf):
    return rounded(C.rank_hac(standing(spark, sf), "x", "y", K), 6, "t")


@query("hac_t", with_base(PAIRS + _hac_sql(False, "8")))
def hac_t(spark, sf):
    return rounded(C.hac_t(standing(spark, sf), "x", "y", K, 8), 6, "t")


@query("thinned_t", with_base(PAIRS + ", i AS (SELECT k, x::DOUBLE AS x, y::DOUBLE AS y, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i FROM fac), a AS (SELECT k, count(*) AS m, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS rest FROM i WHERE i % 6 = 0 GROUP BY k) SELECT k, m, round(CASE WHEN m >= 15 AND rest > 0 THEN b / sqrt(rest / (m - 2) / sxx) END, 6) AS t FROM a"))
def thinned_t(spark, sf):
    return rounded(C.thinned_t(standing(spark, sf), "x", "y", K, 6), 6, "t")


@query("reject_set", "WITH p AS (SELECT c_custkey AS id, c_nationkey AS g, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE pow((c_custkey * 7919 % 1000) / 1000.0::DOUBLE, 3) END AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS r, count(*) OVER (PARTITION BY g) AS m FROM p WHERE p IS NOT NULL), t AS (SELECT g, max(p) FILTER (p <= 0.05 * r / m) AS last FROM r GROUP BY g), md AS (SELECT g, quantile_cont(p, 0.5) AS median_p FROM p GROUP BY g) SELECT id, p.g, coalesce(p <= last, false) AS rejected, round(median_p, 10) AS median_p FROM p JOIN md ON md.g = p.g LEFT JOIN t ON t.g = p.g")
def reject_set(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("id"), F.col("c_nationkey").alias("g"), F.when(k % 11 != 0, F.pow(k * 7919 % 1000 / F.lit(1000.0), F.lit(3))).alias("p"))
    return C.reject_set(p, "p", ["g"]).select("id", "g", "rejected", F.round("median_p", 10).alias("median_p"))


DENSE = PAIRS + ", ric AS (SELECT k, s, CASE WHEN count(*) OVER w = 60 THEN corr(x::DOUBLE, y::DOUBLE) OVER w END AS ic FROM fac WINDOW w AS (PARTITION BY k ORDER BY s ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"


def dense(spark, sf):
    return standing(spark, sf).where("x is not null and y is not null")


@query("rolling_ic", with_base(DENSE + " SELECT k, s, round(ic, 7) AS ic FROM ric"))
def rolling_ic(spark, sf):
    return dense(spark, sf).select("k", "s", F.round(C.rolling_correlation("x", "y", K, 60), 7).alias("ic"))


@query("icir", with_base(DENSE + " SELECT k, round(avg(ic) / stddev_samp(ic), 6) AS icir, count(ic) AS rolling_n FROM ric WHERE ic IS NOT NULL GROUP BY k"))
def icir(spark, sf):
    ics = dense(spark, sf).select("k", C.rolling_correlation("x", "y", K, 60).alias("ic"))
    return rounded(C.icir(ics, "ic", K), 6, "icir")


#: Rank correlations of windows by a range join; ranks within each window.
ROLLING_RANKS = STANDING + """, wn AS (SELECT e.k, e.s AS t, v.s, v.x, v.y FROM st e JOIN st v ON v.k = e.k AND v.s BETWEEN e.s - 59 AND e.s WHERE e.s >= 60),
wr AS (SELECT k, t, rank() OVER (PARTITION BY k, t ORDER BY x) + (count(*) OVER (PARTITION BY k, t, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY k, t ORDER BY y) + (count(*) OVER (PARTITION BY k, t, y) - 1) / 2.0::DOUBLE AS b FROM wn WHERE x IS NOT NULL AND y IS NOT NULL),
rs AS (SELECT k, t AS s, count(*) AS m, CASE WHEN count(*) >= 40 THEN corr(a, b) END AS ic FROM wr GROUP BY k, t)"""


@query("rolling_spearman", with_base(ROLLING_RANKS + " SELECT k, s, m AS n, round(ic, 8) AS ic FROM rs"))
def rolling_spearman(spark, sf):
    out = C.rolling_spearman(standing(spark, sf), "x", "y", K, least=40, span=512)
    return rounded(out.where("s >= 60 and n > 0"), 8, "ic")


BLOCKS = STANDING + """, bk AS (SELECT k, x, y, 3 - (row_number() OVER (PARTITION BY k ORDER BY s DESC) - 1) // 63 AS block FROM st),
br AS (SELECT k, block, rank() OVER (PARTITION BY k, block ORDER BY x) + (count(*) OVER (PARTITION BY k, block, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY k, block ORDER BY y) + (count(*) OVER (PARTITION BY k, block, y) - 1) / 2.0::DOUBLE AS b FROM bk WHERE block >= 0 AND x IS NOT NULL AND y IS NOT NULL),
bl AS (SELECT k, CAST(block AS INTEGER) AS block, count(*) AS n, CASE WHEN count(*) >= 40 THEN corr(a, b) END AS ic FROM br GROUP BY k, block)"""


@query("trailing_blocks", with_base(BLOCKS + " SELECT k, block, n, round(ic, 8) AS ic FROM bl"))
def trailing_blocks(spark, sf):
    return rounded(C.trailing_blocks(standing(spark, sf), "x", "y", K, least=40), 8, "ic")


@query("global_percentile", "WITH e AS (SELECT c_custkey AS id, c_acctbal AS v, c_custkey % 7 <> 0 AS ok FROM customer) SELECT e.id, e.ok, r.pct FROM e LEFT JOIN (SELECT id, 100 * (rank() OVER (ORDER BY abs(v)) + (count(*) OVER (PARTITION BY abs(v)) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER () - 1) AS pct FROM e WHERE ok) r USING (id)")
def global_percentile(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 7 != 0).alias("ok"))
    return C.global_percentile(e, "v", "ok", "pct").select("id", "ok", "pct")


SCREEN = ROLLING_RANKS + BLOCKS.removeprefix(STANDING) + """, pr AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0::DOUBLE AS b FROM st WHERE x IS NOT NULL AND y IS NOT NULL),
i1 AS (SELECT k, round(corr(a, b), 9) AS ic FROM pr GROUP BY k), i2 AS (SELECT k, round(avg(ic) / stddev_samp(ic), 7) AS icir FROM rs WHERE ic IS NOT NULL GROUP BY k),
sz AS (SELECT k, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*) AS coverage FROM st GROUP BY k),
eg AS (SELECT k, quantile_cont(x::DOUBLE, [0.2,0.4,0.6,0.8]) AS q FROM st WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY k),
qb AS (SELECT st.k, y, len(list_filter(q, lambda v: st.x > v)) AS b FROM st JOIN eg ON eg.k = st.k WHERE x IS NOT NULL AND y IS NOT NULL),
qm AS (SELECT k, """ + ", ".join(f"count(*) FILTER (b = {i}) AS n{i}, CAST(sum(y) FILTER (b = {i}) AS BIGINT) / nullif(count(*) FILTER (b = {i}), 0) AS m{i}" for i in range(5)) + """ FROM qb GROUP BY k),
fg AS (SELECT sz.k, n, coverage, ic, icir, coalesce(sign(ic), 0) AS sg, n0, n1, n2, n3, n4, m0, m4, """ + " + ".join(f"(CASE WHEN coalesce(sign(ic), 0) * (m{i + 1} - m{i}) > 0 THEN 1 ELSE 0 END)" for i in range(4)) + """ AS steps, n >= 300 AND coverage >= 0.7::DOUBLE AND ic IS NOT NULL AND icir IS NOT NULL AS ok FROM sz LEFT JOIN i1 USING (k) LEFT JOIN i2 USING (k) LEFT JOIN qm USING (k)),
sb AS (SELECT fg.k, count(*) FILTER (bl.ic * sg > 0) AS same_blocks FROM fg LEFT JOIN bl ON bl.k = fg.k GROUP BY fg.k),
rk AS (SELECT k, CASE WHEN count(*) OVER () = 1 THEN 50 ELSE 100 * (rank() OVER (ORDER BY abs(ic)) + (count(*) OVER (PARTITION BY abs(ic)) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER () - 1) END AS ic_pct, CASE WHEN count(*) OVER () = 1 THEN 50 ELSE 100 * (rank() OVER (ORDER BY abs(icir)) + (count(*) OVER (PARTITION BY abs(icir)) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER () - 1) END AS icir_pct FROM fg WHERE ok),
al AS (SELECT fg.*, same_blocks, ic_pct, icir_pct, (ic_pct + icir_pct) / 2 AS score, [ok, coalesce(abs(ic) >= 0.01::DOUBLE, false), coalesce(ic_pct >= 50, false), coalesce(icir_pct >= 50, false), coalesce(ic * icir > 0, false), coalesce(least(n0, n1, n2, n3, n4) >= 20, false), coalesce(sg * (m4 - m0) > 0 AND steps >= 3, false), same_blocks >= 3] AS checks FROM fg LEFT JOIN rk USING (k) LEFT JOIN sb USING (k)),
sc AS (SELECT *, len(list_filter(checks, lambda c: NOT c)) = 0 AS passed FROM al)"""


def screened(spark, sf):
    return C.screen(standing(spark, sf), "x", "y", K, floor=0.01, rank_cut=50.0, coverage=0.7, roll_least=40, block_least=40)


@query("factor_screen", with_base(SCREEN + " SELECT k, n, coverage, ic, icir, ic_pct, icir_pct, score, CAST(steps AS INTEGER) AS steps, same_blocks, array_to_string(list_transform(checks, lambda c: CAST(CAST(c AS INTEGER) AS VARCHAR)), '') AS checks, passed, CAST(CASE WHEN passed THEN row_number() OVER (PARTITION BY passed ORDER BY score DESC, abs(ic) DESC, abs(icir) DESC, k) END AS INTEGER) AS place, CASE WHEN NOT ok THEN 'insufficient' WHEN NOT passed THEN 'rejected' WHEN row_number() OVER (PARTITION BY passed ORDER BY score DESC, abs(ic) DESC, abs(icir) DESC, k) <= 20 THEN 'selected' ELSE 'capped' END AS status FROM sc"))
def factor_screen(spark, sf):
    marks = F.array_join(F.transform("checks", lambda c: c.cast("int").cast("string")), "")
    return screened(spark, sf).withColumn("checks", marks)


@query("screen_funnel", with_base(SCREEN + " SELECT CAST(i AS INTEGER) AS stage, ['data','ic_floor','ic_rank','icir_rank','sign_agree','group_count','group_trend','stability'][i + 1] AS name, (SELECT count(*) FILTER (len(list_filter(checks[1:i + 1], lambda c: NOT c)) = 0) FROM sc) AS remaining FROM (SELECT unnest(range(8)) AS i)"))
def screen_funnel(spark, sf):
    return C.funnel(screened(spark, sf))


@query("recent_ic", with_base(PAIRS + ", n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC) AS r FROM fac), rk AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0::DOUBLE AS b FROM n WHERE r <= 125) SELECT k, count(*) AS n, round(corr(a, b), 8) AS ic FROM rk GROUP BY k"))
def recent_ic(spark, sf):
    """Rank correlation over a factor's last 125 pairs."""
    from pyspark.sql import Window

    last = dense(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("s")))).where("r <= 125")
    return rounded(S.spearman(last, "x", "y", K), 8, "ic")


REGIME = PAIRS + ", tr AS (SELECT s, CASE WHEN count(*) OVER w = 60 THEN x > avg(x) OVER w END AS up FROM lvl WINDOW w AS (ORDER BY s ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), fr AS (SELECT fac.*, CASE WHEN up THEN 'up' ELSE 'down' END AS regime FROM fac JOIN tr USING (s) WHERE up IS NOT NULL), rk AS (SELECT k, regime, rank() OVER (PARTITION BY k, regime ORDER BY x) + (count(*) OVER (PARTITION BY k, regime, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY k, regime ORDER BY y) + (count(*) OVER (PARTITION BY k, regime, y) - 1) / 2.0::DOUBLE AS b FROM fr)"


@query("regime_ic", with_base(REGIME + " SELECT k, regime, count(*) AS n, round(CASE WHEN count(*) >= 40 THEN corr(a, b) END, 8) AS ic FROM rk GROUP BY k, regime"))
def regime_ic(spark, sf):
    """Rank correlation by trend: the level over or under its mean of 60 sessions; null under 40 pairs."""
    x = F.col("x")
    trend = level(spark, sf).select("s", R.full(R.frame([], 60), 60, x > R.mean_over(x, R.frame([], 60), 60)).alias("up")).where("up is not null")
    both = dense(spark, sf).join(trend, "s").withColumn("regime", F.when(F.col("up"), "up").otherwise("down"))
    out = S.spearman(both, "x", "y", ["k", "regime"])
    return rounded(out.withColumn("ic", F.when(F.col("n") >= 40, F.col("ic"))), 8, "ic")
