"""Checkup queries: five series in three forms against two targets over three horizons, in hundredths of a unit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import checkup as C
from tidemark.plans.rolling import _full, _mean, _vals
from tidemark.sources.sql import with_base
from tidemark.sources.tables import level, series

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
HORIZONS = (1, 5, 20)
TEST = ["k", "form", "target", "h"]


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def factors(spark, sf):
    """(k, form, s, x, z): each series as it is, as the percentile of its mean of ten sessions, and as its change over five,
    all of the session before; z over 250 sessions."""
    x, by = F.col("x"), R.ordered(["k"])
    own = series(spark, sf).select("k", "s", "x", R.mean_over(x, R.frame(["k"], 10), 7).alias("m"))
    pct = R.full(R.frame(["k"], 60), 60, R.percentile_midrank(F.col("m"), R.frame(["k"], 60), 1))
    own = own.select("k", "s", (x / 100).alias("raw"), pct.alias("pct"), ((x - F.lag("x", 5).over(by)) / 100).alias("diff"))
    long = own.unpivot(["k", "s"], ["raw", "pct", "diff"], "form", "x")
    wide = R.frame(["k", "form"], 250)
    sd = F.stddev_samp("x").over(wide)
    z = R.full(wide, 250, F.when(F.min("x").over(wide) < F.max("x").over(wide), (x - F.avg("x").over(wide)) / sd))
    lagged = R.ordered(["k", "form"])
    return long.select("k", "form", "s", F.lag("x").over(lagged).alias("x"), F.lag(z).over(lagged).alias("z"))


def targets(spark, sf):
    """(target, s, d, v): the level, and the difference of two series where both have a value, on all sessions."""
    s = series(spark, sf)
    gap = s.groupBy("s", "d").agg((F.max(F.when(F.col("k") == "1", F.col("x"))) - F.max(F.when(F.col("k") == "2", F.col("x")))).alias("v"))
    own = level(spark, sf).select(F.lit("level").alias("target"), "s", "d", (F.col("x") / 100).alias("v"))
    return own.union(gap.select(F.lit("gap"), "s", "d", F.col("v") / 100))


def labels(spark, sf):
    by = R.ordered(["target"])
    ahead = [F.struct(F.lit(h).alias("h"), (F.lead("v", h).over(by) - F.col("v")).alias("y")) for h in HORIZONS]
    v = F.col("v")
    step = v - F.lag("v").over(by)
    t = targets(spark, sf).withColumns({"trend": v - F.lag("v", 60).over(by), "step": step})
    t = t.withColumn("vol", F.when((F.row_number().over(by) >= 21) & (F.count("step").over(R.frame(["target"], 20)) >= 2), F.stddev_samp("step").over(R.frame(["target"], 20))))
    t = t.withColumns({"trend": F.when(F.col("trend") > 0, "up").when(F.col("trend") <= 0, "down"), "ahead": F.array(*ahead)})
    return t.select("target", "s", "d", "trend", "vol", F.explode("ahead").alias("a")).select("target", "s", "d", "trend", "vol", "a.h", "a.y")


def tests(spark, sf):
    return C.grid(factors(spark, sf), labels(spark, sf))


RANK = "2 * rank() OVER (PARTITION BY {p} ORDER BY {c}) + count(*) OVER (PARTITION BY {p}, {c}) - 1"
T = "k, form, target, h"
BASE = f""", mm AS (SELECT k, s, x AS raw, {_mean('x', 10, 7)} AS x, lag(x, 5) OVER (PARTITION BY k ORDER BY s) AS back FROM ser),
pc AS (SELECT k, s, raw, back, {_full(60, f"CASE WHEN x IS NOT NULL THEN 50.0::DOUBLE * (2*len(list_filter({_vals(60)}, lambda v: v < x)) + len(list_filter({_vals(60)}, lambda v: v = x))) / len({_vals(60)}) END")} AS pct FROM mm),
lg AS (SELECT k, s, 'raw' AS form, raw / 100 AS x FROM pc UNION ALL SELECT k, s, 'pct', pct FROM pc UNION ALL SELECT k, s, 'diff', (raw - back) / 100 FROM pc),
zz AS (SELECT *, CASE WHEN count(*) OVER w = 250 AND min(x) OVER w < max(x) OVER w THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END AS z FROM lg WINDOW w AS (PARTITION BY k, form ORDER BY s ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)),
fa AS (SELECT k, form, s, lag(x) OVER w AS x, lag(z) OVER w AS z FROM zz WINDOW w AS (PARTITION BY k, form ORDER BY s)),
tg AS (SELECT 'level' AS target, s, d, x / 100 AS v FROM lvl UNION ALL SELECT 'gap', s, d, (max(x) FILTER (k = '1') - max(x) FILTER (k = '2')) / 100 FROM ser GROUP BY s, d),
tv AS (SELECT *, v - lag(v) OVER (PARTITION BY target ORDER BY s) AS step, v - lag(v, 60) OVER (PARTITION BY target ORDER BY s) AS tr FROM tg),
tw AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY s) >= 21 AND count(step) OVER w >= 2 THEN stddev_samp(step) OVER w END AS vol, CASE WHEN tr > 0 THEN 'up' WHEN tr <= 0 THEN 'down' END AS trend FROM tv WINDOW w AS (PARTITION BY target ORDER BY s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
lb AS ({' UNION ALL '.join(f"SELECT target, s, d, trend, vol, {h} AS h, lead(v, {h}) OVER (PARTITION BY target ORDER BY s) - v AS y FROM tw" for h in HORIZONS)}),
tt AS (SELECT k, form, target, h, fa.s, d, trend, vol, x, y, z FROM fa JOIN lb ON lb.s = fa.s WHERE x IS NOT NULL AND y IS NOT NULL)"""

GROUP = "(CASE WHEN z > -0.8416 THEN 1 ELSE 0 END) + (CASE WHEN z > -0.2533 THEN 1 ELSE 0 END) + (CASE WHEN z > 0.2533 THEN 1 ELSE 0 END) + (CASE WHEN z > 0.8416 THEN 1 ELSE 0 END)"


def _rate(where, hit):
    return f"CASE WHEN count(*) FILTER ({where}) >= 20 THEN count(*) FILTER ({where} AND {hit}) / count(*) FILTER ({where}) END"


def _payoff(where):
    return f"round(CASE WHEN count(*) FILTER ({where} AND gain > 0) >= 5 AND count(*) FILTER ({where} AND gain < 0) >= 5 THEN avg(gain) FILTER ({where} AND gain > 0) / -avg(gain) FILTER ({where} AND gain < 0) END, 8)"


CHECKUP = BASE + f""", b0 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {T}) AS n, row_number() OVER (PARTITION BY {T} ORDER BY s) - 1 AS i FROM tt) WHERE n >= 200),
b1 AS (SELECT *, {RANK.format(p=T, c='x')} AS ra, {RANK.format(p=T, c='y')} AS rb, x - avg(x) OVER p AS a, y - avg(y) OVER p AS b, CASE WHEN z > 1 THEN 1 WHEN z < -1 THEN -1 ELSE 0 END AS pos, {GROUP} AS g, i % h = 0 AS thin,
  CASE WHEN i >= 59 AND min(x) OVER f < max(x) OVER f AND min(y) OVER f < max(y) OVER f THEN corr(x, y) OVER f END AS rolled FROM b0 WINDOW p AS (PARTITION BY {T}), f AS (PARTITION BY {T} ORDER BY s ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
b2 AS (SELECT *, pos * y AS gain, sum(a * a) OVER p AS sxx, sum(a * b) OVER p / sum(a * a) OVER p AS beta, lag(a) OVER o AS before, CASE WHEN lag(pos) OVER o IS NULL THEN NULL WHEN pos <> lag(pos) OVER o THEN 1.0::DOUBLE ELSE 0 END AS turned, CAST(greatest(h - 1, floor(4 * pow(n / 100, 2 / 9)), 1) AS INTEGER) AS lags FROM b1 WINDOW p AS (PARTITION BY {T}), o AS (PARTITION BY {T} ORDER BY s)),
uu AS (SELECT {T}, i, lags, a * (b - beta * a) AS u FROM b2),
ul AS (SELECT *, unnest(range(0, lags + 1)) AS l FROM uu),
vv AS (SELECT ul.k, ul.form, ul.target, ul.h, sum(CASE WHEN l = 0 THEN 1.0::DOUBLE ELSE 2 * (1 - l / (ul.lags + 1.0::DOUBLE)) END * ul.u * o.u) AS v FROM ul JOIN uu o ON o.k = ul.k AND o.form = ul.form AND o.target = ul.target AND o.h = ul.h AND o.i = ul.i - l GROUP BY ALL),
sh AS (SELECT {T}, i, n, unnest(range(0, n)) AS shift, ra - (n + 1) AS ra FROM b2),
sc AS (SELECT sh.k, sh.form, sh.target, sh.h, shift, CAST(sum(sh.ra * (j.rb - (j.n + 1))) AS BIGINT) AS c FROM sh JOIN b2 j ON j.k = sh.k AND j.form = sh.form AND j.target = sh.target AND j.h = sh.h AND j.i = (sh.i + shift) % sh.n GROUP BY ALL),
sp AS (SELECT {T}, count(*) FILTER (abs(c) >= abs(c0)) / count(*) AS p FROM (SELECT *, max(c) FILTER (shift = 0) OVER (PARTITION BY {T}) AS c0 FROM sc) GROUP BY {T}),
fg AS (SELECT {T}, any_value(n) AS n, round(CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END, 8) AS ic, round(CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END, 8) AS icp, round(CASE WHEN count(rolled) > 10 AND stddev_samp(rolled) > 0 THEN avg(rolled) / stddev_samp(rolled) END, 7) AS icir,
  any_value(beta) AS beta, any_value(sxx) AS sxx, count(*) FILTER (thin) AS m, regr_slope(y, x) FILTER (thin) AS tb, regr_sxx(y, x) FILTER (thin) AS txx, regr_syy(y, x) FILTER (thin) - regr_sxy(y, x) FILTER (thin) * regr_sxy(y, x) FILTER (thin) / regr_sxx(y, x) FILTER (thin) AS rest,
  {', '.join(f"CASE WHEN count(*) FILTER (g = {k} AND z IS NOT NULL) >= 20 THEN avg(y) FILTER (g = {k} AND z IS NOT NULL) END AS q{k + 1}" for k in range(5))},
  {_rate('pos <> 0', 'gain > 0')} AS win, {_rate('pos > 0', 'y > 0')} AS wl, {_rate('pos < 0', 'y < 0')} AS ws, {_payoff('pos <> 0')} AS pl, {_payoff('pos <> 0 AND abs(z) > 1.5')} AS tail, round(avg(turned), 10) AS turn,
  round(CASE WHEN min(x) < max(x) THEN kurtosis_pop(x) END, 6) AS kurt, round(sum(a * before) / any_value(sxx), 8) AS acf FROM b2 GROUP BY {T}),
f2 AS (SELECT fg.*, vv.v, sp.p, CASE WHEN m >= 15 AND txx > 0 AND rest > 0 THEN tb / sqrt(rest / (m - 2) / txx) END AS ti, m - 2 AS df FROM fg JOIN vv USING (k, form, target, h) JOIN sp USING (k, form, target, h)),
f3 AS (SELECT *, atan(abs(ti) / sqrt(df)) AS an FROM f2),
f4 AS (SELECT *, CASE WHEN ti IS NULL THEN NULL WHEN df % 2 = 1 THEN (an + sin(an) * coalesce(list_sum(list_transform(range(0, (df - 3) // 2 + 1), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5::DOUBLE)) * sqrt(pi()) / 2 * pow(cos(an), 2 * k + 1))), 0)) * 2 / pi() ELSE sin(an) * coalesce(list_sum(list_transform(range(0, (df - 2) // 2 + 1), lambda k: CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(an), 2 * k) END)), 0) END AS inside FROM f3),
f5 AS (SELECT *, CASE WHEN k IN ('1', '2') THEN 'first' ELSE 'rest' END AS grp, round(CASE WHEN inside IS NOT NULL THEN greatest(0, 1 - inside) END, 9) AS pind FROM f4),
bh AS (SELECT *, row_number() OVER (PARTITION BY form, target, h, grp, pind IS NULL ORDER BY pind) AS r1, count(pind) OVER (PARTITION BY form, target, h, grp) AS c1, row_number() OVER (PARTITION BY form, target, h, grp, p IS NULL ORDER BY p) AS r2, count(p) OVER (PARTITION BY form, target, h, grp) AS c2 FROM f5),
lm AS (SELECT *, max(pind) FILTER (pind <= 0.05::DOUBLE * r1 / c1) OVER (PARTITION BY form, target, h, grp) AS l1, max(p) FILTER (p <= 0.05::DOUBLE * r2 / c2) OVER (PARTITION BY form, target, h, grp) AS l2 FROM bh)
SELECT {T}, grp, n, ic, icp, icir, round(CASE WHEN sxx > 0 AND v > 0 THEN beta * sxx / sqrt(v) END, 6) AS t, m, round(ti, 6) AS ti, pind, p, {', '.join(f'round(q{k}, 6) AS q{k}' for k in range(1, 6))}, round(q5 - q1, 6) AS qd, CASE WHEN q1 < q2 AND q2 < q3 AND q3 < q4 AND q4 < q5 THEN 1 WHEN q1 > q2 AND q2 > q3 AND q3 > q4 AND q4 > q5 THEN -1 ELSE 0 END AS mono,
  win, wl, ws, pl, tail, turn, kurt, acf, coalesce(pind <= l1, false) AS sig, coalesce(p <= l2, false) AS sigp FROM lm"""

DIGITS = {"ic": 8, "icp": 8, "icir": 7, "t": 6, "ti": 6, "q1": 6, "q2": 6, "q3": 6, "q4": 6, "q5": 6, "qd": 6, "pl": 8, "tail": 8, "turn": 10, "kurt": 6, "acf": 8}


@query("factor_checkup", with_base(CHECKUP))
def factor_checkup(spark, sf):
    """Every test's figures, and what is rejected within a form, target, horizon and group of series."""
    t = tests(spark, sf)
    longest = level(spark, sf).count()
    figures = C.checkup(t.select(*TEST, "s", "x", "y", "z"), TEST, "h", HORIZONS, longest)
    figures = figures.withColumn("grp", F.when(F.col("k").isin("1", "2"), "first").otherwise("rest")).withColumn("pind", F.round("pind", 9))
    out = C.marked(figures, ["form", "target", "h"], "grp")
    return out.select(*[F.round(c, DIGITS[c]).alias(c) if c in DIGITS else F.col(c) for c in out.columns])


SLICES = BASE + f""", md AS (SELECT target, median(vol) AS mv FROM tw GROUP BY target),
sl AS (SELECT {T}, x, y, 'year:' || year(d) AS slice FROM tt UNION ALL SELECT {T}, x, y, 'trend:' || trend FROM tt WHERE trend IS NOT NULL
  UNION ALL SELECT {T}, x, y, 'vol:' || CASE WHEN vol > mv THEN 'high' ELSE 'low' END FROM tt JOIN md USING (target) WHERE vol IS NOT NULL
  UNION ALL SELECT {T}, x, y, 'recent:' FROM (SELECT *, row_number() OVER (PARTITION BY {T} ORDER BY s DESC) AS r FROM tt) WHERE r <= 125),
rk AS (SELECT {T}, slice, {RANK.format(p=T + ', slice', c='x')} AS ra, {RANK.format(p=T + ', slice', c='y')} AS rb FROM sl)
SELECT {T}, slice, count(*) AS n, round(CASE WHEN count(*) >= CASE WHEN slice = 'recent:' THEN 125 ELSE 40 END AND min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END, 8) AS ic FROM rk GROUP BY {T}, slice"""


@query("checkup_slices", with_base(SLICES))
def checkup_slices(spark, sf):
    """Rank correlations of every test by year, trend and volatility of the target, and over its last 125 rows."""
    t = tests(spark, sf)
    middle = labels(spark, sf).where(F.col("h") == HORIZONS[0]).groupBy("target").agg(F.median("vol").alias("middle"))
    t = t.join(middle, "target")
    out = C.checkup_slices(t, TEST, {"year": F.year("d"), "trend": F.col("trend"), "vol": F.when(F.col("vol") > F.col("middle"), "high").when(F.col("vol").isNotNull(), "low")})
    return out.withColumn("ic", F.round("ic", 8))
