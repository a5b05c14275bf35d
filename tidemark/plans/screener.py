"""Screener queries: five series in six forms against the coming change of the level, over two windows side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import screener as C
from tidemark.plans.rolling import _mean
from tidemark.sources.sql import with_base
from tidemark.sources.tables import level, series

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
MEANS = (3, 5, 10, 20)


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def candidates(spark, sf):
    """(win, item, grp, s, year, x, y, level): all sessions with a label, and those of the first two thirds."""
    x = F.col("x")
    own = series(spark, sf).select("k", "s", "d", *[R.mean_over(x, R.frame(["k"], n), 1).cast("double").alias(f"m{n}") for n in MEANS], x.cast("double").alias("m1"), (x - F.lag("x", 5).over(R.ordered(["k"]))).cast("double").alias("d5"))
    long = own.unpivot(["k", "s", "d"], ["m1", *[f"m{n}" for n in MEANS], "d5"], "form", "x")
    label = level(spark, sf).select("s", F.col("x").alias("level"), (F.lead("x", 6).over(R.ordered([])) - F.col("x")).alias("y")).where("y is not null")
    last = F.lit(level(spark, sf).count() * 2 // 3)
    rows = long.join(label, "s").select(F.concat("k", F.lit("|"), "form").alias("item"), F.col("k").alias("grp"), "s", F.year("d").alias("year"), "x", "y", "level")
    return rows.withColumn("win", F.explode(F.when(F.col("s") <= last, F.array(F.lit("all"), F.lit("early"))).otherwise(F.array(F.lit("all")))))


def _rank_sql(source: str, keys: str, a: str, b: str, name: str) -> str:
    rank = "rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0::DOUBLE"
    return f"SELECT {keys}, CASE WHEN count(*) >= 60 AND min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END AS {name} FROM (SELECT {keys}, {rank.format(k=keys, c=a)} AS ra, {rank.format(k=keys, c=b)} AS rb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY {keys}"


WI = "win, item"
CANDIDATES = f""", fm AS (SELECT k, s, d, x::DOUBLE AS m1, {', '.join(f"({_mean('x', n, 1)})::DOUBLE AS m{n}" for n in MEANS)}, (x - lag(x, 5) OVER (PARTITION BY k ORDER BY s))::DOUBLE AS d5 FROM ser),
ln AS ({' UNION ALL '.join(f"SELECT k, s, d, '{f}' AS form, {f} AS x FROM fm" for f in ('m1', *(f'm{n}' for n in MEANS), 'd5'))}),
lb AS (SELECT * FROM (SELECT s, x AS level, lead(x, 6) OVER (ORDER BY s) - x AS y FROM lvl) WHERE y IS NOT NULL),
rw AS (SELECT k || '|' || form AS item, k AS grp, ln.s, year(d) AS year, x, y, level FROM ln JOIN lb ON lb.s = ln.s),
cd AS (SELECT 'all' AS win, * FROM rw UNION ALL SELECT 'early', * FROM rw WHERE s <= (SELECT count(*) * 2 // 3 FROM lvl)),
ix AS ({_rank_sql('cd', WI, 'x', 'y', 'ic')}), mx AS ({_rank_sql('cd', WI, 'x', 'level', 'mech')}),
bl AS (SELECT {WI}, b, CASE WHEN count(x) >= 10 AND min(x) < max(x) AND min(y) FILTER (x IS NOT NULL) < max(y) FILTER (x IS NOT NULL) THEN corr(x, y::DOUBLE) END AS r FROM (SELECT *, (row_number() OVER (PARTITION BY {WI} ORDER BY s) - 1) // 20 AS b, count(*) OVER (PARTITION BY {WI}) AS n FROM cd) WHERE (b + 1) * 20 <= n GROUP BY {WI}, b),
ir AS (SELECT {WI}, CASE WHEN count(*) >= 6 AND stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) END AS icir FROM bl GROUP BY {WI}),
yb AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {WI}, year) AS yn FROM cd) WHERE yn >= 30), yr AS ({_rank_sql('yb', WI + ', year', 'x', 'y', 'r')}),
ya AS (SELECT yr.win, yr.item, count(*) FILTER (abs(r) > 1e-12) AS good, count(*) FILTER (abs(r) > 1e-12 AND sign(r) = coalesce(sign(ic), 0)) AS agree FROM yr JOIN ix ON ix.win = yr.win AND ix.item = yr.item GROUP BY yr.win, yr.item),
yc AS (SELECT {WI}, count(DISTINCT year) AS years FROM yb GROUP BY {WI}),
fg AS (SELECT cv.win, cv.item, grp, round(ic, 9) AS ic, round(icir, 9) AS icir, round(mech, 9) AS mech, CASE WHEN years >= 3 AND good >= 3 THEN agree / good END AS same, cov FROM (SELECT {WI}, min(grp) AS grp, count(x) / count(*) AS cov FROM cd GROUP BY {WI}) cv LEFT JOIN ix USING (win, item) LEFT JOIN ir USING (win, item) LEFT JOIN mx USING (win, item) LEFT JOIN ya USING (win, item) LEFT JOIN yc USING (win, item)),
al AS (SELECT *, ic IS NOT NULL AND icir IS NOT NULL AND coalesce(abs(mech), 0) < 0.7::DOUBLE AND cov >= 0.8::DOUBLE AND coalesce(same, 1) >= 0.8::DOUBLE AS alive FROM fg),
ge AS (SELECT win, grp, quantile_cont(abs(ic), 0.5) AS t1, quantile_cont(abs(icir), 0.5) AS t2 FROM al WHERE alive GROUP BY win, grp HAVING count(*) >= 4),
ps AS (SELECT al.*, alive AND coalesce(abs(ic) >= t1 AND abs(icir) >= t2, false) AS passed FROM al LEFT JOIN ge ON ge.win = al.win AND ge.grp = al.grp),
pl AS (SELECT *, CASE WHEN passed THEN row_number() OVER (PARTITION BY win, passed ORDER BY abs(icir) DESC, item) END AS place FROM ps),
px AS (SELECT cd.win, cd.item, place, s, x FROM cd JOIN pl ON pl.win = cd.win AND pl.item = cd.item WHERE passed AND x IS NOT NULL),
pp AS (SELECT a.win, a.item AS a, b.item AS b, a.place AS pa, b.place AS pb, a.x AS xa, b.x AS xb FROM px a JOIN px b ON a.win = b.win AND a.s = b.s AND a.place < b.place),
pr AS (SELECT win, a, b, pa, pb, rho FROM ({_rank_sql('pp', 'win, a, b, pa, pb', 'xa', 'xb', 'rho')}) WHERE abs(rho) >= 0.7::DOUBLE)"""

PAIRS = with_base(CANDIDATES + " SELECT win, least(a, b) AS a, greatest(a, b) AS b, round(rho, 8) AS rho FROM pr")


@query("screener_pairs", PAIRS)
def screener_pairs(spark, sf):
    """The pairs of candidates that pass the rules and go together."""
    rows = candidates(spark, sf)
    some = C.screen_window(rows, ["win"], "item", "grp").where("passed").select("win", "item")
    return C.correlated_pairs(rows.join(some, ["win", "item"], "left_semi"), ["win"], "item", block=8).withColumn("rho", F.round("rho", 8))


@query("window_screener", "WITH RECURSIVE " + with_base(CANDIDATES).removeprefix("WITH ") + """, gr AS (SELECT win, 0::BIGINT AS step, []::VARCHAR[] AS kept FROM (SELECT DISTINCT win FROM pl) UNION ALL
SELECT gr.win, gr.step + 1, CASE WHEN (SELECT count(*) FROM pr WHERE pr.win = gr.win AND pr.b = pl.item AND list_contains(gr.kept, pr.a)) > 0 THEN gr.kept ELSE list_append(gr.kept, pl.item) END FROM gr JOIN pl ON pl.win = gr.win AND pl.place = gr.step + 1),
fin AS (SELECT win, arg_max(kept, step) AS kept FROM gr GROUP BY win)
SELECT pl.win, item, grp, ic, icir, mech, same, cov, alive, passed, CAST(place AS INTEGER) AS place, passed AND list_contains(fin.kept, item) AS kept FROM pl JOIN fin ON fin.win = pl.win""")
def window_screener(spark, sf):
    """Every candidate's figures, and which are kept, in both windows."""
    return C.screen_window(candidates(spark, sf), ["win"], "item", "grp")
