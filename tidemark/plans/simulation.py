"""Exit rules, trade replays, shift tests, walk-forward ridge and the streaming means."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators.ridge import ridge_walk_forward
from tidemark.operators.simulate import simulate
from tidemark.operators.stats import circular_shift_test
from tidemark.plans.statistics import signals
from tidemark.sources.sql import BASE, with_base
from tidemark.sources.scratch import settled
from tidemark.sources.tables import level, series, table
from tidemark.streaming.issue import issue_sessions
from tidemark.streaming.rolling import replay, rolling_mean

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

HOLD = 6
ENTRIES = ", sg AS (SELECT s, x, CAST(coalesce(sign(x - lag(x) OVER (ORDER BY s)), 0) AS INTEGER) AS signal FROM lvl)"


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def exit_sql(leave: str, reason: str) -> str:
    """Session by session: a position ends after six sessions, or earlier where ``leave`` holds."""
    return f"""WITH RECURSIVE {BASE},
sg AS (SELECT s, x AS level, CAST(coalesce(sign(x - lag(x) OVER (ORDER BY s)), 0) AS INTEGER) AS sig FROM lvl),
ph AS (SELECT s, level, phase, CASE WHEN (s + phase) % 3 = 0 THEN 0 ELSE sig END AS signal, max(s) OVER () AS last FROM sg CROSS JOIN (SELECT unnest([0,1]) AS phase) q),
run AS (
  SELECT phase, s, 0 AS position, level, 0::BIGINT AS daily_pnl, 0::BIGINT AS equity, '' AS reason, CASE WHEN s < last THEN signal ELSE 0 END AS held, 0 AS age FROM ph WHERE s = 1
  UNION ALL
  SELECT phase, s, was, level, pnl, equity + pnl, reason,
    CASE WHEN was <> 0 AND reason = '' THEN was WHEN s < last THEN signal ELSE 0 END,
    CASE WHEN was <> 0 AND reason = '' THEN age + 1 ELSE 0 END
  FROM (SELECT p.*, r.held AS was, r.age, r.equity, r.held * (p.level - r.level) AS pnl,
      CASE WHEN r.held = 0 OR p.s = p.last THEN '' WHEN r.age + 1 >= {HOLD} THEN 'max_hold' WHEN {leave} THEN '{reason}' ELSE '' END AS reason
    FROM run r JOIN ph p ON p.phase = r.phase AND p.s = r.s + 1) q)
SELECT CAST(phase AS BIGINT) AS phase, s, CAST(position AS INTEGER) AS position, daily_pnl::DOUBLE AS daily_pnl, equity::DOUBLE AS equity, reason FROM run"""


@query("sim_reverse", exit_sql("p.signal = -r.held", "reverse"))
def sim_reverse(spark, sf):
    return simulate(signals(spark, sf), ["phase"], hold=HOLD, reverse=True).select("phase", "s", "position", "daily_pnl", "equity", "reason")


@query("sim_neutral", exit_sql("p.signal = 0", "neutral"))
def sim_neutral(spark, sf):
    return simulate(signals(spark, sf), ["phase"], hold=HOLD, neutral=True).select("phase", "s", "position", "daily_pnl", "equity", "reason")


def entries(spark, sf):
    """(s, x, signal, phase): the sign of the last change, and the phase of a session among the six starts."""
    change = F.signum((F.col("x") - F.lag("x").over(R.ordered([]))).cast("double")).cast("int")
    return level(spark, sf).select("s", "x", F.coalesce(change, F.lit(0)).alias("signal"), ((F.col("s") - 1) % HOLD).alias("phase"))


@query("phase_paths", with_base(ENTRIES + ", t AS (SELECT (s - 1) % 6 AS phase, s, signal, signal * (lead(x, 6) OVER (ORDER BY s) - x) AS pnl FROM sg) SELECT phase, s, signal, pnl, CAST(sum(pnl) OVER (PARTITION BY phase ORDER BY s) AS BIGINT) AS equity FROM t WHERE pnl IS NOT NULL"))
def phase_paths(spark, sf):
    """Trades of six sessions from each of six starts, with the running profit of each start."""
    t = entries(spark, sf).withColumn("pnl", F.col("signal") * (F.lead("x", HOLD).over(R.ordered([])) - F.col("x"))).where("pnl is not null")
    return t.select("phase", "s", "signal", "pnl", F.sum("pnl").over(R.ordered(["phase"])).alias("equity"))


@query("exit_replay", with_base(ENTRIES + ", t AS (SELECT e.s, e.signal, e.x, coalesce(min(d.s), e.s + 6) AS leave, CASE WHEN min(d.s) IS NULL THEN 'max_hold' ELSE 'reverse' END AS reason FROM sg e LEFT JOIN sg d ON d.s > e.s AND d.s < e.s + 6 AND d.signal = -e.signal WHERE e.signal <> 0 AND e.s + 6 <= (SELECT max(s) FROM sg) GROUP BY e.s, e.signal, e.x) SELECT t.s, t.signal, t.leave, t.reason, t.signal * (sg.x - t.x) AS pnl FROM t JOIN sg ON sg.s = t.leave"))
def exit_replay(spark, sf):
    """Fixed entries, other exits: the first opposite signal within the holding time, else its end. A frame finds it, not a range join."""
    e, within = entries(spark, sf), R.ordered([]).rowsBetween(1, HOLD - 1)
    up, down = (F.min(F.when(F.col("signal") == side, F.struct("s", "x"))).over(within) for side in (1, -1))
    last = F.when(F.lead("s", HOLD).over(R.ordered([])).isNotNull(), F.struct(F.lead("s", HOLD).over(R.ordered([])).alias("s"), F.lead("x", HOLD).over(R.ordered([])).alias("x")))
    t = e.withColumn("hit", F.when(F.col("signal") == 1, down).when(F.col("signal") == -1, up)).withColumn("last", last).where("signal <> 0 and last is not null")
    end = F.coalesce("hit", "last")
    reason = F.when(F.col("hit").isNull(), "max_hold").otherwise("reverse")
    return t.select("s", "signal", end["s"].alias("leave"), reason.alias("reason"), (F.col("signal") * (end["x"] - F.col("x"))).alias("pnl"))


@query("circular_shift_p", with_base(""", f AS (SELECT year(d) AS yr, s, x AS a, lead(x) OVER (PARTITION BY year(d) ORDER BY s) - x AS b FROM lvl),
i AS (SELECT yr, a, b, row_number() OVER (PARTITION BY yr ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY yr) AS n FROM f WHERE b IS NOT NULL),
k AS (SELECT i.*, unnest(range(0, n)) AS shift FROM i),
m AS (SELECT k.yr, k.shift, count(*) AS n, sum(k.a)::DOUBLE AS sa, sum(j.b)::DOUBLE AS sb, sum(k.a*k.a)::DOUBLE AS saa, sum(j.b*j.b)::DOUBLE AS sbb, sum(k.a*j.b)::DOUBLE AS sab FROM k JOIN i j ON j.yr = k.yr AND j.i = (k.i + k.shift) % k.n GROUP BY 1, 2),
c AS (SELECT yr, shift, CASE WHEN n*saa - sa*sa > 0 AND n*sbb - sb*sb > 0 THEN (n*sab - sa*sb) / (sqrt(n*saa - sa*sa) * sqrt(n*sbb - sb*sb)) END AS ic FROM m),
o AS (SELECT yr, ic AS own FROM c WHERE shift = 0)
SELECT yr, round(any_value(own), 9) AS ic, count(*) FILTER (shift > 0) AS shifts, (1 + count(*) FILTER (shift > 0 AND abs(ic) >= abs(own) - 1e-12)) / (1 + count(*) FILTER (shift > 0)) AS p FROM c JOIN o USING (yr) GROUP BY yr"""))
def circular_shift_p(spark, sf):
    f = level(spark, sf).select(F.year("d").cast("long").alias("yr"), "s", F.col("x").alias("a"))
    f = f.withColumn("b", F.lead("a").over(R.ordered(["yr"])) - F.col("a"))
    return circular_shift_test(f, "a", "b", ["yr"]).select("yr", F.round("ic", 9).alias("ic"), "shifts", "p")


@query("circular_shift_rank_p", with_base(""", f AS (SELECT year(d) AS yr, s, x AS a, lead(x) OVER (PARTITION BY year(d) ORDER BY s) - x AS b FROM lvl),
i AS (SELECT yr, 2 * rank() OVER (PARTITION BY yr ORDER BY a) + count(*) OVER (PARTITION BY yr, a) - 1 AS a, 2 * rank() OVER (PARTITION BY yr ORDER BY b) + count(*) OVER (PARTITION BY yr, b) - 1 AS b, row_number() OVER (PARTITION BY yr ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY yr) AS n FROM f WHERE a IS NOT NULL AND b IS NOT NULL),
k AS (SELECT i.*, unnest(range(0, n)) AS shift FROM i),
m AS (SELECT k.yr, k.shift, count(*) AS n, sum(k.a)::DOUBLE AS sa, sum(j.b)::DOUBLE AS sb, sum(k.a*k.a)::DOUBLE AS saa, sum(j.b*j.b)::DOUBLE AS sbb, sum(k.a*j.b)::DOUBLE AS sab FROM k JOIN i j ON j.yr = k.yr AND j.i = (k.i + k.shift) % k.n GROUP BY 1, 2),
c AS (SELECT yr, shift, CASE WHEN n*saa - sa*sa > 0 AND n*sbb - sb*sb > 0 THEN (n*sab - sa*sb) / (sqrt(n*saa - sa*sa) * sqrt(n*sbb - sb*sb)) END AS ic FROM m),
o AS (SELECT yr, ic AS own FROM c WHERE shift = 0)
SELECT yr, round(any_value(own), 9) AS ic, count(*) AS shifts, CASE WHEN any_value(own) IS NOT NULL THEN count(*) FILTER (abs(ic) >= abs(own) - 1e-12) / count(*) END AS p FROM c JOIN o USING (yr) GROUP BY yr"""))
def circular_shift_rank_p(spark, sf):
    """The exact circular-permutation p: all shifts of average ranks (doubled, so that they are whole)."""
    f = level(spark, sf).select(F.year("d").cast("long").alias("yr"), "s", F.col("x").alias("a"))
    f = f.withColumn("b", F.lead("a").over(R.ordered(["yr"])) - F.col("a")).where("a is not null and b is not null")

    def doubled(c):
        return (2 * F.rank().over(Window.partitionBy("yr").orderBy(c)) + F.count(F.lit(1)).over(Window.partitionBy("yr", c)) - 1).cast("long")

    out = circular_shift_test(f.select("yr", "s", doubled("a").alias("a"), doubled("b").alias("b")), "a", "b", ["yr"])
    return out.select("yr", F.round("ic", 9).alias("ic"), (F.col("shifts") + 1).alias("shifts"), F.when(F.col("ic").isNotNull(), F.col("p")).alias("p"))


@query("ridge_walk_forward", with_base(""", f AS (SELECT year(d) AS yr, x - lag(x) OVER (ORDER BY s) AS a, x - lag(x, 5) OVER (ORDER BY s) AS b, lead(x) OVER (ORDER BY s) - x AS y FROM lvl),
m AS (SELECT yr, count(*) AS n, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*y) AS ay, sum(b*y) AS by_, sum(y*y) AS yy FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL GROUP BY yr),
t AS (SELECT p.yr, CAST(sum(q.n) AS BIGINT) AS n_train, sum(q.aa)::DOUBLE + 1e9::DOUBLE AS aa, sum(q.ab)::DOUBLE AS ab, sum(q.bb)::DOUBLE + 1e9::DOUBLE AS bb, sum(q.ay)::DOUBLE AS ay, sum(q.by_)::DOUBLE AS by_ FROM m p JOIN m q ON q.yr < p.yr GROUP BY p.yr),
w AS (SELECT yr, n_train, (bb*ay - ab*by_) / (aa*bb - ab*ab) AS wa, (aa*by_ - ab*ay) / (aa*bb - ab*ab) AS wb FROM t)
SELECT w.yr, n_train, m.n AS n_test, round(wa, 9) AS weight_a, round(wb, 9) AS weight_b, round(sqrt((m.yy::DOUBLE - 2*wa*m.ay::DOUBLE - 2*wb*m.by_::DOUBLE + wa*wa*m.aa::DOUBLE + 2*wa*wb*m.ab::DOUBLE + wb*wb*m.bb::DOUBLE) / m.n), 4) AS rmse FROM w JOIN m USING (yr)"""))
def ridge(spark, sf):
    w, x = R.ordered([]), F.col("x")
    f = level(spark, sf).select(F.year("d").cast("long").alias("yr"), (x - F.lag(x).over(w)).alias("a"), (x - F.lag(x, 5).over(w)).alias("b"), (F.lead(x).over(w) - x).alias("y"))
    out = ridge_walk_forward(f, "yr", "a", "b", "y", 1e9)
    return out.select("yr", "n_train", "n_test", F.round("weight_a", 9).alias("weight_a"), F.round("weight_b", 9).alias("weight_b"), F.round("rmse", 4).alias("rmse"))


@query("stream_rolling_mean", "SELECT event_id, user_id, false AS late, count(*) OVER w AS n, round(sum(CAST(round(value*100) AS BIGINT)) OVER w / (100.0::DOUBLE * count(*) OVER w), 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def stream_rolling_mean(spark, sf):
    """Means of each user's last five events, by a stream that keeps them as state."""
    source = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")  # a pattern: the table is a file or a folder
    rows = source.select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("x"))
    out = replay(rolling_mean(rows, "user_id", "ts", "event_id", "x", 5), "rolling-mean")
    return out.select("event_id", "user_id", "late", "n", F.round(F.col("total") / (F.lit(100.0) * F.col("n")), 6).alias("mean"))


@query("issued_sessions", with_base(""", f AS (SELECT k, s, CASE WHEN s % 97 <> 0 THEN coalesce(x, 0) ELSE x END AS x FROM ser), b AS (SELECT k, coalesce(min(s) FILTER (x IS NULL), 1000000) AS stop FROM f GROUP BY k),
i AS (SELECT f.k, f.s, lvl.x - f.x AS v FROM f JOIN lvl USING (s) JOIN b ON b.k = f.k WHERE f.s < b.stop)
SELECT k, 'issued' AS kind, s AS session, NULL AS feed, CAST(v AS DOUBLE) AS value, row_number() OVER w AS n, CAST(sum(v) OVER w AS DOUBLE) AS total FROM i WINDOW w AS (PARTITION BY k ORDER BY s)
UNION ALL SELECT k, 'blocked', stop, 'flow', NULL, NULL, NULL FROM b WHERE stop < 1000000"""))
def issued_sessions(spark, sf):
    """The level less each series, issued session by session from two feeds; a session whose flow is missing blocks what follows."""
    x = F.when(F.col("s") % 97 != 0, F.coalesce("x", F.lit(0))).otherwise(F.col("x")).cast("double")
    flow = series(spark, sf).select("k", "s", F.lit("flow").alias("feed"), x.alias("v")).where("v is not null")
    price = series(spark, sf).select("k", "s").join(level(spark, sf).select("s", F.col("x").cast("double").alias("v")), "s").select("k", "s", F.lit("price").alias("feed"), "v")
    feeds = settled(flow.unionByName(price), "feeds")
    source = spark.readStream.schema(feeds.schema).parquet(feeds.inputFiles()[0].rsplit("/", 1)[0])
    return replay(issue_sessions(source, "k", "s", "feed", "v", ["price", "flow"]), "issued").select("k", "kind", "session", "feed", "value", "n", "total")
