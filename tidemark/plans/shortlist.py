"""Shortlist queries: positions in the level by each series' deviation, entries and exits by size, reviewed and shortened."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import shortlist as S
from tidemark.sources.scratch import settled
from tidemark.sources.sql import with_base
from tidemark.sources.tables import level, series

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
ENTRIES, EXITS = [1, -1], [0, 20000, 60000]
KEYS = ["model", "entry", "exit"]


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def daily(spark, sf):
    """(model, entry, exit, s, position, profit): with (1) or against (-1) a series' change since its last session, if over the exit's size."""
    x = F.col("x")
    lv = level(spark, sf).select("s", (F.lead("x").over(R.ordered([])) - x).alias("move"))
    w = R.ordered(["k"])
    own = series(spark, sf).where("x is not null").select(F.col("k").alias("model"), "s", (x - F.lag("x").over(w)).alias("change")).where("change is not null")
    each = own.join(F.broadcast(lv), "s").where("move is not null").withColumn("entry", F.explode(F.array(*map(F.lit, ENTRIES)))).withColumn("exit", F.explode(F.array(*map(F.lit, EXITS))))
    position = F.when(F.abs("change") > F.col("exit"), F.signum(F.col("change").cast("double")).cast("int") * F.col("entry")).otherwise(0)
    return each.select(*KEYS, "s", position.alias("position"), (position * F.col("move")).alias("profit"))


def review(spark, sf):
    rows = daily(spark, sf)
    best = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("profit"), "s"))
    latest = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("s")))
    at = rows.withColumns({"best": best, "latest": latest})
    p = F.col("profit")
    figures = at.groupBy(*KEYS).agg(F.sum(p).alias("total"), F.count_if(F.col("position") != 0).alias("held"), F.sum(F.when(F.col("position") > 0, p).otherwise(0)).alias("long"), F.sum(F.when(F.col("position") < 0, p).otherwise(0)).alias("short"), F.sum(F.when((F.col("best") > 3) | (p <= 0), p).otherwise(0)).alias("rest"), F.sum(F.when(F.col("latest") <= 60, p).otherwise(0)).alias("recent"))
    beside = F.count_if(F.col("total") > 0).over(Window.partitionBy("model", "entry"))
    figures = figures.withColumn("beside", beside).join(S.path_digest(rows, KEYS, "s", "position"), KEYS)
    rules = {"total": F.col("total") > 0, "few": F.col("held") >= 30, "one side": F.least("long", "short") > 0, "three best": F.col("rest") > 0, "recent": F.col("recent") > 0, "beside": F.col("beside") >= 2}
    return S.reviewed(figures, rules)


SQL = with_base(f""", m AS (SELECT s, lead(x) OVER (ORDER BY s) - x AS move FROM lvl), o AS (SELECT k AS model, s, x - lag(x) OVER (PARTITION BY k ORDER BY s) AS change FROM ser WHERE x IS NOT NULL),
p AS (SELECT model, entry, exit, s, CASE WHEN abs(change) > exit THEN CAST(sign(change) AS INTEGER) * entry ELSE 0 END AS position, move FROM o JOIN m USING (s), (SELECT unnest({ENTRIES}) AS entry), (SELECT unnest({EXITS}) AS exit) WHERE change IS NOT NULL AND move IS NOT NULL),
d AS (SELECT *, position * move AS profit, row_number() OVER (PARTITION BY model, entry, exit ORDER BY position * move DESC, s) AS best, row_number() OVER (PARTITION BY model, entry, exit ORDER BY s DESC) AS latest FROM p),
c AS (SELECT model, entry, exit, s // 500 AS part, sha256(string_agg(s || ':' || position, ',' ORDER BY s)) AS d FROM p GROUP BY ALL),
g AS (SELECT model, entry, exit, sha256(string_agg(d, ',' ORDER BY part)) AS digest FROM c GROUP BY ALL),
f AS (SELECT model, entry, exit, CAST(sum(profit) AS BIGINT) AS total, count(*) FILTER (position <> 0) AS held, CAST(coalesce(sum(profit) FILTER (position > 0), 0) AS BIGINT) AS long, CAST(coalesce(sum(profit) FILTER (position < 0), 0) AS BIGINT) AS short, CAST(coalesce(sum(profit) FILTER (best > 3 OR profit <= 0), 0) AS BIGINT) AS rest, CAST(coalesce(sum(profit) FILTER (latest <= 60), 0) AS BIGINT) AS recent FROM d GROUP BY ALL),
b AS (SELECT *, count(*) FILTER (total > 0) OVER (PARTITION BY model, entry) AS beside FROM f),
r AS (SELECT b.*, digest, concat_ws(',', CASE WHEN total <= 0 THEN 'total' END, CASE WHEN held < 30 THEN 'few' END, CASE WHEN least(long, short) <= 0 THEN 'one side' END, CASE WHEN rest <= 0 THEN 'three best' END, CASE WHEN recent <= 0 THEN 'recent' END, CASE WHEN beside < 2 THEN 'beside' END) AS failures FROM b JOIN g USING (model, entry, exit))""")


@query("strategy_review", SQL + " SELECT model, entry, exit, total, held, long, short, rest, recent, beside, digest, failures, failures = '' AS eligible, count(*) OVER (PARTITION BY digest) AS alike FROM r")
def strategy_review(spark, sf):
    """Figures, path digest, failures of every strategy, and how many share its path."""
    alike = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    return review(spark, sf).withColumns({"failures": F.array_join("failures", ","), "alike": alike})


@query("strategy_shortlist", SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT *, row_number() OVER (ORDER BY total DESC, model, entry, exit) AS o FROM r WHERE failures = ''),
a AS (SELECT * FROM n WHERE o = 1), z AS (SELECT n.* FROM n, a WHERE n.model <> a.model AND n.digest <> a.digest ORDER BY n.o LIMIT 1)
SELECT 1::BIGINT AS place, model, entry, exit, total FROM a UNION ALL SELECT 2::BIGINT, model, entry, exit, total FROM z""")
def strategy_shortlist(spark, sf):
    """The two best eligible strategies of different models and paths."""
    made = settled(review(spark, sf).select(*KEYS, "total", "digest", "eligible"), "review")
    rows = S.shortlist(made, "model", "digest", [F.desc("total"), *map(F.col, KEYS)], 2)
    return spark.createDataFrame([(i + 1, r["model"], r["entry"], r["exit"], r["total"]) for i, r in enumerate(rows)], "place long, model string, entry int, exit int, total long")
