"""Row rules at the door: settled and future days, finite values, coverage, period masks, yields after tax."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.finance import net_yield
from tidemark.operators import ingest as I
from tidemark.sources.sql import with_base
from tidemark.sources.tables import orders_by_day, series, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Two moments of one day, before and after its bars are final.
MOMENTS = ("1995-06-16 15:29:00", "1995-06-16 15:30:00")


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


@query("settled_rows", " UNION ALL ".join(f"SELECT '{m}' AS moment, o_orderpriority AS k, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '{m[:10]}' OR (CAST(o_orderdate AS DATE) = DATE '{m[:10]}' AND '{m[11:16]}' >= '15:30') GROUP BY o_orderpriority" for m in MOMENTS))
def settled_rows(spark, sf):
    """Bars that are final at a moment: no later days, and the day itself only once its session has closed."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("d"))
    at = o.withColumn("moment", F.explode(F.array(*[F.lit(m) for m in MOMENTS])))
    kept = at.where(I.settled(F.col("d"), F.to_timestamp("moment")))
    return kept.groupBy("moment", "k").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("last"))


@query("finite_values", "SELECT event_type, round(CASE WHEN event_id % 7 > 1 THEN value END, 4) AS v, count(*) AS n FROM events GROUP BY ALL")
def finite_values(spark, sf):
    """Values in four digits; not a number and infinity are missing."""
    rest = F.col("event_id") % 7
    v = F.when(rest == 0, F.lit(float("nan"))).when(rest == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_type", I.finite(v, 4).alias("v")).groupBy("event_type", "v").agg(F.count(F.lit(1)).alias("n"))


@query("panel_coverage", with_base(", w AS (SELECT s, count(x) / 5 AS share FROM ser GROUP BY s) SELECT share, share >= 0.9::DOUBLE AS enough, count(*) AS sessions FROM w GROUP BY share"))
def panel_coverage(spark, sf):
    """How many sessions have which share of the five series, and whether that is enough."""
    wide = series(spark, sf).groupBy("s").pivot("k", ["1", "2", "3", "4", "5"]).agg(F.first("x"))
    share = wide.select(I.coverage(["1", "2", "3", "4", "5"]).alias("share"))
    return share.groupBy("share").agg(F.count(F.lit(1)).alias("sessions")).withColumn("enough", F.col("share") >= 0.9)


@query("period_masks", with_base(" SELECT k, CAST(sum(c) FILTER (year(d) = 1995) AS BIGINT) AS in_year, CAST(sum(c) FILTER (strftime(d, '%Y-%m') = '1995-03') AS BIGINT) AS in_month, CAST(sum(c) FILTER (year(d) = 1995 AND quarter(d) = 2) AS BIGINT) AS in_quarter, CAST(sum(c) FILTER (d >= DATE '1997-07-01') AS BIGINT) AS since FROM ord GROUP BY k"))
def period_masks(spark, sf):
    """Sums by year, month, quarter and from a day on, of one scan."""
    d = F.col("d")
    masks = {"in_year": F.year(d) == 1995, "in_month": F.date_format(d, "yyyy-MM") == "1995-03", "in_quarter": (F.year(d) == 1995) & (F.quarter(d) == 2), "since": d >= F.lit("1997-07-01").cast("date")}
    return orders_by_day(spark, sf).groupBy("k").agg(*[F.sum(F.when(m, F.col("c"))).alias(n) for n, m in masks.items()])


@query("yield_after_tax", "SELECT l_returnflag AS k, l_linestatus AS st, round(avg(l_discount / (1 + l_tax)), 10) AS net, round(avg(l_discount) - avg(l_discount / (1 + l_tax)), 10) AS gap FROM lineitem GROUP BY ALL")
def yield_after_tax(spark, sf):
    """Mean rate after tax, and what the tax takes."""
    net = F.avg(net_yield(F.col("l_discount"), F.col("l_tax")))
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("st")).agg(F.round(net, 10).alias("net"), F.round(F.avg("l_discount") - net, 10).alias("gap"))
