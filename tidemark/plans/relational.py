"""Ingest, cleaning, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import relational as Q
from tidemark.operators.session import asof_backward, calendar, interpolate
from tidemark.plans.statistics import table
from tidemark.sources.sql import with_base
from tidemark.sources.tables import orders_by_day

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


@query("remap_taxonomy", "SELECT CASE WHEN n_nationkey < 12 THEN 'bank' WHEN n_nationkey < 18 THEN 'fund' ELSE n_name END AS name, count(*) AS n, CAST(sum(round(c_acctbal*100)) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def remap_taxonomy(spark, sf):
    n = table(spark, sf, "nation")
    rules = n.select("n_name", F.when(F.col("n_nationkey") < 12, "bank").when(F.col("n_nationkey") < 18, "fund").alias("to")).where("to is not null")
    named = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    out = Q.remap(named, "n_name", rules, "n_name", "to")
    return out.groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@query("dedupe_keep_last", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def dedupe_keep_last(spark, sf):
    return Q.keep_last(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).drop("o_orderdate")


@query("unpivot_wide", "SELECT c_custkey, kind, value FROM (SELECT c_custkey, 'balance' AS kind, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer) WHERE value IS NOT NULL AND value <> 0")
def unpivot_wide(spark, sf):
    wide = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return wide.unpivot("c_custkey", ["balance", "nation"], "kind", "value").where("value is not null and value <> 0")


@query("robust_parse", "WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '-' WHEN c_custkey % 7 = 1 THEN '' WHEN c_custkey % 7 = 2 THEN ' 1,' || CAST(100 + c_custkey % 900 AS VARCHAR) || '.5 ' ELSE CAST(c_custkey AS VARCHAR) END AS raw FROM customer) SELECT c_custkey, TRY_CAST(replace(trim(raw), ',', '') AS DOUBLE) AS value FROM t")
def robust_parse(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 7 == 0, "-").when(k % 7 == 1, "").when(k % 7 == 2, F.concat(F.lit(" 1,"), (100 + k % 900).cast("string"), F.lit(".5 "))).otherwise(k.cast("string"))
    return table(spark, sf, "customer").select("c_custkey", Q.robust_number(raw).alias("value"))


@query("incremental_antijoin", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 3 = 0)")
def incremental_antijoin(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.join(o.where("o_orderkey % 3 = 0").select("d").distinct(), "d", "left_anti").select("o_orderkey", "d")


@query("semi_available", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_available(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("gapfill_backup", with_base(", a AS (SELECT d, CAST(sum(c) AS BIGINT) AS v FROM ord WHERE k = '1' GROUP BY d), b AS (SELECT d, CAST(sum(c) AS BIGINT) AS v FROM ord WHERE k = '2' GROUP BY d) SELECT d, v FROM a UNION ALL SELECT d, v FROM b WHERE d BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND d NOT IN (SELECT d FROM a)"))
def gapfill_backup(spark, sf):
    o = orders_by_day(spark, sf)
    a, b = (o.where(F.col("k") == k).groupBy("d").agg(F.sum("c").alias("v")) for k in "12")
    return Q.fill_gaps(a, b, "d", F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date"))


@query("date_union", with_base("SELECT d FROM ord WHERE k = '1' UNION SELECT d FROM ord WHERE k = '2'"))
def date_union(spark, sf):
    o = orders_by_day(spark, sf)
    return o.where("k = '1'").select("d").union(o.where("k = '2'").select("d")).distinct()


@query("date_intersect", with_base("SELECT d FROM ord WHERE k = '1' INTERSECT SELECT d FROM ord WHERE k = '2' INTERSECT SELECT d FROM ord WHERE k = '3'"))
def date_intersect(spark, sf):
    o = orders_by_day(spark, sf)
    return o.where("k = '1'").select("d").intersect(o.where("k = '2'").select("d")).intersect(o.where("k = '3'").select("d"))


@query("date_except", with_base("SELECT d FROM ord WHERE k = '1' EXCEPT SELECT d FROM ord WHERE k = '2'"))
def date_except(spark, sf):
    o = orders_by_day(spark, sf)
    return o.where("k = '1'").select("d").subtract(o.where("k = '2'").select("d"))


@query("full_align", with_base(", a AS (SELECT d, x FROM val WHERE k = '1'), b AS (SELECT d, x FROM val WHERE k = '2') SELECT coalesce(a.d, b.d) AS d, a.x AS one, b.x AS two, a.x - b.x AS spread FROM a FULL JOIN b ON a.d = b.d"))
def full_align(spark, sf):
    v = orders_by_day(spark, sf).groupBy("k", "d").agg(F.expr("sum(c) div 100").alias("x"))
    a, b = v.where("k = '1'").select("d", F.col("x").alias("one")), v.where("k = '2'").select("d", F.col("x").alias("two"))
    return a.join(b, "d", "full").withColumn("spread", F.col("one") - F.col("two"))


@query("asof_policy", with_base(", ch AS (SELECT d, max(c) AS rate FROM (SELECT CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice*100) AS BIGINT) AS c FROM orders WHERE o_orderkey % 97 = 0) GROUP BY d) SELECT cal.d, cal.s, ch.rate FROM cal ASOF LEFT JOIN ch ON cal.d >= ch.d"))
def asof_policy(spark, sf):
    o = table(spark, sf, "orders")
    ch = o.where("o_orderkey % 97 = 0").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.max(F.round(F.col("o_totalprice") * 100).cast("long")).alias("rate"))
    return asof_backward(calendar(orders_by_day(spark, sf)), ch, "d", "rate")


@query("curve_interp", "WITH n AS (SELECT p_size AS node, CAST(sum(round(p_retailprice*100)) AS BIGINT) / count(*) AS value FROM part WHERE p_size % 5 = 0 GROUP BY p_size), sp AS (SELECT node AS x0, value AS y0, lead(node) OVER (ORDER BY node) AS x1, lead(value) OVER (ORDER BY node) AS y1, max(node) OVER () AS top FROM n), b AS (SELECT p_partkey, p_size + (p_partkey % 10) / 10.0::DOUBLE AS x FROM part) SELECT p_partkey, x, y0 + (y1 - y0) * (x - x0) / (x1 - x0) AS y FROM b LEFT JOIN sp ON x1 IS NOT NULL AND x >= x0 AND (x < x1 OR (x = x1 AND x1 = top))")
def curve_interp(spark, sf):
    p = table(spark, sf, "part")
    nodes = p.where("p_size % 5 = 0").groupBy(F.col("p_size").alias("node")).agg((F.sum(F.round(F.col("p_retailprice") * 100).cast("long")) / F.count(F.lit(1))).alias("value"))
    return interpolate(p.select("p_partkey", (F.col("p_size") + F.col("p_partkey") % 10 / F.lit(10.0)).alias("x")), nodes, "x", [])


@query("business_days", "SELECT o_orderkey, CAST(len(list_filter(range(CAST(o_orderdate AS DATE) + 1, CAST(o_orderdate AS DATE) + INTERVAL 15 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS BIGINT) AS n FROM orders")
def business_days(spark, sf):
    d = F.to_date("o_orderdate")
    days = F.sequence(F.date_add(d, 1), F.date_add(d, 14))
    return table(spark, sf, "orders").select("o_orderkey", F.size(F.filter(days, lambda x: F.weekday(x) < 5)).cast("long").alias("n"))


ORDER_ROW = "concat_ws(',', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), CAST(CAST(round(o_totalprice*100) AS BIGINT) AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority)"


@query("digest", f"SELECT o_orderstatus, sha256(string_agg(digest, ',' ORDER BY part)) AS digest FROM (SELECT o_orderstatus, o_orderkey // 16384 AS part, sha256(string_agg({ORDER_ROW}, ';' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1, 2) GROUP BY 1")
def digest(spark, sf):
    """Digest of all of a group's canonical rows, in two levels: of each range of 16,384 keys, then of the ranges' digests."""
    row = F.concat_ws(",", "o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "o_orderpriority")
    o = table(spark, sf, "orders").select("o_orderstatus", F.expr("o_orderkey div 16384").alias("part"), F.struct(F.col("o_orderkey").alias("key"), row.alias("text")).alias("row"))

    def digest_of(rows, field, mark):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r[field]), mark), 256)

    parts = o.groupBy("o_orderstatus", "part").agg(digest_of("row", "text", ";").alias("digest"))
    return parts.groupBy("o_orderstatus").agg(digest_of(F.struct("part", "digest"), "digest", ",").alias("digest"))


@query("top20", "SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top20(spark, sf):
    from pyspark.sql import Window

    best = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))


@query("pareto_front", "WITH c AS (SELECT c_custkey AS id, c_nationkey AS g, c_acctbal AS a, (c_custkey * 7919 % 1009)::DOUBLE AS b FROM customer) SELECT id, g, a, b FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.g = c.g AND o.a >= c.a AND o.b >= c.b AND (o.a > c.a OR o.b > c.b))")
def pareto_front(spark, sf):
    """Rows that no row of their group beats on one figure and equals or beats on the other: a running maximum, no self join."""
    from pyspark.sql import Window

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("a"), (F.col("c_custkey") * 7919 % 1009).cast("double").alias("b"))
    above = F.max("b").over(Window.partitionBy("g").orderBy(F.desc("a")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    better = F.max(F.struct("b", "a")).over(Window.partitionBy("g").orderBy(F.desc("a")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return c.withColumn("top", above).withColumn("who", better["a"]).where("b = top and a = who").select("id", "g", "a", "b")


@query("stride_phases", with_base("SELECT s % 6 AS phase, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM lvl GROUP BY 1"))
def stride_phases(spark, sf):
    from tidemark.sources.tables import level

    return level(spark, sf).groupBy((F.col("s") % 6).alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query("clip_policy", "SELECT CASE WHEN p_type LIKE 'PROMO%' THEN 'clip' WHEN p_type LIKE 'STANDARD%' THEN 'keep' ELSE 'other' END AS policy, count(*) AS n, CAST(sum(least(greatest(p_size, 5), 45)) AS BIGINT) AS clipped FROM part GROUP BY 1")
def clip_policy(spark, sf):
    policy = F.when(F.col("p_type").startswith("PROMO"), "clip").when(F.col("p_type").startswith("STANDARD"), "keep").otherwise("other")
    return table(spark, sf, "part").groupBy(policy.alias("policy")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.greatest("p_size", F.lit(5)), F.lit(45))).alias("clipped"))
