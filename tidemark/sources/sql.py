"""The same series as common table expressions for the checking engine."""

BASE = """
ord AS (SELECT CAST(o_orderdate AS DATE) AS d, substr(o_orderpriority,1,1) AS k, o_orderstatus AS st, CAST(round(o_totalprice*100) AS BIGINT) AS c FROM orders),
cal AS (SELECT d, row_number() OVER (ORDER BY d) AS s FROM (SELECT DISTINCT d FROM ord)),
lvl AS (SELECT s, d, CAST(sum(c) // (count(*)*100) AS BIGINT) AS x FROM ord JOIN cal USING (d) GROUP BY s, d),
val AS (SELECT k, d, CAST(sum(c) // 100 AS BIGINT) AS x FROM ord GROUP BY k, d),
ser AS (SELECT g.k, cal.d, cal.s, val.x FROM cal CROSS JOIN (SELECT DISTINCT k FROM val) g LEFT JOIN val ON val.k = g.k AND val.d = cal.d)
"""


def with_base(sql: str) -> str:
    return f"WITH {BASE} {sql}"
