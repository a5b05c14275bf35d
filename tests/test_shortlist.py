"""Path digests, failure reasons and the shortlist."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import shortlist as S


def test_equal_paths_and_only_those_share_a_digest(spark):
    rows = [(k, s, (s * 7 % 3) - 1 if (k, s) != ("c", 900) else None) for k in "abc" for s in range(1200)] + [("d", s + 1, (s * 7 % 3) - 1) for s in range(1200)]
    df = spark.createDataFrame(rows, "k string, s long, p int")
    got = [{r["k"]: r["digest"] for r in S.path_digest(df.repartition(n), ["k"], "s", "p").collect()} for n in (1, 7)]
    assert got[0] == got[1] and got[0]["a"] == got[0]["b"] and len(set(got[0].values())) == 3
    assert S.path_digest(df.where("false"), ["k"], "s", "p").count() == 0


@pytest.fixture(scope="module")
def table(spark):
    rows = [("a", 1, 100.0, 5, "p"), ("a", 2, 90.0, 50, "q"), ("b", 1, 80.0, 50, "q"), ("b", 2, 70.0, 50, "r"), ("a", 3, 60.0, 50, "s"), ("c", 1, 50.0, 50, None), ("c", 2, None, 50, "t"), ("d", 1, -5.0, 5, "u")]
    df = spark.createDataFrame(rows, "model string, n int, total double, trades int, digest string")
    return S.reviewed(df, {"total": F.col("total") > 0, "few": F.col("trades") >= 30})


def test_a_high_profit_overrides_no_failure(table):
    got = {(r["model"], r["n"]): (r["failures"], r["eligible"]) for r in table.collect()}
    assert got["a", 1] == (["few"], False) and got["a", 2] == ([], True) and got["d", 1] == (["total", "few"], False) and got["c", 2] == (["total"], False)


def test_one_a_model_and_no_path_twice(table):
    order = [F.desc("total"), F.col("model"), F.col("n")]
    pick = lambda df, most: [(r["model"], r["n"]) for r in S.shortlist(df, "model", "digest", order, most)]
    assert pick(table, 2) == [("a", 2), ("b", 2)]  # the better one of b walks a's path
    assert pick(table, 9) == [("a", 2), ("b", 2), ("c", 1)]
    assert pick(table.where("false"), 2) == [] and pick(table, 0) == []
