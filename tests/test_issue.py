"""Sessions issued from two feeds: resumed equals uninterrupted, a missing feed issues nothing, revisions change nothing."""

import pytest

from tidemark.streaming.issue import issue_sessions
from tidemark.streaming.rolling import replay

DDL = "k string, s long, feed string, v double"


def run(spark, base, *batches):
    out = None
    for rows in batches:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = issue_sessions(spark.readStream.schema(DDL).parquet(f"{base}/in"), "k", "s", "feed", "v", ["price", "flow"])
        out = replay(stream, "t", f"{base}/state", f"{base}/out")
    return out


def kind(out, name):
    return sorted((r["k"], r["session"], r["feed"] or "", r["value"], r["archived"], r["n"], r["total"]) for r in out.collect() if r["kind"] == name)


def feeds(k, sessions, flow=lambda s: s / 10):
    return [(k, s, "price", 100.0 + s) for s in sessions] + [(k, s, "flow", flow(s)) for s in sessions]


def test_resumed_equals_uninterrupted(spark, tmp_path):
    rows = feeds("a", range(1, 13)) + feeds("b", range(1, 7))
    whole = run(spark, tmp_path / "one", rows)
    parts = run(spark, tmp_path / "two", [r for r in rows if r[1] <= 4], [r for r in rows if r[1] > 4], [("a", 2, "price", 102.0)])
    assert kind(whole, "issued") == kind(parts, "issued") and len(kind(whole, "issued")) == 18
    last = kind(whole, "issued")[11]
    assert last[1] == 12 and last[5] == 12 and last[6] == pytest.approx(sum(100 + s - s / 10 for s in range(1, 13)))
    assert not kind(parts, "revision") and not kind(parts, "blocked")


def test_a_missing_feed_blocks_and_its_arrival_frees(spark, tmp_path):
    rows = [r for r in feeds("a", range(1, 7)) if (r[1], r[2]) != (3, "flow")] + [("a", 4, "other", 1.0), ("a", 3, "flow", None)]
    out = run(spark, tmp_path, rows)
    assert [r[1] for r in kind(out, "issued")] == [1, 2] and [(r[1], r[2]) for r in kind(out, "blocked")] == [(3, "flow")]
    out = run(spark, tmp_path, [("a", 3, "flow", 0.3)])
    assert [r[1] for r in kind(out, "issued")] == [1, 2, 3, 4, 5, 6] and len(kind(out, "blocked")) == 1


def test_revisions_are_recorded_and_not_applied(spark, tmp_path):
    out = run(spark, tmp_path, feeds("a", range(1, 4)), [("a", 2, "price", 999.0), ("a", 2, "flow", 0.2), *feeds("a", [4])])
    assert kind(out, "revision") == [("a", 2, "price", 999.0, 102.0, None, None)]
    assert kind(out, "issued")[-1][6] == pytest.approx(sum(100 + s - s / 10 for s in range(1, 5)))
