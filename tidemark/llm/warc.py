"""WARC archives and their capture index: local sorted runs, merged by a loser tree within ranges of the URL key."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import math
import re
from collections import Counter
from itertools import groupby
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, materialize, read, scratch_path

END = "\r\n\r\n"
CAPTURE = "page_id long, url_key string, captured_at string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, without user, port or scheme; path and query lower-cased. Null: empty."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
    except ValueError:
        return (url or "").strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}".lower() if host else (url or "").strip().lower()


def classified(pages: DataFrame, least: int = 100) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, its length and SHA-256, and ``refers_to`` of repeated payloads.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response. Null html is an empty payload;
    smaller payloads, and empty ones, are all responses. Minima are taken per digest before the join.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html.cast("binary"), 256).alias("digest"))
    slim = own.select("page_id", "bytes", "digest").where(F.col("bytes") >= least)
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    joined = own.join(firsts, "digest", "left")
    return joined.withColumn("refers_to", F.when((F.col("bytes") >= least) & (F.col("page_id") > F.col("first")), F.col("first"))).drop("first")


def _safe(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")


def records(pages: DataFrame, epoch: int = 1_700_000_000) -> DataFrame:
    """One WARC record a row, without the blank lines that end it. A page without a capture time gets ``epoch`` plus its id in seconds."""
    day = F.date_format(F.timestamp_seconds(F.lit(epoch) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _safe(F.col("url"))),
        F.concat(F.lit("WARC-Date: "), day),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return pages.select(F.concat(lines, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = 8_000_000) -> None:
    """Write ``pages`` as gzipped WARC files of about ``file_bytes``, and at most 1.5 GB, before compression under ``path``.

    A record's own end, two empty lines, separates them. A file is one gzip member, so it is read as a whole.
    """
    mean, most = pages.agg(F.avg(F.octet_length("html")), F.max(F.octet_length("html"))).first()
    rows = max(1, min(1_000_000, int(file_bytes / ((mean or 1) + 600)), int(1.5e9 / ((most or 1) + 600))))  # under what binaryFile reads, whatever stands together
    records(classified(pages)).write.option("lineSep", END).option("maxRecordsPerFile", rows).option("compression", "gzip").text(path)


def parse_archive(content: bytes):
    """Yield (headers, block) of each record of an archive; the block's place is known by its length alone."""
    view, at = memoryview(content), 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:head_end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {first[:40]!r}")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines if ": " in line)}
        begin = head_end + 4
        end = begin + int(headers["content-length"])
        yield headers, view[begin:end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    text = urn.strip("<>").rsplit(":", 1)[1] if urn else ""
    return int(text) if text else None


def _order(url_key: str, captured_at: str, page_id: int | None) -> tuple:
    """Sort key of a capture; one without a page_id comes first among its equals."""
    return (url_key, captured_at, -(2**63) if page_id is None else page_id)


def captures(content: bytes) -> list[tuple]:
    """The archive's captures as a run sorted by (url_key, captured_at, page_id); a response's digest is computed anew."""
    run = []
    for headers, block in parse_archive(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
        raw = bytes(block)
        http_end = raw.index(b"\r\n\r\n") + 4
        http = dict(x.split(": ", 1) for x in raw[: http_end - 4].decode().split("\r\n")[1:])
        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
        size = int(http["Content-Length"])
        if kind == "response" and (size != len(raw) - http_end or hashlib.sha256(raw[http_end:]).hexdigest() != digest):
            raise ValueError(f"payload of {headers['warc-record-id']} doesn't agree with its headers")
        run.append((url_key(headers.get("warc-target-uri")), headers["warc-date"], _page(headers["warc-record-id"]), size, digest, kind, _page(headers.get("warc-refers-to"))))
    return sorted(run, key=lambda x: _order(*x[:3]))


class LoserTree:
    """K-way merge of sorted iterators: inner nodes hold the loser of their match, so that each item costs log k matches."""

    def __init__(self, runs, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads = [self._take(i) for i in range(len(self.runs))] or [None]
        self.losers = [-1] * self.k
        self.winner = self._play(1)

    def _take(self, i):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, self.losers[node] = (a, b) if self._less(a, b) else (b, a)
        return won

    def __iter__(self):
        while (head := self.heads[self.winner]) is not None:
            yield head[2]
            i = self.winner
            self.heads[i] = self._take(i)
            node = (i + self.k) // 2
            while node >= 1:
                if self._less(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def merged_index(path: str, spark: SparkSession, range_rows: int = 20_000, sample: int = 20_000) -> DataFrame:
    """Capture histories of the archives under ``path``: rows of CAPTURE with ``range`` and ``position``.

    ``position`` is the place, from 0, in the global order by (url_key, captured_at, page_id). Each file is one run, sorted
    where it is read and cut at the range borders; a range's pieces are merged by a loser tree, and its places begin after
    the rows of the ranges before, of which a count a range is added up. Borders are keys of a sample of rows, two
    a range of ``range_rows`` captures and ``sample`` at least, and steer balance only; they are whole keys, so that one host or URL spreads over ranges. No file, no rows.
    """
    names = ("url_key", "captured_at", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    entry = "struct<url_key:string,captured_at:string,page_id:long,payload_bytes:long,payload_digest:string,record_type:string,refers_to:long>"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def read_runs(batches):
        for b in batches:
            yield {"run": [[dict(zip(names, r, strict=True)) for r in captures(content)] for content in b["content"]]}

    runs = materialize(map_batches(files, read_runs, f"run array<{entry}>"), "runs")
    total = runs.agg(F.sum(F.size("run"))).first()[0] or 0
    keys = runs.select(F.explode("run").alias("r")).select("r.url_key", "r.captured_at", "r.page_id")
    ranges = max(12, math.ceil(total / range_rows))
    sample = max(sample, 2 * ranges)
    found = sorted(_order(*r) for r in keys.where(F.rand(5) < 2 * sample / max(1, total)).limit(sample).collect())
    borders = sorted({found[int(x)] for x in np.linspace(0, len(found), ranges + 1)[1:-1]}) if found else []

    def cut(batches):
        for b in batches:
            out = [(k, list(piece)) for run in b["run"] for k, piece in groupby(run, key=range_of)]
            yield {"range": [k for k, _ in out], "run": [piece for _, piece in out]}

    def count(batches):
        for b in batches:
            found = Counter(range_of(r) for run in b["key"] for r in run)
            yield {"range": list(found), "n": list(found.values())}

    def range_of(r) -> int:
        return bisect.bisect_right(borders, _order(r["url_key"], r["captured_at"], r["page_id"]))

    pieces = map_batches(runs, cut, f"range int, run array<{entry}>")
    slim = runs.select(F.arrays_zip(F.col("run.url_key").alias("url_key"), F.col("run.captured_at").alias("captured_at"), F.col("run.page_id").alias("page_id")).alias("key"))
    sizes = map_batches(slim, count, "range int, n long").groupBy("range").agg(F.sum("n").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row a range

    def merge(batches):
        pending: dict[int, list] = {}
        for b in batches:  # rows come sorted by range: a range is whole when the next begins
            for k, run in zip(b["range"], b["run"], strict=True):
                if k not in pending and pending:
                    yield from done(pending)
                    pending = {}
                pending.setdefault(k, []).append(run)
        yield from done(pending)

    def done(pending):
        for k, runs in pending.items():
            tree = LoserTree(runs, key=lambda r: _order(r["url_key"], r["captured_at"], r["page_id"]))
            rows = list(tree)
            yield {"range": [k] * len(rows), "position": list(range(len(rows)))} | {n: [r[n] for r in rows] for n in names}

    dealt = pieces.repartition(len(borders) + 1, "range").sortWithinPartitions("range")
    merged = map_batches(dealt, merge, f"range int, position long, {CAPTURE}")
    return merged.join(before, "range").withColumn("position", F.col("position") + F.col("before")).drop("before")


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write, read back and merge all pages; ``position`` is the place in the global order by URL key, time and page_id.

    A null html is an empty payload, a null url the empty key; rows equal in page_id are captures of their own; a row
    without a page_id is a response. No rows, no rows.
    """
    path = scratch_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    index = merged_index(path, spark)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position")


OP2_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest,
  strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at,
  regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www[0-9]*\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM p),
k AS (SELECT *, lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END) AS url_key FROM d),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT k.page_id, k.payload_bytes, k.payload_digest,
  CASE WHEN k.payload_bytes >= 100 AND k.page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.payload_bytes >= 100 AND k.page_id > first_id THEN first_id END AS refers_to,
  url_key, captured_at, row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS position
FROM k LEFT JOIN f USING (payload_digest)
"""
