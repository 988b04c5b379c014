"""Diagnostics as rules over rows: each rule is a level and a code, or nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_NODE, LARGE_NODE = 32 * 1024, 8 * 1024 * 1024
MAX_INDEX_READS = 8
EXPOSED = ("content-range", "content-length", "accept-ranges")


def finding(level: str, code: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))


def _rows(df: DataFrame, key: Sequence[str], rules: Sequence[Column]) -> DataFrame:
    found = df.select(*key, F.explode(F.filter(F.array(*rules), lambda f: f.isNotNull())).alias("f"))
    return found.select(*key, "f.level", "f.code")


def shape_findings(clouds: DataFrame, key: Sequence[str]) -> DataFrame:
    """From (nodes, points, declared, data_bytes, index_reads, crs, format): what is odd about a cloud's shape."""
    c = F.col
    empty = c("nodes") == 0
    average = F.when(~empty, c("data_bytes") / c("nodes"))
    rules = [
        finding("fail", "not-indexed", c("format") == "las"),
        finding("warn", "no-crs", c("crs").isNull()),
        finding("fail", "empty-hierarchy", empty),
        finding("warn", "point-count", (c("declared") > 0) & (c("declared") != c("points"))),
        finding("pass", "point-count", (c("declared") > 0) & (c("declared") == c("points"))),
        finding("warn", "small-nodes", (c("data_bytes") > 0) & (average < SMALL_NODE)),
        finding("warn", "large-nodes", average > LARGE_NODE),
        finding("pass", "node-size", average.between(SMALL_NODE, LARGE_NODE)),
        finding("warn", "hierarchy-requests", ~empty & (c("index_reads") > MAX_INDEX_READS)),
        finding("pass", "hierarchy", ~empty & (c("index_reads") <= MAX_INDEX_READS)),
    ]
    return _rows(clouds, key, rules)


def transport_findings(probes: DataFrame, key: Sequence[str], origin: str) -> DataFrame:
    """From (status, body_length, encoding, allow_origin, expose, preflight, cache) of a server's answers; without a status it was not reached."""
    c = F.col
    cors = F.coalesce(c("allow_origin").isin("*", origin), F.lit(False))
    exposed = F.lower(F.coalesce("expose", F.lit("")))
    lacks = ~(exposed.contains(EXPOSED[0]) & exposed.contains(EXPOSED[1]) & exposed.contains(EXPOSED[2]))
    cache = F.lower(F.coalesce("cache", F.lit("no-store")))
    rules = [
        finding("pass", "range", c("status") == 206),
        finding("warn", "range-length", (c("status") == 206) & (c("body_length") != 16)),
        finding("fail", "no-range", c("status") == 200),
        finding("fail", "payload-missing", c("status").isin(403, 404)),
        finding("fail", "payload-status", ~c("status").isin(200, 206, 403, 404)),
        finding("fail", "range-encoded", c("encoding").isNotNull() & (c("encoding") != "identity")),
        finding("pass", "cors", cors),
        finding("fail", "cors", ~cors),
        finding("warn", "cors-expose", cors & lacks),
        finding("warn", "preflight", ~F.coalesce(c("preflight").between(200, 299), F.lit(False))),
        finding("warn", "cache", cache.contains("no-store") | cache.contains("no-cache")),
        finding("pass", "latency", F.lit(True)),
    ]
    reached = c("status").isNotNull()
    return _rows(probes, key, [finding("fail", "unreachable", ~reached), *[F.when(reached, r) for r in rules]])


def exit_codes(findings: DataFrame, key: Sequence[str]) -> DataFrame:
    """1 where the worst finding is a failure, else 0."""
    return findings.groupBy(*key).agg(F.max(F.when(F.col("level") == "fail", 1).otherwise(0)).alias("exit_code"))
