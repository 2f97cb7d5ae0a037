"""URL filters by a temporal list join.

A list is a log of dated entries: from a time on, a pattern is blocked or allowed. The entries of one pattern, in
time order, become validity intervals, each until the next entry of the same pattern (the last stays open). A
capture asks for all patterns that could cover it: its host and the domains above it, and the host with each leading
run of path segments. An as-of join gives it the entry of each pattern that was active at its fetch time; of those
the most specific decides (a path before a host, more labels or segments first). Later entries never reach back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from impactspark.llm._shared import table, written

#: Interval tables of at most so many rows are broadcast, after a count.
BROADCAST_ROWS = 200_000


def host_of(url: Column) -> Column:
    """The host, lower-cased, without user, port and final dot; empty where there is none."""
    site = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(site, "^.*@", ""), ":[0-9]*$|\\.$", ""))


def segments_of(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


@dataclass(frozen=True)
class Shapes:
    """What a list's patterns look like, so that captures ask for no others: fewest and most labels, most path segments."""

    fewest: int
    most: int
    depth: int


def shapes(valid: DataFrame) -> Shapes:
    """Of the patterns of intervals(); one row comes to the driver. An empty list asks for nothing."""
    host, slashes = F.substring_index("pattern", "/", 1), F.length("pattern") - F.length(F.replace(F.col("pattern"), F.lit("/"), F.lit("")))
    labels = F.size(F.split(host, "\\."))
    bare = F.when(slashes == 0, labels)
    row = valid.agg(F.min(bare), F.max(bare), F.max(slashes)).first()
    return Shapes(row[0] or 1, row[1] or 0, row[2] or 0)


def patterns_of(url: Column, of: Shapes) -> Column:
    """Patterns that could cover a URL: ``host``, each domain above it, and ``host/segment/...``; none without a host."""
    host, segments = host_of(url), segments_of(url)
    labels, none = F.split(host, "\\."), F.array().cast("array<string>")
    n = F.size(labels)
    first, last = F.greatest(F.lit(1), n - of.most + 1), n - of.fewest + 1
    domains = F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(none)
    depth = F.least(F.size(segments), F.lit(of.depth))
    paths = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))).otherwise(none)
    return F.when(host == "", none).otherwise(F.array_distinct(F.concat(domains, paths)))


def specificity(pattern: Column) -> Column:
    """Paths before hosts, deeper before shallower."""
    slashes = F.length(pattern) - F.length(F.replace(pattern, F.lit("/"), F.lit("")))
    dots = F.length(F.substring_index(pattern, "/", 1)) - F.length(F.replace(F.substring_index(pattern, "/", 1), F.lit("."), F.lit("")))
    return slashes * 1000 + dots


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) of entries(pattern, action, effective); until is null where open.

    Entries without a pattern or time are dropped; of several at one time for one pattern, 'block' wins; other
    actions than block and allow are refused. Patterns are of any depth. An empty list has no intervals.
    """
    bad = F.raise_error(F.concat(F.lit("unknown action of "), F.col("pattern"))).cast("string")
    clean = entries.where("pattern is not null and effective is not null").select(F.lower(F.col("pattern")).alias("pattern"), "effective", F.when(F.col("action").isin("block", "allow"), F.col("action")).otherwise(bad).alias("action"))
    one = clean.groupBy("pattern", "effective").agg(F.max("action").alias("action"))
    line = Window.partitionBy("pattern").orderBy("effective")
    return one.select("pattern", "action", F.col("effective").alias("since"), F.lead("effective").over(line).alias("until"))


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with verdict ('block', 'allow' or 'none'), pattern and since of the entry that decides.

    Paths are compared case aside, as hosts are. A null or hostless URL and a null time have no entry. Repeated
    captures are judged alike, each in its own row. Columns of captures that bear one of the new names are replaced,
    all others, whatever their names, pass as they are. Without entries every verdict is 'none'.
    """
    kept = [c for c in captures.columns if c not in ("verdict", "pattern", "since")]
    rows = captures.select(F.struct("*").alias("row"), F.col(url).alias("u"), F.col(fetched).alias("f"))
    asked = rows.where("u is not null and f is not null").select("u", "f").distinct()
    valid = written(intervals(entries), "intervals")
    keyed = asked.withColumn("key", F.explode(patterns_of(F.col("u"), shapes(valid)))).withColumn("pattern", F.lower("key"))
    valid = F.broadcast(valid) if valid.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else valid
    active = keyed.join(valid, "pattern").where("since <= f and (until is null or f < until)")
    best = active.groupBy("u", "f").agg(F.max(F.struct(specificity(F.col("pattern")).alias("rank"), "pattern", "action", "since")).alias("best"))
    joined = rows.join(best, ["u", "f"], "left")
    return joined.select(*(F.col("row").getField(c).alias(c) for c in kept), F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("since"))


def _digit(text: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("int")


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list made of the pages' own hosts and first paths, as the test tables have none: a third of the hosts
    is blocked from some day, half of these are allowed later and some blocked again; a fifth of the first paths of
    a host is allowed or blocked from some day."""
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("pattern")).where("pattern <> ''").distinct()
    v = _digit(F.col("pattern"), 1)
    day = lambda c: F.date_add(F.lit("2023-01-01").cast("date"), c.cast("int"))
    turns = F.array(
        F.struct(F.lit("block").alias("action"), day(v % 365).alias("effective"), (v % 3 == 0).alias("on")),
        F.struct(F.lit("allow").alias("action"), day(v % 365 + 30 + v % 150).alias("effective"), ((v % 3 == 0) & (v % 2 == 0)).alias("on")),
        F.struct(F.lit("block").alias("action"), day(v % 365 + 400).alias("effective"), ((v % 3 == 0) & (v % 4 == 0)).alias("on")),
    )
    by_host = hosts.select("pattern", F.explode(turns).alias("t")).where("t.on").select("pattern", "t.action", "t.effective")
    first = segments_of(F.col("url"))
    paths = pages.where(F.size(first) > 0).select(F.lower(F.concat(host, F.lit("/"), F.element_at(first, 1))).alias("pattern"), host.alias("h")).where("h <> ''").select("pattern").distinct()
    w = _digit(F.col("pattern"), 5)
    by_path = paths.where(w % 5 == 0).select("pattern", F.when(w % 2 == 0, "allow").otherwise("block").alias("action"), day(w % 700).alias("effective"))
    return by_host.unionByName(by_path)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures; a page's fetch day follows from its id, as the test tables have no dates."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int")))
    found = judged(captures, sample_list(pages))
    return found.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "verdict", F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce(F.col("since").cast("string"), F.lit("")).alias("since"))


OP7_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2023-01-01' + CAST(page_id % 730 AS INTEGER) AS f,
             lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$|\.$', '')) AS host,
             list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM pages),
h AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 4) AS INTEGER) AS v FROM (SELECT DISTINCT host AS pattern FROM p WHERE host <> '')),
s AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 5, 4) AS INTEGER) AS w FROM (SELECT DISTINCT lower(host || '/' || seg[1]) AS pattern FROM p WHERE host <> '' AND len(seg) > 0)),
e AS (SELECT pattern, 'block' AS action, DATE '2023-01-01' + CAST(v % 365 AS INTEGER) AS since FROM h WHERE v % 3 = 0
      UNION ALL SELECT pattern, 'allow', DATE '2023-01-01' + CAST(v % 365 + 30 + v % 150 AS INTEGER) FROM h WHERE v % 3 = 0 AND v % 2 = 0
      UNION ALL SELECT pattern, 'block', DATE '2023-01-01' + CAST(v % 365 + 400 AS INTEGER) FROM h WHERE v % 3 = 0 AND v % 4 = 0
      UNION ALL SELECT pattern, CASE WHEN w % 2 = 0 THEN 'allow' ELSE 'block' END, DATE '2023-01-01' + CAST(w % 700 AS INTEGER) FROM s WHERE w % 5 = 0),
i AS (SELECT pattern, max(action) AS action, since, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM e GROUP BY pattern, since),
k AS (SELECT DISTINCT url, f, lower(key) AS pattern FROM (
        SELECT url, f, unnest(list_concat(
          list_transform(range(1, len(string_split(host, '.')) + 1), lambda j: array_to_string(list_slice(string_split(host, '.'), j, len(string_split(host, '.'))), '.')),
          list_transform(range(1, least(len(seg), 8) + 1), lambda j: host || '/' || array_to_string(list_slice(seg, 1, j), '/')))) AS key
        FROM p WHERE host <> '')),
a AS (SELECT url, f, k.pattern, action, since, (length(k.pattern) - length(replace(k.pattern, '/', ''))) * 1000
        + length(split_part(k.pattern, '/', 1)) - length(replace(split_part(k.pattern, '/', 1), '.', '')) AS rank
      FROM k JOIN i ON k.pattern = i.pattern AND since <= f AND (until IS NULL OR f < until)),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url, f ORDER BY rank DESC, pattern DESC, action DESC, since DESC) = 1)
SELECT page_id, p.url, CAST(p.f AS VARCHAR) AS fetched, coalesce(action, 'none') AS verdict, coalesce(pattern, '') AS pattern, coalesce(CAST(since AS VARCHAR), '') AS since
FROM p LEFT JOIN b ON p.url = b.url AND p.f = b.f
"""
