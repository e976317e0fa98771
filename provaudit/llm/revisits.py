"""WARC not-modified revisit records: resolve each to the response whose payload it stands for.

As-of join: a revisit refers to the latest full response (status 200, payload present) of its canonical URL that is strictly
earlier; of several at that time the largest record_id. Validators are then checked: entity tags if both sides
have one (weak marks ignored), else Last-Modified if both have one, else payload digests if both have one. A
verified revisit takes the response's payload digest and headers, renewed by those headers of its own that a
304 answer may renew; all other headers of the revisit are dropped.

The join never needs all rows of a URL in one task. Time is cut into blocks at quantiles of all rows; windows run
within (URL, block), and a summary of one row per (URL, block) carries the last response of earlier blocks.

outcome is "resolved", "mismatch" (a validator differs), "unverified" (none to compare) or "no-response" (none is
earlier, or the URL is NULL or empty). NULL timestamps resolve nothing. Records without a URL meet none, so each goes to a task
by a hash of itself. Repeated records are resolved each. Empty or NULL tags, dates, digests and headers are compared as they
are (NULL: not at all); values of any length are kept whole. An empty table gives no rows. Extra columns are left out,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provaudit.llm.common import table

#: Header fields that a 304 answer may renew, and query fields that only track.
RENEWABLE = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
TRACKING = "^(utm_[a-z]+|gclid|fbclid)="

ROWS_PER_BLOCK = 10_000
MOST_BLOCKS = 256
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, www. and default port, path without closing slashes, sorted query fields
    without tracking ones, no fragment; NULL for a NULL or empty URL."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    fields = F.filter(F.array_sort(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")), lambda p: (p != "") & ~p.rlike(TRACKING))
    whole = F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit("")))
    return F.when(whole != "", whole)


def strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def time_blocks(records: DataFrame, rows_per_block: int, most: int = MOST_BLOCKS) -> Column:
    """The block of a row's ts: cuts are quantiles over all rows, at most `most` numbers on the driver."""
    n = int(records.agg(F.count(F.lit(1))).first()[0])
    m = max(1, min(most, n // rows_per_block))
    cuts = records.agg(F.percentile_approx("ts", [i / m for i in range(1, m)], 10_000)).first()[0] if m > 1 else None
    cuts = sorted(set(cuts or []))
    return F.size(F.filter(F.array(*[F.lit(int(c)).cast("long") for c in cuts]), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)


def resolved(records: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Resolve the revisits of (record_id, kind, url, ts, status, etag, last_modified, headers, digest).

    ts: seconds; headers: array of (name, value). Returns record_id, canonical_url, ts, refers_to, outcome,
    validator, headers, digest for each record of kind "revisit".
    """
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), "status", "etag", "last_modified", F.coalesce(F.col("headers").cast(HEADERS), F.array().cast(HEADERS)).alias("headers"), "digest")
    rows = rows.withColumn("block", time_blocks(rows, rows_per_block))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("digest").isNotNull() & F.col("url").isNotNull() & F.col("ts").isNotNull()
    response = F.when(full, F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    own = F.concat(F.lit("\0"), F.xxhash64("record_id", "ts", "etag", "last_modified", "digest").cast("string"))
    rows = rows.withColumn("response", response).withColumn("key", F.coalesce("url", own))
    here = Window.partitionBy("key", "block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.max("response").over(here)).where(F.col("kind") == "revisit").drop("response", "kind", "status")
    ends = rows.where(F.col("response").isNotNull()).groupBy("key", "block").agg(F.max("response").alias("end"))
    asked = rows.where((F.col("kind") == "revisit") & F.col("url").isNotNull()).select("key", "block").distinct()
    summary = asked.join(ends, ["key", "block"], "full")
    carried = summary.select("key", "block", F.max("end").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    found = inside.join(carried, ["key", "block"], "left")
    match = F.when(F.col("url").isNotNull() & F.col("ts").isNotNull(), F.coalesce("inside", "carried"))
    return checked(found.withColumn("m", match))


def checked(found: DataFrame) -> DataFrame:
    """Compare validators of revisits with their response `m` and merge headers."""
    r = lambda c: F.col("m." + c)
    by_tag, by_time, by_digest = (F.col(c).isNotNull() & r(c).isNotNull() for c in ("etag", "last_modified", "digest"))
    validator = F.when(by_tag, "etag").when(by_time, "last-modified").when(by_digest, "digest")
    same = F.when(by_tag, strong(F.col("etag")) == strong(r("etag"))).when(by_time, F.col("last_modified") == r("last_modified")).when(by_digest, F.col("digest") == r("digest"))
    outcome = F.when(F.col("m").isNull(), "no-response").when(validator.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    name = lambda h: F.lower(h["name"])
    renewed = F.filter("headers", lambda h: name(h).isin(RENEWABLE))
    kept = F.filter(r("headers"), lambda h: ~F.coalesce(F.array_contains(F.transform(renewed, name), name(h)), F.lit(False)))
    merged = F.array_sort(F.concat(F.transform(kept, lambda h: F.struct(name(h).alias("name"), h["value"].alias("value"))), F.transform(renewed, lambda h: F.struct(name(h).alias("name"), h["value"].alias("value")))))
    done = F.col("outcome") == "resolved"
    out = found.withColumn("outcome", outcome)
    return out.select(
        "record_id", F.col("url").alias("canonical_url"), "ts", r("record_id").alias("refers_to"), "outcome", F.when(F.col("m").isNotNull(), validator).alias("validator"), F.when(done, merged).alias("headers"), F.when(done, r("digest")).alias("digest")
    )


def captures(pages: DataFrame) -> DataFrame:
    """WARC records that the page table stands for: each page's response, and later revisits of up to two crawls.

    Revisits come by another spelling of the URL. Some carry another entity tag, some none, some precede their response;
    some responses are partial.
    """
    page = pages.select(F.col("page_id").cast("long").alias("p"), F.coalesce("url", F.lit("")).alias("url"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("size"))
    p, j = F.col("p"), F.col("j")
    each = page.withColumn("j", F.explode(F.sequence(F.lit(0), F.pmod(p, F.lit(3)).cast("int"))))
    first = j == 0
    made = F.lit(1_700_000_000) + F.pmod(p * 7919, F.lit(1_000_000))
    ts = F.when(first, made).when(F.pmod(p, F.lit(13)) == 0, made - j * 3600).otherwise(made + j * 3600)
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"'))
    etag = F.when(F.pmod(p, F.lit(5)) == 0, None).when(first, tag).when(F.pmod(p, F.lit(7)) == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    modified = F.concat(F.lit("day "), F.pmod(p, F.lit(28)).cast("string"))
    url = F.when(first, F.col("url")).otherwise(F.concat(F.regexp_replace("url", "^https?://", "HTTP://"), F.lit("#r"), j.cast("string")))
    h = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    stored = [h("Content-Type", F.lit("text/html")), h("Content-Length", F.col("size")), h("Date", ts), h("Server", F.pmod(p, F.lit(3))), h("Cache-Control", F.lit("max-age=60"))]
    answer = [h("Date", ts), h("Cache-Control", F.concat(F.lit("max-age="), (j * 100).cast("string"))), h("Content-Length", F.lit(0)), h("X-Cache", F.lit("HIT"))]
    return each.select(
        (p * 4 + j).alias("record_id"), F.when(first, "response").otherwise("revisit").alias("kind"), url.alias("url"), ts.cast("long").alias("ts"), F.when(~first, 304).when(F.pmod(p, F.lit(11)) == 0, 206).otherwise(200).alias("status"),
        etag.alias("etag"), modified.alias("last_modified"), F.when(first, F.array(*stored)).otherwise(F.array(*answer)).alias("headers"), F.when(first, F.col("digest")).alias("digest"),
    )


def op1_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolved(captures(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return out.withColumn("headers", lines)


ORACLE = r"""
WITH page AS (
  SELECT page_id AS p, coalesce(url, '') AS url, sha256(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size FROM pages),
each AS (SELECT *, unnest(range(0, (p % 3) + 1)) AS j FROM page),
capture AS (
  SELECT p * 4 + j AS record_id, p, j, digest, size,
    CASE WHEN j = 0 THEN url ELSE regexp_replace(url, '^https?://', 'HTTP://') || '#r' || j END AS url,
    1700000000 + (p * 7919) % 1000000 + CASE WHEN j = 0 THEN 0 WHEN p % 13 = 0 THEN -j * 3600 ELSE j * 3600 END AS ts,
    CASE WHEN p % 5 = 0 THEN NULL WHEN j > 0 AND p % 7 = 0 THEN 'changed' ELSE substr(digest, 1, 12) END AS tag,
    'day ' || (p % 28) AS modified
  FROM each),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM capture),
split AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(regexp_replace(b, '^[^/?]*', ''), '^[^?]*'), '/+$', '') AS path,
    list_filter(list_sort(string_split(regexp_extract(b, '\?(.*)$', 1), '&')), lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_[a-z]+|gclid|fbclid)=')) AS fields
  FROM bare),
record AS (SELECT *, host || path || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS c FROM split),
revisit AS (SELECT * FROM record WHERE j > 0),
response AS (SELECT c, ts, max(record_id) AS record_id FROM record WHERE j = 0 AND p % 11 <> 0 AND c <> '' GROUP BY c, ts),
found AS (
  SELECT v.*, a.record_id AS refers_to FROM revisit v ASOF LEFT JOIN response a ON v.c = a.c AND v.ts > a.ts),
compared AS (
  SELECT f.record_id, f.c, f.ts, f.j, f.refers_to, r.digest AS d, r.size AS s, r.p AS rp,
    CASE WHEN f.refers_to IS NULL THEN NULL WHEN f.tag IS NOT NULL AND r.tag IS NOT NULL THEN 'etag' ELSE 'last-modified' END AS validator,
    CASE WHEN f.tag IS NOT NULL AND r.tag IS NOT NULL THEN f.tag = r.tag ELSE f.modified = r.modified END AS same
  FROM found f LEFT JOIN record r ON r.record_id = f.refers_to)
SELECT record_id, nullif(c, '') AS canonical_url, ts, refers_to,
  CASE WHEN refers_to IS NULL THEN 'no-response' WHEN same THEN 'resolved' ELSE 'mismatch' END AS outcome, validator,
  CASE WHEN refers_to IS NOT NULL AND same THEN 'cache-control: max-age=' || (j * 100) || chr(10) || 'content-length: ' || s || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'server: ' || (rp % 3) END AS headers,
  CASE WHEN refers_to IS NOT NULL AND same THEN d END AS digest
FROM compared
"""
