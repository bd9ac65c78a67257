"""Operator 9, WARC revisits: not-modified records joined to the response they stand for.

A revisit (a 304 answer) has headers but no body. It stands for the latest full response of
the same canonical URL that is strictly earlier. If its validators hold, the revisit takes over
the body, and the stored headers with those that a 304 may change laid over them.

Plan. An as-of join without a join: responses and revisits are one table, and a window over
(URL, time block) carries the last response to the revisits after it. Time blocks lie between
quantiles of the times of all records, so a URL with a third of all records is spread over
them. The last response of each (URL, block) then goes on to that URL's later blocks in a
second window, whose rows are blocks, not records. What is carried is a small struct (id,
time, validators, headers, digest), never a body. Built-in functions only.

Validators: if both sides have an ETag, these decide (a weak mark W/ is dropped); else if both
have a Last-Modified, that decides; else the revisit is unchecked and resolves.

Defined results. A null URL never finds nor serves as an original, an empty one is a URL of its own; a null time never finds nor serves as an original;
of responses at one time the largest id is the latest; header names are taken in lower case, null headers are none. Other columns of the table are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelens.llm.common import place, table

# Header fields that a 304 answer may send to update a stored response (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]

#: Records of one time block, and blocks, at most.
BLOCK_ROWS = 50_000
BLOCKS = 8192

# Fixed patterns: what a canonical URL leaves out.
_TRACKING = "(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port; no scheme, fragment, tracking parameter, final slash or index page."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/index[.]html?$", "/"), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(bare, "[?](.*)$", 1), _TRACKING, "")
    query = F.regexp_replace(F.regexp_replace(query, "&+", "&"), "^&|&$", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, sent: Column) -> Column:
    """Stored headers with the permitted ones of the 304 laid over them, sorted by name."""
    allowed = F.map_filter(F.coalesce(sent, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, allowed))))


def _lower_names(headers: Column) -> Column:
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    # of names that differ in case only, the last counts
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))))


def resolve(records: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of records (record_id, url, at long, revisit boolean, headers map, digest, length) one row per revisit.

    Returns record_id, url_key, at, original_id, original_at, verdict (resolved, unchecked,
    changed, missing), headers (merged where resolved or unchecked) and digest, length of the body.
    """
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("at").cast("long").alias("at"),
        F.coalesce(F.col("revisit"), F.lit(False)).alias("revisit"), _lower_names(F.col("headers")).alias("headers"), F.col("digest").cast("string").alias("digest"), F.col("length").cast("long").alias("length"),
    )
    n = records.count()
    blocks = max(1, min(BLOCKS, -(-n // block_rows)))
    if n > 1000:
        blocks = max(blocks, 16)
    shares = [i / blocks for i in range(1, blocks)]
    cuts = sorted({x for x in records.select(F.percentile_approx(F.col("at").cast("long"), shares, 10_000)).first()[0] or [] if x is not None}) if shares else []
    block = place(F.col("at"), cuts)
    timed = rows.filter("at is not null and url_key is not null").withColumn("block", block.cast("int"))
    served = F.when(~F.col("revisit"), F.struct("at", "record_id", "headers", "digest", "length"))
    # at one time revisits come before responses: an original is strictly earlier
    order = Window.partitionBy("url_key", "block").orderBy("at", F.when(F.col("revisit"), 0).otherwise(1), "record_id")
    local = timed.withColumn("near", F.last(served, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("revisit")
    latest = timed.filter("not revisit").groupBy("url_key", "block").agg(F.max_by(F.struct("at", "record_id", "headers", "digest", "length"), F.struct("at", "record_id")).alias("served"))
    # a row for each block of a URL that has a response or a revisit
    asked = timed.filter("revisit").select("url_key", "block").distinct().withColumn("served", F.lit(None).cast(latest.schema["served"].dataType))
    carried = latest.unionByName(asked).withColumn("asks", F.col("served").isNull())
    before = Window.partitionBy("url_key").orderBy("block", F.when(F.col("asks"), 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    far = carried.withColumn("far", F.last("served", ignorenulls=True).over(before)).filter("asks").select("url_key", "block", "far")
    joined = local.join(far, ["url_key", "block"], "left").select("record_id", "url_key", "at", "headers", F.coalesce("near", "far").alias("found"))
    untimed = rows.filter("(at is null or url_key is null) and revisit").select("record_id", "url_key", "at", "headers", F.lit(None).cast(joined.schema["found"].dataType).alias("found"))
    found = joined.unionByName(untimed)
    mine, theirs = (lambda name: F.col("headers")[name]), (lambda name: F.col("found.headers")[name])
    etags, dates = (_strong(mine("etag")), _strong(theirs("etag"))), (mine("last-modified"), theirs("last-modified"))
    verdict = (
        F.when(F.col("found").isNull(), "missing")
        .when(etags[0].isNotNull() & etags[1].isNotNull(), F.when(etags[0] == etags[1], "resolved").otherwise("changed"))
        .when(dates[0].isNotNull() & dates[1].isNotNull(), F.when(dates[0] == dates[1], "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    held = F.col("verdict").isin("resolved", "unchecked")
    return found.withColumn("verdict", verdict).select(
        "record_id", "url_key", "at", F.col("found.record_id").alias("original_id"), F.col("found.at").alias("original_at"), "verdict",
        F.when(held, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"), F.when(held, F.col("found.digest")).alias("digest"), F.when(held, F.col("found.length")).alias("length"),
    )


def crawl(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl over a pages table: every page is fetched at 2 * page_id, and asked for again.

    The second fetch is answered 304 and comes later (for every tenth page earlier than the
    first); its headers have the page's ETag, or (page_id % 5 = 3) its Last-Modified, or
    (page_id % 5 = 4) neither.
    """
    page, etag = F.col("page_id"), F.md5(F.col("html").cast("binary"))
    date = F.concat(F.lit("day "), F.pmod(page, F.lit(28)).cast("string"))
    full = F.create_map(F.lit("etag"), etag, F.lit("last-modified"), date, F.lit("content-type"), F.lit("text/html"), F.lit("date"), (2 * page).cast("string"))
    later = F.when(page % 10 == 7, 2 * page - 1).otherwise(2 * page + 1 + 2 * F.pmod(page * 7919, F.lit(5000)))
    sent = F.map_concat(
        F.create_map(F.lit("Date"), later.cast("string"), F.lit("Content-Type"), F.lit("text/plain"), F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.pmod(page, F.lit(9)).cast("string"))),
        F.when(page % 5 < 3, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), etag))).when(page % 5 == 3, F.create_map(F.lit("Last-Modified"), date)).otherwise(F.create_map().cast("map<string,string>")),
    )
    first = pages.select((2 * page).alias("record_id"), "url", (2 * page).alias("at"), F.lit(False).alias("revisit"), full.alias("headers"), etag.alias("digest"), F.octet_length("html").alias("length"))
    again = pages.select((2 * page + 1).alias("record_id"), "url", later.alias("at"), F.lit(True).alias("revisit"), sent.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("int").alias("length"))
    return first.unionByName(again)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(crawl(table(spark, sf_dir, "pages")))
    shown = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", "url_key", F.col("at").alias("captured"), "original_id", "original_at", "verdict", shown.alias("headers"), "digest", "length")


ORACLE = {
    "op9_warc_revisits": r"""
with parts as (
  select page_id, html, md5(html) as etag, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from pages
), keyed as (
  select page_id, html, etag, 'day ' || (page_id % 28) as lm,
    case when page_id % 10 = 7 then 2 * page_id - 1 else 2 * page_id + 1 + 2 * ((page_id * 7919) % 5000) end as later,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '') as host,
    regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/index[.]html?$', '/'), '/+$', '') as path,
    regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '[?](.*)$', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '&+', '&', 'g'), '^&|&$', '', 'g') as query
  from parts
), urls as (
  select *, host || path || case when query <> '' then '?' || query else '' end as url_key from keyed
), firsts as (
  select url_key, 2 * page_id as captured, 2 * page_id as record_id, etag, lm, strlen(html) as length from urls
), found as (
  select 2 * u.page_id + 1 as record_id, u.url_key, u.later as captured, u.page_id, f.record_id as original_id, f.captured as original_at, u.etag as my_etag, u.lm as my_lm, f.etag as etag, f.lm as lm, f.length as length
  from urls u asof left join firsts f on u.url_key = f.url_key and u.later > f.captured
), judged as (
  select *, case when original_id is null then 'missing'
    when page_id % 5 < 3 then case when my_etag = etag then 'resolved' else 'changed' end
    when page_id % 5 = 3 then case when my_lm = lm then 'resolved' else 'changed' end
    else 'unchecked' end as verdict from found
)
select cast(record_id as bigint) as record_id, url_key, cast(captured as bigint) as captured, cast(original_id as bigint) as original_id, cast(original_at as bigint) as original_at, verdict,
  case when verdict in ('resolved', 'unchecked') then 'cache-control=max-age=' || (page_id % 9) || ';content-type=text/html;date=' || captured || ';etag=' || case when page_id % 5 < 3 then 'W/' || my_etag else etag end || ';last-modified=' || lm end as headers,
  case when verdict in ('resolved', 'unchecked') then etag end as digest,
  cast(case when verdict in ('resolved', 'unchecked') then length end as bigint) as length
from judged
"""
}
