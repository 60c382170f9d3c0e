"""Not-modified revisit resolution: an as-of join of 304 records to the latest earlier full response of
the same canonical URL, with validator checks and header merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranged, table

#: Headers of a 304 that update the stored response (RFC 9111, 3.2 and RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
CAPTURE = "rid, url, ts, status, etag, last_modified, headers"


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host lower-cased without www., default port, fragment, tracking parameters and
    final slash gone. Null stays null; text without :// is kept but for fragment and slash."""
    u = F.regexp_replace(url, r"#.*$", "")
    u = F.regexp_replace(u, r"([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*", r"$1")
    u = F.regexp_replace(F.regexp_replace(u, r"[?&]+$", ""), r"([?&])&+", r"$1")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    tail = F.regexp_replace(F.regexp_replace(rest, r"^[^/?]*", ""), r"/+($|\?)", r"$1")
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.concat(host, tail)


def _lowered(headers: Column) -> Column:
    """Entries with lower-case names; of names that then clash the last stays. Null gives none."""
    e = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    e = F.transform(e, lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
    return F.filter(
        e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"])
    )


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, those that a 304 may update replaced by its own; by name."""
    new = F.filter(_lowered(fresh), lambda x: x["key"].isin(*PERMITTED))
    old = F.filter(_lowered(stored), lambda x: ~F.exists(new, lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.array_sort(F.concat(old, new)))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each status-304 row of records (columns of CAPTURE; ts of any ordered type, headers a
    map<string,string>): rid, url_key, ts, full_rid, full_ts, verdict, headers.

    verdict: `etag` (weak comparison of entity tags holds), `last_modified` (no tag on one side, dates
    equal), `mismatch` (a validator differs), `unchecked` (neither side shares a kind of validator), or
    `orphan` (no full response of status 200 strictly before it). Only etag and last_modified count as resolved: else
    full_rid, full_ts and headers are null. Null urls or times are orphans. At equal times the response
    with the largest rid is the latest. Repeated rows each give a row; an empty table gives none.

    Rows are range-partitioned by (key, ts), so one URL with a third of all captures is spread over many
    tasks; what a partition needs from those before it is one response per partition.
    """
    r = records.where(F.col("status").isin(200, 304)).select(
        "rid", canonical_url(F.col("url")).alias("k"), "ts", (F.col("status") == 200).cast("int").alias("full"),
        "etag", "last_modified", "headers",
    )
    spark, schema = records.sparkSession, None
    p = ranged(r, ["k", "ts", "full", "rid"], "warc")
    hit = F.struct("k", "ts", "rid", "etag", "last_modified", "headers")
    usable = (F.col("full") == 1) & F.col("k").isNotNull() & F.col("ts").isNotNull()
    per = p.groupBy("_pid").agg(F.max("k").alias("last_key"))
    tails = (
        p.where(usable).join(F.broadcast(per), "_pid").where("k = last_key")
        .groupBy("_pid").agg(F.max_by(hit, F.struct("ts", "rid")).alias("hit"))
    )
    rows = per.join(tails, "_pid", "left").orderBy("_pid")
    schema, carry, seen = rows.select(F.col("_pid"), F.col("hit")).schema, None, []
    for row in rows.collect():  # one row per partition
        if carry is not None:
            seen.append((row["_pid"], carry))
        if row["hit"] is not None:
            carry = row["hit"]
        elif carry is not None and carry["k"] != row["last_key"]:
            carry = None
    carried = spark.createDataFrame(seen, schema).select("_pid", F.col("hit").alias("carried"), F.col("hit.k").alias("k"))
    w = Window.partitionBy("_pid", "k").orderBy("ts", "full", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.last(F.when(usable, hit), ignorenulls=True).over(w)
    j = p.withColumn("here", here).where("full = 0").join(F.broadcast(carried), ["_pid", "k"], "left")
    j = j.withColumn("f", F.when(F.col("ts").isNotNull(), F.coalesce("here", "carried")))
    both_tags = F.col("etag").isNotNull() & F.col("f.etag").isNotNull()
    both_dates = F.col("last_modified").isNotNull() & F.col("f.last_modified").isNotNull()
    verdict = (
        F.when(F.col("f").isNull(), "orphan")
        .when(both_tags, F.when(_weak(F.col("etag")) == _weak(F.col("f.etag")), "etag").otherwise("mismatch"))
        .when(both_dates, F.when(F.col("last_modified") == F.col("f.last_modified"), "last_modified").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    j = j.withColumn("verdict", verdict)
    good = F.col("verdict").isin("etag", "last_modified")
    return j.select(
        "rid", F.col("k").alias("url_key"), "ts", F.when(good, F.col("f.rid")).alias("full_rid"),
        F.when(good, F.col("f.ts")).alias("full_ts"), "verdict",
        F.when(good, merged_headers(F.col("f.headers"), F.col("headers"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Two capture records of each page: a full response at 2 * page_id, and a 304 at 2 * page_id + 5 that
    repeats the validators, weakly for every third page and wrongly for every seventh; every fifth page has
    no tag, every eleventh none of either."""
    tag = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"')))
    date = F.when(F.col("page_id") % 11 != 0, F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string")))
    pid = F.col("page_id")
    wrong = pid % 7 == 0
    base = pages.select("page_id", "url", tag.alias("t"), date.alias("d"), F.octet_length("html").cast("string").alias("n"))
    full = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.coalesce("n", F.lit("0")),
        F.lit("Date"), (pid * 2).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    fresh = F.create_map(
        F.lit("date"), (pid * 2 + 5).cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Expires"), (pid * 2 + 65).cast("string")
    )
    fulls = base.select(pid.alias("rid"), "url", (pid * 2).alias("ts"), F.lit(200).alias("status"), F.col("t").alias("etag"), F.col("d").alias("last_modified"), full.alias("headers"))
    seen = F.when(wrong, F.lit('"other"')).when(pid % 3 == 0, F.concat(F.lit("W/"), "t")).otherwise(F.col("t"))
    again = base.select(
        pid.alias("rid"), "url", (pid * 2 + 5).alias("ts"), F.lit(304).alias("status"), F.when(F.col("t").isNotNull(), seen).alias("etag"),
        F.when(wrong, F.lit("day -1")).otherwise(F.col("d")).alias("last_modified"), fresh.alias("headers"),
    )
    return fulls.unionByName(again)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select(F.col("rid").alias("page_id"), "url_key", "ts", F.col("full_rid").alias("full_page_id"), "full_ts", "verdict", text.alias("headers"))


_KEY = r"""regexp_replace(regexp_replace(lower(regexp_extract(r, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
 || regexp_replace(regexp_replace(r, '^[^/?]*', ''), '/+($|\?)', '\1', 'g')"""
OP1_SQL = rf"""
WITH c AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''),
   '([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '([?&])&+', '\1', 'g'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r FROM pages),
b AS (SELECT page_id, {_KEY} AS k, CASE WHEN page_id % 5 <> 0 THEN '"' || md5(html) || '"' END AS t,
   CASE WHEN page_id % 11 <> 0 THEN 'day ' || (page_id % 1000) END AS d, coalesce(strlen(html), 0) AS n FROM c),
j AS (SELECT x.page_id, x.k, 2 * x.page_id + 5 AS ts, f.page_id AS fid, f.n AS fn, f.t AS ft, f.d AS fd,
   CASE WHEN x.t IS NULL THEN NULL WHEN x.page_id % 7 = 0 THEN '"other"' ELSE x.t END AS xt,
   CASE WHEN x.page_id % 7 = 0 THEN 'day -1' ELSE x.d END AS xd
   FROM b x LEFT JOIN b f ON f.k = x.k AND 2 * f.page_id < 2 * x.page_id + 5
   QUALIFY row_number() OVER (PARTITION BY x.page_id ORDER BY f.page_id DESC NULLS LAST) = 1),
v AS (SELECT *, CASE WHEN fid IS NULL THEN 'orphan' WHEN xt IS NOT NULL AND ft IS NOT NULL THEN CASE WHEN xt = ft THEN 'etag' ELSE 'mismatch' END
   WHEN xd IS NOT NULL AND fd IS NOT NULL THEN CASE WHEN xd = fd THEN 'last_modified' ELSE 'mismatch' END ELSE 'unchecked' END AS verdict FROM j)
SELECT page_id, k AS url_key, ts, CASE WHEN verdict IN ('etag', 'last_modified') THEN fid END AS full_page_id,
   CASE WHEN verdict IN ('etag', 'last_modified') THEN 2 * fid END AS full_ts, verdict,
   CASE WHEN verdict IN ('etag', 'last_modified') THEN 'cache-control=max-age=60;content-length=' || fn || ';content-type=text/html;date=' || ts || ';expires=' || (ts + 60) END AS headers FROM v
"""
