"""Redirect equivalence: block decisions reach a URL's aliases through connected components over redirect
and canonical-link edges; an explicit allow goes before any block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components
from .op1_warc import canonical_url

#: (verdict, host, path), as in the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule (host and path together) that fits, else null. Rules are a
    short list fixed by the caller, so they are folded into one expression; no join is needed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _without_dots(path: Column) -> Column:
    """An absolute path without its . and .. segments; .. at the root goes nowhere."""
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.contains("/."), F.array_join(F.concat(kept, end), "/")).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """The absolute URL, without fragment, that a page at `base` means by `target` (RFC 3986, 5.2). Null for null, empty
    and fragment-only targets, those of schemes without :// (mailto: and the like), and relative ones where
    base itself isn't absolute."""
    t = F.regexp_replace(F.regexp_replace(target, r"&amp;", "&"), r"(?s)#.*$", "")
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path, query = F.regexp_extract(t, r"^[^?]*", 0), F.regexp_extract(t, r"(?s)\?.*$", 0)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"(?s)^/(.*/)?[^/]*$", 1))
    relative = (
        F.when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(root, _without_dots(path), query))
        .when(t.startswith("?"), F.concat(root, path_of(base), t))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), query))
    )
    absolute = t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    return F.when(absolute, t).when((t != "") & (root != "") & ~t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), relative)


def alias_edges(pages: DataFrame) -> DataFrame:
    """Distinct (a, b) URL strings: each url and its canonical form (as // and that form), and the targets of canonical
    links and meta refreshes in its html, resolved against the url. Null urls, and targets that resolve to none, give no edge."""
    u, node = F.col("url"), lambda c: F.concat(F.lit("//"), canonical_url(c))
    ends = F.array(node(u), *[resolved(F.regexp_extract("html", p, 1), u) for p in (_LINK, _REFRESH)])
    e = pages.where(u.isNotNull()).select(u.alias("a"), F.explode(F.array_distinct(ends)).alias("b")).where("b is not null")
    declared = e.where(~F.col("b").startswith("//")).select(F.col("b").alias("a"), node(F.col("b")).alias("b"))
    return e.unionByName(declared).distinct()


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, component_blocked for each row of pages (page_id, url, html).

    A url's own rule decides. A url without a rule takes its aliases' decision: allow if any alias is
    allowed by a rule, else block if any is blocked by one, else allow. Null urls and urls without :// have
    empty host and path and are allowed. Null html gives no links; urls and html of any length are read whole; of
    several canonical links or refreshes on a page the first counts. Of rules that fit, the longest decides, of two
    equally long ones the later of `rules`. Repeated rows each get a row, as do rows with a null page_id; other columns, whatever
    their names, are not read; empty tables give none.
    """
    url = F.col("url")
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    cc = cut(components(alias_edges(pages)), "url-components")
    said = rule_for(host_of(F.col("id")), path_of(F.col("id")), rules)
    votes = cc.where(F.col("id").contains("://")).select("component", said["verdict"].alias("v"))
    votes = votes.where("v is not null").groupBy("component").agg((F.min("v") == "block").alias("only_block"))
    spread = cut(cc.join(cut(votes, "url-votes"), "component").where("only_block").select(F.col("id").alias("url"), F.lit(True).alias("hit")), "url-spread")
    out = judged.join(spread, "url", "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("hit"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("hit", F.lit(False)).alias("component_blocked"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
