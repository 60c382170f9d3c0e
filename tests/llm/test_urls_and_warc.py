import sys
from html.parser import HTMLParser
from pathlib import Path
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from lexiloom.llm import op1_warc, op2_url_filters

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import both, connect  # noqa: E402

from .helpers import components  # noqa: E402

SF = "/root/testdata/sf0.01"
RECORD = "rid long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, k string, full string"


def test_op1_equals_sql(spark):
    got, want = both(spark, connect(SF), SF, op1_warc.op1_warc_revisits, op1_warc.OP1_SQL)
    assert got == want and got


def test_op1_cases(spark):
    h = {"Content-Type": "text/html"}
    rows = [
        (1, "http://a.org/x", 10, 200, '"t"', "d1", h, "", ""), (2, "https://www.a.org/x/", 20, 304, 'W/"t"', None, None, "", ""),
        (3, "http://a.org/x", 10, 304, '"t"', None, h, "", ""), (4, "http://a.org/x", 30, 304, '"u"', "d1", h, "", ""),
        (5, "http://a.org/x", 30, 304, None, "d1", h, "", ""), (6, "http://a.org/x", 30, 304, None, None, h, "", ""),
        (7, None, 30, 304, '"t"', None, h, "", ""), (8, "http://a.org/x", None, 304, '"t"', None, h, "", ""),
        (9, "http://b.org/", 5, 200, None, None, None, None, None), (2, "https://www.a.org/x/", 20, 304, 'W/"t"', None, None, "", ""),
    ]
    out = op1_warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()
    said = sorted((r["rid"], r["verdict"], r["full_rid"]) for r in out)
    want = [(2, "etag", 1), (2, "etag", 1), (3, "orphan", None), (4, "mismatch", None), (5, "last_modified", 1), (6, "unchecked", None), (7, "orphan", None), (8, "orphan", None)]
    assert said == sorted(want, key=lambda r: (r[0], r[1]))
    assert op1_warc.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def _rule(host, path):
    best = None
    for verdict, h, p in op2_url_filters.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
    path = rest[end:]
    cut = min([i for i in map(path.find, "?#") if i >= 0] or [len(path)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:cut]


class _Links(HTMLParser):
    """Targets of a page's first canonical link and first meta refresh."""

    def __init__(self, html):
        super().__init__()
        self.found = {}
        self.feed(html or "")

    def handle_starttag(self, tag, attrs):
        d = dict(attrs)
        if tag == "link" and "canonical" in (d.get("rel") or "").lower() and d.get("href"):
            self.found.setdefault("link", d["href"])
        if tag == "meta" and (d.get("http-equiv") or "").lower() == "refresh" and "url=" in (d.get("content") or ""):
            self.found.setdefault("refresh", d["content"].split("url=", 1)[1].strip())


def _canonical(url):
    u = url.split("#")[0]
    rest = u.split("://", 1)[-1]
    at = min([i for i in map(rest.find, "/?") if i >= 0] or [len(rest)])
    host, (path, _, query) = rest[:at].lower().removeprefix("www."), rest[at:].partition("?")
    host = host.removesuffix(":80").removesuffix(":443")
    query = "&".join(q for q in query.split("&") if q and not q.startswith(("utm_", "fbclid=", "gclid=")))
    return "//" + host + path.rstrip("/") + ("?" + query if query else "")


def _edges(rows):
    out = set()
    for r in rows:
        if r["url"] is not None:
            out.add((r["url"], _canonical(r["url"])))
            for t in _Links(r["html"]).found.values():
                to = urldefrag(urljoin(r["url"], t)).url
                if "://" in to and to != r["url"]:
                    out |= {(r["url"], to), (to, _canonical(to))}
    return list(out)


def test_op2_targets_are_resolved(spark):
    bases = ["http://a.org/x/y?q", "https://a.org", "http://a.org/x/y/"]
    targets = ["/es/1", "//b.net/es/", "z", "./z", "../z", "../../../z", "?p=1", "/a/./b/../c", "..", "http://c.net/fr/#top", "a?u=http://d.org/", "/e?a=1&b=2#f", "."]
    rows = [(b, t) for b in bases for t in targets if (b, t) != ("https://a.org", "?p=1")]
    got = spark.createDataFrame(rows, "b string, t string").select("b", "t", op2_url_filters.resolved(F.col("t"), F.col("b")).alias("to")).collect()
    assert [(r["b"], r["t"], r["to"]) for r in got] == [(b, t, urldefrag(urljoin(b, t)).url) for b, t in rows]
    none = [("http://a.org/", x) for x in (None, "", "#top", "mailto:x@y.z", "data:text/html,x")] + [("no scheme", "/x"), (None, "/x")]
    got = spark.createDataFrame(none, "b string, t string").select(op2_url_filters.resolved(F.col("t"), F.col("b")).alias("to")).collect()
    assert all(r["to"] is None for r in got)


def test_op2_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    extra = spark.createDataFrame(
        [(9001, None, "<p>"), (9002, "no scheme", None), (9003, "HTTP://WWW.EXAMPLE.com/en/x?y#z", ""), (9004, "http://x.net/es/1", ""), (9005, "http://q.org/", '<link rel="canonical" href="http://x.net/es/1">'),
         (9006, "http://r.org/a", '<meta http-equiv=refresh content="0; url=http://q.org/">'), (9007, "http://s.com/es/", '<link rel=canonical href=http://t.org/>'), (9008, "http://t.org/", '<link rel=canonical href=http://x.net/es/2>'),
         (9009, "http://x.net/es/2", ""), (9004, "http://x.net/es/1", ""), (9010, "http://y.net/plain", "<link rel='canonical' href='/es/3'>"), (9011, "http://z.org/k", '<link href="//y.net/fr/4" rel="canonical">'),
         (None, "http://y.net/deep/er", '<meta content="3; url=../es/3?a&amp;b" http-equiv="refresh">'), (9013, "http://v.org/" + "p/" * 40000, ""), (9014, "http://v.org/", "<link rel=canonical href=mailto:me@v.org>")], "page_id long, url string, html string",
    )
    all_pages = pages.select("page_id", "url", "html").unionByName(extra)
    edges = _edges(all_pages.collect())
    comp = components({x for e in edges for x in e}, edges)
    votes: dict = {}
    for node, c in comp.items():
        if "://" in node and (r := _rule(*_parts(node))):
            votes.setdefault(c, set()).add(r[1])
    rows = all_pages.collect()
    want = []
    for r in rows:
        host, path = _parts(r["url"])
        rule = _rule(host, path)
        spread = votes.get(comp.get(r["url"]), set()) == {"block"}
        want.append((r["page_id"], host, path, rule and rule[0], rule[1] if rule else ("block" if spread else "allow")))
    got = [tuple(r)[:5] for r in op2_url_filters.judge_urls(all_pages.withColumn("component", all_pages.url)).collect()]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)
    by_id = {r[0]: r for r in got}
    assert by_id[9005][4] == by_id[9006][4] == "block" and by_id[9008][4] == "allow"
    assert by_id[9010][4] == by_id[9011][4] == by_id[None][4] == "block"
    assert op2_url_filters.judge_urls(all_pages.limit(0)).count() == 0
