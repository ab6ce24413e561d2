"""Resolution of not-modified revisit records of web archives, in DataFrame functions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Query parameters that only track the visitor.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref|sessionid)(=|$)"
#: Stored headers that a not-modified answer must not replace.
KEPT_HEADERS = ("content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "transfer-encoding", "trailer")
URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Records are ordered within slices of so much time; only one row per slice crosses the slices.
SLICE = 3_600


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path without closing slashes, query without tracking parameters and sorted; no scheme, no fragment.

    What has no host is taken as it stands.
    """
    part = lambda k: F.regexp_extract(url, URL, k)
    host = F.regexp_replace(F.lower(part(1)), r":(80|443)?$", "")
    path = F.regexp_replace(part(2), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(part(3), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host == "", url).otherwise(F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def header_map(block: Column) -> Column:
    """Headers of an HTTP header block by lower-case name; of repeated ones the last counts, lines without a colon do not."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, "^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, replaced or joined by the permitted ones of the not-modified answer."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def _tag(headers: Column) -> Column:
    """Entity tag for weak comparison."""
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "")


def validated(stored: Column, fresh: Column) -> Column:
    """'match', 'mismatch' or 'none': entity tags decide if both answers have one, else dates of last modification."""
    tags = _tag(stored), _tag(fresh)
    dates = tuple(F.try_element_at(h, F.lit("last-modified")) for h in (stored, fresh))
    verdict = lambda a, b: F.when(a == b, "match").otherwise("mismatch")
    return (F.when(tags[0].isNotNull() & tags[1].isNotNull(), verdict(*tags))
            .when(dates[0].isNotNull() & dates[1].isNotNull(), verdict(*dates)).otherwise("none"))


def resolve_revisits(records: DataFrame, span: int = SLICE) -> DataFrame:
    """Each revisit record with the response it stands for.

    `records` has record_id, kind ('response' or 'revisit'), url, at (seconds, long), status (of HTTP), headers (a block of text). A full response is a
    response of status 200. A revisit is joined as of its time to the latest earlier full response of the same canonical URL (of equal times the one with the
    greatest record_id), which then must pass the validators; an older one is never taken in its place.

    Rows are ordered within (URL, slice of `span` seconds); the last response of each slice crosses the slices, so one URL with a third of all
    records is spread over its slices. Payloads stay behind: join them by `response_id`. Records with a null URL, time or kind resolve to nothing. Repeated
    records give repeated rows. An empty table gives none. Other columns are ignored.
    Returns record_id, canonical, response_id, outcome ('resolved', 'mismatch', 'no validator', 'no response') and headers (the merged map if resolved).
    """
    r = records.select("record_id", "kind", F.col("at").cast("long").alias("at"), canonical_url(F.col("url")).alias("canonical"),
                       header_map(F.col("headers")).alias("h"), ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"))
    r = r.where((F.col("kind") == "revisit") | F.col("full")).withColumn("_slice", F.floor(F.col("at") / span))
    full = F.when(F.col("full") & F.col("at").isNotNull() & F.col("canonical").isNotNull(),
                  F.struct("at", F.col("record_id").alias("response_id"), F.col("h").alias("stored")))
    key = F.struct("at", "record_id")
    last = F.max_by(full, F.when(F.col("full"), key))
    earlier = W.partitionBy("canonical").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    ends = (r.where("full AND at IS NOT NULL AND canonical IS NOT NULL").groupBy("canonical", "_slice").agg(last.alias("_last")))
    slices = r.select("canonical", "_slice").distinct().join(ends, ["canonical", "_slice"], "left")
    carried = slices.select("canonical", "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    within = W.partitionBy("canonical", "_slice").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    seen = r.withColumn("_own", F.max_by(full, F.when(F.col("full"), key)).over(within)).where("kind = 'revisit'")
    found = seen.join(carried, ["canonical", "_slice"], "left").withColumn("_hit", F.coalesce("_own", "_before"))
    verdict = validated(F.col("_hit.stored"), F.col("h"))
    outcome = (F.when(F.col("_hit").isNull(), "no response").when(verdict == "match", "resolved")
               .when(verdict == "mismatch", "mismatch").otherwise("no validator"))
    return found.select("record_id", "canonical", F.col("_hit.response_id").alias("response_id"), outcome.alias("outcome"),
                        F.when(outcome == "resolved", merge_headers(F.col("_hit.stored"), F.col("h"))).alias("headers"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """Records of a crawl made from `pages`: a full response for each page at the second of its id, a revisit at the same second and one up to 5,000
    seconds later, each with the validators of the page; of every seventh length the later one comes with another date."""
    html = F.coalesce("html", F.lit(""))
    size = F.char_length(html)
    day = lambda later: F.concat(F.lit("\r\nLast-Modified: day "), (size + later) % 28 + 1)
    tag = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("\r\nETag: \""), F.md5(F.coalesce("url", F.lit(""))), F.lit("\""))).otherwise("")
    response = F.concat(F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(html), day(F.lit(0)), tag, F.lit("\r\nCache-Control: max-age=60"))
    revisit = lambda at, later: F.concat(F.lit("Date: second "), at, F.lit("\r\nContent-Length: 0"), day(later), tag, F.lit("\r\ncache-control: no-cache"))
    record = lambda k, kind, status, at, headers: F.struct((3 * F.col("page_id") + k).alias("record_id"), F.lit(kind).alias("kind"), F.lit(status).alias("status"),
                                                           at.alias("at"), headers.alias("headers"))
    now, later = F.col("page_id"), F.col("page_id") + 1 + size % 5_000
    rows = F.array(record(0, "response", 200, now, response), record(1, "revisit", 304, now, revisit(now, F.lit(0))),
                   record(2, "revisit", 304, later, revisit(later, F.when(size % 7 == 0, 1).otherwise(0))))
    return pages.select("url", F.explode(rows).alias("_r")).select("url", "_r.*")


def revisit_table(pages: DataFrame) -> DataFrame:
    """`resolve_revisits` over the crawl of `pages`, its headers as sorted lines; no response is -1."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolve_revisits(crawl_of(pages)).withColumns({"headers": lines, "response_id": F.coalesce("response_id", F.lit(-1))})


REVISIT_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1) AS h,
                  regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2) AS pa,
                  regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3) AS q FROM pages),
     c AS (SELECT page_id, html, 'day ' || (length(html) % 28 + 1) AS day, CASE WHEN page_id % 3 <> 0 THEN '"' || md5(coalesce(url, '')) || '"' END AS tag,
                  regexp_replace(lower(h), ':(80|443)?$', '') AS host, regexp_replace(pa, '/+$', '') AS path, url,
                  array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x,
                      '^(utm_[^=]*|gclid|fbclid|ref|sessionid)(=|$)'))), '&') AS query FROM p),
     k AS (SELECT *, CASE WHEN host = '' THEN url ELSE host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical FROM c),
     v AS (SELECT *, unnest([1, 2]) AS n FROM k),
     w AS (SELECT 3 * page_id + n AS record_id, canonical, tag, CASE WHEN n = 1 THEN page_id ELSE page_id + 1 + length(html) % 5000 END AS sec,
                  CASE WHEN n = 2 AND length(html) % 7 = 0 THEN 'day ' || ((length(html) + 1) % 28 + 1) ELSE day END AS day FROM v),
     j AS (SELECT a.record_id, a.sec, a.canonical, b.page_id AS hit, a.tag, a.day, b.tag AS old_tag, b.day AS old_day, strlen(b.html) AS size
           FROM w a ASOF LEFT JOIN k b ON a.canonical = b.canonical AND a.sec > b.page_id),
     o AS (SELECT *, CASE WHEN hit IS NULL THEN 'no response' WHEN CASE WHEN tag IS NOT NULL AND old_tag IS NOT NULL THEN tag = old_tag ELSE day = old_day END
                          THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
SELECT record_id, canonical, coalesce(3 * hit, -1) AS response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: no-cache' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) ||
            'date: second ' || sec || coalesce(chr(10) || 'etag: ' || old_tag, '') || chr(10) || 'last-modified: ' || day END AS headers
FROM o
"""
