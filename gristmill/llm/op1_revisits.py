"""WARC: Not-modified revisits resolved by an as-of join on the canonical URL to the latest earlier full response,
whose validators are checked and whose headers are merged with those that a revisit may change.

Scale: bodies and headers stay out of the as-of join, which knows (url, instant, record) only. Captures of one URL at
one instant are one row of it, URLs are cut by day, and what earlier days carry over is a prefix over one row for each
URL and day: a URL with a third of all captures costs no task more than the instants of one day. Results are joined
back by (url, instant) and by record, joins that Spark splits where they are skewed.

Defined results: a full response is a `response` record with status 200; "earlier" is strict; of responses at one
instant the largest record_id counts. A revisit without an earlier response is `unmatched`; with a null url or ts as
well. Validators: equal entity tags (weak comparison) or, if one side has none, equal Last-Modified dates resolve it;
unequal ones give `changed`, no common one `unverified`; only `resolved` rows have merged headers. Header names are
compared in lower case, the first of several counts. Repeated records give repeated rows; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm._common import materialize

#: What a 304 may update in a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def canonical_url(url: Column) -> Column:
    """Scheme, user, default port, fragment, tracking parameters and final slashes go; the host is lower-cased, parameters are sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_extract(u, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"^.*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(TRACKING)))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    names = F.array_distinct(F.transform(F.map_keys(headers), F.lower))
    first = lambda k: F.element_at(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == k), 1)["value"]
    return F.coalesce(F.map_from_arrays(names, F.transform(names, first)), F.expr("cast(map() as map<string,string>)"))


def as_of(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """(url, ts) and (url, ts, id): for each distinct query the id of the latest answer strictly before it."""
    q = queries.select("url", "ts").where("url is not null and ts is not null").distinct().select("url", "ts", F.lit(0).alias("role"), F.lit(None).cast("string").alias("id"))
    a = answers.where("url is not null and ts is not null").groupBy("url", "ts").agg(F.max("id").alias("id")).select("url", "ts", F.lit(1).alias("role"), "id")
    day = F.date_trunc("day", "ts").alias("day")
    days = q.select("url", day, "ts", "id").union(a.select("url", day, "ts", "id")).groupBy("url", "day").agg(F.max_by("id", F.when(F.col("id").isNotNull(), F.col("ts"))).alias("last"))
    before = Window.partitionBy("url").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("url", "day", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("url", "day").orderBy("ts", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = q.union(a).withColumn("day", F.date_trunc("day", "ts")).withColumn("own", F.last("id", ignorenulls=True).over(within)).where("role = 0")
    return both.join(carried, ["url", "day"], "left").select("url", "ts", F.coalesce("own", "carried").alias("found"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, url (canonical), ts, refers_to, verdict, headers (merged).

    records: record_id string, url string, ts timestamp, kind string, status int, headers map<string,string>.
    """
    slim = records.select("record_id", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("timestamp_ntz").alias("ts"), "kind", "status", lower_names(F.col("headers")).alias("h"))
    slim = materialize(slim, "captures")
    full = slim.where("kind = 'response' and status = 200")
    revisits = slim.where("kind = 'revisit'").select("record_id", "url", "ts", F.col("h").alias("own"))
    found = as_of(revisits, full.select("url", "ts", F.col("record_id").alias("id")))
    rows = revisits.join(found, ["url", "ts"], "left")
    first = full.where("record_id is not null").groupBy(F.col("record_id").alias("found")).agg(F.max_by("h", F.struct("ts", "url")).alias("stored"))
    first = materialize(first, "responses")  # a join of two plain scans, which Spark splits where one response has many revisits
    rows = rows.join(first, "found", "left")
    tag = lambda h: F.regexp_replace(h["etag"], r"^W/", "")
    own, stored = F.col("own"), F.col("stored")
    verdict = (
        F.when(F.col("found").isNull(), "unmatched")
        .when(tag(own).isNotNull() & tag(stored).isNotNull(), F.when(tag(own) == tag(stored), "resolved").otherwise("changed"))
        .when(own["last-modified"].isNotNull() & stored["last-modified"].isNotNull(), F.when(own["last-modified"] == stored["last-modified"], "resolved").otherwise("changed"))
        .otherwise("unverified")
    )
    new = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    rows = rows.withColumn("verdict", verdict)
    return rows.select("record_id", "url", "ts", F.col("found").alias("refers_to"), "verdict", F.when(F.col("verdict") == "resolved", merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of the table of pages, which has none: a response for each page and a revisit of its URL.

    Captures are a minute apart in page order, a revisit 90 minutes after its response and for every seventh page 90
    before. Of five revisits one has a weak tag, one only a date, one another tag.
    """
    at = lambda minutes: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, {minutes}, 0)")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    modified = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    k = F.col("page_id") % 5
    response = F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"))
    revisit = F.create_map(F.lit("Last-Modified"), modified, F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.col("page_id").cast("string")), F.lit("Content-Length"), F.lit("0"))
    revisit = F.when(k == 3, revisit).otherwise(F.map_concat(revisit, F.create_map(F.lit("etag"), F.when(k == 2, F.concat(F.lit("W/"), tag)).when(k == 4, F.lit('"other"')).otherwise(tag))))
    a = pages.select(F.concat(F.lit("r"), "page_id").alias("record_id"), "url", at("page_id").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), response.alias("headers"))
    b = pages.select(F.concat(F.lit("v"), "page_id").alias("record_id"), "url", at("page_id + if(page_id % 7 = 6, -90, 90)").alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), revisit.alias("headers"))
    return a.unionByName(b)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return rows.select("record_id", F.col("url").alias("canonical_url"), "refers_to", "verdict", F.array_join(lines, "\n").alias("merged_headers"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, html, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS x FROM pages),
c AS (
  SELECT page_id, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (page_id % 28) AS modified, length(html) AS n,
    regexp_replace(regexp_replace(lower(regexp_extract(x, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(x, '^[^/?]*([^?]*)', 1), '/+$', '') AS head,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(x, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)='))), '&') AS q
  FROM u),
k AS (SELECT *, head || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS curl FROM c),
r AS (SELECT 'r' || page_id AS id, curl, page_id AS at, tag, modified, n FROM k),
v AS (SELECT 'v' || page_id AS record_id, page_id, curl, page_id + CASE WHEN page_id % 7 = 6 THEN -90 ELSE 90 END AS at, modified,
        CASE page_id % 5 WHEN 3 THEN NULL WHEN 2 THEN 'W/' || tag WHEN 4 THEN '"other"' ELSE tag END AS tag FROM k),
j AS (SELECT v.*, r.id, r.tag AS rtag, r.modified AS rmod, r.n,
        row_number() OVER (PARTITION BY v.record_id ORDER BY r.at DESC NULLS LAST, r.id DESC) AS place
      FROM v LEFT JOIN r ON r.curl = v.curl AND r.at < v.at),
w AS (SELECT *, CASE WHEN id IS NULL THEN 'unmatched'
        WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = rtag THEN 'resolved' ELSE 'changed' END
        WHEN modified = rmod THEN 'resolved' ELSE 'changed' END AS verdict FROM j WHERE place = 1)
SELECT record_id, curl AS canonical_url, id AS refers_to, verdict,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=' || page_id || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: ' || coalesce(tag, rtag) || chr(10) || 'last-modified: ' || modified END AS merged_headers
FROM w
"""
