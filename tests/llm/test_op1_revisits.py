"""As-of resolution of revisits against a loop over all earlier responses, and edge rows."""

import datetime

from compare import assert_same, connect
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.llm import op1_revisits as op

SCHEMA = "record_id string, url string, ts timestamp_ntz, kind string, status int, headers map<string,string>"
T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + datetime.timedelta(minutes=minutes)


def resolve(spark, rows):
    df = spark.createDataFrame([(i, u, at(m), k, s, h) for i, u, m, k, s, h in rows], SCHEMA)
    return sorted(op.resolve_revisits(df).collect(), key=lambda r: (r.record_id is not None, r.record_id or ""))


def test_query_equals_sql(spark, sf_dir):
    assert_same(op.query(spark, sf_dir), connect(sf_dir), op.ORACLE)


def test_canonical_url(spark):
    cases = {
        "HTTP://User@Example.com:80/a/b/?b=2&utm_source=x&a=1#top": "example.com/a/b?a=1&b=2", "https://example.com": "example.com", "https://example.com/": "example.com",
        "example.com:8080/x": "example.com:8080/x", "": "", "https://e.com/?ref=1": "e.com",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in df.select("u", op.canonical_url(F.col("u")).alias("c")).collect()} == cases


def test_verdicts_and_headers(spark):
    full = {"ETag": '"1"', "Last-Modified": "monday", "Content-Type": "text/html", "CACHE-CONTROL": "old"}
    rows = [
        ("r1", "http://e.com/a", 10, "response", 200, full),
        ("r2", "http://e.com/a", 20, "response", 404, {"ETag": '"9"'}),
        ("v0", "http://e.com/a", 10, "revisit", 304, {"ETag": '"1"'}),  # not earlier: strict
        ("v1", "https://E.com/a/", 30, "revisit", 304, {"etag": 'W/"1"', "Cache-Control": "new", "Content-Length": "0"}),
        ("v2", "http://e.com/a", 31, "revisit", 304, {"ETag": '"2"', "Last-Modified": "monday"}),
        ("v3", "http://e.com/a", 32, "revisit", 304, {"last-modified": "monday"}),
        ("v4", "http://e.com/a", 33, "revisit", 304, {"Last-Modified": "friday"}),
        ("v5", "http://e.com/a", 34, "revisit", 304, {}),
        ("v6", "http://e.com/a", 35, "revisit", 304, None),
        ("v7", None, 36, "revisit", 304, {"ETag": '"1"'}),
        ("v8", "http://e.com/a", None, "revisit", 304, {"ETag": '"1"'}),
        ("v9", "http://e.com/other", 40, "revisit", 304, {"ETag": '"1"'}),
    ]
    got = {r.record_id: r for r in resolve(spark, rows)}
    want = {"v0": "unmatched", "v1": "resolved", "v2": "changed", "v3": "resolved", "v4": "changed", "v5": "unverified", "v6": "unverified", "v7": "unmatched", "v8": "unmatched", "v9": "unmatched"}
    assert {k: r.verdict for k, r in got.items()} == want
    assert got["v1"].headers == {"etag": 'W/"1"', "last-modified": "monday", "content-type": "text/html", "cache-control": "new"}
    assert got["v1"].refers_to == "r1" and got["v2"].headers is None


def test_ties_repeats_and_empty(spark):
    rows = [("r1", "e.com/a", 1, "response", 200, {"ETag": "x"}), ("r2", "e.com/a", 1, "response", 200, {"ETag": "y"}), ("r2", "e.com/a", 1, "response", 200, {"ETag": "y"}), ("v", "e.com/a", 2, "revisit", 304, {"ETag": "y"}), ("v", "e.com/a", 2, "revisit", 304, {"ETag": "y"})]
    got = resolve(spark, rows)
    assert [(r.record_id, r.refers_to, r.verdict) for r in got] == [("v", "r2", "resolved")] * 2
    assert resolve(spark, []) == []


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 5000), st.booleans()), max_size=40))
def test_as_of_equals_loop(spark, events):
    rows = [(f"{'v' if v else 'r'}{i:03d}", f"e.com/{u}", m, "revisit" if v else "response", 304 if v else 200, {"ETag": u}) for i, (u, m, v) in enumerate(events)]
    want = {}
    for i, u, m, k, _, _ in rows:
        if k == "revisit":
            earlier = [(m2, i2) for i2, u2, m2, k2, _, _ in rows if k2 == "response" and u2 == u and m2 < m]
            want[i] = max(earlier)[1] if earlier else None
    assert {r.record_id: r.refers_to for r in resolve(spark, rows)} == want


def test_extra_columns(spark):
    df = spark.createDataFrame([("v", "e.com", at(1), "revisit", 304, {"a": "b"}, 1, "x")], SCHEMA + ", found int, day string")
    assert [r.verdict for r in op.resolve_revisits(df).collect()] == ["unmatched"]
