"""WARC round trips and the URL filter."""

from __future__ import annotations

import gzip
import hashlib
import re

from pyspark.sql import functions as F

from assayer.llm import queries, url_filter, warc
from assayer.session import new_table_path

PAGES = "page_id long, url string, html string, key long, record_type string"


def pages_dir(spark, rows):
    path = new_table_path(spark, "pages-dir")
    spark.createDataFrame([(*r, 0, "x") for r in rows], PAGES).write.parquet(f"{path}/pages.parquet")
    return path


BIG = "<p>ä</p>" * 150
TRICKY = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 20 + "WARC/1."
ROWS = [
    (1, "http://a/", BIG), (2, "http://b/", BIG), (3, None, BIG), (3, "http://c/", BIG), (4, "http://d/", "small"),
    (5, "http://e/", "small"), (6, "http://f\r\nWARC-Type: x/", None), (7, "", ""), (8, "http://g/", TRICKY),
    (9, "http://g/", TRICKY), (10, "http://h/", "\r\n\r\n"), (11, "http://i/", "x" * 2_000_000), (12, "u", "y" * 999),
    (13, "u", "y" * 999), (14, "u", "z" * 1000), (15, "u", "z" * 1000), (None, "n", "z" * 1000), (None, "n", "only here" * 200),
]


def test_query_against_brute_force(spark):
    got = queries.op1_warc_transactions(spark, pages_dir(spark, ROWS)).collect()
    expected = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "").encode() == body and p is not None]
        revisit = len(body) >= 1000 and same and page != max(same)
        expected.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(expected, key=key)
    assert queries.op1_warc_transactions(spark, pages_dir(spark, [])).count() == 0


def test_urls_that_hold_the_mark(spark):
    urls = ["http://a/WARC/1.1", "WARC/1.", "http://b/WARC/1.0/WARC/1.WARC/1.1?x", "http://c/WARC/1.0", "x WARC/1.0 y", "http://d/"]
    rows = [(i, url, "t" * 1200 if i < 3 else TRICKY + str(i)) for i, url in enumerate(urls)]
    got = queries.op1_warc_transactions(spark, pages_dir(spark, rows)).collect()
    sha = lambda i: hashlib.sha1(rows[i][2].encode()).hexdigest()
    expected = [(i, len(h), sha(i), "revisit" if i < 2 else "response", 2 if i < 2 else None) for i, _, h in rows]
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == expected


def test_headers_cut_off_do_not_swallow_the_next():
    whole = b"0\r\nWARC-Type: response\r\nWARC-Record-ID: <%s>\r\nWARC-Target-URI: http://x/\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"
    cut_at_line, cut_inside = whole[: whole.index(b"WARC-Target")] % b"a", whole[: whole.index(b"/\r\nContent")] % b"b"
    pieces = [b"", cut_at_line, whole % b"c", cut_inside, whole % b"d", b"0\r\nno length\r\n\r\n", whole % b"e"]
    assert [r[0] for r in warc._records(iter(pieces), True)] == ["<c>", "<d>", "<e>"]


def test_payloads_and_records_come_back(spark):
    rows = [(1, "http://a/", TRICKY.encode()), (2, "http://b/", b"\xff\xfe\x00\r\n\r\nWARC/1.0\r\n"), (3, "http://c/", b"")]
    captures = spark.createDataFrame(rows, "key long, target_uri string, payload binary")
    path = new_table_path(spark, "warc-test")
    warc.write_warc(warc.plan_revisits(captures), path)
    whole = warc.assemble(warc.read_warc(spark, path)).collect()
    assert {(r.response.target_uri, bytes(r.response.payload)) for r in whole} == {(u, p) for _, u, p in rows}
    assert all(r.response.digest_ok and len(r.requests) == len(r.metadata) == 1 for r in whole)
    assert {r.metadata[0].fields.strip() for r in whole} == {"captureKey: 1", "captureKey: 2", "captureKey: 3"}


def test_foreign_archive(spark):
    """Members compressed one by one, a response that names its request, one without any, a cut-off end."""
    def record(kind, name, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", *more, f"Content-Length: {len(block)}"]
        return gzip.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n")

    http = "Content-Type: application/http"
    data = record("warcinfo", "i", b"software: x\r\n") + record("request", "q", b"GET /\r\n\r\n", http)
    data += record("response", "r", b"HTTP/1.1 200 OK\r\n\r\nbody", http, "WARC-Concurrent-To: <urn:q>")
    data += record("metadata", "m", b"a: 1\r\n", "WARC-Concurrent-To: <urn:r>", "Content-Type: application/warc-fields")
    data += record("response", "s", b"HTTP/1.1 404 No\r\n\r\n", http)
    data += gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:t>\r\nContent-Length: 99\r\n\r\ncut")
    path = new_table_path(spark, "foreign")
    # Spark writes the file, as any archive would lie in the store
    spark.createDataFrame([("x",)], "value string").coalesce(1).write.text(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/a.warc.gz")
    out = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(folder)
    out.write(bytearray(data))
    out.close()
    got = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, f"{path}/a.warc.gz")).collect()}
    assert set(got) == {"<urn:r>", "<urn:s>"}
    assert bytes(got["<urn:r>"].response.payload) == b"body" and got["<urn:r>"].requests[0].record_id == "<urn:q>"
    assert got["<urn:r>"].metadata[0].fields == "a: 1\r\n" and got["<urn:s>"].requests is None


URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://A.EXAMPLE.org/es/x?q=1"), (5, "https://example.org/en/12"),
    (6, "x://example.org/en/2"), (7, "http://org/"), (8, "http://notorg/a"), (9, "http://a.com/fr/"), (10, "http://com/de/z#f"),
    (11, "http://b.net/p?utm_source=x&b=2&a=1"), (12, "http://www.b.net:80/p/?a=1&b=2"), (13, "http://b.net/p?a=1"),
    (14, "http://É.net?x/y://z"), (15, "://h/p"), (16, "http://c.net/?ref=1"), (17, "http://c.net"), (17, "http://c.net"),
    (None, "http://c.net/#top"), (18, "http://org?x"), (19, "http://example.org.evil.net/es/"),
]


def test_url_filter(spark):
    frame = spark.createDataFrame([(i, u, "h", "v") for i, u in URLS], "page_id long, url string, host string, verdict string")
    listed = frame.filter(url_filter.has_tracking(F.col("url"))).select(url_filter.canonical_url(F.col("url")).alias("canonical"))
    got = url_filter.judge(frame, listed, queries.URL_RULES).collect()
    found = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(URLS)
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    blocked = {11, 12, 16, 17, None}
    for i, url in URLS:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = []
        for rule in rules:
            own, _, start = rule.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
                fits.append(rule)
        rule = max(fits, key=len, default=None)
        verdict = rules[rule] if rule else "block" if i in blocked else "allow"
        assert found[i, url] == (host, path, rule, verdict), url
    assert url_filter.judge(frame.limit(0), listed, []).count() == 0
    assert url_filter.judge(frame, listed.limit(0), []).filter("verdict = 'block'").count() == 0


def test_page_columns_of_any_name_stay(spark):
    frame = spark.createDataFrame([(1, "http://b.net/p", "own", 5, "x")], "page_id long, url string, __block string, __w0 int, Host string")
    listed = spark.createDataFrame([("b.net/p",)], "canonical string")
    got = url_filter.judge(frame, listed, []).collect()[0].asDict()
    assert got == {"page_id": 1, "url": "http://b.net/p", "__block": "own", "__w0": 5, "host": "b.net", "path": "/p", "canonical": "b.net/p", "rule": None, "verdict": "block"}


def test_filter_never_misses_and_a_full_one_stays_exact(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h.net/"), "id").alias("canonical"))
    asked = spark.range(1000, 4000).select(F.concat(F.lit("http://h.net/"), "id").alias("url"), "id")
    for blocks in (1, 1 << 17):
        bloom = url_filter.build_filter(listed, "canonical", max_blocks=blocks)
        assert bloom.table.count() <= bloom.blocks <= blocks
        flagged = url_filter.may_be_listed(listed, "canonical", bloom, "hit")
        assert flagged.filter("not hit").count() == 0
        judged = url_filter.judge(asked, listed, [], max_blocks=blocks)
        assert judged.filter("verdict = 'block'").agg(F.count("*"), F.max("id")).first() == (1000, 1999)
    sparse = url_filter.build_filter(listed, "canonical")
    others = asked.filter("id >= 2000").select(url_filter.canonical_url(F.col("url")).alias("canonical"))
    assert url_filter.may_be_listed(others, "canonical", sparse, "hit").filter("hit").count() < 40
