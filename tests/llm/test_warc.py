import base64
import gzip
import hashlib
import html
import json
import re
import zlib
from html.parser import HTMLParser

from shelfmark.llm import warc as W
from shelfmark.llm.common import new_folder
from shelfmark.llm.html_text import extract


def digest(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


class Slow(HTMLParser):
    """Text and links by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.skip, self.title = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.title = tag == "title" or (self.title and tag != "title")
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag == "title":
            self.title = False

    def handle_data(self, data):
        if not self.skip and not self.title:
            self.text.append(data)


def squeezed(text):
    return re.sub(r"\s+", "", text)


def test_extract():
    page = extract('<!doctype html><html><head><title>A &amp; B</title><meta name="d" content="x>y"><base href="http://h/q/"></head><body><!-- <p>no</p> --><p>One<br>two <b>three</b></p><script>var t="</p>"</script><a href="r?a=1&amp;b=2">go <i>there</i></a><img src=\'i.png\' alt="pic"><div>4 &lt; 5</div> tail <a href="#x">un')
    assert page == {"title": "A & B", "text": "One\ntwo three\ngo there\n4 < 5\ntail un", "metas": [("d", "x>y")], "links": [("A@/href", "http://h/q/r?a=1&b=2", "go there"), ("IMG@/src", "http://h/q/i.png", "pic"), ("A@/href", "http://h/q/#x", "un")]}
    for odd in ("", "<", "<p", "a < b > c", "<!--", "<script>x", "<a href=\"x", "</", "&amp", "<b " + "x" * 10_000, "<p>" * 20_000):
        extract(odd)


def test_pages_against_the_standard_parser(spark, sf):
    pages = {r.url: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in pages.values():
        slow = Slow()
        slow.feed(r.html)
        slow.close()
        got = extract(r.html, r.url)
        assert squeezed(got["text"]) == squeezed("".join(slow.text))
        assert len([x for x in got["links"] if x[0] == "A@/href"]) == len(slow.links)
        assert html.unescape(re.search("<title>(.*?)</title>", r.html, re.S)[1]).strip() == got["title"]
    rows = W.op1_warc_derivatives(spark, sf).collect()
    assert len(rows) == 2 * len(pages) == 2 * len({r.refers_to for r in rows}) == len({r.record_id for r in rows})
    for r in rows:
        page = pages[r.target_uri].html
        assert r.source_payload_digest == digest(page.encode())
        if r.type == "conversion":
            assert r.block_digest == digest(extract(page, r.target_uri)["text"].encode())


def test_linked_records(spark):
    other = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=latin-1\r\n\r\ncaf\xe9"
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"
    rows = [("response", "<urn:uuid:1>", None, "http://a/", "2020-01-01T00:00:00Z", [("X-Own", "kept")], other), ("response", "<urn:uuid:2>", None, "http://b/", None, None, image), ("response", None, None, None, None, None, None), ("request", "<urn:uuid:3>", None, "http://a/", None, None, b"GET"), (None, None, None, None, None, None, None)]
    got = W.derive(spark.createDataFrame(rows, W.RECORD)).collect()
    assert sorted((r.type, r.target_uri) for r in got) == [("conversion", ""), ("conversion", "http://a/"), ("metadata", ""), ("metadata", "http://a/"), ("metadata", "http://b/")]
    one = next(r for r in got if r.type == "metadata" and r.refers_to == "<urn:uuid:1>")
    facts = json.loads(bytes(one.block))
    assert facts["WARC-Header-Metadata"] == {"X-Own": "kept"} and facts["Payload-Digest"] == digest(b"caf\xe9") and facts["Block-Digest"] == digest(other)
    text = next(r for r in got if r.type == "conversion" and r.refers_to == "<urn:uuid:1>")
    assert bytes(text.block) == "café".encode() and {h.name: h.value for h in text.headers}["WARC-Refers-To"] == "<urn:uuid:1>"
    assert W.derive(spark.createDataFrame([], W.RECORD)).count() == 0


def test_page_cases_and_files(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "c"), (1, "http://a/", "<p>x</p>", "c"), (None, None, None, "c"), (2, "http://b/", "", "c"), (3, "http://c/", "<p>long</p>" * 20_000, "c")], "page_id long, url string, html string, type string")
    both = W.responses_of_pages(pages)
    both = both.union(W.derive(both))
    assert both.count() == 15
    folder = new_folder(spark, "warc")
    manifest = W.write(both, folder)
    key = lambda df: sorted((r.type, r.record_id, r.refers_to or "", r.target_uri, r.date, str(r.headers), bytes(r.block)) for r in df.collect())
    assert key(W.read(manifest)) == key(both)
    again = W.derive(W.read(manifest))
    assert key(again) == key(W.derive(W.responses_of_pages(pages)))


def test_repeated_headers_and_coded_bodies(spark):
    page = b'<p>one caf\xc3\xa9</p><a href="/x">go</a>' + b"<p>more</p>" * 2000
    chunked = lambda b: b"".join(b"%x;e=1\r\n%s\r\n" % (len(b[k : k + 700]), b[k : k + 700]) for k in range(0, len(b), 700)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(page) + raw.flush()
    bodies = [("Transfer-Encoding: chunked", chunked(page)), ("Content-Encoding: gzip", gzip.compress(page[:50]) + gzip.compress(page[50:])), ("Content-Encoding: deflate", zlib.compress(page)), ("Content-Encoding: deflate", raw), ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked(gzip.compress(page))), ("Content-Encoding: gzip", page), ("Transfer-Encoding: chunked", page)]
    bodies.append(("Content-Encoding: br", b"\x8b\x00"))
    own = [("WARC-Concurrent-To", "<urn:a>"), ("X", "1"), ("WARC-Concurrent-To", "<urn:b>")]
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nSet-Cookie: a=1\r\nVia: v\r\nSet-Cookie: b=2\r\n"
    rows = [("response", f"<urn:{k}>", None, "http://a/", None, own, f"{head}{h}\r\n\r\n".encode() + b) for k, (h, b) in enumerate(bodies)]
    got = W.derive(spark.createDataFrame(rows, W.RECORD)).collect()
    texts = {r.refers_to: bytes(r.block).decode() for r in got if r.type == "conversion"}
    assert texts == {f"<urn:{k}>": extract(page.decode(), "http://a/")["text"] for k in range(7)}
    for r in got:
        if r.type == "metadata":
            facts, (_, body) = json.loads(bytes(r.block)), bodies[int(r.refers_to[5:-1])]
            assert [(h["name"], h["value"]) for h in facts["WARC-Header-List"]] == own
            assert [h["value"] for h in facts["HTTP-Response-Metadata"]["Header-List"] if h["name"] == "Set-Cookie"] == ["a=1", "b=2"]
            assert facts["Actual-Payload-Digest"] == digest(body)
            assert len(facts["HTML-Metadata"]["Links"]) == (b"\x8b\x00" != body)


def test_pages_that_never_close():
    import time

    from shelfmark.llm.html_text import extract

    began = time.time()
    for part in ("<a ", "<a \"'", "<!", "<script ", "<a b=\"", "<a aaaa"):
        big = part * (1_000_000 // len(part))
        for page in (big, big + ">", "<p>text</p>" + big):
            extract(page)
    assert time.time() - began < 60
    assert extract("<p>one < two <b>three</b> <i")["text"] == "one < two three <i"
