import gzip
import hashlib
import json
import re
import time
from html.parser import HTMLParser

from hitsieve.llm import derivatives as D

BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "tr", "table", "article", "nav", "footer", "title", "head", "body"}


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.out.append("\n" if tag in BLOCKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.out.append("\n" if tag in BLOCKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_visible_text_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in pages:
        reader = Plain()
        reader.feed(r.html)
        reader.close()
        assert D.visible_text(r.html).split() == "".join(reader.out).split()


def test_unclosed_marks_take_linear_time_and_hide_the_rest():
    for mark in ("<!-- ", "<script ", "<script>", "<style>x", "<p ", "<template>", "< ", "</script ", "&#1", "<title>", "\n "):
        start = time.process_time()
        D.visible_text(mark * (5_000_000 // len(mark)))
        assert time.process_time() - start < 8, mark
    for end in ("&#" + "1" * 50_000, "<" + " " * 1_000_000 + "p"):
        D.visible_text(end)
    assert D.visible_text("a<script>x</SCRIPT >b<!-- c --> d<style>e{}<p>f") == "a b d"
    assert D.visible_text("x<!-- y") == "x" and D.visible_text("&#00065;&#99999999999;") == "A\ufffd"


def test_titles_of_unclosed_pages_are_found_once(spark):
    page = "<title " * 40_000 + "<title>" * 40_000
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n{page}"
    frame = spark.createDataFrame([("<r>", "u", "d", "response", {}, block)], "record_id string, target_uri string, warc_date string, warc_type string, "
                                                                              "headers map<string,string>, block string")
    got = D.derive(frame).where("warc_type = 'metadata'").first()
    assert "Title" not in json.loads(got.content) and re.fullmatch("<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-3[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>", got.record_id)


def test_records(spark, tmp_path):
    page = "<html><title>A &amp; B</title><body><p>x&eacute;<br>y</p><a href='/l'>z</a><script>no</script></body></html>"
    block = f"HTTP/1.1 404 Not Found\r\nContent-Type: Text/HTML; charset=utf-8\r\nX-A: 1\r\nX-A: 2\r\n\r\n{page}"
    rows = [("<r1>", "http://a", "2020", "response", {"WARC-Payload-Digest": "sha1:KEPT", "Other": "o"}, block, 1, "e"),
            ("<r2>", None, None, "response", None, "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nplain <b>text", 2, "e"),
            ("<r3>", "u", "d", "response", {}, "HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x01", 3, "e"),
            ("<r4>", "u", "d", "request", {}, "GET /", 4, "e"), (None, None, None, "response", None, None, 5, "e"),
            ("<r6>", "u", "d", "response", {}, "no head at all", 6, "e")]
    frame = spark.createDataFrame(rows + [rows[0]], "record_id string, target_uri string, warc_date string, warc_type string, headers map<string,string>, "
                                                   "block string, key int, content string")
    got = D.derive(frame).collect()
    kinds = sorted((r.key, r.warc_type) for r in got)
    assert kinds == [(1, "conversion")] * 2 + [(1, "metadata")] * 2 + [(2, "conversion"), (2, "metadata"), (3, "metadata"), (5, "metadata"), (6, "metadata")]
    by = {(r.key, r.warc_type): r for r in got}
    text, meta = by[1, "conversion"], by[1, "metadata"]
    assert text.content == "A & B\nxé\ny\nz" and by[2, "conversion"].content == "plain <b>text"
    assert text.refers_to == meta.refers_to == "<r1>" and text.related_id == meta.record_id and meta.related_id == text.record_id
    assert text.payload_digest == "sha1:KEPT" and text.source_block_digest == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
    assert text.block_digest == "sha256:" + hashlib.sha256(text.content.encode()).hexdigest() and text.content_length == len(text.content.encode())
    body = json.loads(meta.content)
    assert body["Status"] == 404 and body["HTTP-Headers"] == {"content-type": "Text/HTML; charset=utf-8", "x-a": "2"} and body["Links"] == ["/l"]
    assert body["Source-Headers"]["Other"] == "o" and body["WARC-Refers-To"] == "<r1>" and body["Title"] == "A &amp; B"
    D.write_warc(D.derive(frame), str(tmp_path / "w"))
    data = "".join(gzip.open(p, "rt", newline="").read() for p in (tmp_path / "w").glob("*.gz"))
    assert data.count("WARC/1.1\r\n") == len(got) and data.count("\r\n\r\nA & B\nxé\ny\nz\r\n\r\n") == 2
    assert D.derive(frame.limit(0)).count() == 0


def test_null_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>a"), (1, None, None)], "page_id long, url string, html string")
    got = D.derive(D.responses(pages)).collect()
    assert len(got) == 6 and {r.content for r in got if r.warc_type == "conversion"} == {"", "a"}
