import base64
import hashlib
import json
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tidemill.llm import warc_derive as op

BLOCKS = set("article p div nav ul li h1 h2 h3 title td tr table br body html head header footer section main".split())


class Slow(HTMLParser):
    """Text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in {"script", "style", "noscript", "head"}
        self.out.append("\n" if tag in BLOCKS else "")

    def handle_endtag(self, tag):
        self.skip -= tag in {"script", "style", "noscript", "head"}
        self.out.append("\n" if tag in BLOCKS else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def slow_text(page):
    p = Slow()
    p.feed(page)
    p.close()
    return " ".join("".join(p.out).split())


def test_records_of_whole_table(spark, sf_small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    rows = op.warc_derive(spark.read.parquet(f"{sf_small}/pages.parquet")).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        page = pages[r.page_id]
        payload = page.html.encode()
        sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert r.source_payload_digest == sha1(payload) and r.block_digest == sha1(r.block.encode())
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest == r.block.encode() + b"\r\n\r\n"
        assert fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Type"] == r.warc_type
        assert int(fields["Content-Length"]) == r.content_length == len(r.block.encode())
        if r.warc_type == "metadata":
            e = json.loads(r.block)["Envelope"]
            assert e["WARC-Header-Metadata"]["WARC-Record-ID"] == r.refers_to
            assert e["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]["Content-Length"] == str(len(payload))
        else:
            assert " ".join(r.block.split()) == slow_text(page.html)
    pairs = {r.page_id: {x.refers_to for x in rows if x.page_id == r.page_id} for r in rows}
    assert all(len(v) == 1 for v in pairs.values())


def test_defined_cases(spark):
    rows = [(1, None, None), (2, "http://a/", ""), (3, "u", "<p>a&amp;b<br>c</p><script>x<y</script>"), (3, "u", "<p>a&amp;b<br>c</p><script>x<y</script>"),
            (None, "u", "1 < 2 <b>bold</b><!-- no --> text<a href='/x?a=1&amp;b=2'>l</a>"), (5, "u", "<p>" + "word " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("block", F.lit(1))
    got = op.warc_derive(df).collect()
    assert len(got) == 12
    text = {r.page_id: r.block for r in got if r.warc_type == "conversion"}
    assert text[1] == text[2] == "" and text[3] == "a&b\nc" and text[None] == "1 < 2 bold textl" and len(text[5]) == 999_999
    assert "WARC-Target-URI" not in bytes(next(r.record for r in got if r.page_id == 1)).partition(b"\r\n\r\n")[0].decode()
    meta = json.loads(next(r.block for r in got if r.page_id is None and r.warc_type == "metadata"))
    links = meta["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"]
    assert links == [{"tag": "a", "attribute": "href", "url": "/x?a=1&b=2"}]
    assert op.warc_derive(df.limit(0)).count() == 0


def test_odd_mark_up_takes_linear_time():
    import time

    for page in ('<a "' * 20_000, "<title>" * 20_000, "<a b=" * 20_000, "<!" * 20_000, "<script>" * 20_000, "<a " + "x" * 200_000, "a='" * 20_000, "<noscript>" * 20_000):
        began = time.thread_time()
        op.derive(1, "u", page)
        assert time.thread_time() - began < 2
    page = "<head><title>T &amp; t</title><meta name=x content='a>b'><link href=/c></head><p>a <b>bold</b> < 5<script>x='<p>no'</script><style>y</style><noscript>n<img src=i></noscript> end <a title='>' href=\"/q\">l</a>"
    seen = op.Page(page)
    assert seen.plain_text() == "a bold < 5 end l" and seen.title == "T & t" and seen.metas == [{"name": "x", "content": "a>b"}]
    assert [x["url"] for x in seen.links] == ["/c", "i", "/q"]


def test_letters_outside_of_ascii_take_no_more_time():
    import time

    def least(page):
        times = []
        for _ in range(5):
            began = time.thread_time()
            seen = op.Page(page)
            times.append(time.thread_time() - began)
        return seen, min(times)

    plain, wide = "<P>Some Words and more</P>" + "a B c " * 100_000, "<P>Some Words and more</P>" + "é Ж İ " * 100_000
    (seen, fast), (other, slow) = least(plain), least(wide)
    assert slow < 10 * fast
    assert seen.plain_text().startswith("Some Words and more\na B c") and other.plain_text().endswith("é Ж İ")
    odd = "İ<SCRIPT>x</Script>\ud800<P>a\t b  c d  e f"
    assert op.plain_text(odd) == "İ\ud800\na b c d e f"
