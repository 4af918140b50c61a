import base64
import gzip
import hashlib
import io
import time

from furrow.llm import warc as W

PAGE = (
    '<html lang="de"><head><title>A &amp; B</title><style>p{}</style><script>var x = "</p>";</script></head>'
    '<body><!-- gone --><h1>Head</h1><p>One <b>two</b>&nbsp;three<br>four &lt;5</p><a href="/x?a=1&amp;b=2">link</a><a href=\'y\'>z</a></body></html>'
)


def parse(data):
    """Records of a WARC stream as (headers, block)."""
    out, f = [], io.BytesIO(data)
    while line := f.readline():
        assert line == b"WARC/1.1\r\n"
        headers = {}
        while (line := f.readline()) != b"\r\n":
            k, v = line.decode().rstrip("\r\n").split(": ", 1)
            headers[k] = v
        block = f.read(int(headers["Content-Length"]))
        assert f.read(4) == b"\r\n\r\n"
        out.append((headers, block))
    return out


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_text_and_metadata():
    assert W.plain_text(PAGE) == "A & B\nHead\nOne two three\nfour <5\nlinkz"
    block, n = W.metadata_block(PAGE)
    assert n == 2 and b"title: A & B\r\nlanguage: de\r\n" in block and b"outlink: /x?a=1&b=2\r\noutlink: y\r\n" in block


def test_records_are_linked(spark):
    pages = spark.createDataFrame([(1, "http://a/b c", PAGE), (2, None, None), (None, "http://x", ""), (1, "http://a/b c", PAGE)], "page_id long, url string, html string")
    rows = W.derivative_records(pages).collect()
    assert len(rows) == 8 and {r.warc_type for r in rows} == {"metadata", "conversion"}
    for r in rows:
        [(h, block)] = parse(bytes(r.record))
        assert h["WARC-Refers-To"] == r.refers_to == W.response_id(r.page_id, r.target_uri)
        assert h["WARC-Record-ID"] == r.record_id != r.refers_to
        assert h["WARC-Block-Digest"] == r.block_digest == sha1(block) and len(block) == r.content_length
        assert ("WARC-Target-URI" in h) == (r.target_uri is not None)
        assert h["WARC-Source-Payload-Digest"] == sha1((PAGE if r.page_id == 1 else "").encode())
    assert len({r.record_id for r in rows}) == 6


def test_files_hold_all_records(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    records = W.derivative_records(pages)
    files = W.packed_files(records, 20_000).collect()
    assert len(files) > 1
    found = sorted(h["WARC-Record-ID"] for f in files for h, _ in parse(gzip.decompress(bytes(f.content))))
    assert found == sorted(r.record_id for r in records.collect())


def test_report_and_empty_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert W.derivative_report(pages).count() == 2 * pages.count()
    assert W.derivative_report(pages.limit(0)).count() == 0
    assert W.derivative_report(pages.selectExpr("*", "1 as record", "2 as block_digest")).count() == 2 * pages.count()


def test_odd_pages():
    assert W.plain_text("a < b <p>c</p> 1 <2> d <!-- <p> --> e") == "a < b\nc\n1 <2> d e"
    assert W.plain_text("x <script>a <!-- b</script> y <style> never closed <p>z") == "x y"
    assert W.plain_text("rest <b never closed") == "rest <b never closed" and W.plain_text("a<!-- open") == "a"
    assert W.read_page("<a href=\"x>y\">t</a><A HREF=z>u</A><a name=q>v</a><a href='open>w").links == ["x>y", "z"]
    assert W.plain_text("&#65;&#00065;&#" + "9" * 5000 + ";") == "AA�"
    assert W.read_page("<title>never closed <title>x").title == "" and W.plain_text("") == ""


def test_hostile_pages_take_linear_time():
    start = time.perf_counter()
    for piece in ("<a ", "<title>", "<script ", "<!--", "<a href=\"x>", "<html lang", "<a href  ", "</script ", "<", "&#0", "<title></title ", "<style></style "):
        W.metadata_block(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 20


def test_index_is_read_from_files(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    named = ["page_id", "warc_type", "record_id", "refers_to", "block_digest", "source_digest", "content_length"]
    records = W.derivative_records(pages).selectExpr(*named, "crc32(record) as record_crc32", "if(warc_type = 'metadata', n_links, null) as n_links").collect()
    index = W.derivative_report(pages, file_bytes=20_000)
    assert sorted(map(str, index.select(*named, "record_crc32", "n_links").collect())) == sorted(map(str, records))
    assert index.select("file", "first_byte").distinct().count() == len(records)
