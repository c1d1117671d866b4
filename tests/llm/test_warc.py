"""Markup, records and files of WARC derivatives."""

import gzip
import html
import random
import re
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyverify.llm import warc

PAGE = '<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><script>x = "<p>no</p>";</script><style>p {}</style></head><body><!-- <p>no</p> --><p>One  two<br>three &lt;x&gt;</p><a class=k href="/y?a=1&amp;b=2">link</a></body></html>'


def test_markup():
    text = warc.plain_text
    assert warc.read_page(PAGE) == ("A & B", "en", ["/y?a=1&b=2"], "A & B\nOne two\nthree <x>\nlink")
    assert text('<p title="a>b">hi</p>') == "hi" and text("<p title='a>b' x>hi") == "hi" and text("<p a=b/c>hi") == "hi"
    assert text("a<script>var x = 1;") == "a" and text("a<script>1</scriptx>2</SCRIPT >b") == "a b"
    assert text("1 < 2 <3 </ 4") == "1 < 2 <3 </ 4" and text("a<!-- b") == "a" and text("a<!b>c<?d?>e") == "ace"
    assert text("a<template>b<p>c</template>d<noscript>e</noscript>f") == "adf" and text("<p><a href=") == ""
    assert text("") == "" and text("\0 x\xa0 y") == "\0 x y" and text("<textarea><b>x</textarea>") == "<b>x"
    assert warc.read_page('<a HREF=a&amp;b>x</a><a href>y</a><A href="c" href="d">')[2] == ["a&b", "", "c"]
    assert warc.read_page("<title>one</title><title>two</title>")[0] == "one"


def test_made_pages_read_back():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab<>&\"'é =/") for _ in range(rng.randrange(1, 7)))
    tidy = lambda x: re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip()
    for _ in range(300):
        lines = [" ".join(word() for _ in range(4)) for _ in range(rng.randrange(1, 6))]
        links = [word() for _ in range(3)]
        quote = lambda x: rng.choice([f'"{html.escape(x)}"', f"'{html.escape(x)}'"])
        noise = ["<!-- <p> -->", "<script>if (a < b) '</p>'</script>", f"<b title={quote(word())}>", "</b>", "<img alt='>'>"]
        page = "".join(f"<p data-x={quote(word())}>{rng.choice(noise[2:])}{html.escape(x)}</p>{rng.choice(noise)}" for x in lines)
        page += "".join(f"<a class=c href = {quote(x)}></a>" for x in links)
        _, _, got, text = warc.read_page(page)
        assert got == links and text.split("\n") == [x for x in map(tidy, lines) if x] or not any(map(tidy, lines))


@pytest.mark.parametrize("piece", ["<script", "<script>", "<!--", "<!", "<a href='", '<a b="c', "<p ", "</p", "<", "&", "<title>", "<template>", "<a =", "< a", "&#", "<p/"])
def test_hostile_pages_take_linear_time(piece):
    took = []
    for n in (20_000, 80_000):
        page = piece * n
        began = time.process_time()
        warc.read_page(page)
        took.append(time.process_time() - began)
    assert took[1] < 0.2 + 12 * took[0]


def test_charsets():
    assert warc.decoded("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert warc.decoded("é".encode(), "text/html") == "é" and warc.decoded("é".encode("utf-16"), "") == "é"
    assert warc.decoded(b'<meta charset="windows-1251">' + "д".encode("cp1251"), "")[-1] == "д"
    assert warc.decoded("é".encode(), "text/html; charset=nonsense") == "é" and warc.decoded(b"\xff", "") == "�"


def test_records(spark):
    pages = spark.createDataFrame([(1, "http://e.com/a", PAGE, 5), (2, None, None, 6), (3, "http://e.com/c\r\nX: y", "", 7), (1, "http://e.com/a", PAGE, 5), (1, "http://e.com/a", PAGE + " later", 5), (None, "u", "<p>" + "long " * 300_000, 1)], "page_id bigint, url string, html string, headers int")
    resp = warc.responses(pages)
    rows = warc.derivatives(resp).collect()
    assert Counter(r.warc_type for r in rows) == {"metadata": 6, "conversion": 6}
    ids = {r.record_id for r in resp.collect()}
    assert {r.refers_to for r in rows} == ids and len(ids) == 5
    for i in [*ids, *(r.record_id for r in rows)]:
        u = uuid.UUID(i.removeprefix("<urn:uuid:").removesuffix(">"))
        assert u.version == 5 and u.variant == uuid.RFC_4122
    one = {r.warc_type: r for r in rows if r.page_id == 1 and b"later" not in bytes(r.block)}
    assert bytes(one["conversion"].block).decode() == "A & B\nOne two\nthree <x>\nlink"
    meta = bytes(one["metadata"].block).decode().split("\r\n")
    assert meta[:2] == ["title: A & B", "language: en"] and "outlink: /y?a=1&b=2" in meta
    assert "source-status: HTTP/1.1 200 OK" in meta and "source-header-content-type: text/html; charset=utf-8" in meta
    for r in rows:
        ((fields, block),) = warc.read_records(warc.record(r.headers, bytes(r.block)))
        assert block == bytes(r.block) and fields["WARC-Block-Digest"] == warc.digest(block) == r.block_digest
        assert fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Record-ID"] == r.record_id and "X" not in fields
        assert fields["WARC-Source-Payload-Digest"] == r.source_digest
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_http_headers_are_used(spark):
    resp = spark.createDataFrame([(1, "<urn:uuid:x>", "u", "d", "HTTP/1.0 203 Odd\r\ncontent-type: text/html;\r\n charset=latin-1\r\nX-Y: z\r\n\r\n", bytearray("<p>é".encode("latin-1"))), (2, "<urn:uuid:y>", None, "d", None, None)], "page_id bigint, record_id string, target_uri string, warc_date string, http_headers string, payload binary")
    rows = {(r.page_id, r.warc_type): bytes(r.block).decode() for r in warc.derivatives(resp).collect()}
    assert rows[1, "conversion"] == "é" and rows[2, "conversion"] == ""
    assert rows[1, "metadata"].split("\r\n")[1:4] == ["source-status: HTTP/1.0 203 Odd", "source-header-content-type: text/html; charset=latin-1", "source-header-x-y: z"]


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://e.com/{k}", PAGE + "x" * k) for k in range(40)], "page_id bigint, url string, html string").repartition(3)
    resp = warc.responses(pages)
    made = warc.response_records(resp).select("headers", "block").union(warc.derivatives(resp).select("headers", "block"))
    folder = f"file://{tmp_path}/out"
    files = warc.write_files(made, folder).collect()
    warc.write_files(made, folder)  # a repeated task's files replace these
    assert sum(f.records for f in files) == 120 and len(list((tmp_path / "out").iterdir())) == len(files)
    back = warc.read_files(spark, folder)
    assert Counter(r[0] for r in back.select(F.col("fields")["WARC-Type"]).collect()) == {"response": 40, "metadata": 40, "conversion": 40}
    want = Counter((frozenset(warc.http_fields(r.headers.strip())[1]), bytes(r.block)) for r in made.collect())
    assert Counter((frozenset(r.fields.items()), bytes(r.block)) for r in back.collect()) == want
    data = (tmp_path / "out" / "part-00000.warc.gz").read_bytes()
    assert list(warc.read_records(gzip.decompress(data))) == list(warc.read_records(data))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_records(gzip.decompress(data)[:-100]))
