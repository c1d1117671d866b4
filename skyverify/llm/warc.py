"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response is a row of record id, target URI, date, HTTP header and payload.  Each gives a
``metadata`` record (title, language, links, the source's HTTP header and digests) and a
``conversion`` record (the page's text).  Both refer to the response by ``WARC-Refers-To``, repeat its
URI, date and payload digest, and carry digests of their own blocks.  Record ids are made from the
response's id, so a repeated task writes the same records.

Pages are read by one pass over their markup, which looks at each character a bounded number of
times whatever is left open.  Files hold a gzip member for each record; they are written and read by
executors.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, small_batches

_FIELDS = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_digest", "headers", "block"]
_OUT = pa.schema([(f, pa.int64() if f in ("page_id", "content_length") else pa.large_binary() if f == "block" else pa.string()) for f in _FIELDS])
_SQL = ", ".join(f"{f} {'bigint' if f in ('page_id', 'content_length') else 'binary' if f == 'block' else 'string'}" for f in _FIELDS)
#: Elements whose content is no markup (of the last two it is text), whose content isn't shown, and that break lines.
RAW, TEXT = {"script", "style", "xmp", "iframe", "noembed", "noframes"}, {"title", "textarea"}
HIDDEN = {"template", "noscript"}
BREAKS = {"p", "div", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "tr", "table", "article", "section", "nav", "header", "footer", "main", "aside", "title", "head", "body", "blockquote", "pre", "form", "figure", "option"}
_TAG_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?\s*")
_BARE = re.compile(r"[^\s>]*")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW | TEXT}
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([^\s\"';>/]+)", re.I)
_META_CHARSET = re.compile(rb"<meta[^>]{0,512}?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_BREAKING = re.compile(r"[\r\n]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """Attributes of a tag from ``at`` on, and where the tag ends; -1 if it doesn't."""
    out = []
    while True:
        m = _ATTRIBUTE.match(page, at)
        name, at = m[1], m.end()
        if at >= len(page):
            return out, -1
        if page[at] == ">":
            return [*out, (name.lower(), "")] if name else out, at + 1
        value = ""
        if page[at] == "=":
            at += 1
            while at < len(page) and page[at].isspace():
                at += 1
            if page[at : at + 1] in ("'", '"'):
                end = page.find(page[at], at + 1)
                if end < 0:
                    return out, -1
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
        if name:
            out.append((name.lower(), html.unescape(value)))


def tokens(page: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """Markup as ``("text", text, [])``, ``("start", name, attributes)`` and ``("end", name, [])``.

    Comments are left out, and what stands in a tag, comment or raw element that never ends.
    """
    at, n = 0, len(page)
    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            yield "text", html.unescape(page[at:]), []
            return
        if open_ > at:
            yield "text", html.unescape(page[at:open_]), []
        sign = page[open_ + 1 : open_ + 2]
        if sign in ("!", "?"):
            comment = page.startswith("<!--", open_)
            end = page.find("-->" if comment else ">", open_ + (4 if comment else 2))
            if end < 0:
                return
            at = end + (3 if comment else 1)
            continue
        closing = sign == "/"
        first = page[open_ + 2 : open_ + 3] if closing else sign
        if not (first.isascii() and first.isalpha()):
            yield "text", "<", []
            at = open_ + 1
            continue
        m = _TAG_NAME.match(page, open_ + 1 + closing)
        name = m[0].lower()
        attributes, at = _attributes(page, m.end())
        if at < 0:
            return
        if closing:
            yield "end", name, []
            continue
        yield "start", name, attributes
        if name in _CLOSE:
            end = _CLOSE[name].search(page, at)
            if name in TEXT and (inner := page[at : end.start() if end else n]):
                yield "text", html.unescape(inner), []
            if not end:
                return
            at = end.start()


def read_page(page: str) -> tuple[str, str, list[str], str]:
    """Title, language, links and text: one line for each block, spaces run together."""
    title, lang, links, out = None, "", [], []
    within, hidden = "", 0
    for kind, value, attributes in tokens(page):
        if kind == "text":
            if within == "title" and title is None:
                title = value
            if not hidden:
                out.append(value)
            continue
        if kind == "start":
            given = dict(reversed(attributes))  # the first of equal names counts
            if value == "html" and not lang:
                lang = given.get("lang", "")
            elif value == "a" and "href" in given:
                links.append(given["href"])
        if value in HIDDEN:
            hidden = max(0, hidden + (1 if kind == "start" else -1))
        within = value if kind == "start" else ""
        if value in BREAKS and not hidden:
            out.append("\n")
        elif value in RAW and not hidden:
            out.append(" ")
    text = "\n".join(x for line in "".join(out).split("\n") if (x := _BLANK.sub(" ", line).strip()))
    return _BLANK.sub(" ", title or "").strip(), lang, links, text


def plain_text(page: str) -> str:
    return read_page(page)[3]


def decoded(payload: bytes, content_type: str) -> str:
    """A payload as text, by the media type's charset, a byte order mark, a ``meta`` tag near the start, or else UTF-8."""
    names = [m[1] for m in [_CHARSET.search(content_type)] if m]
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if payload.startswith(mark):
            names.insert(0, name)
    names += [m[1].decode() for m in [_META_CHARSET.search(payload[:4096])] if m]
    for name in names:
        try:
            known = codecs.lookup(name).name
            if known in ("iso8859-1", "ascii"):  # as browsers read them
                known = "cp1252"
            return payload.decode(known, "replace")
        except (LookupError, ValueError):
            continue
    return payload.decode("utf-8", "replace")


def http_fields(header: str) -> tuple[str, list[tuple[str, str]]]:
    """Status line and fields of an HTTP header; a line that begins with a blank goes on with the field before."""
    status, fields = "", []
    for k, line in enumerate(re.split(r"\r?\n", header)):
        if k == 0:
            status = line.strip()
        elif line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            fields.append((name.strip(), value.strip()))
    return status, fields


def _one_line(value: str) -> str:
    """Without line ends, which would forge a field."""
    return _BREAKING.sub(" ", value)


def header_block(fields: dict[str, str]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields.items() if v) + "\r\n"


def record(headers: str, block: bytes) -> bytes:
    """One record as a gzip member; members after each other are a WARC file."""
    return gzip.compress(headers.encode() + block + b"\r\n\r\n", mtime=0)


def _members(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members after each other; other data come as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof and at < len(data):
            some = data[at : at + 65536]
            out.append(unzip.decompress(some))
            at += len(some)
        at -= len(unzip.unused_data)
        yield b"".join(out)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of a WARC file's bytes; ValueError if it is cut off."""
    for part in _members(data):
        at = 0
        while at < len(part):
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                raise ValueError("a WARC header doesn't end")
            fields = dict(http_fields(part[at:end].decode("utf-8", "replace"))[1])
            size = int(next(v for k, v in fields.items() if k.lower() == "content-length"))
            block = part[end + 4 : end + 4 + size]
            if len(block) < size:
                raise ValueError("a WARC block is cut off")
            yield fields, block
            at = end + 8 + size


def derive(page_id, rid: str, uri: str | None, date: str, http: str | None, payload: bytes) -> list[tuple]:
    """The metadata and conversion records of one response."""
    status, source = http_fields(http or "")
    media = next((v for k, v in source if k.lower() == "content-type"), "")
    title, lang, links, text = read_page(decoded(payload, media))
    own, payload_digest = text.encode("utf-8", "replace"), digest(payload)
    info = [("title", title), ("language", lang), ("source-content-length", str(len(payload))), ("source-status", status)]
    info += [(f"source-header-{k.lower()}", v) for k, v in source] + [("outlink", x) for x in links]
    meta = "".join(f"{_one_line(k)}: {_one_line(v)}\r\n" for k, v in info if v).encode("utf-8", "replace")
    out = []
    for kind, media_type, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", own)):
        own_id, own_digest = record_id(rid, kind), digest(block)
        fields = {"WARC-Type": kind, "WARC-Record-ID": own_id, "WARC-Refers-To": rid, "WARC-Target-URI": uri or "", "WARC-Date": date, "WARC-Block-Digest": own_digest}
        fields |= {"WARC-Refers-To-Target-URI": uri or "", "WARC-Refers-To-Date": date, "WARC-Source-Payload-Digest": payload_digest, "Content-Type": media_type, "Content-Length": str(len(block))}
        out.append((page_id, kind, own_id, rid, uri, date, media_type, len(block), own_digest, payload_digest, header_block(fields), block))
    return out


def _uuid(hashed: Column) -> Column:
    """A version 5 UUID of a SHA-1 in hexadecimal digits."""
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(hashed, 17, 1), 16, 10).cast("int") % 4) + 1)
    parts = [F.substring(hashed, 1, 8), F.substring(hashed, 9, 4), F.concat(F.lit("5"), F.substring(hashed, 14, 3)), F.concat(variant, F.substring(hashed, 18, 3)), F.substring(hashed, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", content_type: str = "text/html; charset=utf-8") -> DataFrame:
    """Response records of a table of pages: ``page_id, record_id, target_uri, warc_date, http_headers, payload``.

    A record's id is made from page id, URL, date and payload, so only repeated rows share one.
    """
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    parts = [F.lit("response"), F.lit(date), F.coalesce(pages[id_col].cast("string"), F.lit("null")), F.sha1(payload), F.coalesce(pages[url_col].cast("string"), F.lit(""))]
    http = F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\n\r\n")
    return pages.select(pages[id_col].cast("long").alias("page_id"), _uuid(F.sha1(F.concat_ws("\n", *parts))).alias("record_id"), pages[url_col].cast("string").alias("target_uri"), F.lit(date).alias("warc_date"), http.alias("http_headers"), payload.alias("payload"))


def response_records(resp: DataFrame) -> DataFrame:
    """Responses as records (``page_id, warc_type, headers, block``), whose block is HTTP header and payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            heads, blocks = [], []
            for rid, uri, date, http, payload in zip(*(c.to_pylist() for c in rows.columns[1:]), strict=True):
                payload = payload or b""
                block = (http or "").encode() + payload
                fields = {"WARC-Type": "response", "WARC-Record-ID": rid, "WARC-Target-URI": uri or "", "WARC-Date": date, "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block)}
                heads.append(header_block(fields | {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}))
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(["response"] * len(heads)), pa.array(heads), pa.array(blocks, pa.large_binary())], names=["page_id", "warc_type", "headers", "block"])

    return resp.select("page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload").mapInArrow(run, "page_id bigint, warc_type string, headers string, block binary")


def derivatives(resp: DataFrame) -> DataFrame:
    """Two records for each response: all header fields, the header text and the block.

    A null or empty payload gives an empty text and a metadata block without title.  A null URI is
    left out of the header.  Repeated responses give repeated records with the same ids.  An empty
    table gives an empty result; other columns are ignored.
    """
    small_batches(resp.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            got = [r for x in zip(*(c.to_pylist() for c in rows.columns), strict=True) for r in derive(*x[:5], x[5] or b"")]
            yield batch(_OUT, list(zip(*got, strict=True)) or [[]] * len(_OUT))

    return resp.select("page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload").mapInArrow(run, _SQL)


def write_files(records: DataFrame, folder: str) -> DataFrame:
    """Write records (``headers, block``) as ``part-N.warc.gz``, one file for each partition that has any.

    Executors write to ``folder``, a URI that all of them reach.  A file gets its name when it is
    whole, so a repeated task replaces what it wrote.  ``file, records`` come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        draft, n, out = f"{name}.{uuid.uuid4().hex}", 0, None
        for rows in batches:
            for headers, block in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                out = out or store.open_output_stream(draft)
                out.write(record(headers, block or b""))
                n += 1
        if out:
            out.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "records"])

    written = records.select("headers", "block").mapInArrow(run, "file string, records bigint").collect()  # one row for each file
    return records.sparkSession.createDataFrame(written, "file string, records bigint")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, nr, fields, block`` of the records of WARC files, with or without gzip; a file is one task's, and at most 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("file", pa.string()), ("nr", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.large_binary())])
        for rows in batches:
            for file, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                for nr, (fields, block) in enumerate(read_records(data)):
                    yield batch(types, [[file], [nr], [list(fields.items())], [block]])

    small_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, nr bigint, fields map<string,string>, block binary")
