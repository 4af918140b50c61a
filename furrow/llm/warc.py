"""Derivative WARC records: metadata and plain text made from responses.

Each response gives two records, both naming it in ``WARC-Refers-To``: one of type ``metadata`` with its title, language,
length and links, and one of type ``conversion`` with the text of the page. Both repeat the target address and
date of the response, give the digest of their block, and carry the response's payload digest as a source header.

Record ids are name-based UUIDs of the type and the response's id, so that a rerun or a retried task writes the
same records. Pages are taken one at a time, each in one walk of linear time; nothing is shuffled. Records are packed into
files of gzip members, and the report is read back from these.

A null page is an empty one; a null address gives no ``WARC-Target-URI``; a null id is an empty name. Repeated rows give repeated
records. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import written

FILE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
RECORD_SCHEMA = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, "
    "block_digest string, source_digest string, n_links int, content_length long, record binary"
)

_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)")
_HIDDEN = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "template", "noscript")}
_BREAK = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol tr table article section header footer nav main aside blockquote pre title head body html br hr".split()
)
_TITLE_END = re.compile(r"</title\s*>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:([\"'])|([^\s>]+))", re.I)
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_LONG_NUMBER = re.compile(r"&#[0-9]{8,};?")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {name}')}>"


def response_id(page_id: int | None, url: str | None) -> str:
    return record_id("response", f"{'' if page_id is None else page_id} {url or ''}")


def _unescaped(s: str) -> str:
    """Entities resolved; a number beyond all code points, however long, is the replacement character."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", _ZEROS.sub("&#", s)))


class Page(NamedTuple):
    text: str
    title: str
    lang: str
    links: list[str]


def read_page(page: str) -> Page:
    """What a page shows and names, in one walk from left to right.

    A ``<`` before a letter, ``/``, ``!`` or ``?`` opens a tag that the next ``>`` closes; a quoted address may hold a ``>``. Comments
    and the content of scripts, styles, templates and ``noscript`` are left out, to the end of the page where they are
    not closed. Once a sign is missing from the rest of a page it is not looked for again, so the time is linear.
    """
    out: list[str] = []
    found: list[str] = []
    title = lang = None
    at, absent = 0, set()

    def find(sign: str, start: int) -> int:
        if sign in absent:
            return -1
        place = page.find(sign, start)
        if place < 0:
            absent.add(sign)
        return place

    while (i := find("<", at)) >= 0:
        out.append(page[at:i].replace("\n", " "))
        if page.startswith("<!--", i):
            at = find("-->", i + 4) + 3
            if at < 3:
                at = len(page)
            continue
        end = find(">", i)
        if end < 0:
            at = i
            break
        name = _NAME.match(page, i)
        if name is None and page[i + 1] not in "/!?":
            out.append("<")
            at = i + 1
            continue
        at = end + 1
        if name is None:
            continue
        tag, opens = name[2].lower(), not name[1]
        if tag in _BREAK:
            out.append("\n")
        if not opens:
            continue
        if tag in _HIDDEN:
            closed = _HIDDEN[tag].search(page, at)
            at = closed.end() if closed else len(page)
        elif tag == "title" and title is None:
            closed = _TITLE_END.search(page, at)
            title = page[at : closed.start()] if closed else ""
        elif tag == "html" and lang is None:
            said = _LANG.search(page, i, end)
            lang = said[1] if said else None
        elif tag == "a" and (href := _HREF.search(page, i, end)):
            if href[1] is None:
                found.append(_unescaped(href[2]))
            elif (quote := find(href[1], href.end())) >= 0:
                found.append(_unescaped(page[href.end() : quote]))
                at = max(at, find(">", quote) + 1)
    out.append(page[at:].replace("\n", " "))
    lines = (_BLANKS.sub(" ", x).strip() for x in _unescaped("".join(out)).split("\n"))
    shown = _BLANKS.sub(" ", _unescaped(title or "")).replace("\n", " ").strip()
    return Page("\n".join(x for x in lines if x), shown, lang or "", found)


def plain_text(page: str) -> str:
    """Text as read: no scripts, styles or comments, one line per block, entities resolved."""
    return read_page(page).text


def metadata_block(page: str, read: Page | None = None) -> tuple[bytes, int]:
    """Named fields, one a line."""
    read = read or read_page(page)
    fields = [("title", read.title), ("language", read.lang), ("source-length", str(len(page.encode())))]
    fields += [("outlink", x.replace("\r", "").replace("\n", "")) for x in read.links]
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode(), len(read.links)


def warc_record(kind: str, refers_to: str, uri: str | None, date: str, source: str, block: bytes) -> tuple[str, str, bytes]:
    """(record id, block digest, bytes of the whole record)."""
    own, sum_ = record_id(kind, refers_to), digest(block)
    content = "application/warc-fields" if kind == "metadata" else "text/plain; charset=utf-8"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", refers_to)]
    headers += [("WARC-Target-URI", re.sub(r"\s", "", uri))] if uri else []
    headers += [("WARC-Date", date), ("WARC-Source-Payload-Digest", source), ("WARC-Block-Digest", sum_)]
    headers += [("Content-Type", content), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return own, sum_, head.encode() + block + b"\r\n\r\n"


def _derive(date: str):
    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                some = batch.slice(first, 256)
                for page_id, url, page in zip(*(some.column(k).to_pylist() for k in range(3))):
                    page = page or ""
                    of, source = response_id(page_id, url), digest(page.encode())
                    read = read_page(page)
                    meta, n = metadata_block(page, read)
                    for kind, block in (("metadata", meta), ("conversion", read.text.encode())):
                        own, sum_, record = warc_record(kind, of, url, date, source, block)
                        rows.append((page_id, kind, own, of, url, sum_, source, n, len(block), record))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], _NAMES)

    return derive


FILE_SCHEMA = "name string, n_records long, page_ids array<long>, offsets array<long>, content binary"
INDEX_SCHEMA = RECORD_SCHEMA.replace("record binary", "record_crc32 long, file string, first_byte long")


def _arrow(schema: str) -> tuple[list[str], list[pa.DataType]]:
    types = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return list(names), [types[x] for x in kinds]


_NAMES, _TYPES = _arrow(RECORD_SCHEMA)
_FILE_NAMES, _FILE_TYPES = _arrow(FILE_SCHEMA)
_INDEX_NAMES, _INDEX_TYPES = _arrow(INDEX_SCHEMA)


def derivative_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Two rows per row of ``pages`` (``page_id``, ``url``, ``html``), each with its whole WARC record."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_derive(date), RECORD_SCHEMA)


def packed_files(records: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(name, n_records, page_ids, offsets, content): gzip members, one per record, joined to files of about ``file_bytes``.

    A file holds records of one task in their order; a single record may exceed the limit. ``offsets`` are the first
    bytes of the members, ``page_ids`` the pages they are made from.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            starts = list(accumulate(map(len, held[:-1]), initial=0))
            row = [f"derived-{part:05d}-{seq:05d}.warc.gz", len(held), ids, starts, b"".join(held)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _FILE_TYPES)], _FILE_NAMES)

        for batch in batches:
            for page_id, record in zip(batch.column(0), batch.column(1)):
                member = gzip.compress(record.as_py(), 6, mtime=0)
                if held and size + len(member) > file_bytes:
                    yield close()
                    seq, held, ids, size = seq + 1, [], [], 0
                held.append(member)
                ids.append(page_id.as_py())
                size += len(member)
        if held:
            yield close()

    return records.select("page_id", "record").mapInArrow(pack, FILE_SCHEMA)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def file_index(files: DataFrame) -> DataFrame:
    """One row per record of packed files, as read back from its member: its headers, its file and first byte.

    ``n_links`` counts the links of a metadata record and is null for a conversion; ``block_digest`` is that of the block found.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, starts, content in zip(*(batch.column(k) for k in range(4))):
                whole = memoryview(content.as_buffer())
                starts = starts.as_py()
                rows = []
                for page_id, first, end in zip(ids.as_py(), starts, [*starts[1:], len(whole)]):
                    data = gzip.decompress(whole[first:end])
                    h, block = parse_record(data)
                    kind = h["WARC-Type"]
                    n = sum(x.startswith(b"outlink: ") for x in block.split(b"\r\n")) if kind == "metadata" else None
                    said = [h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI"), digest(block), h["WARC-Source-Payload-Digest"]]
                    rows.append((page_id, kind, *said, n, len(block), zlib.crc32(data), name.as_py(), first))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _INDEX_TYPES)], _INDEX_NAMES)

    return files.select("name", "page_ids", "offsets", "content").mapInArrow(read, INDEX_SCHEMA)


def derivative_report(pages: DataFrame, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The index of the packed files that the records of ``pages`` are written to."""
    return file_index(written(packed_files(derivative_records(pages, date), file_bytes), "warc-files"))
