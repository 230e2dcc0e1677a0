"""Operator 3: WARC derivatives.

From response records, each gets a metadata record (JSON: the source's WARC and
HTTP headers in their order, repeated ones too, its digests, title, meta tags
and links, made absolute) and a conversion record (the page's plain text). Both
refer to the response by WARC-Refers-To, keep its target, date and payload
digest, and have record ids that follow from the response's, so that building
them again gives the same records.

load() reads the records of WARC files, responses() takes their HTTP responses
apart, pages_as_responses() makes responses of raw pages; derive() turns either
into derivatives and save() writes them, into folders that Spark can reach.

A payload is read as its headers say: chunks are put together, gzip and deflate
undone (other encodings leave it without text, links and metadata), and its
characters decoded by a byte order mark, else by the charset of Content-Type,
else by that of a meta tag within the first META_BYTES, else as UTF-8; what
doesn't fit becomes U+FFFD. Digests are of the bytes as they were sent.

A null page is an empty payload, a null url an empty target; their derivatives
are empty too. Repeated pages give equal records. Pages are parsed whole, and
markup that isn't well formed is read as far as it can be. A file that ends
within a record is an error. Columns beside page_id, url and html aren't read;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from codecs import BOM_UTF8, BOM_UTF16_BE, BOM_UTF16_LE, lookup
from collections.abc import Iterator
from typing import IO
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bounded, openable, opened, reading

#: pages have no date of their own
DATE = "2026-01-01T00:00:00Z"
CRLF = "\r\n"

_MARKUP = re.compile(r"<(?:!--|[!?]|(?P<end>/?)(?P<name>[a-z][^\s/>]*+))", re.I)
_GAP = re.compile(r"[\s/]*+")
_NAME = re.compile(r"[^\s/>][^\s/>=]*+")
_IS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
#: elements whose content is no text, with their ends
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+>", re.I) for x in ("script", "style", "template", "noscript", "svg", "iframe")}
# Elements that end a line of text, and attributes that hold links.
BLOCKS = frozenset("address article aside blockquote br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td th thead title tr ul".split())
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "frame": "src", "embed": "src", "source": "src", "form": "action", "base": "href"}
_BLANK = re.compile(r"[^\S\n]+")
#: the first bytes of a page, in which a meta tag may say its charset
META_BYTES = 4096
_META_CHARSET = re.compile(rb"<meta[^>]+?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
# Names of charsets that browsers read as windows-1252.
AS_1252 = frozenset(("iso-8859-1", "latin-1", "latin1", "l1", "ascii", "us-ascii", "iso8859-1"))


class Fields(dict[str, str]):
    """The first value of each named field; `pairs` has all of them in order."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        super().__init__(reversed(pairs))
        self.pairs = pairs


class WarcError(ValueError):
    """A WARC file that ends within a record, or holds none."""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def derived_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"


class _Markup:
    """A page's tags, in one pass from left to right.

    A quoted value goes on to its closing quote, however far that is and
    whatever it holds; where there is none the quote is a character like others.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        #: from where on there is no further quote of a kind
        self.none_from = {"\"": len(page), "'": len(page)}

    def _closing(self, quote: str, at: int) -> int:
        if at >= self.none_from[quote]:
            return -1
        found = self.page.find(quote, at)
        if found < 0:
            self.none_from[quote] = at
        return found

    def attributes(self, at: int, wanted: bool) -> tuple[dict[str, str], int]:
        """The attributes (the first of each name, if wanted) from a tag's name on, and where its text ends; -1 if it has no end."""
        page, found = self.page, {}
        while True:
            at = _GAP.match(page, at).end()
            name = _NAME.match(page, at)
            if not name:
                return found, at + 1 if at < len(page) else -1
            at, value = name.end(), ""
            if sign := _IS.match(page, at):
                at = sign.end()
                quote = page[at : at + 1]
                stop = self._closing(quote, at + 1) if quote in self.none_from else -1
                if stop >= 0:
                    value, at = page[at + 1 : stop], stop + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0].strip("\"'"), bare.end()
            if wanted:
                found.setdefault(name[0].lower(), html.unescape(value))

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, dict[str, str]]]:
        """Start, end, name ('' of comments and raw elements), whether it is an end tag, and attributes of each."""
        page, at, last = self.page, 0, self.page.rfind(">")
        while m := _MARKUP.search(page, at):
            start, name, attrs = m.start(), (m["name"] or "").lower(), {}
            if m[0] == "<!--":
                stop = page.find("-->", m.end())
                at = stop + 3 if stop >= 0 else len(page)
            elif not name:
                stop = page.find(">", m.end())
                at = stop + 1 if stop >= 0 else len(page)
            else:
                # what no ">" follows isn't closed
                attrs, at = self.attributes(m.end(), not m["end"] and (name in LINKS or name == "meta")) if m.end() <= last else ({}, -1)
                if at < 0:
                    at = len(page)
                    name = ""
                elif name in _RAW and not m["end"]:
                    closed = _RAW[name].search(page, at)
                    at, name = closed.end() if closed else len(page), ""
            yield start, at, name, bool(m["end"]), attrs


def parse(page: str, base: str) -> dict:
    """title, metas, links and plain text of a page."""
    text: list[str] = []
    links: list[dict] = []
    metas: list[dict] = []
    title = None
    title_at = anchor = None
    at = 0
    for start, stop, name, end, attrs in _Markup(page):
        if start > at:
            text.append(page[at:start])
        at = stop
        if not name:
            continue
        if name in BLOCKS:
            text.append("\n")
        if end:
            if name == "title" and title_at is not None and title is None:
                title = " ".join(html.unescape("".join(text[title_at:])).split())
            elif name == "a" and anchor is not None:
                links[anchor[0]]["text"] = " ".join(html.unescape("".join(text[anchor[1] :])).split())
                anchor = None
        elif name == "title":
            title_at = len(text)
        elif name == "meta":
            metas.append(dict(sorted(attrs.items())))
        elif name in LINKS and (link := attrs.get(LINKS[name])):
            if name == "base":
                base = _absolute(base, link)
                continue
            links.append({"path": f"{name.upper()}@/{LINKS[name]}", "url": _absolute(base, link)})
            if name == "a":
                anchor = (len(links) - 1, len(text))
    text.append(page[at:])
    plain = _BLANK.sub(" ", html.unescape("".join(text)).replace("\r", "\n"))
    lines = [line for x in plain.split("\n") if (line := x.strip())]
    return {"title": title, "metas": metas, "links": links, "text": "\n".join(lines)}


def _absolute(base: str, link: str) -> str:
    try:
        return urljoin(base, link.strip())
    except ValueError:
        return link


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, url, page in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
            body = (page or "").encode()
            http = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""])
            url = url or ""
            out.append((key, derived_id("response", f"{key} {url}"), url, DATE, None, http, body, digest(body), digest(http.encode() + body)))
        yield _rows(out, _RESPONSE, batch.schema.field("page_id").type)


_RESPONSE = (("page_id", None), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("warc", pa.string()), ("http", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("block_digest", pa.string()))
_DERIVED = (("page_id", None), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("source_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("n_links", pa.int64()), ("block", pa.string()))


def _rows(rows: list[tuple], fields: tuple, key: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t or key) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _ddl(fields: tuple, key: str) -> str:
    names = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "long"}
    return ", ".join(f"{n} {names[t] if t else key}" for n, t in fields)


def pages_as_responses(pages: DataFrame) -> DataFrame:
    """Response records of pages(page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_responses, _ddl(_RESPONSE, pages.schema["page_id"].dataType.simpleString()))


Headers = list[tuple[str, str]]


def headers_of(head: str) -> tuple[str, Headers]:
    """The first line and the named fields in order, repeated ones too; lines that begin with a space go on with the field before."""
    first, *rest = re.split(r"\r?\n", head)
    fields: Headers = []
    for line in rest:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif line.strip():
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return first, fields


def grouped(headers: Headers) -> dict[str, str | list[str]]:
    """Fields by name, in the order of the names' first; a repeated one has the list of its values."""
    out: dict[str, list[str]] = {}
    for name, value in headers:
        out.setdefault(name, []).append(value)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def field(headers: Headers, name: str) -> str:
    """The first field of a name, whatever its case; empty without one."""
    return next((v for k, v in headers if k.lower() == name.lower()), "")


def unchunked(data: bytes) -> bytes:
    """The body of a chunked message, as far as its chunks are whole; data that isn't chunked stays."""
    parts, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(parts) if parts else data
        if size == 0:
            return b"".join(parts)
        parts.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(parts) if parts else data


def body_of(headers: Headers, payload: bytes) -> bytes:
    """The payload without transfer and content encodings; empty if one of them isn't known."""
    if "chunked" in field(headers, "Transfer-Encoding").lower():
        payload = unchunked(payload)
    for encoding in reversed([x.strip().lower() for x in field(headers, "Content-Encoding").split(",") if x.strip()]):
        if encoding in ("gzip", "x-gzip", "deflate"):
            if not payload or encoding != "deflate" and payload[:2] != b"\x1f\x8b":
                continue  # crawlers store bodies decoded, too
            for bits in (47, -15):  # gzip or zlib by its header, else raw
                try:
                    payload = zlib.decompressobj(bits).decompress(payload)
                    break
                except zlib.error:
                    continue
            else:
                return b""
        elif encoding != "identity":
            return b""
    return payload


def text_of(headers: Headers, body: bytes) -> str:
    """A body's characters."""
    for mark, charset in ((BOM_UTF8, "utf-8"), (BOM_UTF16_LE, "utf-16-le"), (BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(charset, "replace")
    said = _CHARSET.search(field(headers, "Content-Type"))
    meta = None if said else _META_CHARSET.search(body[:META_BYTES])
    charset = said[1] if said else meta[1].decode() if meta else "utf-8"
    if meta and charset.lower().startswith("utf-16"):
        charset = "utf-8"  # the tag could not have been read
    charset = "windows-1252" if charset.lower() in AS_1252 else charset
    try:
        if not lookup(charset)._is_text_encoding:
            charset = "utf-8"
    except LookupError:
        charset = "utf-8"
    return body.decode(charset, "replace")


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            status, headers = headers_of(r["http"])
            found = parse(text_of(headers, body_of(headers, r["payload"])), r["target_uri"])
            source = {"WARC-Type": "response", "WARC-Record-ID": r["record_id"], "WARC-Target-URI": r["target_uri"], "WARC-Date": r["date"], "WARC-Payload-Digest": r["payload_digest"], "WARC-Block-Digest": r["block_digest"], "Content-Length": str(len(r["http"].encode("utf-8", "surrogateescape")) + len(r["payload"]))}
            envelope = {
                "Envelope": {
                    "WARC-Header-Metadata": grouped([tuple(x) for x in json.loads(r["warc"])]) if r["warc"] else source,
                    "Payload-Metadata": {
                        "HTTP-Response-Metadata": {
                            "Response-Message": status, "Headers": grouped(headers),
                            "HTML-Metadata": {"Head": {"Title": found["title"], "Metas": found["metas"]}, "Links": found["links"]},
                        }
                    },
                }
            }
            for kind, content, block in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", found["text"])):
                data = block.encode("utf-8", "replace")
                out.append((r["page_id"], kind, derived_id(kind, r["record_id"]), r["record_id"], r["target_uri"], r["date"], content, r["payload_digest"], digest(data), len(data), len(found["links"]), data.decode()))
        yield _rows(out, _DERIVED, batch.schema.field("page_id").type)


def derive(responses: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response."""
    return responses.mapInArrow(_derived, _ddl(_DERIVED, responses.schema["page_id"].dataType.simpleString()))


def record_bytes(kind: str, record_id: str, target: str, date: str, content_type: str, block: bytes, extra: dict[str, str]) -> bytes:
    """One record, as a gzip member of its own."""
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Target-URI": target, "WARC-Date": date, **extra, "WARC-Block-Digest": digest(block), "Content-Type": content_type, "Content-Length": str(len(block))}
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v), "", ""]
    return gzip.compress(CRLF.join(lines).encode() + block + b"\r\n\r\n", mtime=0)


def save(derived: DataFrame, folder: str) -> DataFrame:
    """Write one WARC file for each partition, record by record; returns (file, records). The folder is local to all, or a URI that Arrow opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, n = f"part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        with opened(folder, name) as f:
            for batch in batches:
                for r in batch.to_pylist():
                    f.write(record_bytes(r["record_type"], r["record_id"], r["target_uri"], r["date"], r["content_type"], r["block"].encode(), {"WARC-Refers-To": r["refers_to"], "WARC-Payload-Digest": r["source_digest"]}))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    return derived.mapInArrow(run, "file string, records long")


def records(source: bytes | IO[bytes]) -> Iterator[tuple[Fields, bytes]]:
    """Headers and block of each record of a WARC file, compressed or not, one at a time."""
    f = io.BufferedReader(io.BytesIO(source) if isinstance(source, bytes) else source)
    if f.peek(2)[:2] == b"\x1f\x8b":
        f = io.BufferedReader(gzip.GzipFile(fileobj=f))
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise WarcError(f"no record begins with {line[:40]!r}")
        lines = [line]
        while (line := f.readline()).strip():
            lines.append(line)
        _, headers = headers_of(b"".join(lines).decode("utf-8", "replace"))
        size = int(field(headers, "Content-Length") or 0)
        block = f.read(size)
        if not line or len(block) < size:
            raise WarcError(f"the file ends within the record {field(headers, 'WARC-Record-ID')}: {len(block)} of {size} bytes")
        yield Fields(headers), block


_LOADED = ("file", "record_type", "record_id", "target_uri", "refers_to", "headers", "block")


def _loaded(name: str, source: bytes | IO[bytes]) -> Iterator[pa.RecordBatch]:
    """A file's records in batches of some BATCH_BYTES."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names=list(_LOADED))

    rows, size = [], 0
    for h, b in records(source):
        named = (field(h.pairs, x) or None for x in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Refers-To"))
        rows.append((name, *named, json.dumps(h.pairs, ensure_ascii=False), b))
        size += len(b)
        if size >= BATCH_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def load(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files as (file, record_type, record_id, target_uri, refers_to, headers, block); headers are JSON pairs in order.

    Files that Arrow can open are read record by record; others (stores that
    only Spark reads) come whole, up to 2 GB each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    first = files.select("path").first()
    streamed = first is not None and openable(first.path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch["path"].to_pylist()):
                if streamed:
                    with reading(name) as f:
                        yield from _loaded(name, f)
                else:
                    yield from _loaded(name, batch["content"][i].as_py())

    return files.select("path", *([] if streamed else ["content"])).mapInArrow(run, "file string, record_type string, record_id string, target_uri string, refers_to string, headers string, block binary")


def _taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            warc = [tuple(x) for x in json.loads(r["headers"])]
            # a block that isn't HTTP has no headers of its own
            http = re.search(rb"\r?\n\r?\n", r["block"]) if r["block"][:5] == b"HTTP/" else None
            head, payload = (r["block"][: http.end()], r["block"][http.end() :]) if http else (b"", r["block"])
            block = field(warc, "WARC-Block-Digest") or digest(r["block"])
            out.append((r["record_id"], r["record_id"], r["target_uri"] or "", field(warc, "WARC-Date"), r["headers"], head.decode("utf-8", "replace"), payload, field(warc, "WARC-Payload-Digest") or digest(payload), block))
        yield _rows(out, _RESPONSE, pa.string())


def responses(loaded: DataFrame) -> DataFrame:
    """What derive() reads, of the response records among loaded ones; digests that the file doesn't give are made."""
    rows = loaded.where(F.col("record_type") == "response").select("record_id", "target_uri", "headers", "block")
    return rows.mapInArrow(_taken_apart, _ddl(_RESPONSE, "string"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(pages_as_responses(bounded(spark).read.parquet(f"{sf_dir}/pages.parquet")))


QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL: dict[str, str] = {}
