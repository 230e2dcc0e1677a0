"""Derivatives of hand-written WARC files, and metadata against Python's own HTML parser."""

import gzip
import html.parser
import json
import random
import zlib
from urllib.parse import urljoin

import pytest

from dagspark.llm import warc

CAFE = "<html><head><title>Café “x”</title></head><body><p>café</p><a href='/m?a=1&amp;b'>menü</a></body></html>"


def record(kind, name, block, *more, version="WARC/1.0"):
    head = [version, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2020-02-03T04:05:06Z", *more, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def http(body, *fields, status="HTTP/1.1 200 OK"):
    return "\r\n".join([status, *fields, "", ""]).encode() + body


def chunked(data, size):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(f"{len(p):X};x=y\r\n".encode() + p + b"\r\n" for p in parts) + b"0\r\n\r\n"


def test_responses_of_a_file_become_derivatives(spark, tmp_path):
    latin = CAFE.encode("windows-1252")
    packed = chunked(gzip.compress(CAFE.encode()), 50)
    data = record("warcinfo", "0", b"software: x\r\n")
    data += record("response", "1", http(latin, "Content-Type: text/html; charset=ISO-8859-1", "Set-Cookie: a=1", "set-cookie: c=3", "Set-Cookie: b=2"), "WARC-Target-URI: http://h.example/d/", "WARC-Payload-Digest: sha1:GIVEN", "WARC-Concurrent-To: <urn:uuid:8>", "WARC-Concurrent-To: <urn:uuid:9>")
    data += record("response", "2", http(packed, "Content-Type: text/html", "Content-Encoding: gzip", "Transfer-Encoding: chunked"), "WARC-Target-URI: http://h.example/e")
    data += record("request", "3", b"GET / HTTP/1.1\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record("response", f"z{i}", http(CAFE.encode(), "Content-Type: text/html; charset=utf-8"), f"WARC-Target-URI: http://h.example/{i}")) for i in range(3)))
    found = warc.responses(warc.load(spark, str(tmp_path))).repartition(3)
    got = {(r.refers_to, r.record_type): r for r in warc.derive(found).collect()}
    assert len(got) == 10
    for name in ("1", "2", "z0"):
        text, meta = got[f"<urn:uuid:{name}>", "conversion"], got[f"<urn:uuid:{name}>", "metadata"]
        assert text.block == "Café “x”\ncafé\nmenü"
        assert text.date == "2020-02-03T04:05:06Z"
        body = json.loads(meta.block)["Envelope"]
        seen = body["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert seen["HTML-Metadata"]["Head"]["Title"] == "Café “x”"
        assert seen["HTML-Metadata"]["Links"] == [{"path": "A@/href", "url": "http://h.example/m?a=1&b", "text": "menü"}]
        assert body["WARC-Header-Metadata"]["WARC-Record-ID"] == f"<urn:uuid:{name}>"
    one = json.loads(got["<urn:uuid:1>", "metadata"].block)["Envelope"]
    assert one["WARC-Header-Metadata"]["WARC-Concurrent-To"] == ["<urn:uuid:8>", "<urn:uuid:9>"]
    assert one["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"] == {"Content-Type": "text/html; charset=ISO-8859-1", "Set-Cookie": ["a=1", "b=2"], "set-cookie": "c=3"}
    assert got["<urn:uuid:1>", "conversion"].source_digest == "sha1:GIVEN"
    assert got["<urn:uuid:2>", "conversion"].source_digest == warc.digest(packed)
    folder = str(tmp_path / "out")
    warc.save(warc.derive(found), folder).collect()
    assert {(r.record_id, r.refers_to) for r in warc.load(spark, folder).collect()} == {(r.record_id, r.refers_to) for r in got.values()}


@pytest.mark.parametrize(
    ("fields", "body", "text"),
    [
        ([], "é".encode(), "é"),
        ([("Content-Type", 'text/html; Charset="Windows-1251"')], "да".encode("cp1251"), "да"),
        ([("content-type", "text/html")], b'<meta http-equiv=Content-Type content="text/html; charset=shift_jis">' + "日本".encode("shift_jis"), "日本"),
        ([("Content-Type", "text/html")], b"<META CHARSET='latin1'>\x93x\x94", "“x”"),
        ([("Content-Type", "text/html; charset=utf-16")], b"\xff\xfe" + "ü".encode("utf-16-le"), "ü"),
        ([("Content-Type", "text/html; charset=nonsense")], "ü".encode(), "ü"),
        ([("Content-Type", "text/html; charset=base64")], "ü".encode(), "ü"),
        ([("Content-Type", "text/html; charset=iso-8859-1")], b"\xef\xbb\xbf" + "ü".encode(), "ü"),
        ([], b"\xff", "�"),
    ],
)
def test_charsets(fields, body, text):
    assert warc.parse(warc.text_of(fields, body), "")["text"] == text


def test_encodings():
    data = b"payload " * 50
    for name, packed in (("gzip", gzip.compress(data)), ("x-gzip", gzip.compress(data)), ("deflate", zlib.compress(data)), ("deflate", zlib.compress(data)[2:-4]), ("identity", data), ("gzip", data), ("", data)):
        assert warc.body_of([("Content-Encoding", name)], packed) == data
    assert warc.body_of([("content-encoding", "deflate, gzip")], gzip.compress(zlib.compress(data))) == data
    assert warc.body_of([("Content-Encoding", "br")], data) == b""
    noise = random.Random(1).randbytes(5000)
    assert noise.startswith(cut := warc.body_of([("Content-Encoding", "gzip")], gzip.compress(noise)[:-300]))
    assert len(cut) > 4000
    assert warc.body_of([("Transfer-Encoding", "chunked")], chunked(data, 7)) == data
    assert warc.body_of([("Transfer-Encoding", "chunked")], data) == data
    assert warc.body_of([("Content-Encoding", "gzip")], b"") == b""


def test_cut_files_are_errors(spark, tmp_path):
    whole = record("response", "1", http(b"x" * 100))
    assert len(list(warc.records(whole * 2))) == 2
    for cut in (whole[:-60], whole + whole[:30], whole[: whole.index(b"Content-Length")]):
        with pytest.raises(warc.WarcError, match="ends within"):
            list(warc.records(cut))
    with pytest.raises(EOFError):
        list(warc.records(gzip.compress(whole)[:-20]))
    with pytest.raises(warc.WarcError, match="no record"):
        list(warc.records(b"<html>"))
    (tmp_path / "a.warc").write_bytes(whole[:-60])
    with pytest.raises(Exception, match="ends within"):
        warc.load(spark, str(tmp_path)).count()


def test_folded_and_repeated_fields():
    status, fields = warc.headers_of("HTTP/1.1 200 OK\r\nA: 1\r\n  2\r\nB:3\r\nA: 4\r\n\r\n")
    assert status == "HTTP/1.1 200 OK"
    assert fields == [("A", "1 2"), ("B", "3"), ("A", "4")]
    assert warc.grouped(fields) == {"A": ["1 2", "4"], "B": "3"}


class Page(html.parser.HTMLParser):
    """Title, meta tags and links as Python's parser sees them."""

    def __init__(self, base):
        super().__init__(convert_charrefs=True)
        self.base, self.titles, self.metas, self.links = base, [], [], []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        if tag == "title":
            self.in_title = True
            self.titles.append("")
        elif tag == "meta":
            self.metas.append(first)
        elif first.get(warc.LINKS.get(tag, "-")):
            link = urljoin(self.base, first[warc.LINKS[tag]].strip())
            if tag == "base":
                self.base = link
            else:
                self.links.append((f"{tag.upper()}@/{warc.LINKS[tag]}", link))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.titles[-1] += data


def test_metadata_of_all_pages_equals_another_parser(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    sources = {r.page_id: r for r in pages.collect()}
    rows = warc.derive(warc.pages_as_responses(pages)).where("record_type = 'metadata'").collect()
    assert len(rows) == len(sources)
    linked = 0
    for r in rows:
        source = sources[r.page_id]
        p = Page(source.url)
        p.feed(source.html)
        got = json.loads(r.block)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
        assert got["Head"]["Title"] == (" ".join(p.titles[0].split()) if p.titles else None)
        assert got["Head"]["Metas"] == [dict(sorted(m.items())) for m in p.metas]
        assert [(x["path"], x["url"]) for x in got["Links"]] == p.links
        assert r.n_links == len(p.links)
        linked += len(p.links)
    assert linked > 100
