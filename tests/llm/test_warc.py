import gzip
import hashlib
import io

import pytest

from plainfold.llm import warc


def test_both_versions_are_parsed_by_declared_length():
    body = b"HTTP/1.1 200 OK\r\n\r\nhttp://x/ 1.2.3.4 20200101000000 text/html 5\nabc\n"
    for version in (1, 2):
        data = warc.arc_record(version, "http://a/", "text/html; charset=utf-8", body) * 2
        assert [(h["url"], h["type"], b) for h, b in warc.parse_arc(data, version)] == [("http://a/", "text/html; charset=utf-8", body)] * 2
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a/ 0.0.0.0 20200101000000 text/html 50\nshort\n", 1))
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_record(1, "u", "t", b"x"), 2))


def test_record_ids_hold_the_row():
    for row in (0, 1, -1, 2**63 - 1, -(2**63), 12345):
        id_ = warc.record_id(row)
        assert warc.row_of(id_) == row and len(id_) == len("<urn:uuid:>") + 36


def test_round_trip(spark):
    nasty = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3 + "é"
    rows = [(1, "http://a b/\n", nasty), (2, None, nasty), (0, "http://é/", "x" * 99), (9, "u", "x" * 99), (3, "", None), (4, "u", ""), (5, "u", "y" * 200_000), (7, "u", "y" * 200_000), (-6, "u", "y" * 200_000), (None, "u", nasty), (5, "u", "y" * 200_000)]
    got = {r.page_id: r for r in warc.convert(spark.createDataFrame([(*r, b"z") for r in rows], "page_id long, url string, html string, block binary"), records=2).collect()}
    want = {i: (t or "").encode() for i, _, t in rows if i is not None}
    assert set(got) == set(want)
    for i, data in want.items():
        same = min(j for j, x in want.items() if x == data) if len(data) >= 100 else i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "response" if same == i else "revisit", None if same == i else same)


def test_empty_table(spark):
    assert warc.convert(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_broken_archives():
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    data = warc.warc_record(7, {"date": "2020", "url": "http://a/", "ip": "1.2.3.4"}, block, None)
    (head, got), (_, again) = warc.parse_warc(io.BytesIO(data * 2))
    assert got == again == block and head["warc-date"] == "2020-01-01T00:00:00Z" and warc._row(head, got)[:2] == (7, 3)
    for bad in (data[:-10], data[:40], b"x" + data):
        with pytest.raises(ValueError):
            list(warc.parse_warc(io.BytesIO(bad)))
    with pytest.raises(ValueError):
        warc._row(head, got + b"!")


def arc(version, *records, name="x.arc"):
    return warc.version_block(version, name) + b"".join(records)


def test_version_blocks_name_the_fields():
    body = b"HTTP/1.1 200 OK\r\n\r\nfiledesc://no 0.0.0.0 20200101000000 text/plain 3\nabc"
    for version in (1, 2):
        data = arc(version, *[warc.arc_record(version, "http://a/", "text/html; charset=utf-8", body, "1.2.3.4", "2001")] * 2)
        assert [(h["url"], h["ip"], h["date"], h["type"], b) for h, b in warc.read_arc(io.BytesIO(data))] == [("http://a/", "1.2.3.4", "2001", "text/html; charset=utf-8", body)] * 2
        assert list(warc.read_arc(io.BytesIO(arc(version)))) == []
    fields = b"1 0 me\nURL Archive-date Content-type IP-address Archive-length\n"
    other = b"filedesc://y 2001 text/plain 0.0.0.0 %d\n%s\n" % (len(fields), fields)
    (head, got), = warc.read_arc(io.BytesIO(other + b"http://b/ 1999 text/html 9.9.9.9 3\nabc\n"))
    assert (head["ip"], head["date"], got) == ("9.9.9.9", "1999", b"abc")
    assert list(warc.read_arc(io.BytesIO(b""))) == []
    one, two = warc.arc_record(1, "u", "t", b"x"), warc.arc_record(2, "u", "t", b"x")
    for bad in (one, arc(1, two)[:-3], arc(2, one), arc(1).replace(b"1 0", b"7 0"), arc(1).replace(b"URL", b"ULR"), arc(1, one[:-4]), arc(1)[:-9]):
        with pytest.raises(ValueError):
            list(warc.read_arc(io.BytesIO(bad)))


def test_arc_files_become_warc_files(spark, tmp_path):
    page = lambda text: b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + text
    one = [warc.arc_record(1, f"http://a/{i}", "text/html", page(b"a" * 150 if i % 2 else b"%d" % i), "1.2.3.4", "19970203040506") for i in range(6)]
    two = [warc.arc_record(2, f"http://b/{i}", "text/html", page(b"a" * 150 + b"b" * (i // 2) * (1 << 16))) for i in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.arc").write_bytes(arc(1, *one))
    (tmp_path / "in/two.arc.gz").write_bytes(b"".join(map(gzip.compress, [arc(2), *two])))  # a member for each record
    (tmp_path / "in/empty.arc").write_bytes(b"")
    records = warc.read_arcs(spark, str(tmp_path / "in"))
    warc.write_archives(records, str(tmp_path / "out"))
    got = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert sorted(r.uri for r in got) == sorted([f"http://a/{i}" for i in range(6)] + [f"http://b/{i}" for i in range(4)])
    same = [r for r in got if r.payload_bytes == 150]
    first = min(r.page_id for r in same)
    assert len(same) == 5 and all((r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first)) for r in same)
    assert sorted(r.payload_bytes for r in got if r.payload_bytes != 150) == [1, 1, 1, 150 + (1 << 16), 150 + (1 << 16)]
    text = "".join(gzip.decompress(p.read_bytes()).decode() for p in (tmp_path / "out").rglob("*.gz"))
    assert "WARC-Date: 1997-02-03T04:05:06Z" in text and "WARC-IP-Address: 1.2.3.4" in text and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["class0", "class1"]
