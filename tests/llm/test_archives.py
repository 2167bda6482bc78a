import gzip
import hashlib

import pytest

from geolens.llm import archives as A

SCHEMA = "page_id long, url string, html string, date string"
LONG = "x" * 120
ROWS = [(3, "http://a/", LONG), (1, "http://b/ c\n", LONG), (2, None, LONG), (4, "http://d/", "short"), (5, "http://e/", "short"), (6, "", None), (7, "http://f/", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"),
        (8, "http://g/", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (None, "http://h/", LONG), (9, "http://i/", "\n" * 99), (10, "http://i/", "\n" * 100), (11, "http://i/", "\n" * 100), (12, "http://k/", "y" * 3_000_000)]


def plain(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        revisit = len(payload) >= 100 and page_id != min(same, default=None)
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows, chunk", [(16, 4 << 20), (2, 200), (1, 1)])
def test_round_trip(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(A, "ROWS", rows)
    monkeypatch.setattr(A, "CHUNK", chunk)
    frame = spark.createDataFrame([(*r, "own") for r in ROWS], SCHEMA).repartition(3)
    assert sorted(map(tuple, A.round_trip(frame).collect()), key=repr) == plain(ROWS)
    monkeypatch.setattr(A, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, A.round_trip(frame).collect()), key=repr) == plain(ROWS)
    assert A.round_trip(frame.limit(0)).count() == 0


def test_files_are_bounded_by_size(spark, tmp_path):
    """Forty pages of a million characters in one task: files of about 64 MB would hold them all, files of 4 rows don't."""
    pages = spark.range(0, 40, 1, 1).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id % 10 AS string), 1000000) AS html", "'' AS date")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(A, "ROWS", 4)
        patch.setattr(A, "CHUNK", 2_000_000)
        A.write_arc(pages, str(tmp_path / "arc"))
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "arc").glob("part-*")]
    assert len(sizes) == 5 and max(sizes) < 4 * 3_000_000 + 10_000 and sum(sizes) > 40_000_000
    assert A.read_arc(spark, str(tmp_path / "arc"), payloads=False).count() == 40


def test_repeated_rows_are_a_response_and_its_revisits(spark):
    got = A.round_trip(spark.createDataFrame([(1, "u", LONG, "")] * 3, SCHEMA)).collect()
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["refers_to"]) == [("revisit", 1)] * 2
    assert sum(r["record_type"] == "response" for r in got) == 1


def arc(version, lines):
    about = f"{version} 0 test\n{A._V1 if version == 1 else A._V2}\n"
    tail = "" if version == 1 else " 200 - - 0 f.arc"
    out = f"filedesc://f.arc 0.0.0.0 19990101000000 text/plain{tail} {len(about)}\n{about}\n".encode()
    for url, date, kind, body in lines:
        out += f"{url} 1.2.3.4 {date} {kind}{tail} {len(body)}\n".encode() + body + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_foreign_archives(spark, tmp_path, version):
    """Other hands' archives: other schemes, short dates, bytes that aren't UTF-8, plain and compressed files."""
    head = b"HTTP/1.0 200 OK\r\nContent-Type: image/gif\r\n\r\n"
    lines = [("http://a b/", "20010203040506", "text/html", head + b"\xff\xfe\x00" * 50), ("dns:a", "2001", "text/dns", b"a 1.2.3.4"), ("http://c/", "20010203040506", "text/html", b"no head")]
    (tmp_path / "arc").mkdir()
    data = arc(version, lines)
    (tmp_path / "arc" / "part-1.arc").write_bytes(data)
    (tmp_path / "arc" / "part-2.arc.gz").write_bytes(gzip.compress(data[:200]) + gzip.compress(data[200:]))
    records = A.read_warc(spark, A.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc")), payloads=True).collect()
    assert len(records) == 6 and len({r["record_id"] for r in records}) == 6
    got = {(r["uri"], r["date"], r["record_type"], r["payload"] and bytes(r["payload"])) for r in records}
    assert got == {
        ("http://a b/", "2001-02-03T04:05:06Z", "response", b"\xff\xfe\x00" * 50), ("http://a b/", "2001-02-03T04:05:06Z", "revisit", None),
        ("dns:a", "2001-01-01T00:00:00Z", "resource", b"a 1.2.3.4"), ("http://c/", "2001-02-03T04:05:06Z", "response", b"no head"),
    }


def test_damaged_archives_are_refused():
    with pytest.raises(ValueError):
        list(A._arc_records(arc(1, [("http://a/", "2001", "text/html", b"abc")])[:-3]))
    with pytest.raises(ValueError):
        list(A._warc_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
