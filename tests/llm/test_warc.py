import base64
import hashlib
import io
import random
import zipfile

import pytest
from pyarrow import fs

from menurank.llm import warc


def plain(rows, least=0):
    last = {}
    for i, _, h in rows:
        p = (h or "").encode()
        last.setdefault(p, []).append(i)
    top = {p: max(ids, key=lambda i: (i is not None, i or 0)) for p, ids in last.items()}
    out = []
    for i, u, h in rows:
        p = (h or "").encode()
        kind = "revisit" if len(p) >= least and i != top[p] else "response"
        out.append((i, u, kind, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), top[p] if kind == "revisit" else None, None if kind == "revisit" else p))
    return sorted(out, key=str)


def pages(n=200):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 3}/ü\n{i}", f"<p>{rng.choice(['a', 'é', 'copy'])}{rng.randint(0, 40)}</p>\r\n\r\n") for i in range(n)]
    return rows + [(n, None, None), (n + 1, "", ""), (n + 2, "x", "y" * 300_000), (5, "again", rows[5][2]), (n + 2, "x", "y" * 300_000), (None, "u", "z"), (None, "u", "z"), (n + 3, "u", "only WARC/1.1\r\n\r\n\x00" + "PK\x05\x06" * 9)]


def read(spark, rows, **options):
    df = spark.createDataFrame([(*r, "?", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int").repartition(3)
    return sorted((tuple(x if not isinstance(x, bytearray) else bytes(x) for x in r) for r in warc.archive_pages(df, **options).collect()), key=str)


@pytest.mark.parametrize(("least", "package"), [(0, 1 << 28), (9, 2000)])
def test_round_trip(spark, least, package):
    assert read(spark, pages(), least_bytes=least, package_bytes=package) == plain(pages(), least)


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ranges_of_a_package(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    made = warc.write_packages(df, str(tmp_path))
    path = made.first()["path"]
    assert made.count() == 1 and not any(i.compress_type for i in zipfile.ZipFile(path).infolist())
    for span_bytes in (1, 5000, 1 << 30):
        got = warc.read_packages(made, span_bytes=span_bytes)
        assert sorted((tuple(x if not isinstance(x, bytearray) else bytes(x) for x in r) for r in got.collect()), key=str) == plain(pages())
    with fs.LocalFileSystem().open_input_file(path) as file:
        found = list(warc.spans(file, file.size(), 5000))
        assert sum(s.records for s in found) == len(pages()) and len(found) > 3
        (own,) = [m for m in warc.stored_members(file, file.size(), ("archive/",))]
        assert sum(s.size for s in found) == own.size and found[0].begin == own.begin
    assert warc.read_packages(made, payloads=False).where("payload IS NOT NULL").count() == 0


def zipped(members, method=zipfile.ZIP_STORED, comment=b""):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", method) as z:
        for name, body in members:
            z.writestr(name, body)
        z.comment = comment
    return data


def gz(*records):
    import gzip

    return b"".join(gzip.compress(r) for r in records)


def one(page, payload):
    return warc.record("response", page, "u", payload, warc.base32_sha1(payload), None, warc.DATE)


def test_directories_against_zipfile(monkeypatch):
    rng = random.Random(4)
    for full in (False, True):
        if full:  # all that passes these bounds goes to ZIP64's fields
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
        for comment in (b"", b"PK\x05\x06" * 20, bytes(rng.randrange(256) for _ in range(65535))):
            members = [(f"archive/é{i}.warc.gz", bytes(rng.randrange(256) for _ in range(rng.randint(0, 60)))) for i in range(8)] + [("other/x", b"PK\x01\x02"), ("indexes/", b"")]
            data = zipped(members, comment=comment)
            got = warc.stored_members(data, len(data.getvalue()), ("archive/",))
            assert [m.name for m in got] == [n for n, _ in members[:8]]
            assert [data.getvalue()[m.begin : m.begin + m.size] for m in got] == [b for _, b in members[:8]]
            assert (b"PK\x06\x06" in data.getvalue()) >= full


def test_without_index_and_damage():
    body = gz(one(1, b"a"), one(2, b"b" * 50))
    data = zipped([("archive/x.warc.gz", body), ("archive/y.warc.gz", gz(one(3, b"")))])
    found = [warc.parse(r)[0] for s in warc.spans(data, len(data.getvalue()), 10) for r in warc.gzip_members(data, s.begin, s.size, piece=7)]
    assert found == [1, 2, 3]
    for bad, say in ((b"PK", "not a ZIP"), (zipped([("archive/x.warc.gz", body)], zipfile.ZIP_DEFLATED).getvalue(), "stored"), (zipped([("archive/x.warc.gz", b"x")]).getvalue().replace(b"PK\x01\x02", b"PK\x01\x09"), "damaged")):
        with pytest.raises(ValueError, match=say):
            list(warc.spans(io.BytesIO(bad), len(bad), 10))
    with pytest.raises(ValueError, match="within a record"):
        list(warc.gzip_members(io.BytesIO(body), 0, len(body) - 3))
    whole = one(1, b"payload")
    for wrong, say in ((whole.replace(b"payload", b"PAYLOAD"), "digest"), (whole[:-5], "long"), (b"x" + whole, "not a WARC")):
        with pytest.raises(ValueError, match=say):
            warc.parse(wrong)
