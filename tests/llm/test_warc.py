import base64
import hashlib

import zstandard

from fathomix.llm import warc as Z
from fathomix.llm.common import new_path


def brute(rows, least=0):
    groups = {}
    for i, h in rows:
        p = (h or "").encode()
        if len(p) >= least:
            groups.setdefault(p, []).append(i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        kept = max((x for x in groups.get(p, [])if x is not None), default=None)
        revisit = len(groups.get(p, [])) > 1 and kept is not None and i != kept
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", kept if revisit else None))
    return sorted(out, key=repr)


ROWS = [(1, "<html>é</html>"), (2, None), (3, ""), (4, "<html>é</html>"), (5, "x" * 3_000_000), (6, "line\r\n\r\nWARC/1.1\r\n\r\n"), (7, "only"), (8, "<html>é</html>"), (None, "null id"), (9, "only"), (9, "only"), (10, "<html>é</html>\u0000")]


def test_cases(spark):
    df = spark.createDataFrame([(i, None if i == 7 else "http://a/\r\nb", h, 3) for i, h in ROWS], "page_id long, url string, html string, payload_bytes int")
    for least in (0, 5):
        got = sorted((tuple(r) for r in Z.archive_pages(df, least).collect()), key=repr)
        assert got == brute(ROWS, least)


def test_heavy_payloads_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(Z, "heavy_from", lambda total: 4)
    rows = [(i, "the hot page") for i in range(40)] + [(i, f"page {i % 30}") for i in range(40, 100)] + [(100 + i, None) for i in range(9)] + [(200, "single")]
    df = spark.createDataFrame([(i, "u", h, "x", 1) for i, h in rows], "page_id long, url string, html string, sha1 string, kept int")
    for least in (0, 1):
        assert sorted((tuple(r) for r in Z.archive_pages(df, least).collect()), key=repr) == brute(rows, least)


def test_seek(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 20_000) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    manifest = Z.write_bundles(df, new_path(spark, "warc")).collect()
    for m in manifest:
        reader = Z.BundleReader(m.uri)
        for page_id in reader.index:
            fields, block = reader.fetch(page_id)
            assert fields["WARC-Record-ID"] == f"<urn:page:{page_id}>"
            assert block.endswith(f"page {page_id} ".encode())
        assert reader.n_frames > 1 or m.n_records < 10
        # Any Zstandard reader takes the file: skippable frames are skipped.
        with open(m.uri.removeprefix("file://"), "rb") as f:
            whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == m.n_records


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert Z.archive_pages(none).count() == 0
    assert Z.write_bundles(none, new_path(spark, "warc")).count() == 0
