import base64
import hashlib
import re

from zstandard import ZstdDecompressor

from switchback.llm import warc as A
from switchback.storage import new_path

PAGES = "page_id bigint, url string, html string, digest string, first int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(3)


def test_round_trip(spark):
    html = [f"<p>é {k % 7}</p>\r\n\r\n" * (k % 5) for k in range(60)]
    rows = [(k, f"http://x/{k}", h) for k, h in enumerate(html)] + [(100, None, None), (101, "u\r\nX: y", "z" * 3_000_000), (3, "again", html[3]), (None, "n", html[1])]
    index = A.write_bundles(pages_of(spark, rows), new_path(spark, "t"), frame_bytes=500, bundle_bytes=900)
    got = A.read_bundles(index).collect()
    least = {}
    for page, _, h in rows:
        if page is not None:
            least[h or ""] = min(page, least.get(h or "", page))
    assert len(got) == len(rows)
    want = sorted((str(p), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for p, _, h in rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == want
    text = {p: h or "" for p, _, h in rows}
    responses = [r for r in got if r["record_type"] == "response"]
    assert sorted(r["page_id"] for r in responses) == sorted(least.values())
    assert all(r["refers_to"] == least[text[r["page_id"]]] for r in got if r["record_type"] == "revisit")
    assert all(r["refers_to"] is None for r in responses)

    rows = index.collect()
    assert len({r["bundle"] for r in rows}) > 3 and max(r["frame"] for r in rows) > 0
    for r in rows[::9]:  # random access, and each frame stands on its own
        fields, http, payload = A.fetch(r["bundle"], r["frame"], r["offset"], r["length"])
        assert fields["WARC-Record-ID"] == f"<urn:uuid:{r['record_id']}>" and A.page_of(r["record_id"]) == r["page_id"]
        assert http["Content-Length"] == str(len(text[r["page_id"]].encode())) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        if fields["WARC-Type"] == "revisit":
            assert payload == b"" and fields["WARC-Refers-To"][10:-1] in {x["record_id"] for x in rows} and fields["WARC-Refers-To-Date"] and fields["WARC-Profile"] == A.PROFILE
        else:
            assert payload.decode() == text[r["page_id"]] and "WARC-Refers-To" not in fields
    for bundle in {r["bundle"] for r in rows}:  # each record is where the index says, and nothing else is there
        raw = open(bundle.removeprefix("file://"), "rb").read()
        plain = [ZstdDecompressor().decompress(raw[a : a + n]) for a, n in A.frames_of(bundle)]
        spans = sorted((r["frame"], r["offset"], r["offset"] + r["length"]) for r in rows if r["bundle"] == bundle)
        assert all(b[1] == (a[2] if a[0] == b[0] else 0) for a, b in zip(spans, spans[1:], strict=False))
        assert {f: max(e for g, _, e in spans if g == f) for f, *_ in spans} == {f: len(p) for f, p in enumerate(plain)}
        assert all(p.startswith(b"WARC/1.1\r\n") for p in plain)
    raw = open(rows[0]["bundle"].removeprefix("file://"), "rb").read()
    at = 0
    for packed, plain in A.read_seek_table(raw):
        assert len(ZstdDecompressor().decompress(raw[at : at + packed])) == plain
        at += packed
    assert raw[at:] == A.seek_table(A.read_seek_table(raw))


def test_small_payloads_and_no_rows(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "c", "long enough"), (4, "d", "long enough")]
    got = A.read_bundles(A.write_bundles(pages_of(spark, rows), new_path(spark, "t"), min_bytes=5)).collect()
    assert {r["page_id"]: r["record_type"] for r in got} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert A.read_bundles(A.write_bundles(pages_of(spark, rows).limit(0), new_path(spark, "t"))).count() == 0


def test_identifiers():
    pages = [None, 0, 1, -1, 2**63 - 1, -(2**63), 12345]
    names = {A.record_id(page, row): page for page in pages for row in (0, 1, 2**57 - 1)}
    assert len(names) == 3 * len(pages) and all(A.page_of(f"<urn:uuid:{name}>") == page for name, page in names.items())
    assert all(name[14] == "8" and name[19] in "89ab" for name in names)
