"""Seekable Zstandard bundles of WARC records.

A task writes its pages to bundle files in the shared folder: records are grouped into
independent frames of about ``FRAME_BYTES``, and the file ends with a seek table in a skippable
frame (the seekable format of Zstandard). The index maps every record identifier
to (bundle, frame, offset within the frame). To read a record, the frame is found through the
bundle's footer, and only that frame is read and decompressed. A bundle is written under a name of its
task attempt, so a task that runs again leaves what the index names intact.

Records follow WARC/1.1: a response holds the HTTP headers and the payload, a revisit the headers
alone, and names the response by its record identifier, URI and date. Identifiers
are made from the page id and the row (UUID version 8), so a page's identifier is known
before anything is written. Dates are those of the run.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the
smallest page id is a response and the others revisit it. Payloads are matched by their
SHA-256; only digests, ids and addresses are grouped, and the payloads are dealt by row, so that a payload
in a third of all rows makes no large task.

Defined results: a null html is an empty payload; a very long one is a frame of its own; a null page id
sorts last and has no page id on reading; a null or empty address is written as the record's
identifier, and control characters in one are left out; repeated rows of one id and payload (ties) give one
response, the others revisit it; an empty table gives no bundles; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchback.llm.skew import join_by_key
from switchback.storage import materialize, new_path, table

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id bigint, bundle string, frame int, offset bigint, length bigint"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: sizes of each frame, compressed and not."""
    body = b"".join(struct.pack("<II", packed, plain) for packed, plain in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """The frames' (compressed, plain) sizes, from the last bytes of a bundle."""
    count, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    return [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (count - k)) for k in range(count)]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """A UUID of version 8: whether the page has an id, the id, and 57 bits of the row's number."""
    custom = (page_id is not None) << 121 | ((page_id or 0) % (1 << 64)) << 57 | row % (1 << 57)
    return str(uuid.UUID(int=custom >> 74 << 80 | 8 << 76 | (custom >> 62) % (1 << 12) << 64 | 2 << 62 | custom % (1 << 62)))


def page_of(record: str) -> int | None:
    """The page id within a record identifier."""
    value = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int
    custom = value >> 80 << 74 | (value >> 64) % (1 << 12) << 62 | value % (1 << 62)
    page = (custom >> 57) % (1 << 64)
    return None if not custom >> 121 else page - (1 << 64 if page >> 63 else 0)


def _address(url: str | None, record: str) -> str:
    return "".join(c for c in url or "" if c >= " ") or f"urn:uuid:{record}"  # a header is one line


def record(name: str, url: str | None, date: str, payload: bytes, digest: str, refers_to: str | None = None, refers_url: str | None = None) -> bytes:
    """A response, or a revisit of the record ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_address(url, name)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers_to}>", f"WARC-Refers-To-Target-URI: {_address(refers_url, refers_to)}", f"WARC-Refers-To-Date: {date}"]
    block = http if refers_to else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload); a revisit has an empty payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, _fields(http), payload


class _Bundle:
    """One archive file; frames are closed at ``FRAME_BYTES``."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES):
        from pyarrow import fs
        from zstandard import ZstdCompressor

        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = self.system.open_output_stream(f"{path}/{self.path.rpartition('/')[2]}", compression=None)
        self.frame_bytes = frame_bytes
        self.compress = ZstdCompressor(level=3).compress
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.waiting, self.rows, self.start = bytearray(), [], [], 0

    def add(self, record_id: str, page_id: int | None, raw: bytes) -> None:
        self.waiting.append((record_id, page_id, len(self.buffer), len(raw)))
        self.buffer += raw
        if len(self.buffer) >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.buffer:
            packed = self.compress(bytes(self.buffer))
            self.out.write(packed)
            self.rows += [(rid, page, self.path, len(self.frames), at, n) for rid, page, at, n in self.waiting]
            self.frames.append((len(packed), len(self.buffer)))
            self.start += len(packed)
            self.buffer, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self.end_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.rows


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    names = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, kinds[kind]) for column, (_, kind) in zip(zip(*rows, strict=True), names, strict=True)], [name for name, _ in names])


def _write(folder: str, date: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for uid, page_id, url, html, first in zip(*batch.columns, strict=True):
                bundle = bundle or _Bundle(folder, frame_bytes)
                page, payload, other = page_id.as_py(), (html.as_py() or "").encode(), first.as_py()
                name = record_id(page, uid.as_py())
                refers = (record_id(other["page_id"], other["uid"]), other["url"]) if other else ()
                bundle.add(name, page, record(name, url.as_py(), date, payload, payload_digest(payload), *refers))
                if bundle.start >= bundle_bytes:
                    yield _batch(bundle.close(), INDEX)
                    bundle = None
        if bundle is not None:
            yield _batch(bundle.close(), INDEX)

    return run


def deduplicated(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(uid, page_id, url, html, first): ``first`` is the page that a revisit refers to, else null."""
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = materialize(rows, "warc-pages")  # all that follows must see the same uid
    keyed = rows.where(F.octet_length("html") >= min_bytes).select("uid", "page_id", "url", F.sha2(F.encode("html", "utf-8"), 256).alias("digest"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid", "url")
    groups = materialize(keyed.groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1"), "warc-groups")
    revisits = join_by_key(keyed.select("uid", "digest"), groups, "digest", "n").where("first.uid <> uid").select("uid", "first")
    return rows.join(revisits, "uid", "left").select("uid", "page_id", "url", "html", "first")


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write all pages below ``folder`` and return the written index of records."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return materialize(deduplicated(pages, id_col, url_col, html_col, min_bytes).mapInArrow(_write(folder, date, frame_bytes, bundle_bytes), INDEX), "warc-index")


def _open(bundle: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(bundle)
    return system.open_input_file(path)


@lru_cache(256)
def frames_of(bundle: str) -> list[tuple[int, int]]:
    """(start, size) of each frame, from the bundle's footer."""
    with _open(bundle) as source:
        size = source.size()
        source.seek(size - 9)
        count = struct.unpack("<I", source.read(9)[:4])[0]
        source.seek(max(0, size - 9 - 8 * count))
        table = read_seek_table(source.read())
    ends = [0]
    for packed, _ in table:
        ends.append(ends[-1] + packed)
    return [(start, packed) for start, (packed, _) in zip(ends, table, strict=False)]


def fetch(bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record, by its row of the index."""
    return next(_records(bundle, frame, [(offset, length)]))


def _records(bundle: str, frame: int, spans) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    from zstandard import ZstdDecompressor

    start, size = frames_of(bundle)[frame]
    with _open(bundle) as source:
        source.seek(start)
        plain = ZstdDecompressor().decompress(source.read(size))
    for offset, length in spans:
        yield parse_record(plain[offset : offset + length])


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            out = []
            for fields, http, payload in _records(row["bundle"], row["frame"], [(s["offset"], s["length"]) for s in row["spans"]]):
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                if fields["WARC-Type"] == "response" and (payload_digest(payload), len(payload)) != (digest, size):
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {row['bundle']}")
                first = fields.get("WARC-Refers-To")
                out.append((page_of(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], first and page_of(first)))
            yield _batch(out, READ)


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of an index, read from their bundles frame by frame through the footers; payloads of
    responses are held against their digests."""
    return index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "length")).alias("spans")).mapInArrow(_read, READ)


def op8_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"), new_path(spark, "warc")))


_B32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')"
_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS f, row_number() OVER (PARTITION BY t ORDER BY page_id) AS k FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to FROM r
"""

QUERIES = {"op8_seekable_warc": op8_seekable_warc}
ORACLE_SQL = {"op8_seekable_warc": _SQL}
