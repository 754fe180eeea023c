"""Removal of repeated long substrings with a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too.

1. Every window of ``LENGTH`` bytes has a key, the least hash of its k-grams; equal windows have
   equal keys. A run of windows with one key is a segment (about 1 % as many as bytes). Keys of one
   segment only cannot repeat; the text of all other segments is dealt by key. Hashes
   decide only where text goes; whether strings are equal is decided on their bytes.
2. In a task, segments come in batches. Each batch gets a suffix array (of suffixes cut at
   ``LENGTH`` bytes) by prefix doubling; levels of like size merge geometrically, which finds
   their matches and keeps one suffix of each, and the larger levels are merge-scanned for matches
   (all levels for the last batch of a family, which is not merged). Keys come in order, so a
   family ends between two keys once it holds ``FAMILY_WINDOWS``.
3. Equal segments are combined in the task that reads them, before the shuffle. A key of over ``HOT_SEGMENTS``
   segments is split further by content: by the place of its least k-gram in the window, and where
   that is not enough also by a hash of the window; equal windows stay together.
4. Matches are joined to the documents that hold their segments and cut out.

Defined results: a null text is empty; a text under ``LENGTH`` bytes keeps all; repeated
rows are copies of each other, each with its own result; matches never cross documents; a very long
text is read in blocks of ``BLOCK`` bytes that overlap, with the same result; of equal strings (ties) none
is spared, as every one starts elsewhere too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchback.llm.skew import join_by_key
from switchback.storage import discard, materialize, table

LENGTH, GRAM, RUN = 200, 16, 1024
BLOCK, COMBINE_BYTES, HOT_SEGMENTS = 1 << 17, 1 << 25, 8192
BATCH_WINDOWS, FAMILY_WINDOWS, TASK_WINDOWS = 1 << 17, 1 << 19, 1 << 24
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M[3]
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: bytes) -> np.ndarray:
    n = len(data)
    words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    return _mix(words[: n - 15] * _M[0] ^ (words[8:] + _M[2]) * _M[1])


def window_keys(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The key of each window of ``data`` (at least ``length`` bytes), and the hash of each k-gram."""
    width, h = length - GRAM + 1, gram_hashes(data)
    least, held = h, 1  # the least of each ``held`` hashes in a row
    while held < width:
        step = min(held, width - held)
        least, held = np.minimum(least[:-step], least[step:]), held + step
    return least, h


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, key, start, windows, repeats) of the segments of all ``texts``. ``repeats`` is
    true if windows within the segment may be equal to each other: its least k-gram occurs twice."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = b"".join(texts)
    if len(data) < length:
        return tuple(np.empty(0, kind) for kind in (np.int64, np.uint64, np.int64, np.int64, bool))
    keys, h = window_keys(data, length)
    counts = np.maximum(sizes - length + 1, 0)
    firsts = ends - sizes
    some = counts > 0
    new = np.ones(len(keys) + 1, bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:-1])
    new[firsts[some]] = new[(firsts + counts)[some]] = True
    bounds = np.flatnonzero(new)
    first, long = bounds[:-1], np.diff(bounds)
    text = np.searchsorted(ends, first, side="right")
    inside = first - firsts[text] < counts[text]  # windows inside one text
    first, long = first[inside], long[inside]
    parts = -(-long // RUN)
    at = _ranges(np.zeros(len(parts), np.int64), parts) * RUN
    start = at + np.repeat(first, parts)
    windows = np.minimum(np.repeat(long, parts) - at, RUN)
    key = keys[start]
    spread = windows + length - GRAM
    equal = h[_ranges(start, spread)] == np.repeat(key, spread)
    repeats = np.add.reduceat(equal, np.cumsum(spread) - spread, dtype=np.int64) > 1 if len(first) else np.empty(0, bool)
    text = np.searchsorted(ends, start, side="right")
    return text, key, start - firsts[text], windows, repeats


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(uid, offset, text) of texts or blocks of them, about ``BLOCK`` bytes at a time."""
    uids, offsets, texts, held = [], [], [], 0
    for batch in batches:
        for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py().encode()
            for base in range(0, len(raw) - LENGTH + 1, BLOCK):
                uids.append(uid)
                offsets.append(base)
                texts.append(raw[base : base + BLOCK + LENGTH - 1])
                held += len(texts[-1])
                if held >= BLOCK:
                    yield uids, offsets, texts
                    uids, offsets, texts, held = [], [], [], 0
    if texts:
        yield uids, offsets, texts


def _emit_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for uids, offsets, texts in _blocks(batches):
        text, key, start, windows, repeats = segments(texts)
        arrays = [np.array(uids, np.int64)[text], key.view(np.int64), start + np.array(offsets, np.int64)[text], windows.astype(np.int32), repeats]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["uid", "key", "start", "windows", "repeats"])


def pieces(body: bytes, key: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, start, text) of a segment of a hot key, whose windows go to different parts."""
    h = gram_hashes(body)
    windows = len(body) - LENGTH + 1
    least = np.flatnonzero(h == np.uint64(key % (1 << 64)))
    place = least[np.searchsorted(least, np.arange(windows))] - np.arange(windows)
    width = LENGTH - GRAM + 1
    part = place // -(-width // min(parts, width))
    if parts > width:
        hashes = np.array([int.from_bytes(hashlib.blake2b(body[t : t + LENGTH], digest_size=8).digest(), "little") for t in range(windows)], np.uint64)
        part = part + width * (hashes % np.uint64(-(-parts // width))).astype(np.int64)
    bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield int(part[a]), a, body[a : b + LENGTH - 1]


def _held_pieces(text: pa.Scalar, found: pa.Scalar) -> Iterator[tuple[int, int, int, bytes]]:
    raw = text.as_py().encode()
    for c in found.as_py():
        key, start, parts = c["key"], c["start"], c["parts"]
        body = raw[start : start + c["windows"] + LENGTH - 1]
        if parts == 1:
            yield key, 0, start, body
        else:
            for part, at, piece in pieces(body, key, parts):
                yield key, part, start + at, piece


def digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, found) → (key, part, body, n); equal pieces of this task are combined."""

    def out():
        columns = list(zip(*held, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], pa.array(list(held.values()), pa.int64())], ["key", "part", "body", "n"])

    held, size = {}, 0
    for batch in batches:
        for text, found in zip(*batch.columns, strict=True):
            for key, part, _, body in _held_pieces(text, found):
                row = key, part, body
                if row in held:
                    held[row] += 1
                else:
                    held[row], size = 1, size + len(body) + 200
            if size > COMBINE_BYTES:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text, found) → (uid, start, digest) of all pieces."""
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        out: list[list] = [[], [], []]
        for uid, text, found in zip(*batch.columns, strict=True):
            for key, part, start, body in _held_pieces(text, found):
                for column, value in zip(out, (uid.as_py(), start, name_of(key, part, body)), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["uid", "start", "name"])


def name_of(key: int, part: int, body: bytes) -> bytes:
    """What a piece is joined by: its key and part, and a digest that ``_match`` has seen
    to be of one text only."""
    return key.to_bytes(8, "little", signed=True) + part.to_bytes(8, "little") + digest(body)


class SuffixArray:
    """The sorted suffixes of some texts, cut at ``length`` bytes, one of each.

    ``tables[j]`` lists the distinct strings of ``orders[j]`` bytes in their order: at
    first as numbers, then as pairs of ranks in the table before. The last one is the suffix array, and
    ``rows`` has a window of each of its strings. Ranks are equal only for equal bytes.
    """

    def __init__(self, tables: list[np.ndarray], rows: np.ndarray):
        self.tables, self.rows = tables, rows

    @classmethod
    def build(cls, texts: list[bytes], base: int = 0, length: int = LENGTH) -> tuple[SuffixArray, np.ndarray]:
        """The array, and the rank of each window; windows are numbered from ``base``."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = b"".join([*texts, bytes(8)])
        n = int(sizes.sum())
        places = np.arange(n, dtype=np.uint64)
        left = np.repeat(np.cumsum(sizes), sizes) - places.view(np.int64)
        ranks, tables, order = np.zeros(n, np.uint32), [], 0
        bits = np.uint64(max(1, n.bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        while order < length:
            step = min(8 if not order else 2 * order, length)
            held = left >= step
            if not order:
                by = np.flatnonzero(held)
                some = np.ndarray((n,), ">u8", data, strides=(1,))[by].astype(np.uint64)
                at = np.argsort(some)
                some, by = some[at], by[at]
            else:
                ends = max(n - (step - order), 0)
                some = np.left_shift(ranks[:ends], bits, dtype=np.uint64)
                some |= ranks[n - ends :]
                if 3 * bits <= 64:  # two ranks and the place fit into one number
                    some <<= bits
                    some |= places[:ends]
                    some = some[held[:ends]]
                    some.sort()
                    by = (some & low).view(np.int64)
                    some >>= bits
                else:
                    by = np.flatnonzero(held)
                    some = some[by]
                    at = np.argsort(some)
                    some, by = some[at], by[at]
            new = np.ones(len(some), bool)
            np.not_equal(some[1:], some[:-1], out=new[1:])
            ranks[by] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
            found = some[new]
            tables.append(found if not order else found >> bits << np.uint64(32) | found & low)
            order = step
        rank = ranks[left >= length].astype(np.int64)
        rows = np.empty(len(tables[-1]), np.int64)
        rows[rank[::-1]] = np.arange(base, base + len(rank))[::-1]
        return cls(tables, rows), rank

    def find(self, other: SuffixArray) -> np.ndarray:
        """A merge scan: the place in this array of each suffix of ``other``, or -1."""
        place = np.empty(0, np.int64)
        for j, (mine, theirs) in enumerate(zip(self.tables, other.tables, strict=True)):
            known, wanted = np.arange(len(theirs)), theirs
            if j:
                high, low = place[theirs >> np.uint64(32)], place[theirs & _LOW]
                known = np.flatnonzero((high >= 0) & (low >= 0))
                wanted = high[known].astype(np.uint64) << np.uint64(32) | low[known].astype(np.uint64)
            at = np.minimum(np.searchsorted(mine, wanted), len(mine) - 1)
            hit = mine[at] == wanted
            place = np.full(len(theirs), -1)
            place[known[hit]] = at[hit]
        return place

    def merged(self, other: SuffixArray) -> tuple[SuffixArray, np.ndarray]:
        """Both arrays in one, and the rows of both that have an equal in the other; of a suffix in
        both, the row of this one stays."""
        tables, rank, split = [], None, 0
        for mine, theirs in zip(self.tables, other.tables, strict=True):
            if rank is not None:  # ranks in the merged table before, in the same order
                mine, theirs = (m[t.view(np.uint32)].view(np.uint64) for m, t in ((rank[:split], mine), (rank[split:], theirs)))
            both, split = np.concatenate([mine, theirs]), len(mine)
            by = both.argsort(kind="stable")  # two sorted runs: one pass
            both = both[by]
            new = np.ones(len(both), bool)
            np.not_equal(both[1:], both[:-1], out=new[1:])
            rank = np.empty(len(both), np.uint32)
            rank[by] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
            tables.append(both[new])
        rows = np.concatenate([self.rows, other.rows])[by]
        twice = np.flatnonzero(~new)
        return SuffixArray(tables, rows[new]), np.concatenate([rows[twice - 1], rows[twice]])

    def __len__(self) -> int:
        return len(self.rows)


class LevelFamily:
    """Levels of suffix arrays; a level is at least twice as long as the next.
    ``matched[row]`` tells whether the window has an equal. Once ``closing``, a batch is scanned
    for in all levels, but not merged or kept, as none comes after it."""

    def __init__(self):
        self.levels: list[SuffixArray] = []
        self.matched = np.zeros(0, bool)
        self.scans = self.merges = 0
        self.closing = False

    def add(self, texts: list[bytes]) -> None:
        base = len(self.matched)
        new, rank = SuffixArray.build(texts, base)
        self.matched = np.concatenate([self.matched, (np.bincount(rank, minlength=len(new)) > 1)[rank]])
        while not self.closing and self.levels and len(self.levels[-1]) < 2 * len(new):
            new, equal = self.levels.pop().merged(new)
            self.matched[equal] = True
            self.merges += 1
        for level in self.levels:
            place = level.find(new)
            self.matched[level.rows[place[place >= 0]]] = self.matched[new.rows[place >= 0]] = True
            self.scans += 1
        if not self.closing:
            self.levels.append(new)


def _runs(flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans (text, start, end) of the flagged windows of each text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on, on
    first = np.concatenate([[True], (on[1:] != on[:-1] + 1) | (owner[on[1:]] != owner[on[:-1]])])
    a, b, own = on[first], on[np.concatenate([first[1:], [True]])], owner[on[first]]
    shift = (np.cumsum(counts) - counts)[own]
    return own, a - shift, b - shift + LENGTH


class _Task:
    """Distinct pieces of a run of keys, in batches for one family."""

    def __init__(self):
        self.family, self.names, self.bodies, self.n, self.waiting, self.windows = LevelFamily(), {}, [], [], 0, 0

    def add(self, key: int, part: int, body: bytes, n: int) -> None:
        at = self.names.setdefault(name_of(key, part, body), len(self.bodies))
        if at < len(self.bodies):
            if self.bodies[at] != body:
                raise ValueError("two pieces of text have one digest")
            self.n[at] += n
            return
        if self.windows - len(self.family.matched) >= BATCH_WINDOWS:
            self.flush()
        self.bodies.append(body)
        self.n.append(n)
        self.windows += len(body) - LENGTH + 1

    def flush(self) -> None:
        self.family.add(self.bodies[self.waiting :])
        self.waiting = len(self.bodies)

    def end(self) -> pa.RecordBatch:
        self.family.closing = True
        self.flush()
        n = np.array(self.n, np.int64)
        counts = np.fromiter(map(len, self.bodies), np.int64, len(self.bodies)) - LENGTH + 1
        own, start, end = _runs(self.family.matched | np.repeat(n > 1, counts), counts)
        some, first = np.unique(own, return_index=True)
        spans = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
        names = list(self.names)
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in some.tolist()], pa.binary()), pa.array(n[some]), spans], ["name", "n", "spans"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, body, n) in the order of keys → spans of repeated bytes in each body."""
    task, last = _Task(), None
    for batch in batches:
        for key, part, body, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if task.windows >= FAMILY_WINDOWS and last != (key, part):
                yield task.end()
                task = _Task()
            task.add(key, part, body, n)
            last = key, part
    if task.bodies:
        yield task.end()


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What remains of ``raw``, and the maximal removed runs."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    kept, at = [], 0
    for start, end in merged:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]]), [tuple(m) for m in merged]


_RESULT = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _finish(emit_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n_bytes, sha, text, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if text is None:
                    rows.append((doc, n_bytes, 0, 0, sha, None, None))
                    continue
                kept, runs = cut(text.encode(), [(s["start"], s["end"]) for s in spans or []])
                rows.append((doc, n_bytes, n_bytes - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, runs))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            arrays = [pa.array(c, k) for c, k in zip(columns[:6], kinds[:6], strict=True)]
            arrays.append(pa.array([v and [{"start": a, "end": b} for a, b in v] for v in columns[6]], kinds[6]))
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "runs"]
            width = 7 if emit_kept else 5
            yield pa.RecordBatch.from_arrays(arrays[:width], names[:width])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", emit_kept: bool = False) -> DataFrame:
    """One row for each row of ``docs``: what is removed of its text. With ``emit_kept`` also the
    remaining bytes and the removed runs (null where nothing can repeat)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("doc"), text.alias("text")), "texts")
    found = materialize(rows.where(F.octet_length("text") >= LENGTH).select("uid", "text").mapInArrow(_emit_segments, "uid bigint, key bigint, start bigint, windows int, repeats boolean"), "segments")
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.max("repeats").alias("repeats")).where("n > 1 OR repeats")
    keys = keys.select("key", F.ceil(F.col("n") / F.lit(HOT_SEGMENTS)).cast("int").alias("parts"))
    by_doc = found.join(keys, "key").groupBy("uid").agg(F.collect_list(F.struct("key", "start", "windows", "parts")).alias("found"))
    some = F.col("found").isNotNull()
    held = materialize(
        rows.join(by_doc, "uid", "left").select("uid", "doc", F.octet_length("text").cast("bigint").alias("n_bytes"), F.when(~some, F.sha2(F.encode("text", "utf-8"), 256)).alias("sha"), F.when(some, F.col("text")).alias("text"), "found"),
        "held",
    )
    discard(found)
    discard(rows)

    with_found = held.where("found IS NOT NULL")
    load = with_found.agg(F.sum(F.aggregate("found", F.lit(0).cast("bigint"), lambda n, c: n + c["windows"]))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-load // TASK_WINDOWS))
    bodies = with_found.select("text", "found").mapInArrow(_bodies, "key bigint, part bigint, body binary, n bigint")
    matches = materialize(bodies.repartition(tasks, "key", "part").sortWithinPartitions("key", "part").mapInArrow(_match, "name binary, n bigint, spans array<struct<start:bigint,end:bigint>>"), "matches")
    places = with_found.select("uid", "text", "found").mapInArrow(_places, "uid bigint, start bigint, name binary")
    hits = join_by_key(places, matches, "name", "n").select("uid", F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end"))).alias("spans"))
    spans = hits.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    final = held.join(spans, "uid", "left").select("doc", "n_bytes", "sha", "text", "spans")
    return final.mapInArrow(_finish(emit_kept), _RESULT + (", kept binary, runs array<struct<start:bigint,end:bigint>>" if emit_kept else ""))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every window as hexadecimal text, cut from blocks of 2,000 bytes; meant for small tables.
_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (SELECT doc_id, h, n, unnest(range(0, greatest(n - {LENGTH - 1}, 0), 2000)) AS base FROM d),
c AS (SELECT doc_id, base, substr(h, CAST(2 * base + 1 AS BIGINT), {2 * (2000 + LENGTH - 1)}) AS part FROM b),
w AS MATERIALIZED (SELECT doc_id, base + i AS p, md5_number(substr(part, CAST(2 * i + 1 AS BIGINT), {2 * LENGTH})) AS v
FROM (SELECT doc_id, base, part, unnest(range(0, least(2000, length(part) // 2 - {LENGTH - 1}))) AS i FROM c)),
m AS (SELECT v FROM w GROUP BY v HAVING count(*) > 1),
s AS (SELECT doc_id, p, p + {LENGTH} AS e, lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} AS before FROM w SEMI JOIN m USING (v)),
g AS (SELECT doc_id, p, e, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s),
r AS (SELECT doc_id, run, min(p) AS a, max(e) AS z FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM r),
o AS (SELECT k.doc_id, sum(z - a) AS gone, count(*) AS runs, max(z) AS tail, string_agg(substr(h, CAST(2 * last + 1 AS BIGINT), CAST(2 * (a - last) AS BIGINT)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""

QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLE_SQL = {"op4_suffix_dedup": _SQL}
