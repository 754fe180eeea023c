"""Hierarchical multi-length packing of tokenized documents.

Documents are routed to the smallest context tier that holds them. Tiers are
packed from the longest to the shortest, best fit first; gaps of a long window
are filled with whole documents of shorter tiers, and what then remains of a
gap is filled by cutting one document, whose rest is routed again. A tier's length is a
power of two, so a full window is never padded. Full windows are dealt to
step groups so that groups hold alike amounts of tokens and of attention work.

Packing runs inside the partitions of the input, without a shuffle: a task
holds one chunk of about ``CHUNK_TOKENS`` tokens and carries what does not fill a
window to its next chunk. The rest of a partition is cut into
windows of powers of two.

Defined results: a null text is empty (its only token is the end token); a very long text is cut into
windows of the longest tier and a rest; documents of one length (ties) are taken in the order they come;
repeated rows and null ids are packed like any other row; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchback.llm.tokens import PieceEncoder
from switchback.storage import table

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
CHUNK_TOKENS = 1 << 20
STEP_TOKENS = 16 * 4096
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint, step_group bigint"


class Shelf:
    """Pieces (doc, start, length) by length, for best-fit picks."""

    def __init__(self):
        self.lengths: list[int] = []
        self.pieces: dict[int, list[tuple[int, int]]] = {}

    def put(self, doc: int, start: int, length: int) -> None:
        if length not in self.pieces:
            bisect.insort(self.lengths, length)
            self.pieces[length] = []
        self.pieces[length].append((doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` tokens."""
        at = bisect.bisect_right(self.lengths, most) - 1
        return None if at < 0 else self._pop(at)

    def take_longest(self) -> tuple[int, int, int] | None:
        return self._pop(len(self.lengths) - 1) if self.lengths else None

    def _pop(self, at: int) -> tuple[int, int, int]:
        length = self.lengths[at]
        doc, start = self.pieces[length].pop()
        if not self.pieces[length]:
            del self.pieces[length], self.lengths[at]
        return doc, start, length


def pack(lengths: dict[int, int] | list[tuple[int, int, int]], tiers=TIERS, last: bool = False):
    """Windows of pieces, and the pieces left over (none if ``last``).

    ``lengths``: pieces (doc, start, length). A window is a list of pieces whose
    lengths sum to a tier or, in the last chunk, to a power of two.
    """
    tiers = sorted(tiers)
    longest, windows = tiers[-1], []
    shelves = {tier: Shelf() for tier in tiers}

    def route(doc: int, start: int, length: int) -> None:
        if length:
            shelves[tiers[bisect.bisect_left(tiers, length)]].put(doc, start, length)

    for doc, start, length in lengths:
        while length >= longest:
            windows.append([(doc, start, longest)])
            start, length = start + longest, length - longest
        route(doc, start, length)

    left: list[tuple[int, int, int]] = []
    for at in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[at], [shelves[t] for t in tiers[at::-1]]
        while (piece := shelves[tier].take_longest()) is not None:
            window, room = [piece], tier - piece[2]
            for shelf in below:  # whole documents of this tier, then of shorter ones
                while room and (fit := shelf.take(room)) is not None:
                    window.append(fit)
                    room -= fit[2]
            if room:  # every piece left is longer than the gap: cut the longest of the nearest tier
                cut = next((p for shelf in below if (p := shelf.take_longest()) is not None), None)
                if cut is not None:
                    doc, start, length = cut
                    window.append((doc, start, room))
                    route(doc, start + room, length - room)
                    room = 0
            if room:
                left.extend(window)
            else:
                windows.append(window)
    if last and left:
        total = sum(p[2] for p in left)
        queue = sorted(left, key=lambda p: -p[2])[::-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            size = 1 << bit
            if not total & size:
                continue
            for _ in range(max(1, size // longest)):
                window, room = [], min(size, longest)
                while room:
                    doc, start, length = queue.pop()
                    used = min(room, length)
                    window.append((doc, start, used))
                    room -= used
                    if length > used:
                        queue.append((doc, start + used, length - used))
                windows.append(window)
        left = []
    return windows, left


def step_groups(windows, step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window: windows of most attention work first, each to the
    group with the least tokens, then the least work."""
    sizes = [sum(p[2] for p in w) for w in windows]
    work = [sum(p[2] * p[2] for p in w) for w in windows]
    groups = [(0, 0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: (-work[k], -sizes[k], k)):
        tokens, done, group = heapq.heappop(groups)
        out[k] = group
        heapq.heappush(groups, (tokens + sizes[k], done + work[k], group))
    return out


class _Packer:
    def __init__(self, path: str, tiers, end_id: int, emit_ids: bool):
        self.encoder, self.tiers, self.emit_ids = PieceEncoder(path), tiers, emit_ids
        self.end = np.array([end_id], "<u4")
        self.base = TaskContext.get().partitionId() << 36
        self.sequence = self.group = 0
        self.docs: dict[int, tuple[int | None, np.ndarray]] = {}
        self.waiting: list[tuple[int, int, int]] = []
        self.next_doc = self.tokens = 0

    def add(self, ids: list, texts: list) -> None:
        for doc_id, encoded in zip(ids, self.encoder.encode([t or "" for t in texts]), strict=True):
            full = np.concatenate([encoded, self.end])
            self.docs[self.next_doc] = (doc_id, full)
            self.waiting.append((self.next_doc, 0, len(full)))
            self.next_doc += 1
            self.tokens += len(full)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        windows, self.waiting = pack(self.waiting, self.tiers, last)
        groups = step_groups(windows)
        columns: list[list] = [[] for _ in range(9 + self.emit_ids)]
        for window, group in zip(windows, groups, strict=True):
            offset, size = 0, sum(p[2] for p in window)
            for doc, start, length in window:
                doc_id, full = self.docs[doc]
                piece = full[start : start + length]
                row = [doc_id, start, length, zlib.crc32(piece.tobytes()), len(full), self.base + self.sequence, offset, size, self.base + self.group + group]
                for column, value in zip(columns, row + ([piece] if self.emit_ids else []), strict=True):
                    column.append(value)
                offset += length
            self.sequence += 1
        self.group += max(groups, default=-1) + 1
        kept = {doc for doc, _, _ in self.waiting}
        self.docs = {doc: v for doc, v in self.docs.items() if doc in kept}
        self.tokens = sum(length for _, _, length in self.waiting)
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        arrays = [pa.array(c, pa.int64()) for c in columns[:9]]
        if self.emit_ids:
            names, arrays = [*names, "ids"], [*arrays, pa.array(columns[9], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names) if columns[0] else None


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers=TIERS, end_id: int = END_ID, emit_ids: bool = False, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row for each piece; with ``emit_ids`` also its token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(tokenizer_path, tiers, end_id, emit_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                packer.add(part.column(0).to_pylist(), part.column(1).to_pylist())
                if packer.tokens >= chunk_tokens and (out := packer.flush(False)) is not None:
                    yield out
        if (out := packer.flush(True)) is not None:
            yield out

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<bigint>" if emit_ids else ""))


def op10_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op10_hierarchical_packing": op10_hierarchical_packing}
ORACLE_SQL: dict[str, str] = {}
