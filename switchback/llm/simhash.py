"""SimHash near-duplicates: fingerprints, BK-trees and components.

Two fingerprints that differ in at most ``radius`` bits agree on at least ``m - radius`` of ``m``
disjoint groups of bits, so each choice of that many groups deals the distinct fingerprints into shards, and
every link lies within some shard. Groups have as many bits as keep shards at about
``TREE_ROWS`` fingerprints, at every size of the input. A shard, whatever its size, is a BK-tree:
children are keyed by their integer Hamming distance to the parent, and a search follows only
edges within the radius, and none into a subtree that is wholly in the query's group already. A
shard of over ``SHARD_ROWS`` fingerprints is dealt as pairs of blocks. A task returns a
star for each linked group, never all pairs; components join the stars.

Trees are not broadcast: they hold the fingerprints of all documents, which must never be collected
to the driver, so a shard's fingerprints are dealt to the task that builds and searches its tree.

Exact copies collapse to one fingerprint before any search.

``keep_one_of_each`` is the stage of a pipeline: one text of each group whose five-word shingles have a Jaccard
similarity of ``LEAST_SIMILARITY`` or more; no such link is missed, whatever the size of a group. Two similar sets
share one of the first fifth of their shingles in any common order, and ``SHARED`` of some more of them, if they have as many. Texts are
dealt to blocks by the groups that shared shingles of these prefixes chain: those of up to ``RUN_TEXTS`` texts link
a pair that has enough of them, others all their texts. The order is by a table of ``CELLS`` counts over all texts, rare shingles first, which keeps
blocks small; it decides the cost only, never the result. A block is searched by BK-trees on shards of 128-bit fingerprints,
nearest first, and each link is verified on the shingles' hashes (64 bits) before it joins two groups. What the trees
do not join is then found exactly, by an index of the block's own rarest shingles. A block of over ``BLOCK_SHINGLES``
is dealt as pairs of parts. Tasks return at most a link for each text, never all pairs.

Defined results: a null or empty text has fingerprint zero and is linked like any
other; a very long text is hashed in parts of 65,536 shingles, with the same result; repeated rows give
a row each; a bit set in exactly half the hashes (a tie) is 0; a null id never becomes a component's id
unless all its ids are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchback.operators.components import connected_components
from switchback.storage import materialize, table

BITS, RADIUS, SHINGLE_WORDS, SEED = 64, 4, 4, 42
TREE_ROWS, SHARD_ROWS, FRONTIER = 1 << 11, 1 << 15, 1 << 20


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 majority bits over the XXH64 hashes of the word shingles of ``text``."""
    from xxhash import xxh64_intdigest as digest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    spans = list(zip(starts, ends[words - 1 :], strict=False)) if len(parts) >= words else [(0, len(joined))]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(spans), 1 << 16):
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans[at : at + (1 << 16)]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(spans), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, th, fp)`` for each row; ``th`` is a hash of the text and ``fp`` the
    fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(text.as_py(), words, seed) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "th", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id bigint, th bigint, fp bigint")


class BKTree:
    """Distinct codes, each a node; children of a node are keyed by their distance to it.

    Nodes are numbered by the place of their code, and a parent comes before all nodes below
    it. The tree grows level by level: the first code of a group becomes a node, and the others part by
    their distance to it. ``edges`` lists the children in the order of parent and key.
    """

    def __init__(self, codes: np.ndarray):
        self.codes, self.visits = codes, 0
        n = len(codes)
        self.parent, self.key, self.levels = np.full(n, -1), np.zeros(n, np.int64), []
        rows, group = np.arange(n), np.zeros(n, np.int64)
        while len(rows):
            first = np.concatenate([[True], group[1:] != group[:-1]])
            nodes = rows[first]
            self.levels.append(nodes)
            own = nodes[np.cumsum(first) - 1][~first]
            rows = rows[~first]
            far = np.bitwise_count(codes[rows] ^ codes[own]).astype(np.int64)
            group = own << 7 | far
            order = np.argsort(group, kind="stable")
            rows, group = rows[order], group[order]
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(rows) else rows
            self.parent[rows[heads]], self.key[rows[heads]] = group[heads] >> 7, group[heads] & 127
        below = np.concatenate(self.levels[1:]) if len(self.levels) > 1 else np.empty(0, np.int64)
        label = self.parent[below] << 7 | self.key[below]
        order = np.argsort(label, kind="stable")
        self.edges = below[order]
        every = (np.arange(n)[:, None] << 7 | np.arange(BITS + 2)[None, :]).ravel()
        #: where the children of a node from a key on begin in ``edges``, at place node * (BITS + 2) + key
        self.begin = np.searchsorted(label[order], every).astype(np.int32)

    def near(self, queries: np.ndarray, radius: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs within ``radius``, of nodes before their query; ``queries`` are nodes too.
        ``skip(node)``, if given, is the group that a whole subtree is in (or -1), by node, and the
        query's own is left out."""
        found = [], []
        asked, node = queries, np.zeros(len(queries), np.int64)
        while True:
            go = node < asked
            if skip is not None:
                go &= skip[0][node] != skip[1][asked]
            asked, node = asked[go], node[go]
            if not len(asked):
                break
            self.visits += len(asked)
            far = np.bitwise_count(self.codes[asked] ^ self.codes[node]).astype(np.int64)
            hit = far <= radius
            found[0].append(asked[hit])
            found[1].append(node[hit])
            node = node * (BITS + 2)
            low = self.begin[node + np.maximum(far - radius, 0)]
            n = self.begin[node + np.minimum(far + radius, BITS) + 1] - low
            asked = np.repeat(asked, n)
            node = self.edges[np.arange(len(asked)) + np.repeat(low - (np.cumsum(n) - n), n)]
        return tuple(np.concatenate(x) if x else queries[:0] for x in found)

    def groups(self, radius: int) -> np.ndarray:
        """The first node of the group of each: nodes are linked at ``radius`` or less."""
        n = len(self.codes)
        short = np.flatnonzero((self.key <= radius) & (self.parent >= 0))
        root = _united(np.arange(n), short, self.parent[short])
        step = max(1, FRONTIER // max(1, n))
        for at in range(0, n, step):
            a, b = self.near(np.arange(at, min(n, at + step)), radius, (self._whole(root), root))
            root = _united(root, a, b)
        return root

    def _whole(self, root: np.ndarray) -> np.ndarray:
        """The group that all of a subtree is in, or -1."""
        whole = root.copy()
        for nodes in self.levels[:0:-1]:
            up = self.parent[nodes]
            whole[up[whole[nodes] != root[up]]] = -1
        return whole


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Groups after linking ``a`` with ``b``; the least node names a group."""
    while len(a):
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high != low
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        jump = np.arange(len(root))
        np.minimum.at(jump, high[apart], low[apart])
        while (jump[jump] != jump).any():
            jump = jump[jump]
        root = jump[root]
    return root


def shard_links(codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges over the linked groups of one shard's distinct codes."""
    root = BKTree(codes).groups(radius)
    rows = np.nonzero(root != np.arange(len(root)))[0]
    return codes[rows], codes[root[rows]]


def _search_shards(radius: int):
    """Rows (shard, fp) sorted by shard → star edges."""

    def done(parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in shard_links(np.concatenate(parts), radius)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if held and keys[a] != last:
                    yield done(held)
                    held = []
                last = keys[a]
                held.append(codes[a:b])
        if held:
            yield done(held)

    return run


def block_masks(rows: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks of the agreeing groups of bits, as signed longs: as many bits as leave about
    ``TREE_ROWS`` of ``rows`` codes in a shard."""
    wanted = max(0, int(np.floor(np.log2(max(1, rows) / TREE_ROWS))))
    if not wanted:
        return [0]
    m = radius + 1
    while m < 2 * radius and wanted > (m - radius) * (bits // m):
        m += 1
    width = min(bits // m, -(-wanted // (m - radius)))
    places = [bits * k // m for k in range(m)]
    masks = [sum(((1 << width) - 1) << places[k] for k in chosen) for chosen in combinations(range(m), m - radius)]
    return [mask - (1 << bits) if mask >= 1 << (bits - 1) else mask for mask in masks]


def links(fps: DataFrame, rows: int, radius: int = RADIUS) -> DataFrame:
    """Star edges (u, v) that join all distinct ``fp`` within ``radius`` bits."""
    masks = block_masks(rows, radius)
    shards = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(mask)) for mask in masks])).alias("choice", "value"))
    sizes = shards.groupBy("choice", "value").agg(F.count("*").alias("n")).where("n > 1")
    members = shards.join(sizes, ["choice", "value"]).withColumn("parts", F.ceil(F.col("n") / F.lit(SHARD_ROWS)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != own), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    )
    tasks = members.select("fp", "choice", "value", F.explode(pairs).alias("p")).select(F.xxhash64("choice", "value", "p.i", "p.j").alias("shard"), "fp")
    found = tasks.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search_shards(radius), "u bigint, v bigint")
    return found.distinct()  # a link is found in up to every choice


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, th, fp, root, component_id)`` for each row of ``docs``; ``root`` is the least
    fingerprint of the component."""
    fp_docs = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(fp_docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fp")
    found = connected_components(links(distinct.select("fp"), distinct.count(), radius))
    labelled = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return fp_docs.join(labelled.select("fp", "root").join(least, "root"), "fp").select("doc_id", "th", "fp", "root", "component_id")


#: Of the similarity stage: words of a shingle, least Jaccard similarity, how many of such pairs the trees may leave to the
#: exact search, and about how many fingerprints a tree has.
SIMILAR_WORDS, LEAST_SIMILARITY, MISSED, SIMILAR_TREE_ROWS = 5, 0.8, 0.05, 1 << 9
#: Shingles that a pair must share in its prefixes, and texts of a shingle up to which its pairs are counted. One shared shingle
#: comes by chance: pairs of that kind grow with the square of the input, and would chain more and more texts.
SHARED, RUN_TEXTS = 4, 16
#: Cells of the table of counts (a byte each) and the rows it is added up in; shingles that a task counts at once; shingles of a block.
CELLS, CELL_ROWS, COUNTED, BLOCK_SHINGLES = 1 << 25, 1 << 8, 1 << 22, 1 << 22


def shingles(text: str | None, words: int = SIMILAR_WORDS) -> set[bytes]:
    """The distinct word shingles of a text; one of few words has one of all of them, one without words none."""
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[k : k + words]) for k in range(len(parts) - words + 1)} or ({b" ".join(parts)} if parts else set())


def similarity(a: set, b: set) -> float:
    """Jaccard; two texts without words are alike."""
    return len(a & b) / len(a | b) if a or b else 1.0


def _digests(text: str | None) -> np.ndarray:
    """The 128-bit hashes of the distinct shingles of a text, a row of bytes each."""
    from xxhash import xxh3_128_digest as digest

    return np.frombuffer(b"".join(map(digest, shingles(text))), np.uint8).reshape(-1, 16)


def _hashes(digests: np.ndarray) -> np.ndarray:
    """The first 64 bits of each, in order."""
    return np.unique(np.ascontiguousarray(digests[:, :8]).view("<u8").ravel())


def _halves(digests: np.ndarray) -> tuple[int, int]:
    ones = np.zeros(2 * BITS, np.int64)
    for at in range(0, len(digests), 1 << 16):
        ones += np.unpackbits(digests[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    low, high = np.packbits(ones * 2 > len(digests)).view(np.int64).tolist()
    return low, high


def wide_fingerprint(text: str | None) -> tuple[int, int]:
    """128 majority bits over the hashes of the distinct shingles, as two halves."""
    return _halves(_digests(text))


def differing(similar: float) -> float:
    """The share of bits in which fingerprints of a Jaccard similarity differ (sets of one size)."""
    return float(np.arccos(2 * similar / (1 + similar)) / np.pi)


@cache
def tables_for(k: int, least: float = LEAST_SIMILARITY, missed: float = MISSED) -> int:
    """How many tables of ``k`` sampled bits miss at most a share ``missed`` of pairs at the least similarity."""
    share, bits = differing(least), 2 * BITS
    likely = [comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in range(bits + 1)]
    agree = np.array([comb(bits - d, k) / comb(bits, k) for d in range(bits + 1)])
    tables = 1
    while (np.array(likely) * (1 - agree) ** tables).sum() > missed:
        tables += 1 + tables // 16
    return tables


def sampled_masks(rows: int, tree_rows: int | None = None) -> list[tuple[int, int]]:
    """Masks of sampled bits of both halves, as signed longs: as many bits as leave about ``tree_rows``
    (``SIMILAR_TREE_ROWS``) of ``rows`` in a shard."""
    k = min(BITS // 2, max(0, int(np.floor(np.log2(max(1, rows) / (tree_rows or SIMILAR_TREE_ROWS))))))
    if not k:
        return [(0, 0)]
    draw = np.random.default_rng(5)
    chosen = [draw.choice(2 * BITS, k, replace=False) for _ in range(tables_for(k))]
    signed = lambda mask: mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
    return [tuple(signed(sum(1 << int(bit) % BITS for bit in some if bit // BITS == half)) for half in (0, 1)) for some in chosen]


def _spread(share: float, bits: int) -> int:
    """Bits within which nearly all (3 standard deviations) pairs that differ in a share of them lie."""
    return int(share * bits + 3 * (share * (1 - share) * bits) ** 0.5)


def _near_in_shard(codes: np.ndarray, more: np.ndarray, groups: Callable[[], np.ndarray], link: Callable[[int, np.ndarray], None]) -> None:
    """Calls ``link(row, rows)`` with the rows near each row of a shard, nearest first: those in other groups, by
    ``groups()``, within ``_spread`` of both halves. Of equal first halves one row is searched."""
    share = differing(LEAST_SIMILARITY)
    radius, both = _spread(share, BITS), _spread(share, 2 * BITS)
    codes, first = np.unique(codes, return_index=True)
    more, tree = more[first], BKTree(codes)
    step = max(1, FRONTIER // len(codes))
    for at in range(0, len(codes), step):
        root = groups()[first]
        a, b = tree.near(np.arange(at, min(len(codes), at + step)), radius, (tree._whole(root), root))
        far = np.bitwise_count(codes[a] ^ codes[b]).astype(np.int64) + np.bitwise_count(more[a] ^ more[b])
        a, b, far = a[far <= both], b[far <= both], far[far <= both]
        order = np.lexsort((far, a))
        a, b = a[order], b[order]
        cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
        for x, near in zip(a[np.concatenate([[0], cuts])] if len(a) else a, np.split(b, cuts), strict=False):
            link(int(first[x]), first[near])


class _Block:
    """Sets of shingle hashes, no two alike, and the groups that verified links have joined so far."""

    def __init__(self, sets: list[np.ndarray]):
        n = len(sets)
        self.root, self.size, self.compared = np.arange(n), np.array([len(x) for x in sets], np.int64), 0
        self.begin = np.cumsum(self.size) - self.size
        _, found, self.common = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        #: of each set its shingles' numbers, rare in the block first
        self.shingles = found[np.lexsort((found, self.common[found], np.repeat(np.arange(n), self.size)))]
        self.marked = np.zeros(len(self.common), bool)

    def similar(self, row: int, rows: np.ndarray) -> np.ndarray:
        """Which of ``rows`` have at least the similarity with ``row``."""
        own, n = self.shingles[self.begin[row] : self.begin[row] + self.size[row]], self.size[rows]
        self.marked[own] = True
        at = np.arange(n.sum()) + np.repeat(self.begin[rows] - (np.cumsum(n) - n), n)
        both = np.bincount(np.repeat(np.arange(len(rows)), n)[self.marked[self.shingles[at]]], minlength=len(rows))
        self.marked[own] = False
        self.compared += len(rows)
        return both / (n + len(own) - both) >= LEAST_SIMILARITY

    def link(self, row: int, rows: np.ndarray) -> None:
        """Joins the groups of ``rows`` that are similar to ``row``; groups that are joined are not compared again."""
        step, rows = 8, rows[self.root[rows] != self.root[row]]
        while len(rows):
            some, rows = rows[:step], rows[step:]
            hit = some[self.similar(row, some)]
            if len(hit):
                self.root = _united(self.root, np.full(len(hit), row), hit)
                rows = rows[self.root[rows] != self.root[row]]
            step = min(2 * step, 1 << 12)

    def by_trees(self, halves: np.ndarray, tree_rows: int) -> None:
        for low, high in sampled_masks(len(halves), tree_rows):
            key = halves & np.array([low, high])
            order = np.lexsort((key[:, 1], key[:, 0]))
            cuts = np.flatnonzero((key[order][1:] != key[order][:-1]).any(axis=1)) + 1
            for rows in np.split(order, cuts):
                if len(rows) > 1:
                    codes = halves[rows].view(np.uint64)
                    _near_in_shard(codes[:, 0], codes[:, 1], lambda rows=rows: self.root[rows], lambda x, near, rows=rows: self.link(rows[x], rows[near]))

    def by_index(self) -> None:
        """Joins all that are similar: such sets share one of the first fifth of their shingles."""
        by_size = np.argsort(self.size, kind="stable")
        place = np.argsort(by_size)
        row = np.repeat(np.arange(len(self.size)), self.size)
        use = np.arange(len(row)) - self.begin[row] < prefix_length(self.size)[row]
        use &= self.common[self.shingles] > 1
        shingle, row = self.shingles[use], row[use]
        order = np.lexsort((place[row], shingle))
        shingle, row = shingle[order], row[order]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], shingle[1:] != shingle[:-1]]), np.arange(len(row)), 0)) if len(row) else row
        before = np.arange(len(row)) - head  # rows of the same shingle that are smaller
        own = np.argsort(place[row], kind="stable")
        for at in np.split(own, np.flatnonzero(np.diff(row[own])) + 1):
            n = before[at]
            if not n.any():
                continue
            x = row[at[0]]
            y = row[np.arange(n.sum()) + np.repeat(head[at] - (np.cumsum(n) - n), n)]
            y = y[(self.root[y] != self.root[x]) & (self.size[y] >= LEAST_SIMILARITY * self.size[x] - 1e-6)]
            y, often = np.unique(y, return_counts=True)
            self.link(x, y[np.argsort(-often, kind="stable")])


def least_shared(sizes: np.ndarray, shared: int = 1) -> np.ndarray:
    """How many shingles a similar set has of sets of these sizes for sure, ``shared`` at most."""
    return np.minimum(np.ceil(LEAST_SIMILARITY * sizes - 1e-6).astype(np.int64), shared)


def prefix_length(sizes: np.ndarray, shared: int = 1) -> np.ndarray:
    """Of sets of these sizes, how many first shingles in a common order hold ``shared`` shared ones of any similar set, or
    as many as both have for sure."""
    return np.where(sizes > 0, sizes - np.ceil(LEAST_SIMILARITY * sizes - 1e-6).astype(np.int64) + least_shared(sizes, shared), 0)


def similar_groups(sets: list[np.ndarray], halves: np.ndarray, tree_rows: int = SIMILAR_TREE_ROWS) -> np.ndarray:
    """A row that names the group of each: sets are linked at ``LEAST_SIMILARITY`` or more; equal sets are alike."""
    first = {}
    same = np.array([first.setdefault(x.tobytes(), k) for k, x in enumerate(sets)])
    rows = np.array(list(first.values()))
    block = _Block([sets[k] for k in rows])
    block.by_trees(halves[rows], tree_rows)
    block.by_index()
    return rows[block.root][np.searchsorted(rows, same)]


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None]]:
    """Rows (th, text) → those whose text the task has not had before."""
    seen = set()
    for batch in batches:
        for th, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if th not in seen:
                seen.add(th)
                yield th, text.as_py()


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(BITS - CELLS.bit_length() + 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (th, text) → (part, the cells of its shingles: packed differences in order)."""
    width = CELLS // CELL_ROWS

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(held))
        cuts = np.searchsorted(cells, np.arange(0, CELLS + 1, width))
        found = [np.diff(cells[a:b] - k * width, prepend=0).astype("<u4") for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(range(CELL_ROWS), pa.int32()), pa.array([zlib.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in found], pa.binary())], ["part", "cells"])

    held, n = [], 0
    for _, text in _first_seen(batches):
        held.append(_cells(_hashes(_digests(text))))
        n += len(held[-1])
        if n >= COUNTED:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, cells) sorted by part → (part, a byte for the logarithm of each cell's count)."""
    width = CELLS // CELL_ROWS

    def done(part: int, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(255, np.rint(12 * np.log2(1 + n))).astype(np.uint8).tobytes()], pa.binary())], ["part", "cells"])

    last, total = None, None
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != last:
                if total is not None:
                    yield done(last, total)
                last, total = part, np.zeros(width, np.int64)
            steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(cells.as_py()), np.uint8).reshape(4, -1).T).view("<u4").ravel()
            total += np.bincount(np.cumsum(steps, dtype=np.int64), minlength=width)
    if total is not None:
        yield done(last, total)


def _rarity(texts: DataFrame) -> np.ndarray:
    """A byte a cell, higher for cells with more shingles of ``texts`` (th, text)."""
    parts = texts.mapInArrow(_counted, "part int, cells binary").repartition("part").sortWithinPartitions("part").mapInArrow(_added, "part int, cells binary")
    found = np.zeros((CELL_ROWS, CELLS // CELL_ROWS), np.uint8)
    for row in parts.collect():  # CELLS bytes at most
        found[row["part"]] = np.frombuffer(row["cells"], np.uint8)
    return found.ravel()


def _prefixes(rarity):
    """Rows (th, text) → (shingle, size, th) for the first shingles of each set; a set without any has shingle 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def done() -> pa.RecordBatch:
            sizes = np.repeat([x[1] for x in held], [len(x[2]) for x in held]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[2] for x in held]).view(np.int64)), pa.array(sizes), pa.array(np.repeat(np.array([x[0] for x in held], np.int64), [len(x[2]) for x in held]))], ["shingle", "size", "th"])

        for th, text in _first_seen(batches):
            hashes = _hashes(_digests(text))
            rare = np.argsort(rarity.value[_cells(hashes)], kind="stable")  # hashes are in order
            held.append((th, len(hashes), hashes[rare[: prefix_length(np.array([len(hashes)]), SHARED)[0]]] if len(hashes) else np.zeros(1, np.uint64)))
            n += len(held[-1][2])
            if n >= 1 << 16:
                yield done()
                held, n = [], 0
        if held:
            yield done()

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, size, th) sorted so → (a, size of a, b, size of b): each text of a run with the run's first.
    A run ends with its shingle or where sizes part too far for any similar pair across."""
    last = None
    for batch in batches:
        shingle, size, th = (c.to_numpy() for c in batch.columns)
        if not len(th):
            continue
        if last is not None:
            shingle, size, th = (np.concatenate([[x], y]) for x, y in zip(last[:3], (shingle, size, th), strict=True))
        new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (size[:-1] < LEAST_SIMILARITY * size[1:] - 1e-6)])
        head = np.maximum.accumulate(np.where(new, np.arange(len(th)), 0))
        a, m = th[head], size[head]
        if last is not None:
            a[head == 0], m[head == 0] = last[3:]
        last = shingle[-1], size[-1], th[-1], a[-1], m[-1]
        apart = a != th
        yield pa.RecordBatch.from_arrays([pa.array(x[apart]) for x in (a, m, th, size)], ["a", "m", "b", "n"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, size, th) sorted so → (a, size of a, b, size of b, need): the pairs of each run of ``_chained`` that has up to
    ``RUN_TEXTS`` texts, and how many such rows a similar pair has; of a longer run, whose rows are held no longer than that, its
    texts with the first, and 0."""

    def found(shingle: np.ndarray, size: np.ndarray, th: np.ndarray, head: np.ndarray, long: np.ndarray) -> pa.RecordBatch:
        apart = long & (th[head] != th)
        a, b, need = [head[apart]], [np.flatnonzero(apart)], [np.zeros(apart.sum(), np.int64)]
        at = np.flatnonzero(~long)
        for step in range(1, RUN_TEXTS):
            at = at[at + step < len(head)]
            at = at[head[at] == head[at + step]]
            near = at[size[at] >= LEAST_SIMILARITY * size[at + step] - 1e-6]
            a.append(near)
            b.append(near + step)
            need.append(least_shared(size[near], SHARED))
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (th[a], size[a], th[b], size[b], np.concatenate(need))], ["a", "m", "b", "n", "need"])

    held, over = None, False  # the rows of the last run, or the first and the last one if it is longer
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if not len(rows[0]):
            continue
        shingle, size, th = rows if held is None else (np.concatenate(x) for x in zip(held, rows, strict=True))
        fresh = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (size[1:] != size[:-1]) | (th[1:] != th[:-1])])  # a text can come from several tasks
        fresh[:2] |= over
        shingle, size, th = shingle[fresh], size[fresh], th[fresh]
        new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (size[:-1] < LEAST_SIMILARITY * size[1:] - 1e-6)])
        new[1:2] &= not over
        head = np.maximum.accumulate(np.where(new, np.arange(len(th)), 0))
        long = np.bincount(head, minlength=len(th))[head] > RUN_TEXTS
        long |= over & (head == 0)
        last, over = head[-1], bool(long[-1])
        held = [x[[last, -1]] if over else x[last:] for x in (shingle, size, th)]
        end = len(th) if over else last
        yield found(shingle[:end], size[:end], th[:end], head[:end], long[:end])
    if held is not None and not over:
        yield found(*held, np.zeros(len(held[0]), np.int64), np.zeros(len(held[0]), bool))


def _linked(tree_rows: int):
    """Rows (shard, th, text) sorted by shard → links of each text with one of its group."""

    def done(held: list[tuple]) -> pa.RecordBatch:
        th, sets, halves = zip(*held, strict=True)
        th = np.array(th, np.int64)
        root = similar_groups(list(sets), np.array(halves, np.int64).reshape(-1, 2), tree_rows)
        rows = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(th[rows]), pa.array(th[root[rows]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for shard, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and shard != last:
                    yield done(held)
                    held = []
                last, digests = shard, _digests(text.as_py())
                held.append((th, _hashes(digests), _halves(digests)))
        if held:
            yield done(held)

    return run


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, th, root)`` for each row of ``docs``; ``root`` names its group of texts that are linked by a verified
    similarity. All such links count: shared rare shingles deal texts to blocks, which are searched by trees and an index."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text"))
    rarity = docs.sparkSession.sparkContext.broadcast(_rarity(texts))
    prefixes = texts.mapInArrow(_prefixes(rarity), "shingle bigint, size bigint, th bigint")
    runs = prefixes.repartition("shingle").sortWithinPartitions("shingle", "size", "th").mapInArrow(_paired, "a bigint, m bigint, b bigint, n bigint, need bigint")
    shared = runs.groupBy("a", "m", "b", "n").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    chains = materialize(shared.where("shared >= need").select("a", "m", "b", "n"), "chains")
    sizes = chains.select(F.col("a").alias("th"), F.col("m").alias("size")).union(chains.select("b", "n")).distinct()
    dealt = connected_components(chains, "a", "b").select(F.col("node").alias("th"), F.col("root").alias("block")).join(sizes, "th")
    parts = dealt.groupBy("block").agg(F.ceil((F.sum("size") + 1) / F.lit(BLOCK_SHINGLES)).cast("int").alias("parts"))
    members = materialize(dealt.join(parts, "block").select("th", "block", "parts"), "blocks")
    own = F.pmod(F.xxhash64("th"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != own), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    )
    once = texts.join(members.select("th"), "th", "left_semi").groupBy("th").agg(F.min("text").alias("text"))
    tasks = once.join(members, "th").select("th", "text", "block", F.explode(pairs).alias("p")).select(F.xxhash64("block", "p.i", "p.j").alias("shard"), "th", "text")
    found = tasks.repartition("shard").sortWithinPartitions("shard").mapInArrow(_linked(SIMILAR_TREE_ROWS), "a bigint, b bigint")
    groups = connected_components(found, "a", "b")
    own_id = F.col(id_col).cast("bigint")
    rows = docs.select(own_id.alias("doc_id"), F.xxhash64(text).alias("th"))
    return rows.join(groups.select(F.col("node").alias("th"), "root"), "th", "left").select("doc_id", "th", F.coalesce("root", "th").alias("root"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts: that with the smallest id (null ids last), of
    those the smallest text hash, of alike rows any; columns as they come."""
    found = similar_texts(docs, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    keys = ["__switchback_a", "__switchback_b"]
    keep = first.select(F.coalesce("first.doc_id", F.lit(0)).alias(keys[0]), F.xxhash64("first.none", "first.th").alias(keys[1])).distinct()
    own = F.col(id_col).cast("bigint")
    rows = docs.withColumn(keys[0], F.coalesce(own, F.lit(0))).withColumn(keys[1], F.xxhash64(own.isNull(), F.xxhash64(F.col(text_col).cast("string"))))
    return rows.join(keep, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash_bktree": op5_simhash_bktree}
ORACLE_SQL: dict[str, str] = {}
