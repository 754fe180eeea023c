"""Exact top-k search over binary codes by incremental multi-index hashing.

Rows are dealt by their code to shards of about ``SHARD_ROWS``, and a shard indexes all its rows
once per segment of the code, sorted by segment value; segments are as wide as leave about one row for
a value. Search proceeds in rounds: round ``s`` probes, in every segment, the values at distance ``s`` from
the query's. After it every row within ``segments * (s + 1) - 1`` bits is verified, so a query whose
k-th verified distance is no more is done in this shard; the others go on to the next round. The shards' best
``k`` are merged. Queries go to the shards in blocks of ``BLOCK_QUERIES``, a stated bound. Where there are
fewer shards than task slots, several tasks hold a shard and each answers its part of the queries.

Of rows with one code only the ``k`` smallest ids can be among the best, so a hot code is cut to
them first; ties go to the smaller id. Codes of embeddings are the signs of their
components, a fixed rule; every row is indexed.

Defined results: rows with a null or empty vector or a null id are neither indexed nor
queried; null components count as zero, and so do components past a shorter vector's end (those past
``BITS`` are ignored); repeated rows each take a place; a query finds its own row; an
empty table gives no rows; other columns are ignored, texts among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.storage import materialize, table

BITS, K, QUERY_STEP = 64, 10, 50
BLOCK_QUERIES, SLICE, SHARD_ROWS, PROBES = 1 << 16, 128, 1 << 18, 1 << 19


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """A signed long whose bit i is set where component i is positive."""
    parts = [F.when(F.get(vector, F.lit(i)) > 0, F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0)) for i in range(bits)]
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """(id, code): the ``k`` smallest ids of each code. A hot code's rows are first
    ranked within salted parts, so no task sees all of them."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = salted.withColumn("r", F.row_number().over(W.partitionBy("code", "salt").orderBy("id"))).where(F.col("r") <= k)
    kept = first.drop("r", "salt").withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("r") <= k)
    return kept.select("id", "code")


class MultiIndex:
    """One shard: rows by id and code, with a sorted table for each segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, bits: int = BITS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes, self.bits = ids[order], codes[order], bits
        n = max(1, round(bits / max(4.0, log2(max(1, len(ids))))))  # about one row for a value
        self.edges = [round(bits * k / n) for k in range(n + 1)]
        self.rounds = self.verified = 0
        self.tables = []
        for a, b in zip(self.edges, self.edges[1:], strict=False):
            part = self.segment(self.codes, a, b)
            rows = np.argsort(part, kind="stable")
            self.tables.append((part[rows], rows))

    @staticmethod
    def segment(codes: np.ndarray, a: int, b: int) -> np.ndarray:
        return (codes >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)

    def _probe(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs whose values of some segment are ``distance`` apart."""
        found = []
        for (a, b), (values, rows) in zip(zip(self.edges, self.edges[1:], strict=False), self.tables, strict=True):
            if distance > b - a:
                continue
            masks = np.array([sum(1 << i for i in chosen) for chosen in combinations(range(b - a), distance)], np.uint64)
            wanted = (self.segment(queries, a, b)[:, None] ^ masks[None, :]).ravel()
            low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found.append(np.stack([np.repeat(np.repeat(np.arange(len(queries)), len(masks)), n), rows[at]]))
        pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pairs[0], pairs[1]

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the ``k`` nearest rows of each query."""
        best, waiting, kept = [np.empty((3, 0), np.int64)], np.arange(len(queries)), np.empty((3, 0), np.int64)
        widest = max(b - a for a, b in zip(self.edges, self.edges[1:], strict=False))
        for distance in range(widest + 1):
            self.rounds += 1
            step = max(1, PROBES // comb(widest, distance))
            for at in range(0, len(waiting), step):
                some = waiting[at : at + step]
                q, row = self._probe(queries[some], distance)
                self.verified += len(q)
                bits = np.bitwise_count(queries[some[q]] ^ self.codes[row]).astype(np.int64)
                kept = self._nearest(np.concatenate([kept, np.stack([some[q], row, bits])], axis=1), k)
            covered = self.bits if distance == widest else len(self.tables) * (distance + 1) - 1
            held = np.bincount(kept[0][kept[2] <= covered], minlength=len(queries)) >= k
            ready = held[kept[0]]
            best.append(kept[:, ready])
            kept, waiting = kept[:, ~ready], waiting[~held[waiting]]
            if not len(waiting):
                break
        best.append(kept)  # of queries with fewer than k rows in the shard
        return tuple(np.concatenate(best, axis=1))

    @staticmethod
    def _nearest(pairs: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` of each query by distance and row (rows are in the order of ids), each pair once."""
        order = np.lexsort((pairs[1], pairs[2], pairs[0]))
        pairs = pairs[:, order]
        if not pairs.shape[1]:
            return pairs
        fresh = np.concatenate([[True], (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])])
        pairs = pairs[:, fresh]
        first = np.flatnonzero(np.concatenate([[True], pairs[0, 1:] != pairs[0, :-1]]))
        rank = np.arange(pairs.shape[1]) - np.repeat(first, np.diff(np.append(first, pairs.shape[1])))
        return pairs[:, rank < k]


def _search(queries: np.ndarray, k: int, bits: int, parts: int):
    """Rows (shard, part, id, code) in the order of shards and parts → the nearest of each part's queries."""

    def answers(part: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        index = MultiIndex(np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held]).view(np.uint64), bits)
        own = queries[part::parts]
        for at in range(0, len(own), SLICE):
            some = own[at : at + SLICE]
            q, row, distance = index.search(some, k)
            yield pa.RecordBatch.from_arrays([pa.array(some[q].view(np.int64)), pa.array(index.ids[row]), pa.array(distance)], ["query", "neighbour_id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            shard, part, ids, codes = (c.to_numpy() for c in batch.columns)
            group = shard.astype(np.int64) * parts + part
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
            for a, b in zip(cuts, [*cuts[1:], len(group)], strict=True):
                if held and group[a] != last:
                    yield from answers(int(last % parts), held)
                    held = []
                last = group[a]
                held.append((ids[a:b], codes[a:b]))
        if held:
            yield from answers(int(last % parts), held)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``rows`` and ``queries``: (id, code). Returns (query_id, neighbour_id, distance, rank)."""
    held = materialize(smallest_ids(rows.select(F.col("id").cast("bigint").alias("id"), "code"), k), "codes")
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    codes = materialize(asked.select("query").distinct(), "queries")
    wanted = codes.count()
    blocks = max(1, -(-wanted // (BLOCK_QUERIES // 2)))  # by hash, so each stays below twice its mean
    shards = max(1, -(-held.count() // shard_rows))
    parts = max(1, min(held.sparkSession.sparkContext.defaultParallelism // shards, -(-wanted // SLICE)))
    dealt = held.select(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "code")
    dealt = dealt.repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part")
    order = W.partitionBy("query").orderBy("distance", "neighbour_id")
    found = []
    for b in range(blocks):
        some = codes.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toPandas()["query"].to_numpy(np.int64).view(np.uint64)
        found.append(dealt.mapInArrow(_search(some, k, bits, parts), "query bigint, neighbour_id bigint, distance bigint"))
    merged = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.join(merged, "query").select("query_id", "neighbour_id", "distance", "rank")


def op3_multi_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND size(embedding) > 0")
    rows = vectors.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    found = top_k(rows, rows.where(F.col("id") % QUERY_STEP == 0))
    return found.select(F.col("query_id").cast("bigint"), F.col("neighbour_id").cast("bigint"), F.col("distance").cast("int"), F.col("rank").cast("int"))


_CODE = " || ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN '1' ELSE '0' END" for i in range(BITS))
_SQL = f"""
WITH c AS (SELECT vec_id, ({_CODE})::BIT AS code FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance FROM c AS q, c WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, neighbour_id, distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS r FROM p) WHERE r <= {K}
"""

QUERIES = {"op3_multi_index_topk": op3_multi_index_topk}
ORACLE_SQL = {"op3_multi_index_topk": _SQL}
