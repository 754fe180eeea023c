"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` words (one shorter window if the
item has fewer). A window is the set of its word shingles. Its occurrence needs
all of them, so a prefix of one shingle is necessary and sufficient to
find it: shingles are ordered by how often they occur in the whole corpus, and each window
is indexed by its rarest. A document is probed at every position; a hit
fixes where the window would start, which the positional bound (not before the first
word) and the length bound (not past the last) check before the words themselves are
compared with the item-sized window.

Only DataFrame functions run. The index is broadcast in blocks of at most
``BLOCK_WINDOWS`` windows, a stated bound; more windows take more passes.

Defined results: a null text has no words; a very long text is one text, probed at every position; a null or
wordless item, or one without an id, has no windows; repeated items count once; of shingles that are equally
rare (a tie) the one of the least hash is the prefix, which changes no result; repeated rows of documents give a
row each; without items no document is contaminated; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchback.storage import materialize, table

WINDOW, SHINGLE = 10, 3
BLOCK_WINDOWS = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def _shingle(words: str | Column, at: Column, size: Column | int) -> Column:
    """The hash of ``size`` words (1 to SHINGLE) from ``at``."""
    words = F.col(words) if isinstance(words, str) else words
    return F.xxhash64(*[F.when(F.lit(k) < size, F.get(words, at + k)) for k in range(SHINGLE)])


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (item, window_id, win, len)."""
    cut = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    at = cut.select("item", "w", F.least(F.lit(window), F.size("w")).alias("len"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("p"))
    win = at.select("item", "len", F.slice("w", F.col("p") + 1, F.col("len")).alias("win"))
    return win.select("item", F.md5(F.array_join("win", " ")).alias("window_id"), "win", "len").distinct()


def _positions(docs: DataFrame, id_col: str, text_col: str, sizes: list[int]) -> DataFrame:
    """A row for each word position and shingle size, and one marker for each document."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), words_of(F.col(text_col)).alias("w"))
    at = rows.select("doc", "text_hash", "w", F.size("w").alias("n_words"), F.explode(F.sequence(F.lit(0), F.size("w"))).alias("pos"))
    if len(sizes) == 1:
        size = F.lit(sizes[0])
    else:
        at = at.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes]))).where(F.expr(f"k = {sizes[0]} OR pos < n_words"))
        size = F.col("k")
    return at.withColumn("shingle", F.when(F.col("pos") + size <= F.col("n_words"), _shingle("w", F.col("pos"), size)))


def _blocks(rows: int) -> int:
    return max(1, -(-rows // BLOCK_WINDOWS))


def window_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Verified occurrences by document, and the windows of each item.

    The first has (doc, text_hash, n_words, copies, spans, windows): ``copies`` rows are
    alike in id and text; ``spans`` are distinct (start, len) in words.
    """
    windows = materialize(windows_of(items, item_col, item_text_col, window), "windows")
    distinct = windows.select("window_id", "win", "len").distinct()
    size = F.least(F.lit(SHINGLE), F.col("len"))
    parts = materialize(distinct.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("offset")).withColumn("shingle", _shingle("win", F.col("offset"), size)), "window-shingles")
    sizes = sorted((r[0] for r in parts.select(size.alias("k")).distinct().collect()), reverse=True) or [SHINGLE]

    tokens = materialize(parts.select("shingle").distinct(), "shingles")
    counts = []
    blocks = _blocks(tokens.count())
    for b in range(blocks):
        some = F.broadcast(tokens.where(F.pmod("shingle", F.lit(blocks)) == b))
        counts.append(_positions(docs, id_col, text_col, sizes).select("shingle").join(some, "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("seen")))
    rarity = reduce(DataFrame.union, counts)

    ranked = parts.join(rarity, "shingle", "left").groupBy("window_id").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "offset")).alias("prefix")
    )  # one shingle of each window: overlap of the whole window asks for a prefix of one
    index = materialize(distinct.join(ranked, "window_id").select("window_id", "win", "len", "prefix.shingle", "prefix.offset"), "prefix-index")
    blocks = _blocks(index.count())
    found = []
    for b in range(blocks):
        some = index.where(F.pmod("shingle", F.lit(blocks)) == b).withColumnRenamed("shingle", "prefix")
        probe = _positions(docs, id_col, text_col, sizes)
        start = F.col("pos") - F.col("offset")
        held = (F.col("shingle") == F.col("prefix")) & (start >= 0) & (start + F.col("len") <= F.col("n_words")) & (F.slice("w", start + 1, F.col("len")) == F.col("win"))
        marker = F.col("pos") == F.col("n_words")
        marker = marker if len(sizes) == 1 else marker & (F.col("k") == sizes[0])
        hits = probe.join(F.broadcast(some), held, "left").where(F.col("window_id").isNotNull() | marker)
        found.append(
            hits.select("doc", "text_hash", "n_words", F.when(F.col("window_id").isNotNull(), F.struct(start.alias("start"), "len")).alias("span"), "window_id", (marker & F.lit(b == 0)).cast("int").alias("mark"))
        )
    by_doc = reduce(DataFrame.union, found).groupBy("doc", "text_hash", "n_words").agg(F.sum("mark").alias("copies"), F.collect_set("span").alias("spans"), F.collect_set("window_id").alias("windows"))
    return materialize(by_doc, "hits"), windows.select("item", "window_id")


def covered(spans: Column) -> Column:
    """Words in the union of (start, len) spans."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["start"] + s["len"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(acc["end"], s["start"]))).alias("n")),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """(doc, text_hash, n_words, n_hit, items, spans) for each row of ``docs``; ``items`` are
    the ids of the items with an occurring window, sorted as strings."""
    hits, windows = window_hits(docs, items, **columns)
    key = ["doc", "text_hash"]
    listed = (
        hits.where("size(windows) > 0").select(F.struct(*key).alias("key"), F.explode("windows").alias("window_id")).join(windows, "window_id")
        .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    rows = hits.withColumn("key", F.struct(*key)).join(listed, "key", "left")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc", "text_hash", F.col("n_words").cast("bigint").alias("n_words"), covered(F.col("spans")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark window; columns as they come."""
    hits, _ = window_hits(docs, items, id_col, text_col)
    bad = hits.where("size(windows) > 0").select(F.struct(F.col("doc").alias("d"), F.col("text_hash").alias("h")).alias("__bad")).distinct()
    return docs.join(bad, F.struct(F.col(id_col).alias("d"), F.xxhash64(F.col(text_col).cast("string")).alias("h")).eqNullSafe(F.col("__bad")), "left_anti")


def op1_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").cast("bigint").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, n, list_slice(w, p + 1, p + n) AS win FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(0, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, list_slice(w, p + 1, p + n) AS win FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, p, dw.n FROM dw JOIN bw ON dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op1_prefix_decontamination": op1_prefix_decontamination}
ORACLE_SQL = {"op1_prefix_decontamination": _SQL}
