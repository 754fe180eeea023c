"""Secret scans judged by corpus-wide ownership frequency.

Candidates are found with regular expressions and carry only the hash of their
value from then on. Hashes are counted over distinct repositories (here: documents) and
distinct owners (here: sources), pre-aggregated level by level so that a value in a third
of all rows is never one group. A value of ``EXAMPLE_OWNERS`` owners or more is a
widely copied example; one of fewer owners looks live. Base spans (assign, access, hex) stay
as found; spans of the weaker kind ``token`` (a long run that mixes lower case,
upper case and digits) are added where their value looks live and no base span
covers them.

Only DataFrame functions run. The patterns pass over each text once; what they find is written as an
array for each row. Offsets come from the lengths of the pieces between matches, summed in a
window over one document's matches. Only candidates are joined to the verdict on their value, and
values that many candidates share are broadcast (fewer than a thousand), so none makes a large task.

Defined results: a null text is empty; a very long text is one text; a null owner is an owner of its
own; repeated rows give a row each and count as one repository; spans that start together (ties) come in the
order of the kinds; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.llm.skew import join_by_key
from switchback.storage import materialize, table

EXAMPLE_OWNERS = 4
KINDS = ("assign", "access", "hex", "token")
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Runs are maximal, so the least length can stand in the pattern; ``assign`` is filtered after matching.
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}", "token": "[A-Za-z0-9_-]{24,}"}
MASK = "[SECRET]"


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind,idx,gap,len,keep,value>>: all matches of a kind, in order."""
    pattern = F.lit(PATTERNS[kind])
    gaps, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else found
    keep = {"assign": lambda v: F.char_length(v) >= 12, "token": lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")}.get(kind, lambda v: F.lit(True))
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("value")),
        lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("idx"), F.char_length(m["gap"]).alias("gap"), F.char_length(m["hit"]).alias("len"), keep(m["value"]).alias("keep"), F.sha2(m["value"], 256).alias("value")),
    )
    rows = F.filter(rows, lambda m: m["len"].isNotNull())  # the piece after the last match
    return F.when(text.rlike(PATTERNS[kind]), rows)


_FOUND = "array<struct<kind:int,idx:int,gap:int,len:int,keep:boolean,value:string>>"


def searched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", extra: tuple[Column, ...] = ()) -> DataFrame:
    """(uid, doc_id, owner, extra..., found), written: one row for each row of ``docs``, with all
    matches of all kinds; those that fail their filter only count for offsets."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.concat(*[F.coalesce(_matches(text, kind), F.array().cast(_FOUND)) for kind in KINDS])
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), *extra, found.alias("found"))
    return materialize(rows, "searched")


def candidates(rows: DataFrame) -> DataFrame:
    """(uid, doc_id, owner, kind, start, end, value): a row for each candidate of ``searched`` rows.
    ``value`` is a hash."""
    flat = rows.where(F.size("found") > 0).select("uid", "doc_id", "owner", F.inline("found"))
    before = W.partitionBy("uid", "kind").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    placed = flat.withColumn("end", F.sum(F.col("gap").cast("bigint") + F.col("len")).over(before)).where("keep")
    return placed.select("uid", "doc_id", "owner", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """(value, n, n_repositories, n_owners) of candidate hashes; ``n`` counts the candidates."""
    values = found.select("value", F.struct("owner").alias("owner"), "doc_id")
    by_owner = values.groupBy("value", "owner", "doc_id").agg(F.count("*").alias("n")).groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n"), F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def judged_spans(rows: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Candidates of ``searched`` rows with ``live`` and ``kept``: base spans are kept, tokens if
    they look live and overlap no base span."""
    found = materialize(candidates(rows), "candidates")
    facts = materialize(ownership(found), "ownership")
    judged = join_by_key(found, facts, "value", "n").withColumn("live", F.col("n_owners") < example_owners)
    base = F.col("kind") < 3
    order = W.partitionBy("uid").orderBy("start", "kind")
    earlier = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    later = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    alone = (F.coalesce(earlier, F.lit(0)) <= F.col("start")) & (F.coalesce(later, F.col("end")) >= F.col("end"))
    return judged.withColumn("alone", alone).withColumn("kept", base | (F.col("live") & F.col("alone")))


def scan(docs: DataFrame, **columns) -> DataFrame:
    """(uid, doc_id, spans) with one row for each row of ``docs``; ``spans`` is an ordered
    array of (start, kind, end, live)."""
    rows = searched(docs, **columns)
    spans = judged_spans(rows).where("kept").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>")
    return rows.select("uid", "doc_id").join(spans, "uid", "left").select("uid", "doc_id", F.coalesce("spans", none).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", length_col: str | None = "n_chars", mask: str = MASK) -> DataFrame:
    """``docs`` with every live-looking secret replaced; widely copied examples stay.

    Rows are written once with what the patterns found; only rows with a candidate are
    shuffled, to be joined to their spans.
    """
    rows = searched(docs, id_col, text_col, owner_col, (F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),))
    spans = judged_spans(rows).where("kept AND live").groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    merged = F.aggregate(  # overlapping spans become one
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    hit = rows.where(F.size("found") > 0).join(spans, "uid", "left").select("row", merged.alias("merged"))
    text = F.col("row")[text_col]
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("merged"), i - 1)["end"])
    pieces = F.transform("merged", lambda s, i: F.substring(text, (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")))
    tail = F.substring(text, (F.element_at("merged", -1)["end"] + 1).cast("int"), F.char_length(text))
    changed = F.size("merged") > 0
    new = F.when(changed, F.array_join(F.concat(pieces, F.array(tail)), mask)).otherwise(text)
    put = {text_col: new}
    if length_col in docs.columns:
        put[length_col] = F.when(changed, F.char_length(new).cast(docs.schema[length_col].dataType)).otherwise(F.col("row")[length_col])
    masked = hit.select(*[put.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
    return rows.where(F.size("found") == 0).select("row.*").unionByName(masked)


def op2_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    counts = [count(k) for k in range(3)]
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live")
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), live)


def _duck_kind(kind: str) -> str:
    pattern = PATTERNS[kind].replace("'", "''")
    value = f"regexp_extract_all(t, '{pattern}', 2)" if kind == "assign" else "hits"
    keep = {"assign": "length(v) >= 12", "token": "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')"}.get(kind, "true")
    return f"""SELECT doc_id, owner, {KINDS.index(kind)} AS kind, e - length(hit) AS s, e, sha256(v) AS v FROM (
SELECT doc_id, owner, hit, v, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
SELECT doc_id, owner, unnest(hits) AS hit, unnest(vals) AS v, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM (
SELECT doc_id, owner, hits, {value} AS vals, regexp_split_to_array(t, '{pattern}') AS gaps FROM (
SELECT doc_id, owner, t, regexp_extract_all(t, '{pattern}') AS hits FROM d)))) WHERE {keep}"""


_SQL = f"""
WITH d AS (SELECT doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
c AS ({' UNION ALL '.join(_duck_kind(kind) for kind in KINDS)}),
o AS (SELECT v, count(DISTINCT coalesce(owner, chr(1))) AS n FROM c GROUP BY v),
j AS (SELECT c.*, n < {EXAMPLE_OWNERS} AS live FROM c JOIN o USING (v)),
k AS (SELECT * FROM j WHERE kind < 3 OR (live AND NOT EXISTS (SELECT 1 FROM j AS b WHERE b.doc_id = j.doc_id AND b.kind < 3 AND b.s < j.e AND b.e > j.s))),
w AS (SELECT *, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM k),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans, count(*) FILTER (live) AS n_live FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (doc_id)
"""

QUERIES = {"op2_ownership_secrets": op2_ownership_secrets}
ORACLE_SQL = {"op2_ownership_secrets": _SQL}
