"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained with follow-the-regularised-leader under an elastic net and calibrated
with a temperature.

Document frequencies cover all rows to learn from. The classifier is fitted on a bounded
sample of them: about ``SAMPLE_PER_LABEL`` rows of each label and ``SAMPLE_ROWS``
in all, chosen by a hash of id, text and position, so that rows without an id or with one id are chosen
as others are; a fifth of it is kept for the calibration.

Defined results: a null text or one without a letter is ``und`` with score 0; a very long text is one
text; languages of one probability (a tie) give the first in their order; rows with a null
label are not learned from; without any labelled row every text is ``und``; a null id is
hashed as the empty string; repeated rows give a row each; an empty table gives no rows; other columns are
ignored, and columns called lang_pred, score or __text are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchback.llm.features import char_ngrams, letters_and_spaces
from switchback.llm.linear import logits, softmax, temperature, train
from switchback.storage import table

SIZES, BITS = (1, 2, 3), 15
SAMPLE_PER_LABEL, SAMPLE_ROWS = 1000, 6000
UNKNOWN = "und"


def fold(id_col: str, parts: int) -> Column:
    """The remainder of the CRC-32 of an id written as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts), or None without a letter."""
    x = letters_and_spaces(text)
    if len(x) < 2 or (len(x) == 2 and x[1] == 32):
        return None
    counts = np.bincount(char_ngrams(x, SIZES, BITS), minlength=1 << BITS)
    index = np.flatnonzero(counts)
    return index, counts[index]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if (found := _counts(text.as_py())) is not None:
                df[found[0]] += 1
                rows += 1
    index = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(index, -1).astype(np.int32)), pa.array(np.append(df[index], rows))], ["bucket", "n"])


class Model:
    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray | None = None, bias: np.ndarray | None = None, heat: float = 1.0):
        self.labels, self.idf, self.weights, self.bias, self.heat = labels, idf, weights, bias, heat

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        if (found := _counts(text)) is None:
            return None
        index, counts = found
        value = ((1 + np.log(counts)) * self.idf[index]).astype(np.float32)
        return index.astype(np.int32), value / np.linalg.norm(value)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or (row := self.vector(text)) is None:
            return UNKNOWN, 0.0
        p = softmax((row[1] @ self.weights[row[0]] + self.bias) / self.heat)
        best = int(np.argmax(p))
        return self.labels[best], float(min(1.0, p[best]))


def fit(docs: DataFrame, text_col: str, label_col: str, id_col: str) -> Model:
    """A model of the labelled rows of ``docs``."""
    rows = docs.where(F.col(label_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(id_col), F.col(text_col), F.monotonically_increasing_id(), F.lit(9)).alias("h"))
    sizes = dict(rows.groupBy("label").count().collect())
    labels = sorted(sizes)
    found = rows.select("text").mapInArrow(_document_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas() if labels else None
    if not labels:
        return Model([], np.ones(1 << BITS))
    n = dict(zip(found.bucket, found.n, strict=True))
    df = np.zeros(1 << BITS)
    df[found.bucket[found.bucket >= 0]] = found.n[found.bucket >= 0]
    model = Model(labels, np.log((1 + n.get(-1, 0)) / (1 + df)) + 1)

    most = min(SAMPLE_PER_LABEL, SAMPLE_ROWS // len(labels) + 1)
    shares = F.create_map(*[F.lit(x) for label in labels for x in (label, int(min(1.0, most / sizes[label]) * (1 << 30)))])
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(shares, F.col("label")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(label.as_py(), h.as_py(), row) for text, label, h in zip(*batch.columns, strict=True) if (row := model.vector(text.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2][0].tobytes() for k in kept], pa.binary()), pa.array([k[2][1].tobytes() for k in kept], pa.binary())], ["label", "h", "i", "v"])

    got = sample.mapInArrow(vectors, "label string, h bigint, i binary, v binary").toArrow().sort_by("h").to_pydict()
    examples = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["i"], got["v"], strict=True)]
    if not examples:
        return Model([], np.ones(1 << BITS))
    targets = np.array([[label == known for known in labels] for label in got["label"]], float)
    held = np.arange(len(examples)) % 5 == 4
    part = lambda mask: [e for e, m in zip(examples, mask, strict=True) if m]
    model.weights, model.bias = train(part(~held), targets[~held], 1 << BITS)
    model.heat = temperature(logits(part(held), model.weights, model.bias), targets[held])
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", extra: list[Column] = ()) -> DataFrame:
    """``extra`` columns, then lang_pred and score, for each row."""
    own = ("lang_pred", "score", "__text")
    taken = docs.select(*extra, F.col(text_col).cast("string").alias("__text")) if extra else docs.select(F.col(text_col).cast("string").alias("__text"))
    rows = taken.select(*[F.col(f"`{c}`") for c in taken.columns if c not in own], "__text")
    kept = rows.drop("__text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "lang_pred string", "score double"]))


def op9_ftrl_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 4) != 2), "text", "lang", "doc_id")
    return identify(docs, model, "text", [F.col("doc_id"), (fold("doc_id", 4) == 2).alias("held_out")])


def reject_unidentified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` in an identified language; columns as they come."""
    model = fit(docs, "text", "lang", "doc_id")
    names = docs.columns
    found = identify(docs, model, "text", [F.struct(*names).alias("row")])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


QUERIES = {"op9_ftrl_langid": op9_ftrl_langid}
ORACLE_SQL: dict[str, str] = {}
