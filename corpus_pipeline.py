"""A corpus pipeline: language, near-duplicates, benchmarks, secrets, packing.

Each stage works on all rows that the stage before it kept, and its decisions take effect: rows
without an identified language go, one document of each near-duplicate group
stays, documents with a benchmark window go, live-looking secrets are masked in the text,
and what is left is packed. All but the last return the columns of ``documents``.

Defined results: null, empty and letterless texts are rejected by the first stage; very long texts are whole
texts in every stage; of a near-duplicate group the row with the smallest id stays (null ids last, then the smallest
text hash; of rows alike in both, any one); repeated rows are such a group; a null owner is an owner of its own; other
columns pass through all stages but the last; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from switchback.llm.decontaminate import remove_contaminated
from switchback.llm.langid import reject_unidentified
from switchback.llm.packing import pack_documents
from switchback.llm.secrets import redact_live
from switchback.llm.simhash import keep_one_of_each
from switchback.session import reachable
from switchback.storage import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_unidentified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_live(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]
#: Fingerprints, classifiers and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(reachable(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
