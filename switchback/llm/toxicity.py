"""Toxicity by weak supervision.

Voters: stated word lists, patterns, and lexicons and prefix patterns mined
from the labelled rows one may learn from (over all of them, alike texts once; every hashed
feature that passes the thresholds is kept). A generative label model is fitted by expectation
maximisation on the counts of vote patterns of all those rows: each voter has an accuracy for each class and
each vote of the voter it leans on most, if any. These pairs form a tree, chosen by the mutual
information of two voters within the classes, so correlations are parameters of the model. A known label is a
further voter, whose accuracy starts near 1 (``GOLD_ROWS`` rows), so with few labels the
posteriors of labelled rows are their labels, and the voters tell about the rows without one. A linear
classifier over the mined features is trained on the posteriors of a bounded sample
(at most ``SAMPLE_ROWS`` rows of either side, the first by a hash of id, votes and position) and
scores whole texts. Every text is read once for its votes and features, which are written.

Defined results: a null or wordless text is scored by the bias; a very long text is one text, whose
features count once; without labels of both kinds the mined voters are missing and the stated
lists decide; a null id is hashed as the empty string; labels that contradict each other (ties) count as
toxic; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchback.llm.features import letters_and_spaces, word_features
from switchback.llm.langid import fold
from switchback.llm.linear import logits, softmax, temperature, train
from switchback.storage import materialize, table

PREFIXES, BITS = (3, 4, 5), 18
LEAST_ROWS, LEAST_LOG_ODDS = 5, 2.5
STRIPES = 3
SAMPLE_ROWS, GOLD_ROWS, LEAST_INFORMATION = 4000, 20, 1e-3
THRESHOLD = 0.7
LISTS = {
    "en": "idiot idiots stupid moron loser trash scum worthless pathetic disgusting clown dumb jerk bastard",
    "de": "dumm idiot arschloch schwachkopf abschaum widerlich trottel",
    "fr": "idiot stupide connard imbécile ordure dégoûtant crétin",
    "es": "idiota estúpido imbécil basura asqueroso inútil tonto",
}
_SHOUT = re.compile(r"\b[A-Z]{4,}\b(?:\W+\b[A-Z]{4,}\b){2,}")
_MARKS = re.compile(r"[!?]{3,}")
GOLD = "gold"
ALL = -1


def _buckets(text: str | None) -> np.ndarray:
    return word_features(letters_and_spaces(text), PREFIXES, BITS)


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that hold a bucket; those of all under ``ALL``."""
    seen, texts = np.zeros((2, (len(PREFIXES) + 1) << BITS), np.int64), [0, 0]
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            seen[int(toxic.as_py())][_buckets(text.as_py())] += 1
            texts[int(toxic.as_py())] += 1
    index = np.flatnonzero(seen.any(axis=0))
    columns = [np.append(index, ALL).astype(np.int32), np.append(seen[1][index], texts[1]), np.append(seen[0][index], texts[0])]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "toxic", "clean"])


class Voters:
    """Binary votes: one for each list, each pattern and each stripe of mined features."""

    def __init__(self, mined: pd.DataFrame):
        self.groups = np.full((len(PREFIXES) + 1) << BITS, -1, np.int16)
        self.names = [f"list-{k}" for k in LISTS] + ["shout", "marks"]
        for kind, name in ((mined.bucket < 1 << BITS, "words"), (mined.bucket >= 1 << BITS, "prefixes")):
            for stripe in range(STRIPES):  # by rank, so that voters err apart from each other
                some = mined.bucket[kind].to_numpy()[stripe::STRIPES]
                self.groups[some] = len(self.names)
                self.names.append(f"{name}-{stripe}")
        for k, words in enumerate(LISTS.values()):
            for word in words.split():
                at = word_features(letters_and_spaces(word), (), BITS)
                if (self.groups[at] < 0).all():
                    self.groups[at] = k
        self.lists = [frozenset(words.split()) for words in LISTS.values()]

    def vote(self, text: str | None) -> tuple[int, np.ndarray]:
        """The votes as bits, and the text's known features."""
        buckets = _buckets(text)
        known = buckets[self.groups[buckets] >= 0]
        bits = int(np.bitwise_or.reduce(1 << self.groups[known].astype(np.int64), initial=0))
        n = len(self.lists)
        if text and len(known):
            words = set(text.lower().split()) | set(re.findall(r"\w+", text.lower()))
            for k, listed in enumerate(self.lists):
                bits = bits | (1 << k) if words & listed else bits & ~(1 << k)
        if text and _SHOUT.search(text):
            bits |= 1 << n
        if text and _MARKS.search(text):
            bits |= 1 << (n + 1)
        return bits, known


class LabelModel:
    """P(label) times, for each voter, P(its vote | the vote of the voter it leans on, label).

    ``patterns``: columns bits, gold (0, 1 or -1: none), n. ``leans[j]`` is the voter that ``j``
    leans on, or ``j`` itself, whose vote then tells nothing more; ``rate[label, vote of that one, j]``
    is how often ``j`` votes.
    """

    def __init__(self, patterns: pd.DataFrame, voters: int, rounds: int = 30):
        bits, gold, n = (patterns[c].to_numpy(np.int64) for c in ("bits", "gold", "n"))
        votes = self._votes(bits, voters)
        self.leans = np.arange(voters)
        q = np.where(gold >= 0, gold, np.where(votes.any(axis=1), 0.6, 0.05)).astype(float)
        for step in range(rounds):
            mass = np.stack([n * (1 - q), n * q])
            total = mass.sum(axis=1)
            if step in (5, 15):
                self.leans = self._tree(votes, mass)
            self.prior = (total + 1) / (total.sum() + 2)
            self.rate = self._rates(votes, mass)
            known = gold >= 0
            right = [(mass[c][known & (gold == c)].sum() + GOLD_ROWS) / (mass[c][known].sum() + GOLD_ROWS + 1) for c in (0, 1)]
            self.gold = np.array([[right[0], 1 - right[0]], [1 - right[1], right[1]]])
            q = self.posterior(bits, gold)

    @staticmethod
    def _votes(bits: np.ndarray, voters: int) -> np.ndarray:
        return ((np.asarray(bits)[:, None] >> np.arange(voters)) & 1).astype(float)

    def _given(self, votes: np.ndarray) -> np.ndarray:
        """The vote that each voter leans on; 0 for one that leans on none."""
        return np.where(self.leans == np.arange(len(self.leans)), 0.0, votes[:, self.leans])

    def _rates(self, votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Shares of votes, drawn a little (one row) towards those of both labels, so that few rows tell little."""
        given = self._given(votes)
        sides = [[(on * m[:, None]) for on in (1 - given, given)] for m in mass]
        yes = np.array([[(side * votes).sum(axis=0) for side in pair] for pair in sides])
        rows = np.array([[side.sum(axis=0) for side in pair] for pair in sides])
        pooled = (yes.sum(axis=0) + 0.5) / (rows.sum(axis=0) + 1)
        return (yes + pooled) / (rows + 1)

    def _tree(self, votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """The spanning forest of most mutual information within the labels, above a least amount."""
        size = votes.shape[1]
        told = np.zeros((size, size))
        for m in mass:
            both = [[(a * m[:, None]).T @ b + 0.25 for b in (1 - votes, votes)] for a in (1 - votes, votes)]
            total = both[0][0] + both[0][1] + both[1][0] + both[1][1]
            for i in (0, 1):
                for j in (0, 1):
                    row, column = both[i][0] + both[i][1], both[0][j] + both[1][j]
                    told += both[i][j] / mass.sum() * np.log(both[i][j] * total / (row * column))
        leans, free = np.arange(size), np.ones(size, bool)
        best = np.full(size, -np.inf)
        near = np.arange(size)
        for _ in range(size):
            k = int(np.argmax(np.where(free, best, -np.inf))) if np.isfinite(np.where(free, best, -np.inf)).any() else int(np.argmax(free))
            if best[k] >= LEAST_INFORMATION:
                leans[k] = near[k]
            free[k] = False
            closer = free & (told[k] > best)
            best[closer], near[closer] = told[k][closer], k
        return leans

    def posterior(self, bits: np.ndarray, gold: np.ndarray) -> np.ndarray:
        votes = self._votes(bits, len(self.leans))
        given = self._given(votes).astype(int)
        rate = [self.rate[label][given, np.arange(votes.shape[1])] for label in (0, 1)]
        likely = [np.log(np.where(votes > 0, r, 1 - r)).sum(axis=1) for r in rate]
        told = np.log(self.gold[1] / self.gold[0])
        odds = np.log(self.prior[1] / self.prior[0]) + likely[1] - likely[0] + np.where(gold >= 0, told[np.clip(gold, 0, 1)], 0.0)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


class Classifier:
    def __init__(self, voters: Voters, features: np.ndarray, weights: np.ndarray, bias: np.ndarray, heat: float, labels: LabelModel | None = None):
        self.voters, self.features, self.weights, self.bias, self.heat, self.labels = voters, features, weights, bias, heat, labels

    def score(self, known: np.ndarray) -> float:
        """Of the known features of a text."""
        total = self.weights[np.searchsorted(self.features, known)].sum(axis=0) / max(1, len(known)) ** 0.5
        return float(softmax((total + self.bias) / self.heat)[1])


def _told(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("gold"))


def mine(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Voters:
    """The voters, with lexicons from the rows of ``docs`` that ``labels`` names."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    # labels grow with the corpus, so no join may broadcast them
    known = rows.join(_told(labels, id_col, label_col).hint("merge"), "__id").where("gold IN (0, 1)").groupBy("__text").agg(F.max("gold").alias("gold"))  # copies count once
    seen = materialize(known.mapInArrow(_mine, "bucket int, toxic bigint, clean bigint").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "mined")
    total = seen.where(F.col("bucket") == ALL).first() or {"toxic": 0, "clean": 0}
    odds = F.log((F.col("toxic") + 0.5) / F.lit(total["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(total["clean"] + 1.0))
    mined = (
        seen.where((F.col("bucket") != ALL) & (F.col("toxic") >= LEAST_ROWS)).withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS)
        .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "bucket").toPandas()
    )  # fmt: skip  # at most as many rows as there are buckets
    return Voters(mined)


def voted(docs: DataFrame, voters: Voters, text_col: str = "text", extra=()) -> DataFrame:
    """``extra`` columns, then the votes (``__bits``) and known features (``__known``) of each row."""
    rows = docs.select(*extra, F.col(text_col).cast("string").alias("__text"))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [voters.vote(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].astype(np.int32).tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "__bits", "__known"])

    return rows.mapInArrow(votes, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema], "__bits bigint, __known binary"]))


def train_on(votes: DataFrame, voters: Voters, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> Classifier:
    """A classifier from written ``votes`` of the rows one may learn from, with their ids."""
    rows = votes.select(F.col(id_col).alias("__id"), "__bits", "__known", F.xxhash64(F.col(id_col), "__bits", "__known", F.monotonically_increasing_id()).alias("h"))
    rows = rows.join(_told(labels, id_col, label_col).hint("merge"), "__id", "left").withColumn("gold", F.coalesce("gold", F.lit(-1)))
    rows = materialize(rows.drop("__id"), "votes")
    patterns = rows.groupBy(F.col("__bits").alias("bits"), "gold").agg(F.count("*").alias("n")).toPandas()  # at most 3 * 2 ** voters rows
    hits = {side: int(patterns.n[(patterns.bits > 0) == side].sum()) for side in (True, False)}
    if patterns.empty:
        patterns = pd.DataFrame({"bits": [0], "gold": [-1], "n": [1]})
    model = LabelModel(patterns, len(voters.names))

    parts = []
    for side, n in hits.items():
        few = F.pmod("h", F.lit(1 << 30)) < min(1.0, 1.5 * SAMPLE_ROWS / max(1, n)) * (1 << 30)
        parts.append(rows.where((F.col("__bits") > 0) == side).where(few).orderBy("h").limit(SAMPLE_ROWS).toPandas())
    sample = pd.concat(parts).sort_values(["h", "__bits"])
    features = np.flatnonzero(voters.groups >= 0)
    examples = [(at := np.searchsorted(features, np.frombuffer(k, np.int32)), np.full(len(at), max(1, len(at)) ** -0.5)) for k in sample["__known"]]
    q = model.posterior(sample["__bits"].to_numpy(np.int64), sample.gold.to_numpy(np.int64)) if len(sample) else np.empty(0)
    targets = np.stack([1 - q, q], 1)
    held = np.arange(len(examples)) % 5 == 4
    part = lambda mask: [e for e, m in zip(examples, mask, strict=True) if m]
    weights, bias = train(part(~held), targets[~held], len(features), epochs=15, alpha=1.0, l1=1e-3, l2=1e-4)
    return Classifier(voters, features, weights, bias, temperature(logits(part(held), weights, bias), targets[held]), model)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """A classifier learned from rows of ``docs``, of which ``labels`` names some."""
    voters = mine(docs, labels, id_col, text_col, label_col)
    return train_on(voted(docs, voters, text_col, [F.col(id_col)]), voters, labels, id_col, label_col)


def scored(votes: DataFrame, model: Classifier) -> DataFrame:
    """The columns of ``votes`` but for the votes, and a score; a column called score is replaced."""
    kept = [c for c in votes.columns if c not in ("__bits", "__known", "score")]
    rows = votes.select(*[F.col(f"`{c}`") for c in kept], "__known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([model.score(np.frombuffer(known.as_py(), np.int32)) for known in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*kept, "score"])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__known").schema], "score double"]))


def score(docs: DataFrame, model: Classifier, text_col: str = "text", extra=()) -> DataFrame:
    """``extra`` columns, then score, for each row."""
    return scored(voted(docs, model.voters, text_col, extra), model)


def op6_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 3) == 1
    voters = mine(docs.where(~held_out), labels.where(~held_out))
    votes = materialize(voted(docs, voters, "text", [F.col("doc_id"), held_out.alias("held_out")]), "all-votes")
    model = train_on(votes.where("NOT held_out"), voters, labels.where(~held_out))
    return scored(votes, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op6_weak_toxicity": op6_weak_toxicity}
ORACLE_SQL: dict[str, str] = {}
