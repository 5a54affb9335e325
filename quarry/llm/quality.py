"""Quality classifier: a sparse ensemble of rules.

Statistics of each text feed boosted trees on a bounded sample of labelled rows. Every tree path becomes a
conjunctive rule; a logistic lasso weighs the rules and drops most of them; the rest are compiled into one Spark
column expression over the statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import materialize, remainder, slices, small_batches, text_or_empty, unused_name

#: The statistics, in the order of the rules' feature numbers.
STATISTICS = ("log_words", "mean_word", "longest_word", "distinct_words", "short_words", "upper", "digits", "punctuation", "symbols", "exclamations", "bars", "line_ends", "repeated_lines", "spaces", "non_ascii", "top_word")
#: At most so many labelled rows train the model; those with the smallest hash of doc_id are taken.
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.7

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*@^~+=<>{}[]\\/_`")] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?'\"()-|")] = True
_UPPER, _DIGIT, _BLANK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _DIGIT[48:58] = True
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


def statistics_of(text: bytes) -> list[float]:
    """Numbers that describe one text (UTF-8); an empty text gives zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = set(words)
    return [
        float(np.log1p(len(words))), float(sizes.mean()), float(sizes.max()), len(distinct) / count, float((sizes <= 3).sum()) / count,
        float(seen[_UPPER].sum()) / n, float(seen[_DIGIT].sum()) / n, float(seen[_PUNCTUATION].sum()) / n, float(seen[_SYMBOLS].sum()) / n,
        float(seen[33]) / count, float(seen[124]) / count, float(seen[10]) / count, 1.0 - len(set(lines)) / max(1, len(lines)),
        float(seen[_BLANK].sum()) / n, float(seen[128:].sum()) / n, max(Counter(words).values(), default=0) / count,
    ]


def with_statistics(docs: DataFrame, carry: list[str], name: str = "statistics") -> DataFrame:
    """The columns ``carry`` of ``docs`` and, in the array ``name``, the statistics of its text."""
    small_batches(docs.sparkSession)
    rows = docs.select(*carry, text_or_empty().alias(f"{name}_text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([statistics_of(t) for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()], np.float64)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], name])

    return rows.mapInArrow(add, rows.drop(f"{name}_text").withColumn(name, F.array(F.lit(0.0))).schema)


@dataclass
class RuleModel:
    """score = logistic(intercept + sum of the weights of the rules that hold)"""

    intercept: float = 0.0
    rules: list[tuple[tuple[trees.Condition, ...], float]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for path, weight in self.rules:
            out += weight * trees.holds(path, x)
        return out

    def column(self, statistics: Column) -> Column:
        """The score as a Spark expression over the array of statistics."""
        columns = [statistics[i] for i in range(len(STATISTICS))]
        total = F.lit(self.intercept)
        for path, weight in self.rules:
            total = total + F.when(trees.path_column(path, columns), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n, k = z.shape
    centre = z.mean(axis=0)
    zc = z - centre
    step = 1.0 / (0.25 * (np.linalg.norm(zc, 2) ** 2 / n + 1.0) + 1e-9)
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(zc @ v + c))) - y
        w2 = v - step * (zc.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b - centre @ w), w


def fit_rules(x: np.ndarray, y: np.ndarray, n_trees: int = 16, depth: int = 3, penalty: float = 1e-3) -> RuleModel:
    """Rules from boosted trees, weighed by lasso. With one class or no rows the score is constant."""
    start, found = trees.boost(x, y, n_trees, depth)
    rules = list(dict.fromkeys(path for tree in found for path in trees.paths(tree)))
    if not rules:
        return RuleModel(start)
    z = np.stack([trees.holds(p, x) for p in rules], axis=1).astype(np.float64)
    b, w = lasso_logistic(z, y, penalty)
    return RuleModel(b, [(p, float(v)) for p, v in zip(rules, w, strict=True) if abs(v) > 1e-6])


def marked(labels: DataFrame, fold: int | None = 2) -> DataFrame:
    """doc_id, quality of the labels outside the held-out fold.

    Labels other than 0 and 1 and null ids are left out; several labels of one id count as their rounded mean.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    if fold is not None:
        marks = marks.filter(remainder(F.col("doc_id"), 4) != fold)
    return marks.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that may train the model: those of the ``max_rows`` labelled ids with the smallest hashes."""
    ids = marked(labels).select("doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = materialize(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "sample")
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")  # max_rows ids


def train(statistics: DataFrame, labels: DataFrame, fold: int | None = 2, max_rows: int = MAX_TRAIN_ROWS) -> RuleModel:
    """Fit on the labelled rows outside the held-out fold; ``statistics`` has doc_id and statistics."""
    rows = statistics.select("doc_id", "statistics").join(marked(labels, fold), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    x = np.array([r["statistics"] for r in rows], np.float64).reshape(-1, len(STATISTICS))
    return fit_rules(x, np.array([r["quality"] for r in rows], np.float64))


def score(statistics: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return statistics.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), model.column(F.col("statistics")).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    A null or empty text has statistics of zero and is scored like any other. A null doc_id falls into the fold of the
    empty text. Repeated rows are each scored. No documents give no rows; no labels give a score of 0.5. Only the text
    is an input of the score; the labels serve training alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(with_statistics(rows, ["doc_id"]), train(with_statistics(sampled(rows, labels), ["doc_id"]), labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects. The rows don't shuffle.

    Rows are judged as in ``classify``: each by itself, empty texts and null ids too. Without labels every score is 0.5
    and no row stays; an empty table gives no rows; columns of any name pass unchanged.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(with_statistics(sampled(rows, labels), ["doc_id"]), labels)
    name = unused_name("statistics", docs.columns)
    judged = with_statistics(docs, docs.columns, name)
    return judged.filter(model.column(F.col(name)) >= THRESHOLD).drop(name)
