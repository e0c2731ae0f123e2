"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade <= k) = logistic(threshold_k - s): one score s, the sum of the shared weights of a text's features, and
ordered thresholds. A text gets its expected grade and the tail probability P(grade >= top), by which it is selected.

Features of a whole text are its distinct words (A-Z lower-cased, known by 64-bit hash) and marks of
its shape: shares of capitals, digits, symbols and repeated words, word length and number of words, in steps.

Training reads at most about ``TRAIN_ROWS`` labelled texts per grade (a hash of the id selects the same
share of rows everywhere). Features of fewer than a ``MIN_SHARE`` of these texts, which bounds the model by the
average text times ``1 / MIN_SHARE``, and features spread over the grades like the texts themselves are left out. The fit runs in ``SHARDS`` tasks; their parameters
are averaged and refined for ``ROUNDS`` rounds.

Defined results: a NULL or empty text is judged by its shape; labels with a NULL or without a text do not train;
several labels of a document all train; with no labels, or too few to tell a feature, every text has the lowest grade's values; repeated
rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.texts import ALPHANUMERIC, bounded, list_array, map_arrow, mix, words
from tillsight.session import stage

TRAIN_ROWS = 12_000
MIN_SHARE = 1 / 1000
DEVIATION = 5.0
SHARDS = 8
ROUNDS = 2
STEPS = 300
RATE = 0.3
RIDGE = 3e-5
SELECT_AT = 0.5

_UPPER, _DIGIT, _SYMBOL, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL[33:127] = True
_SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123), 0x2C, 0x2E]] = False


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each text, one text after the other, and where each begins."""
    found = words(column, ALPHANUMERIC)
    n = len(found.first) - 1
    counts = np.diff(found.first)
    owner = found.text_of_word()
    order = np.lexsort((found.hashes, owner))
    values, owner = found.hashes[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    size = np.maximum(np.diff(found.offsets), 1)

    def share(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(table[found.data], dtype=np.int64)))[found.offsets]) / size

    distinct = np.bincount(owner, minlength=n)
    marks = [
        np.floor(share(_UPPER) * 20), np.floor(np.sqrt(share(_DIGIT)) * 10), np.floor(np.sqrt(share(_SYMBOL)) * 20),
        np.floor(share(_SPACE) * 20), np.floor(distinct / np.maximum(counts, 1) * 10), np.floor(np.log2(1 + counts)),
        np.minimum(np.floor(size / np.maximum(counts, 1)), 30),
    ]
    extra = [mix(m.astype(np.uint64) + np.uint64((k + 1) << 32)) for k, m in enumerate(marks)]
    values = np.concatenate([values, *extra])
    owner = np.concatenate([owner, *[np.arange(n)] * len(extra)])
    order = np.argsort(owner, kind="stable")
    return values[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Sorted feature hashes, their weights, and ordered thresholds (one fewer than there are grades)."""

    known: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(edges) - 1)
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        each = np.where(self.known[at] == values, self.weights[at], 0.0)
        return np.diff(np.concatenate(([0.0], np.cumsum(each)))[edges])

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k (columns)."""
        return _logistic(scores[:, None] - self.thresholds[None, :])


def descend(rows: list[np.ndarray], grades: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive gradient steps on the balanced log-likelihood; ``rows`` hold feature numbers."""
    weights, thresholds = weights.copy(), thresholds.copy()
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    per_grade = np.bincount(grades, minlength=len(thresholds) + 1)
    balance = (len(grades) / np.maximum(per_grade, 1) / np.count_nonzero(per_grade))[grades] / max(len(grades), 1)
    bounds = (np.full(len(weights), 1e-8), np.full(len(thresholds), 1e-8))
    for _ in range(STEPS):
        s = np.add.reduceat(weights[flat], starts) if len(flat) else np.zeros(len(rows))
        cuts = np.concatenate(([-np.inf], thresholds, [np.inf]))
        upper, lower = _logistic(cuts[grades + 1] - s), _logistic(cuts[grades] - s)
        inside = np.maximum(upper - lower, 1e-9)
        slope = balance * (upper + lower - 1)
        grad = np.bincount(flat, weights=np.repeat(slope, lengths), minlength=len(weights)) - RIDGE * weights
        pull = np.bincount(grades, weights=balance * upper * (1 - upper) / inside, minlength=len(cuts) - 1)[: len(thresholds)]
        pull -= np.bincount(grades, weights=balance * lower * (1 - lower) / inside, minlength=len(cuts) - 1)[1:]
        for value, g, seen in ((weights, grad, bounds[0]), (thresholds, pull, bounds[1])):
            seen += g * g
            value += RATE * g / np.sqrt(seen)
        thresholds = np.maximum.accumulate(thresholds)
    return weights, thresholds


def _learner(shared: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """Refine the shared parameters on one shard."""

    def learn(table: pa.Table) -> pa.Table:
        known, weights, thresholds = shared.value
        column = table.column("features").combine_chunks()
        values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
        ok = known[at] == values if len(known) else np.zeros(len(values), bool)
        edges = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
        kept = np.concatenate(([0], np.cumsum(ok)))[edges]
        numbers = at[ok]
        rows = [numbers[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
        full = [i for i, r in enumerate(rows) if len(r)]
        grades = table.column("grade").to_numpy()[full]
        weights, thresholds = descend([rows[i] for i in full], grades, weights, thresholds)
        return pa.table({"w": pa.array([weights.tobytes()], pa.binary()), "t": pa.array([thresholds.tobytes()], pa.binary())})

    return learn


def _telling(rows: DataFrame, sizes: dict[int, int], total: int) -> DataFrame:
    """Features that are frequent enough and whose share in some grade is off the grade's share by ``DEVIATION`` standard deviations."""
    in_grade = {k: F.sum(F.when(F.col("grade") == k, 1).otherwise(0)).alias(f"n{k}") for k in sizes}
    counted = rows.select("grade", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), *in_grade.values())
    telling = F.lit(False)
    for k, size in sizes.items():
        share = size / total
        telling = telling | (F.abs(F.col(f"n{k}") - F.col("n") * share) >= DEVIATION * F.sqrt(F.col("n") * share * (1 - share)))
    return counted.where((F.col("n") >= max(5, total * MIN_SHARE)) & telling).select("f")


def fit(docs: DataFrame, grades: DataFrame, levels: int, train_rows: int = TRAIN_ROWS) -> Model:
    """Model of ``grades`` (doc_id, grade from 0 to ``levels - 1``) and the texts of ``docs``."""
    spark = docs.sparkSession
    rated = grades.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1)).select("doc_id", "grade")
    share = F.lit(float(train_rows)) / F.col("rows")
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = rated.groupBy("grade").agg(F.count(F.lit(1)).alias("rows"))
    chosen = rated.join(F.broadcast(sizes), "grade").where(unit < share).select("doc_id", "grade")  # about levels * train_rows rows
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            values, edges = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("grade"), list_array(values.view(np.int64), np.diff(edges), pa.int64())],
                ["shard", "grade", "features"],
            )

    narrow = texts.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).alias("shard"), F.col("grade").cast("int").alias("grade"), "text")
    rows = stage(map_arrow(narrow, describe, "shard long, grade int, features array<long>"), "features")
    sizes = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    known = np.sort(np.array([r[0] for r in _telling(rows, sizes, total).collect()], np.int64).view(np.uint64))
    weights, thresholds = np.zeros(len(known)), np.arange(levels - 1, dtype=float) - (levels - 2) / 2

    for _ in range(ROUNDS if len(known) else 0):
        shared = spark.sparkContext.broadcast((known, weights, thresholds))
        parts = rows.groupBy("shard").applyInArrow(_learner(shared), "w binary, t binary").collect()  # SHARDS rows
        weights = np.mean([np.frombuffer(p["w"]) for p in parts], axis=0)
        thresholds = np.mean([np.frombuffer(p["t"]) for p in parts], axis=0)
    return Model(known, weights, thresholds)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``expected_grade`` and ``tail_probability`` (of the highest grade) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in bounded(batches):
            tails = model.tails(model.scores(*features(batch.column("text"))))
            if not len(model.known):
                tails[:] = 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])],
                ["doc_id", "expected_grade", "tail_probability"],
            )

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_arrow(narrow, judge, f"doc_id {kind}, expected_grade double, tail_probability double")


def selected(graded: DataFrame, at: float = SELECT_AT) -> DataFrame:
    """The documents whose highest grade is likely enough."""
    return graded.where(F.col("tail_probability") >= at)
