"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One score, the mean weight of a text's hashed words, word pairs and character
3-grams, is held against ordered thresholds t1 < t2: P(grade >= k) =
sigmoid(score - tk). All grades share the weights. ``score`` gives the expected
grade and the tail probabilities; selection is by the probability of at least
``SELECT_GRADE``.

Grades from the labels: 0 poor quality, 1 good quality but toxic, 2 good.

Defined cases: a null or empty text has score 0 and is graded by the thresholds
alone; equal rows get equal grades; an empty table gives no rows; other columns
are ignored by ``score`` and kept by ``keep``; a text of any length is read
whole, a long one in pieces with bounded temporaries. If fewer than two grades have labelled rows there is no model: the
columns are null and every document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import hashed_text as ht, vectext as vt
from .work import texts

GRADES = 3
#: A document is kept if it has this grade or a better one with at least this probability.
SELECT_GRADE, SELECT_FROM = 1, 0.5
#: Labelled rows of each grade that the model is fitted on, at most.
SAMPLE_PER_GRADE = 800
STEPS, RATE, RIDGE = 80, 1.0, 1e-6


def grade_of_labels() -> Column:
    """0 where quality is 0, else 1 where toxic is 1, else 2; null without a quality."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))


@dataclass(frozen=True)
class OrdinalModel:
    """Shared weights and ordered thresholds; ``weights`` None: no model."""

    weights: np.ndarray | None
    thresholds: np.ndarray | None = None

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a row each."""
        return ht.sigmoid(score[None, :] - self.thresholds[:, None])


def train(rows: list) -> OrdinalModel:
    d = ht.Design(rows)
    y = d.y
    if len(np.unique(y)) < 2:
        return OrdinalModel(None)
    n, size, k = len(y), ht.BUCKETS * ht.FAMILIES, GRADES - 1
    sure = 1e-9

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[size] + np.concatenate([[0.0], np.cumsum(np.exp(p[size + 1 :]))])

    def grad(p: np.ndarray) -> np.ndarray:
        t = thresholds(p)
        c = ht.sigmoid(d.dot(p[:size])[:, None] - t[None, :])
        c = np.concatenate([np.ones((n, 1)), c, np.zeros((n, 1))], 1)  # P(grade >= 0 ... GRADES)
        slope = c * (1 - c)
        at = np.arange(n)
        likely = np.maximum(c[at, y] - c[at, y + 1], sure)
        upper, lower = -slope[at, y] / likely / n, slope[at, y + 1] / likely / n  # d loss / d(score - t) of the grade's two edges
        g = np.zeros(len(p))
        g[:size] = d.back(upper + lower) + RIDGE * p[:size]
        by_t = np.array([-upper[y == j].sum() - lower[y == j - 1].sum() for j in range(1, k + 1)])
        g[size] = by_t.sum()
        g[size + 1 :] = np.cumsum(by_t[::-1])[::-1][1:] * np.exp(p[size + 1 :])
        return g

    p = ht.adam(grad, size + k, STEPS, RATE)
    return OrdinalModel(p[:size].astype(np.float32), thresholds(p))


def fit(docs: DataFrame, labels: DataFrame, grade: Column | None = None, per_grade: int = SAMPLE_PER_GRADE) -> OrdinalModel:
    """Train on at most ``per_grade`` labelled rows of each grade 0 ... GRADES - 1."""
    return train(ht.labelled_sample(docs, labels, grade_of_labels() if grade is None else grade, tuple(range(GRADES)), per_grade))


def score(docs: DataFrame, model: OrdinalModel, select_from: float = SELECT_FROM) -> DataFrame:
    """doc_id, expected_grade, p_tail (of SELECT_GRADE), p_best (of the best grade), kept. One scan, no shuffle."""
    return texts(docs).mapInArrow(
        _worker(docs, model, select_from, True), "doc_id bigint, expected_grade double, p_tail double, p_best double, kept boolean"
    )


def keep(docs: DataFrame, model: OrdinalModel, select_from: float = SELECT_FROM) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return docs.mapInArrow(_worker(docs, model, select_from, False), docs.schema)


def _worker(docs: DataFrame, model: OrdinalModel, select_from: float, report: bool):
    # 3 * 65,536 float32 weights at most: a fixed size
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            if m.weights is None:
                none, kept = pa.nulls(b.num_rows, pa.float64()), np.ones(b.num_rows, bool)
                cols = [none, none, none]
            else:
                z = np.concatenate([ht.scores(s, m.weights) for s in vt.slices(b.column("text"))])
                tails = m.tails(z)
                kept = tails[SELECT_GRADE - 1] >= select_from
                cols = [pa.array(c) for c in (tails.sum(0), tails[SELECT_GRADE - 1], tails[-1])]
            if report:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(kept)], ["doc_id", "expected_grade", "p_tail", "p_best", "kept"])
            else:
                yield b.filter(pa.array(kept))

    return work
