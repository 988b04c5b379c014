"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j | x) = sigmoid(t_j - w.x), with one weight vector over hashed text for all grades and ascending
thresholds t_0 < t_1 < ... kept so by fitting the first and the logarithms of the gaps. Weights are fitted on a
bounded sample of rated documents (``max_train``) by proximal AdaGrad with an L1 penalty, so that chance words keep no
weight. Scoring gives the expected grade and the probability of each upper tail; a document is kept if
P(grade >= keep_grade) is at least ``keep_probability``.

Defined cases: null, empty and blank texts have no features; their grade is that of the thresholds alone; without any
rating every tail probability is 1 and every document is kept; a null doc_id stays null and is not trained on;
repeated rows are scored each, and ratings that differ for a document count as the least; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import SIZE, WORDS, Rows, labelled_sample, places, shrink

MAX_TRAIN = 12_000
KEEP_PROBABILITY = 0.35


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # one fewer than the grades; empty where nothing was learnt

    def tails(self, at: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... given a document's places."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[at].sum(dtype=np.float64), -40, 40)))


def graded(labels: DataFrame) -> DataFrame:
    """The labels table as grades: 0 toxic, 1 of low quality, 2 of good quality; unknown without a quality."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("label"))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = 8e-4, rate: float = 0.15, passes: int = 30, batch: int = 256) -> OrdinalModel:
    """Proximal AdaGrad on the negative log-likelihood; grades are 0 .. n_grades - 1."""
    w = np.zeros(SIZE, np.float64)
    share = np.array([(grades <= j).mean() for j in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    # first threshold, then logarithms of the gaps
    free = np.concatenate((t[:1], np.log(np.maximum(np.diff(t), 0.05))))
    seen_w, seen_f = np.full(SIZE, 1e-6), np.full(len(free), 1e-6)
    sparse, rng = Rows(rows), np.random.default_rng(5)
    # rare grades weigh as much as the square root of their share says
    weight = 1 / np.sqrt(np.maximum(np.bincount(grades, minlength=n_grades) / len(grades), 1e-4))
    weight /= weight[grades].mean()
    for p in range(passes):
        order = rng.permutation(len(rows))
        step = rate * (1 - 0.9 * p / passes)
        for a in range(0, len(order), batch):
            take = order[a : a + batch]
            at, row = sparse.batch(take)
            x = np.bincount(row, w[at], minlength=len(take))
            gaps = np.exp(free[1:])
            t = free[0] + np.concatenate(([0.0], np.cumsum(gaps)))
            y = grades[take]
            low = 1 / (1 + np.exp(np.clip(x - np.where(y > 0, t[np.maximum(y - 1, 0)], 0), -40, 40)))
            high = 1 / (1 + np.exp(np.clip(x - np.where(y < n_grades - 1, t[np.minimum(y, n_grades - 2)], 0), -40, 40)))
            low, high = np.where(y > 0, low, 0.0), np.where(y < n_grades - 1, high, 1.0)
            prob = np.maximum(high - low, 1e-9)
            # d log P / d threshold above, below; the score moves against both
            up, down = high * (1 - high) / prob * weight[y], low * (1 - low) / prob * weight[y]
            gx = (up - down) / len(take)
            gt = np.zeros(n_grades - 1)
            np.add.at(gt, np.minimum(y, n_grades - 2)[y < n_grades - 1], -up[y < n_grades - 1] / len(take))
            np.add.at(gt, (y - 1)[y > 0], down[y > 0] / len(take))
            gf = np.concatenate(([gt.sum()], [gt[j:].sum() * gaps[j - 1] for j in range(1, n_grades - 1)]))
            seen_f += gf * gf
            free -= step * gf / np.sqrt(seen_f)
            # places of this batch alone; the penalty is that of one batch
            own, inverse = np.unique(at, return_inverse=True)
            gw = np.bincount(inverse, gx[row], minlength=len(own))
            seen_w[own] += gw * gw
            scale = step / np.sqrt(seen_w[own])
            w[own] -= scale * gw
            shrink(w, own, scale * np.where(own < WORDS, l1, l1 / 10))
    return OrdinalModel(w.astype(np.float32), free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:])))))


def fit_from(docs: DataFrame, ratings: DataFrame, n_grades: int, max_train: int = MAX_TRAIN) -> OrdinalModel:
    """``ratings``: (doc_id, label), label a grade from 0 to n_grades - 1."""
    sample = labelled_sample(docs, ratings, max_train)
    rows = [(r, int(g)) for g, r in sample if 0 <= int(g) < n_grades]
    if not rows:
        return OrdinalModel(np.zeros(SIZE, np.float32), np.zeros(0))
    return fit([r for r, _ in rows], np.array([g for _, g in rows]), n_grades)


def _scorer(shared, n_grades: int, text_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            back = [name for name in batch.schema.names if name != "text" or text_too]
            tails = np.ones((batch.num_rows, n_grades - 1))
            if len(model.thresholds):
                for i, text in enumerate(batch.column("text")):
                    tails[i] = model.tails(places(text.as_py())[0])
            yield pa.RecordBatch.from_arrays([*batch.select(back).columns, pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], [*back, "expected_grade", "tails"])

    return run


def quality_scores(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, keep_grade: int = 2, keep_probability: float = KEEP_PROBABILITY, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: doc_id, expected_grade, tails (P(grade >= 1), ...), p_keep, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_from(docs, ratings, n_grades, max_train))
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(shared, n_grades, False), "doc_id long, expected_grade double, tails array<double>")
    p = F.get("tails", F.lit(keep_grade - 1))
    return scored.select("doc_id", "expected_grade", "tails", p.alias("p_keep"), (p >= keep_probability).alias("kept"))


def select_quality(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, keep_grade: int = 2, keep_probability: float = KEEP_PROBABILITY, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that the classifier keeps, in one pass; columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_from(docs, ratings, n_grades, max_train))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.toDF(*names).withColumnRenamed(names[at], "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    scored = plain.mapInArrow(_scorer(shared, n_grades, True), f"{schema}, expected_grade double, tails array<double>")
    kept = scored.filter(F.get("tails", F.lit(keep_grade - 1)) >= keep_probability)
    return kept.select(*[F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns)])
