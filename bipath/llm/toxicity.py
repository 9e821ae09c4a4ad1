"""Toxicity categories by a chain of linear classifiers.

The categories come in a fixed order, and the model of each sees the words of a text and the
probabilities of the categories before it. While training, those probabilities are out of fold: each row's
value comes from a model fitted without that row, so that later models learn from inputs as uncertain as the
ones they get at prediction time.

The categories are what the labels tell apart: toxic text in an otherwise poor document, toxic text in an otherwise good
one, and last any toxic text, whose model sees the probabilities of both. Its probability is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bipath.llm.quality import labelled_sample
from bipath.llm.samples import held_out
from bipath.llm.streams import batch_of, column
from bipath.llm.terms import Vocabulary, content_terms, counted, learn_vocabulary
from bipath.llm.words import pieces

CATEGORIES = ("toxic_poor", "toxic_good", "toxic")
PER_CLASS = 2_000  # labelled documents, toxic or not, that are learned from
TERMS = 4_000
FOLDS = 3
PENALTY = 1e-3
STEPS = 150


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients, the intercept last, of a penalised logistic regression (accelerated gradient)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = (weight / weight.sum()).astype(np.float32)
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the curvature's upper bound
        probe = x.T @ (weight * (x @ probe))
        bound = float(np.linalg.norm(probe))
        probe /= max(bound, 1e-12)
    step = 1 / (0.25 * bound * 1.05 + PENALTY)
    now = ahead = np.zeros(x.shape[1], np.float32)
    momentum = 1.0
    for _ in range(STEPS):
        slope = x.T @ (weight * (_logistic(x @ ahead) - y).astype(np.float32))
        slope[:-1] += PENALTY * ahead[:-1]
        new = (ahead - step * slope).astype(np.float32)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = (new + (momentum - 1) / following * (new - now)).astype(np.float32)
        now, momentum = new, following
    return now


def log_odds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How much more often each term comes in rows of label 1, as a logarithm; used to scale the terms.

    A term that one class alone uses gets a long axis, so the penalty hardly holds its coefficient back, while
    the many terms that come in both classes can't add up to a wrong answer.
    """
    inside, outside = 1 + y @ x, 1 + (1 - y) @ x
    return np.log((inside / (2 + y.sum())) / (outside / (2 + (1 - y).sum()))).astype(np.float32)


@dataclass
class Chain:
    vocabulary: Vocabulary
    categories: tuple[str, ...]
    coefficients: list[np.ndarray]  # of terms, earlier categories, and the intercept

    def probabilities(self, text: str) -> list[float]:
        ids, *_ = self.vocabulary.counts(text)
        size, found = len(self.vocabulary), []
        for c in self.coefficients:
            z = c[ids].sum() + c[-1] + sum(p * w for p, w in zip(found, c[size:-1]))
            found.append(float(_logistic(z)))
        return found


def fit_chain(terms: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
    """Coefficients (terms, earlier categories, the intercept) of each category in turn.

    ``terms``: rows x terms of 0 and 1; ``targets``: rows x categories of 0, 1 and, where a row's category is unknown, NaN.
    Such rows take no part in the fits of that category but get its probability like the others. A category with one value only
    gets a constant near it.
    """
    fold = np.arange(len(terms)) % FOLDS
    earlier, coefficients = np.zeros((len(terms), 0), np.float32), []
    for j in range(targets.shape[1]):
        y = targets[:, j]
        known = ~np.isnan(y)

        def fit(rows):
            rows = rows & known
            if not rows.any():
                return np.zeros(terms.shape[1] + j + 1, np.float32)
            scale = np.append(log_odds(terms[rows], y[rows]), np.ones(j + 1, np.float32))
            inputs = np.hstack([terms[rows] * scale[: terms.shape[1]], earlier[rows]])
            return fit_linear(inputs, y[rows], _balanced(y[rows])) * scale

        outside = np.zeros(len(terms), np.float32)
        for f in range(FOLDS):
            own = fold == f
            if own.any() and (~own).any():
                c = fit(~own)
                outside[own] = _logistic(np.hstack([terms[own], earlier[own]]) @ c[:-1] + c[-1])
        coefficients.append(fit(np.ones(len(terms), bool)))
        earlier = np.hstack([earlier, outside[:, None]])
    return coefficients


def _balanced(y: np.ndarray) -> np.ndarray:
    """Both classes count alike, so that rare categories are not drowned."""
    ones = y.sum()
    return np.where(y == 1, 0.5 / max(ones, 1), 0.5 / max(len(y) - ones, 1))


def targets_of(toxic: int, quality: int | None) -> list[float]:
    """The categories of a labelled row; without a quality only the last is known, unless the text isn't toxic."""
    if not toxic:
        return [0.0, 0.0, 0.0]
    if quality is None:
        return [float("nan"), float("nan"), 1.0]
    return [float(quality == 0), float(quality == 1), 1.0]


def learn(documents: DataFrame, labels: DataFrame) -> Chain | None:
    """The chain of a bounded sample of labelled documents that are not held out; None without any."""
    sample, rows, _ = labelled_sample(documents, labels, "toxic", PER_CLASS)
    if sample is None:
        return None
    vocabulary = learn_vocabulary(sample, len(rows), content_terms, 3, TERMS)
    found = counted(sample, vocabulary)
    terms = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, key in enumerate(rows):
        terms[i, found[key][0]] = 1
    targets = np.array([targets_of(r["toxic"], r["quality"]) for r in rows.values()])
    return Chain(vocabulary, CATEGORIES, fit_chain(terms, targets))


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in pieces(batches, "text"):
            found = np.zeros((batch.num_rows, len(CATEGORIES)))
            if chain is not None:
                for i, text in enumerate(column(batch, "text")):
                    found[i] = chain.probabilities(text.as_py() or "")
            yield batch_of(doc_id=column(batch, "doc_id"), **{f"p_{c}": found[:, j] for j, c in enumerate(CATEGORIES)})

    return score


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, p_toxic_poor, p_toxic_good, p_toxic): a row for each document row.

    score is the probability of the last category, and predicted is 1 from 0.5 on. Null and empty texts have no
    words, so their probabilities are those of the intercepts; without any labels all are 0. Labels other
    than 0 and 1 are ignored. Repeated rows get equal scores.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("toxic").cast("int").alias("toxic"),
        F.col("quality").cast("int").alias("quality"),
    )
    shared = documents.sparkSession.sparkContext.broadcast(learn(rows, marks))
    found = rows.mapInArrow(_score(shared), "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("p_toxic").alias("score"),
        (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"),
        *(f"p_{c}" for c in CATEGORIES),
    )
