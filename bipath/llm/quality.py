"""Quality by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled documents, read whole by Spark tasks, gives a vocabulary of terms (words, marks, case, repeats), their
weights, and by a truncated singular value decomposition the directions along which documents differ most. The
sample's vectors and labels are broadcast; their number is bounded by parameters. Every document is mapped into
the space and compared with all of them in exact blocked cosine products; its nearest neighbours vote with
weights that grow with the similarity, scaled so that the classes count as often as in all labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bipath.llm.samples import bounded_sample, held_out, remainder
from bipath.llm.streams import batch_of, column
from bipath.llm.terms import Vocabulary, counted, form_terms, learn_vocabulary
from bipath.llm.words import pieces
from bipath.runtime import written

PER_CLASS = 1_500  # labelled documents of each class that are learned from
TERMS = 4_000
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8
BLOCK = 256
_SEED = 11


@dataclass
class Model:
    vocabulary: Vocabulary
    weight: np.ndarray  # of each term, the repeat share last
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # of the labelled documents, of length 1
    labels: np.ndarray
    class_weight: np.ndarray  # of each labelled document
    prior: float

    def vector(self, text: str) -> np.ndarray:
        ids, counts, words, repeats = self.vocabulary.counts(text)
        raw = np.log1p(counts) * self.weight[ids]
        last = self.weight[-1] * repeats / max(words, 1)
        length = np.sqrt((raw**2).sum() + last**2)
        if length == 0:
            return np.zeros(self.axes.shape[1], np.float32)
        return ((raw @ self.axes[ids] + last * self.axes[-1]) / length).astype(np.float32)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """The share of label 1 among the weighted votes; the prior where there is no vote."""
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        similar = (vectors / np.maximum(length, 1e-12)) @ self.vectors.T
        k = min(NEIGHBOURS, similar.shape[1])
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        near_similar = np.maximum(np.take_along_axis(similar, near, 1), 0).astype(float) ** SHARPNESS
        votes = near_similar * self.class_weight[near]
        total = votes.sum(axis=1)
        share = (votes * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300)
        return np.where((total > 1e-12) & (length[:, 0] > 0), np.clip(share, 0, 1), self.prior)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame | None, dict, dict]:
    """((key, text), key -> label row, class counts) of labelled documents that are not held out.

    At most ``per_class`` label rows of each class are drawn, by a function of their doc_id. A doc_id with several texts
    brings the least of them. The texts stay in a written table, whole.
    """
    rows = labels.filter((remainder() != 1) & F.col(label).isin(0, 1)).distinct()
    sample, counts = bounded_sample(rows, label, "doc_id", per_class, 2)
    if not sample:
        return None, {}, counts
    by_key = dict(enumerate(sample))
    keys = documents.sparkSession.createDataFrame([(k, r["doc_id"]) for k, r in by_key.items()], "key long, doc_id long")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(keys), "doc_id").groupBy("key").agg(F.min("text").alias("text"))
    found = written(found, "labelled-sample")
    by_key = {r["key"]: by_key[r["key"]] for r in found.select("key").orderBy("key").collect()}
    return (found if by_key else None), by_key, counts


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """The model of a bounded sample of labelled documents that are not held out; None without any."""
    sample, rows, counts = labelled_sample(documents, labels, label, PER_CLASS)
    if sample is None:
        return None
    y = np.array([r[label] for r in rows.values()], float)
    vocabulary = learn_vocabulary(sample, len(rows), form_terms, 3, TERMS)
    terms = counted(sample, vocabulary)
    dense = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
    for i, key in enumerate(rows):
        ids, n, words, repeats = terms[key]
        dense[i, ids] = np.log1p(n)
        dense[i, -1] = repeats / max(words, 1)
    return model_of(vocabulary, dense, y, counts)


def model_of(vocabulary: Vocabulary, dense: np.ndarray, y: np.ndarray, counts: dict) -> Model:
    """The model of the sample's raw rows (terms, the repeat share last), its labels, and the class counts of all labels."""
    weight = np.append(np.log(1 / np.maximum(vocabulary.share, 1e-9)) + 0.1, 10.0)
    dense = dense * weight.astype(np.float32)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    axes = _right_singular(dense, min(DIMENSIONS, *dense.shape))
    vectors = dense @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    sampled = np.array([max((y == c).sum(), 1) for c in (0, 1)])
    natural = np.array([counts.get(c, 0) for c in (0, 1)], float)
    by_class = natural / sampled
    return Model(vocabulary, weight, axes, vectors, y, by_class[y.astype(int)], natural[1] / natural.sum())


def _right_singular(matrix: np.ndarray, k: int) -> np.ndarray:
    """The leading right singular vectors by subspace iteration from a fixed start."""
    basis = np.random.default_rng(_SEED).standard_normal((matrix.shape[1], min(k + 8, *matrix.shape))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ right[:k].T).astype(np.float32)


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, "text"):
            texts = column(batch, "text")
            out = np.full(batch.num_rows, 0.5)
            for at in range(0, batch.num_rows if model is not None else 0, BLOCK):
                vectors = [model.vector(t.as_py() or "") for t in texts.slice(at, BLOCK)]
                out[at : at + BLOCK] = model.scores(np.array(vectors))
            yield batch_of(doc_id=column(batch, "doc_id"), score=out)

    return score


def quality_scores(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``documents``.

    Null and empty texts, and texts that share no term with the sample, score the share of label 1 among all
    labels that were learned from; without any labels every score is 0.5. Labels other than 0 and 1
    are ignored. Repeated rows get equal scores.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label))
    shared = documents.sparkSession.sparkContext.broadcast(learn(rows, marks, label))
    found = rows.mapInArrow(_score(shared), "doc_id long, score double")
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
