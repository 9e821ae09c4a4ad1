"""Term counts of whole texts against a fixed vocabulary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bipath.llm.streams import batch_of, column
from bipath.llm.words import pieces

STEM = 5
MEMO = 200_000  # remembered words; the memory is emptied beyond
_CORE = re.compile(r"[^\W\d_]+")


def content_terms(word: str) -> tuple[str, ...]:
    """The letter runs of a word, lower-cased, and the stems (first letters) of longer ones."""
    runs = _CORE.findall(word.lower())
    return (*runs, *(r[:STEM] + "~" for r in runs if len(r) > STEM))


def form_terms(word: str) -> tuple[str, ...]:
    """Letter runs, marks, and the case of a word."""
    core = _CORE.findall(word)
    marks = _CORE.sub("", word)
    case = "#upper" if word.isupper() and len(word) > 1 else "#title" if word[:1].isupper() else "#lower"
    return (*(c.lower() for c in core), "#" + marks if marks else "#plain", case if core else "#none")


class Vocabulary:
    """Ids of given terms, (term, number of documents) among ``size`` documents."""

    def __init__(self, terms: Iterable[tuple[str, int]], size: int, split: Callable[[str], tuple[str, ...]]):
        terms = list(terms)
        self.split = split
        self.ids = {t: i for i, (t, _) in enumerate(terms)}
        self.share = np.array([n for _, n in terms], float) / max(size, 1)
        self._memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_memo": {}}

    def __len__(self) -> int:
        return len(self.ids)

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self._memo.get(word)
        if found is None:
            if len(self._memo) > MEMO:
                self._memo.clear()
            found = tuple(self.ids[t] for t in self.split(word) if t in self.ids)
            self._memo[word] = found
        return found

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(term ids, how often each comes, words, words equal to the one before)."""
        words = text.split()
        tally: dict[int, int] = {}
        memo, of_word = self._memo, self.of_word
        for word, n in Counter(words).items():
            ids = memo.get(word)
            for i in of_word(word) if ids is None else ids:
                tally[i] = tally.get(i, 0) + n
        repeats = sum(map(eq, words, words[1:]))
        ids = np.fromiter(tally.keys(), np.int64, len(tally))
        return ids, np.fromiter(tally.values(), np.float64, len(tally)), len(words), repeats


def learn_vocabulary(sample: DataFrame, size: int, split: Callable[[str], tuple[str, ...]], least: int, most: int) -> Vocabulary:
    """The ``most`` terms that most rows of ``sample`` (text) hold, ``least`` rows at least; whole texts are read by the tasks."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            held = Counter()
            for text in column(batch, "text"):
                held.update({t for w in set((text.as_py() or "").split()) for t in split(w)})
            yield batch_of(term=pa.array(list(held), pa.string()), n=pa.array(list(held.values()), pa.int64()))

    terms = sample.select("text").mapInArrow(tally, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequent = terms.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "term").limit(most).collect()
    return Vocabulary([(r["term"], r["n"]) for r in frequent], size, split)


def counted(sample: DataFrame, vocabulary: Vocabulary) -> dict:
    """key -> (term ids, counts, words, repeats) of every row of ``sample`` (key, text), whose rows the caller bounds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [vocabulary.counts(t.as_py() or "") for t in column(batch, "text")]
            yield batch_of(
                key=column(batch, "key"),
                ids=pa.array([f[0] for f in found], pa.list_(pa.int64())),
                counts=pa.array([f[1] for f in found], pa.list_(pa.float64())),
                words=pa.array([f[2] for f in found], pa.int64()),
                repeats=pa.array([f[3] for f in found], pa.int64()),
            )

    rows = sample.select("key", "text").mapInArrow(count, "key long, ids array<long>, counts array<double>, words long, repeats long")
    found = {}
    for batch in rows.toArrow().to_batches():
        keys, words, repeats = (column(batch, c).to_pylist() for c in ("key", "words", "repeats"))
        for i, key in enumerate(keys):
            ids, counts = (column(batch, c)[i].values.to_numpy() for c in ("ids", "counts"))
            found[key] = (ids, counts, words[i], repeats[i])
    return found
