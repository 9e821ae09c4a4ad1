"""Periodic runs of words: an online sparse DP over the diagonals of equal words.

A run is a maximal stretch of words with smallest period q that holds at least ``exponent`` periods. On the diagonal of
lag q, word i continues the match of word i - 1 if it equals the word q before it; a run is a diagonal's match
whose length plus q is enough. All pairs of equal words would be square in a text, so each word increments only the
lags that its own context allows: for contexts of k = 1, 2, 4, ... words that end at the word, the nearest earlier occurrence of
the same context, if its lag is in (k/2, k]. Inside a run of period q <= k the nearest occurrence of a context of k
words is exactly q back (the q words of a period are no power of shorter ones, so they recur nowhere between), hence every
run of two periods and a context is met at each of its words, and a word has at most one lag for each k. A context of 2k
words recurs only if both its halves do, so the longer contexts are looked for at the few places that repeat.

The pass over a text goes from its first word to its last with the active lags and their match lengths, and gives out a run as
soon as its diagonal ends. Every text is one row of a task, whatever its length; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bipath.llm.streams import batch_of, column
from bipath.llm.words import WORD_BASE, Words, mix, pieces, sha256_hex, words_of

LEAST_WORDS = 6
EXPONENT = 4


def _nearest(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lags from each of the ascending places ``at`` to the nearest earlier and later place of the same key; 0: none."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    gap = np.where(same, at[order[1:]] - at[order[:-1]], 0)
    earlier, later = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    earlier[order[1:]] = gap
    later[order[:-1]] = gap
    return earlier, later


def sparse_lags(words: Words, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, lag, context) of each word's occurrences that count, ascending by word; words are numbered through the batch."""
    owner = words.documents()
    size = np.diff(words.first)
    key = mix(words.hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    at = np.arange(len(key))
    found, k = [], 1
    while len(at):
        earlier, later = _nearest(key, at)
        met = (earlier > k // 2) & (earlier <= k)
        found.append((at[met], earlier[met], np.full(met.sum(), k)))
        # The next contexts, of 2k words, stand where both halves recur near enough for a run that fits the text.
        most = size[owner[at]] // exponent
        near = ((earlier > 0) & (earlier <= most)) | ((later > 0) & (later <= most))
        near &= most > k
        halves = np.zeros(len(words.hashes), np.uint64)
        halves[at[near]] = key[near]
        at = at[near & (at - 2 * k + 1 >= words.first[owner[at]])]
        at = at[halves[at - k] != 0]
        key = mix(halves[at - k] * np.uint64(WORD_BASE) ^ mix(halves[at]))
        k *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    word, lag, context = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((lag, word))
    return word[order], lag[order], context[order]


def runs_of(word: np.ndarray, lag: np.ndarray, context: np.ndarray, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, as their diagonals end, from the sparse lags of one text in word order."""
    runs: list[tuple[int, int, int]] = []
    active: dict[int, list[int]] = {}  # lag -> [last word, match length]

    def end(q: int) -> None:
        last, match = active.pop(q)
        length = match + q
        if length >= least and length >= exponent * q:
            runs.append((last - length + 1, length, q))

    before = -1
    for i, q, k in zip(word.tolist(), lag.tolist(), context.tolist()):
        if i != before:
            for other in [x for x, (last, _) in active.items() if last < i - 1]:
                end(other)
            before = i
        state = active.get(q)
        if state is None:
            active[q] = [i, k]  # the context itself has matched
        elif state[0] == i - 1:
            state[0], state[1] = i, state[1] + 1
        else:
            end(q)
            active[q] = [i, k]
    for q in list(active):
        end(q)
    return sorted(runs)


_RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _scan(least: int, exponent: int, with_text: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = words_of(column(batch, "text"))
            word, lag, context = sparse_lags(words, exponent)
            owner = np.searchsorted(words.first, word, "right") - 1
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            found, digests, texts = [], [], []
            for row, text in enumerate(column(batch, "text")):
                part = slice(cuts[row], cuts[row + 1])
                first = int(words.first[row])
                runs = runs_of(word[part] - first, lag[part], context[part], least, exponent) if cuts[row] < cuts[row + 1] else []
                kept = (text.as_py() or "").encode().split()
                if runs:
                    edge = np.zeros(len(kept) + 1, np.int64)
                    for start, length, period in runs:
                        edge[start + period] += 1
                        edge[start + length] -= 1
                    kept = compress(kept, (np.cumsum(edge)[:-1] == 0).tolist())
                collapsed = b" ".join(kept)
                found.append([dict(zip(("start", "length", "period"), run)) for run in runs])
                digests.append(sha256_hex(collapsed))
                texts.append(collapsed.decode() if with_text else None)
            yield batch_of(
                doc_id=column(batch, "doc_id"),
                n_words=np.diff(words.first),
                runs=pa.array(found, _RUN_TYPE),
                collapsed_sha256=pa.array(digests, pa.string()),
                collapsed=pa.array(texts, pa.string()),
            )

    return scan


def periodic_runs(documents: DataFrame, least: int = LEAST_WORDS, exponent: int = EXPONENT, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_sha256, collapsed): one row for each row of ``documents``.

    ``runs`` lists (start, length, period), by start and period, of every stretch of words with smallest period q and
    at least max(least, exponent * q) words that no neighbouring word extends. ``collapsed`` holds the words that no run contains after
    its first period, joined by one space; it is null without ``with_text``. Words are ``[^\\x20\\x09-\\x0D]+``, compared by 64-bit hashes.

    A null or empty text has no word, no run and an empty collapsed text. Repeated rows get equal results, a null doc_id is as
    good as any, and other columns are ignored. A text is held whole by its task.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not found by contexts of less than two")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id long, n_words long, runs {_RUNS}, collapsed_sha256 string, collapsed string"
    return rows.mapInArrow(_scan(least, exponent, with_text), schema)
