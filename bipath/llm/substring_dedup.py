"""Exact removal of repeated passages: seed and extend over winnowed anchors.

1. **Seeds.** Every ``window`` consecutive words of a document hold ``window - gram + 1`` word n-grams; the
   least of their hashes is the window's anchor (winnowing). Equal windows have equal anchors, and
   neighbouring windows mostly share one, so about one word in seven makes an anchor. Documents are joined on
   anchors; those that occur at a single place of the corpus end the work for their windows.
2. **Extension.** From each repeated anchor the match is extended both ways: the windows around it
   are joined by the hash of all their words, and every window that begins earlier elsewhere, or earlier
   in the same document, is a repeat. Runs of such windows are the maximal repeats, and the words they cover go.

Scale. Exact copies are found by the hash of the whole text and never enter the joins. A task first
settles what repeats inside its own piece of the input and sends on at most one row for each hash, so
a passage that a third of all documents hold costs one row per piece and not one per document. Rows meet by
hash in sorted streams that keep one row in memory. Whole texts cross one exchange, which two steps reuse.

Words and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bipath.llm.streams import batch_of, changes, column, longs, routed, run_starts, signed, unsigned
from bipath.llm.words import Words, mix, ngrams, pieces, sliding_min, words_of

WINDOW = 20
GRAM = 8


def _anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, their documents, anchor of each window, window is inside a document)."""
    grams, _, docs = ngrams(words, gram)
    width = window - gram + 1
    if len(grams) < width:
        return grams, docs, grams[:0], np.zeros(0, bool)
    least = sliding_min(grams, width)
    return grams, docs, least, docs[: len(least)] == docs[width - 1 :]


def _selected(grams, least, inside, width) -> np.ndarray:
    """Which grams are the anchor of some window."""
    if not len(least):
        return np.zeros(len(grams), bool)
    padded = np.zeros(len(grams) + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = np.where(inside, least, 0)
    most = ~sliding_min(~padded, width)  # the greatest anchor of the windows that hold each gram
    return (most == grams) & (most != 0)


def _ask(window: int, gram: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = longs(batch, "t")
            _, first = np.unique(texts, return_index=True)
            texts, words = texts[first], words_of(column(batch, "text").take(pa.array(first)))
            grams, docs, least, inside = _anchors(words, window, gram)
            at = np.flatnonzero(_selected(grams, least, inside, window - gram + 1))
            order = np.lexsort((docs[at], grams[at]))
            anchor, doc = grams[at][order], docs[at][order]
            new = changes(anchor)
            size = np.diff(np.append(np.flatnonzero(new), len(anchor)))
            repeated = np.repeat(size > 1, size)
            once = changes(anchor, doc)
            known = once & repeated
            asks, notices = once & ~repeated, new & repeated
            a, t = signed(anchor), texts[doc]
            yield batch_of(
                route=np.concatenate([a[asks], a[notices], signed(mix(anchor[known] ^ unsigned(t[known])))]),
                anchor=np.concatenate([a[asks], a[notices], a[known]]),
                t=pa.array(
                    np.concatenate([t[asks], t[notices], t[known]]),
                    mask=np.repeat([False, True, False], [asks.sum(), notices.sum(), known.sum()]),
                ),
                known=np.repeat([False, False, True], [asks.sum(), notices.sum(), known.sum()]),
            )

    return ask


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, anchor) of anchors that two texts, or one text twice, hold; holds one row back."""
    held = None  # anchor, text, is a text (no notice), is repeated
    for batch in batches:
        known = column(batch, "known").to_numpy(zero_copy_only=False)
        anchor, t = longs(batch, "anchor"), longs(batch, "t")
        is_text = column(batch, "t").is_valid().to_numpy(zero_copy_only=False)
        yield batch_of(t=t[known], anchor=anchor[known])
        rows = [anchor[~known], t[~known], is_text[~known], np.zeros((~known).sum(), bool)]
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
        if not len(rows[0]):
            continue
        distinct = changes(rows[0], rows[1], rows[2])
        # A notice says by itself that its anchor is repeated, so two of them count like one.
        anchor, t, is_text, repeated = (r[distinct] for r in rows)
        same = anchor[1:] == anchor[:-1]
        repeated[1:] |= same
        repeated[:-1] |= same
        done = repeated[:-1] & is_text[:-1]
        yield batch_of(t=t[:-1][done], anchor=anchor[:-1][done])
        held = [anchor[-1:], t[-1:], is_text[-1:], repeated[-1:]]
    if held is not None and held[2][0] and held[3][0]:
        yield batch_of(t=held[1], anchor=held[0])


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_RESULT = "n_words long, n_removed long, kept_sha256 string, kept string"


def _prepare(window: int, with_text: bool):
    """Settles copies inside a piece and short texts at once; the others go on with their text."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, texts = longs(batch, "doc_id"), longs(batch, "t")
            order = np.lexsort((ids, texts))
            copy = np.zeros(len(ids), bool)
            # Rows with the least id of a text are one document, so they go on together.
            copy[order] = ids[order] != ids[order][run_starts(changes(texts[order]))]
            out = {k: [] for k in ("text", "n_words", "n_removed", "kept_sha256", "kept")}
            for text, is_copy in zip(column(batch, "text"), copy.tolist()):
                raw = (text.as_py() or "").encode()
                words = raw.split() if is_copy or len(raw) < 2 * window else None
                if words is None and raw.count(b" ", 0, 64 * window) < window:
                    words = raw.split()
                n = None if words is None else len(words)
                done = n is not None and (n < window or is_copy)
                kept = b"" if n is not None and n >= window else b" ".join(words or [])
                out["text"].append(None if done else raw.decode())
                out["n_words"].append(n if done else None)
                out["n_removed"].append((n if n >= window else 0) if done else None)
                out["kept_sha256"].append(_digest(kept) if done else None)
                out["kept"].append(kept.decode() if done and with_text else None)
            done = np.array([x is None for x in out["text"]], bool)
            yield batch_of(
                t=np.where(done, signed(mix(unsigned(ids))), texts),
                doc_id=column(batch, "doc_id"),
                text=pa.array(out["text"], pa.string()),
                text_key=texts,
                n_words=pa.array(out["n_words"], pa.int64()),
                n_removed=pa.array(out["n_removed"], pa.int64()),
                kept_sha256=pa.array(out["kept_sha256"], pa.string()),
                kept=pa.array(out["kept"], pa.string()),
            )

    return prepare


def _windows(window: int, gram: int):
    """The windows of repeated anchors: settled inside the piece, or sent on once each."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            # The others are settled, or copies of a text that another document had first.
            first = longs(batch, "doc_id") == longs(batch, "first")
            batch = batch.filter(pa.array(first & column(batch, "text").is_valid().to_numpy(zero_copy_only=False)))
            words = words_of(column(batch, "text"))
            _, docs, least, inside = _anchors(words, window, gram)
            lists = column(batch, "anchors")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            listed = unsigned(lists.flatten().to_numpy()) ^ mix(owner.astype(np.uint64))
            docs = docs[: len(least)]
            at = np.flatnonzero(inside & np.isin(least ^ mix(docs.astype(np.uint64)), listed))
            # The i-th gram of a document is also its i-th window.
            first_gram = np.searchsorted(docs, np.arange(batch.num_rows))
            doc = docs[at]
            pos = at - first_gram[doc]
            start = words.first[doc] + pos
            hashes = _window_hashes(words, start, window)
            ids, texts = longs(batch, "doc_id")[doc], longs(batch, "t")[doc]
            order = np.lexsort((texts, pos, ids, hashes))
            hashes, ids, pos, texts = hashes[order], ids[order], pos[order], texts[order]
            head = run_starts(changes(hashes))
            known = (ids != ids[head]) | (pos != pos[head])
            yield batch_of(
                route=np.where(known, signed(mix(hashes ^ unsigned(texts))), signed(hashes)),
                known=known,
                h=signed(hashes),
                doc_id=ids,
                pos=pos.astype(np.int32),
                t=texts,
            )

    return windows


def _window_hashes(words: Words, start: np.ndarray, window: int) -> np.ndarray:
    grams, pos, docs = ngrams(words, window)
    index = words.first[docs] + pos
    return grams[np.searchsorted(index, start)]


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, pos) of every window that is not the first of its words; keeps the first in memory."""
    head = None
    for batch in batches:
        known = column(batch, "known").to_numpy(zero_copy_only=False)
        h, ids, pos, t = (longs(batch, c) for c in ("h", "doc_id", "pos", "t"))
        yield batch_of(t=t[known], pos=pos[known].astype(np.int32))
        h, ids, pos, t = (x[~known] for x in (h, ids, pos, t))
        if not len(h):
            continue
        if head is not None:
            h, ids, pos, t = (np.concatenate([[a], b]) for a, b in zip(head, (h, ids, pos, t)))
        first = run_starts(changes(h))
        later = (ids != ids[first]) | (pos != pos[first])
        if head is not None:
            later[0] = False
        yield batch_of(t=t[later], pos=pos[later].astype(np.int32))
        head = [x[first[-1]] for x in (h, ids, pos, t)]


def _finish(window: int, with_text: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept")}
            for row in batch.to_pylist():
                if row["text"] is None:
                    found = [row[k] for k in rows]
                else:
                    words = row["text"].encode().split()
                    n = len(words)
                    if row["doc_id"] != row["first"]:
                        removed = np.full(n, n >= window)
                    else:
                        edge = np.zeros(n + 1, np.int64)
                        at = np.array(row["flags"] or [], np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                        removed = np.cumsum(edge)[:n] > 0
                    kept = b" ".join(compress(words, (~removed).tolist()))
                    found = [n, int(removed.sum()), _digest(kept), kept.decode() if with_text else None]
                for k, v in zip(rows, found):
                    rows[k].append(v)
            yield batch_of(
                doc_id=column(batch, "doc_id"),
                n_words=pa.array(rows["n_words"], pa.int64()),
                n_removed=pa.array(rows["n_removed"], pa.int64()),
                kept_sha256=pa.array(rows["kept_sha256"], pa.string()),
                kept=pa.array(rows["kept"], pa.string()),
                text_key=column(batch, "text_key"),
            )

    return finish


def substring_dedup(
    documents: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, text_key): one row for each row of ``documents``.

    ``documents`` needs ``doc_id`` (long) and ``text``; other columns are ignored. A null or empty text has no
    words: nothing is removed, and what is kept is the empty text. Rows with one doc_id and one text are one
    document and get equal results. A null doc_id comes before all others. ``kept`` is null without
    ``with_text``; text_key is xxhash64 of the text, null read as empty. Texts of any length are taken whole; a task holds one Arrow batch of them.
    """
    source = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("t", F.xxhash64("text"))
    least = -(1 << 63)
    firsts = source.groupBy("t").agg(F.min(F.coalesce("doc_id", F.lit(least))).alias("first"))
    asks = source.mapInArrow(_ask(window, gram), "route long, anchor long, t long, known boolean")
    repeated = routed(asks, "route", "known", "anchor", "t").mapInArrow(_repeats, "t long, anchor long")
    anchors = repeated.groupBy("t").agg(F.collect_set("anchor").alias("anchors"))
    texts = source.mapInArrow(
        _prepare(window, with_text), f"t long, doc_id long, text string, text_key long, {_RESULT}"
    )
    # Both joins below see the same filter and all columns, so the exchange of the texts is made once.
    texts = texts.filter(F.col("t").isNotNull())
    seeds = texts.join(firsts.join(anchors, "t"), "t")
    windows = seeds.mapInArrow(
        _windows(window, gram), "route long, known boolean, h long, doc_id long, pos int, t long"
    )
    later = routed(windows, "route", "known", "h", "doc_id", "pos").mapInArrow(_later, "t long, pos int")
    flags = later.groupBy("t").agg(F.collect_set("pos").alias("flags"))
    found = texts.join(firsts.join(flags, "t", "left"), "t", "left").select(
        "doc_id", "text", "n_words", "n_removed", "kept_sha256", "kept", "text_key", "flags",
        F.when(F.col("doc_id").isNull() & (F.col("first") == least), None).otherwise(F.col("first")).alias("first"),
    )
    return found.mapInArrow(_finish(window, with_text), f"doc_id long, {_RESULT}, text_key long")
