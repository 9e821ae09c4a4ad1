"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on seeds: shared runs of ``least`` words, found by a running Karp-Rabin
hash over all words of the text. For a document and an item with enough seeds, the longest match among
unmarked words is marked again and again until none of ``least`` words is left. The tiles don't overlap and may come
in any order, so the share of the item's words that they cover also finds reordered passages.

The benchmark is the small side. It is taken in blocks of bounded size; each block's seeds are broadcast and
looked up in one pass over the documents, so a benchmark of any size works and nothing unbounded is sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bipath.llm.streams import batch_of, changes, column
from bipath.llm.words import ngrams, pieces, words_of

LEAST = 5
COVERAGE = 0.5
BLOCK_BYTES = 4 << 20  # benchmark text in one broadcast
AGREEING = 1 << 18  # places of one document and item that agree and are listed; beyond, the words are gone through


@dataclass
class Block:
    """The seeds of some items: sorted hashes, and for each the item and the place in it."""

    ids: list[int]
    words: list[np.ndarray]
    least: np.ndarray  # seed length of each item: the whole of an item with fewer words
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by seed length


def block_of(items: list[tuple[int, str]], least: int) -> Block:
    words = words_of(pa.array([t for _, t in items], pa.string()), lower=True)
    sizes = np.diff(words.first)
    lengths = np.minimum(sizes, least)
    seeds = {}
    for n in sorted(set(lengths[lengths > 0].tolist())):
        grams, pos, item = ngrams(words, n)
        own = lengths[item] == n
        order = np.argsort(grams[own], kind="stable")
        seeds[n] = grams[own][order], item[own][order], pos[own][order]
    return Block(
        [i for i, _ in items],
        [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])],
        lengths,
        seeds,
    )


def tiles(size: int, item_at: np.ndarray, text_at: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item start, text start, words) of the greedy tiling, given all places where ``least`` words agree.

    The longest match goes first; among equal ones the earliest in the item, then in the text.
    """
    shift = text_at - item_at
    order = np.lexsort((item_at, shift))
    item_at, text_at, shift = item_at[order], text_at[order], shift[order]
    cut = np.flatnonzero(np.append(True, (np.diff(shift) != 0) | (np.diff(item_at) != 1)))
    ends = np.append(cut[1:], len(item_at)) - 1
    runs = [(int(item_at[a]), int(text_at[a]), int(item_at[b] - item_at[a]) + least) for a, b in zip(cut, ends)]
    item_free, text_taken, found = np.ones(size, bool), set(), []
    while runs:
        runs.sort(key=lambda r: (-r[2], r[0], r[1]))
        best = runs.pop(0)
        found.append(best)
        item_free[best[0] : best[0] + best[2]] = False
        text_taken.update(range(best[1], best[1] + best[2]))
        left = []
        for i, t, n in runs:
            start = None
            for k in range(n + 1):
                open_ = k < n and item_free[i + k] and (t + k) not in text_taken
                if open_ and start is None:
                    start = k
                if not open_ and start is not None:
                    if k - start >= least:
                        left.append((i + start, t + start, k - start))
                    start = None
        runs = left
    return found


def tiles_by_rows(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiling of :func:`tiles` from the words themselves, with memory for one row of matches.

    Each round goes through the item's words once and knows for every place of the text how long the match of unmarked words is
    that ends there. It takes the place of lists of all agreeing places where a text repeats itself.
    """
    item_free, text_free, found = np.ones(len(item), bool), np.ones(len(text), bool), []
    places: dict[int, np.ndarray] = {}
    while True:
        best = (0, 0, 0)
        length = np.zeros(len(text) + 1, np.int32)
        for i, word in enumerate(item.tolist()):
            now = np.zeros(len(text) + 1, np.int32)
            if item_free[i]:
                if word not in places:
                    places[word] = np.flatnonzero(text == item[i])
                at = places[word]
                at = at[text_free[at]]
                now[at + 1] = length[at] + 1
                if len(at):
                    longest = int(now[at + 1].max())
                    if longest > best[0]:
                        end = int(at[np.argmax(now[at + 1])])
                        best = (longest, i - longest + 1, end - longest + 1)
            length = now
        n, i, t = best
        if n < least:
            return found
        found.append((i, t, n))
        item_free[i : i + n] = False
        text_free[t : t + n] = False


def _candidates(block: Block, n: int, grams, docs, coverage: float):
    """(document, item, agreeing places) of the pairs whose seeds of ``n`` words cover enough of the item, and the hits.

    A hit is a gram of a document that is a seed. Equal grams of a document count together here, so a text that
    repeats itself costs no more than its different grams.
    """
    seeds, seed_item, seed_pos = block.seeds[n]
    lo = np.searchsorted(seeds, grams, "left")
    hit = np.flatnonzero(seeds[np.minimum(lo, len(seeds) - 1)] == grams)
    order = np.lexsort((hit, lo[hit], docs[hit]))
    hit = hit[order]
    hit_lo, hit_doc = lo[hit], docs[hit]
    first = np.flatnonzero(changes(hit_doc, hit_lo)) if len(hit) else hit
    many = np.diff(np.append(first, len(hit)))  # how often the document holds the gram
    size = np.searchsorted(seeds, seeds[hit_lo[first]], "right") - hit_lo[first]
    gram = np.repeat(np.arange(len(first)), size)
    seed = hit_lo[first][gram] + np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
    doc, item = hit_doc[first][gram], seed_item[seed]
    order = np.lexsort((seed, item, doc))
    doc, item, gram, seed = doc[order], item[order], gram[order], seed[order]
    pairs = np.flatnonzero(changes(doc, item)) if len(doc) else doc
    for a, b in zip(pairs, [*pairs[1:], len(doc)]):
        words = len(block.words[item[a]])
        reach = np.zeros(words + 1, np.int64)
        places = seed_pos[seed[a:b]]
        np.add.at(reach, places, 1)
        np.add.at(reach, places + n, -1)
        if (np.cumsum(reach)[:words] > 0).sum() < coverage * words:
            continue  # even with overlaps the seeds cover too little
        own = gram[a:b]
        total = int(many[own].sum())

        def agreeing(own=own, places=places, total=total):
            count = many[own]
            at = np.repeat(first[own], count) + np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            return np.repeat(places, count), hit[at]

        yield int(doc[a]), int(item[a]), total, agreeing


def _search(shared, coverage: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in pieces(batches, "text"):
            words = words_of(column(batch, "text"), lower=True)
            rows = {k: [] for k in ("row", "item", "coverage", "tiles", "words")}
            for n in block.seeds:
                grams, pos, docs = ngrams(words, n)
                for doc, item, total, agreeing in _candidates(block, n, grams, docs, coverage):
                    own = block.words[item]
                    if total <= AGREEING:
                        item_at, hits = agreeing()
                        found = tiles(len(own), item_at, pos[hits], n)
                    else:
                        found = tiles_by_rows(own, words.hashes[words.first[doc] : words.first[doc + 1]], n)
                    covered = sum(t[2] for t in found)
                    if covered >= coverage * len(own):
                        rows["row"].append(doc)
                        rows["item"].append(block.ids[item])
                        rows["coverage"].append(covered / len(own))
                        rows["tiles"].append(len(found))
                        rows["words"].append(covered)
            yield batch_of(
                doc_id=column(batch, "doc_id").take(pa.array(rows["row"], pa.int64())),
                item_id=pa.array(rows["item"], pa.int64()),
                coverage=pa.array(rows["coverage"], pa.float64()),
                tiles=pa.array(rows["tiles"], pa.int64()),
                matched_words=pa.array(rows["words"], pa.int64()),
            )

    return search


def contaminated(
    documents: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE
) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, matched_words): a document row and an item whose words it covers.

    A pair is returned when tiles of ``least`` words or more cover at least ``coverage`` of the item. An item with
    fewer words counts only as a whole. Null or empty items and texts match nothing. Repeated rows on either side
    give repeated results. Null ids are passed on, other columns are ignored. Texts are read whole; what a task holds grows with
    a text and with an item, not with their product, also where words repeat.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    bytes_ = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-bytes_ // BLOCK_BYTES))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = block_of(sorted(((r[0], r[1]) for r in own.collect()), key=str), least)
        shared = spark.sparkContext.broadcast(block)
        found.append(
            rows.mapInArrow(
                _search(shared, coverage),
                "doc_id long, item_id long, coverage double, tiles long, matched_words long",
            )
        )
    return reduce(DataFrame.unionByName, found)
