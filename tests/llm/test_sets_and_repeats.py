"""The Jaccard join, passage removal, components and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from bipath.llm import decontamination, jaccard_join, substring_dedup, words
from bipath.llm.components import connected_components
from odd_rows import no_documents, odd_documents  # noqa: F401

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall((text or "").encode())


def shingles(text, size):
    w = [x.lower() for x in split(text)]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def components(rows, size, percent):
    """Per row (doc_id, set size, least doc_id of its component)."""
    sets = [shingles(text, size) for _, text, *_ in rows]
    label = [i for i, *_ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                    continue
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [(i, len(s), c) for (i, *_), s, c in zip(rows, sets, label)]


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5)])
def test_jaccard_components(odd_documents, percent, size):
    rows, df = odd_documents
    got = jaccard_join.jaccard_components(df, percent, size)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(components(rows, size, percent), key=repr)


def test_jaccard_of_an_empty_table(no_documents):
    assert jaccard_join.jaccard_components(no_documents).collect() == []


def test_light_sets_alone_and_lists_alone_agree(odd_documents, monkeypatch):
    rows, df = odd_documents
    want = sorted(components(rows, 3, 90), key=repr)
    for boundary in (0, 20):
        monkeypatch.setattr(jaccard_join, "light_boundary", lambda *a, b=boundary: b)
        monkeypatch.setattr(jaccard_join, "BLOCK", 3)
        monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 3)
        assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect()), key=repr) == want


def test_near_copies_around_pivots_and_chains(spark, monkeypatch):
    """Groups of many blocks: all near one text, drifting away from it step by step, and two groups with a bridge."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]

    def edited(text, n):
        text = list(text)
        for i in rng.sample(range(len(text)), n):
            text[i] = f"x{rng.randrange(10_000)}"
        return text

    texts = [edited(base, 1) for _ in range(40)]
    other = edited(base, 9)
    texts += [edited(other, 1) for _ in range(25)] + [edited(base, 20) for _ in range(5)]
    for _ in range(30):
        texts.append(edited(texts[-1], 1))
    rows = [(i, " ".join(t)) for i, t in enumerate(rng.sample(texts, len(texts)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 4)
    want = components(rows, 3, 90)
    assert 2 < len({c for *_, c in want}) < len(rows) / 2
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect())) == sorted(want)


def test_blocks_hold_each_pair_with_an_open_row_once(spark):
    rows = spark.range(60).selectExpr("id % 2 AS cluster", "id AS t")
    settled = rows.filter("t % 2 = 0 AND t < 40 OR t = 1").selectExpr("cluster", "t", "0L AS pivot")
    placed = jaccard_join._in_blocks(jaccard_join._placed(rows, settled, "cluster", 5)).collect()
    shut = {r["t"] for r in settled.collect()}
    blocks, seen = {}, {}
    for r in placed:
        blocks.setdefault((r["cluster"], r["bi"], r["bj"]), []).append((r["t"], r["own"]))
    for (_, bi, bj), members in blocks.items():
        for x, own_x in members:
            for y, own_y in members:
                if x < y and (bi == bj or own_x != own_y):
                    seen[x, y] = seen.get((x, y), 0) + 1
    wanted = {(x, y) for x in range(60) for y in range(x + 2, 60, 2) if x not in shut or y not in shut}
    assert set(seen) == wanted and set(seen.values()) == {1}
    alone = rows.selectExpr("cluster", "t", "0L AS pivot")
    assert jaccard_join._in_blocks(jaccard_join._placed(rows, alone, "cluster", 5)).count() == 0


def test_overlap_bound_equals_the_jaccard_test():
    for s in range(1, 60):
        for t in range(s, 70):
            for common in range(s + 1):
                assert (100 * common >= 90 * (s + t - common)) == (common >= jaccard_join.overlap(s, t, 90))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (300, 299), (None, 5)]
    rng.shuffle(edges)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {300: 299}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def deduplicated(rows, window):
    starts = {}
    for i, text, *_ in rows:
        w = split(text)
        for p in range(len(w) - window + 1):
            place = (-1 if i is None else i, p)
            key = tuple(w[p : p + window])
            starts[key] = min(starts.get(key, place), place)
    out = []
    for i, text, *_ in rows:
        w = split(text)
        gone = set()
        for p in range(len(w) - window + 1):
            if starts[tuple(w[p : p + window])] < (-1 if i is None else i, p):
                gone.update(range(p, p + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


@pytest.mark.parametrize("window,gram", [(20, 8), (6, 3)])
def test_substring_dedup(odd_documents, window, gram):
    rows, df = odd_documents
    got = substring_dedup.substring_dedup(df, window, gram).drop("text_key")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(deduplicated(rows, window), key=repr)


def test_repeated_rows_are_one_document_in_any_partitioning(spark):
    rng = random.Random(21)
    texts = [" ".join(f"r{rng.randrange(9999)}" for _ in range(60)) for _ in range(3)]
    rows = [(4, texts[0]), (4, texts[0]), (9, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[1]), (7, texts[2]), (7, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(deduplicated(rows, 20), key=repr)
    assert [r[2] for r in want].count(0) == 6
    for parts in (1, 3, 8):
        got = substring_dedup.substring_dedup(df.repartition(parts)).drop("text_key")
        assert sorted(map(tuple, got.collect()), key=repr) == want
    kept = corpus_pipeline.repeated_passages(spark, df.coalesce(1), None).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted((r for r in rows if r not in ((9, texts[0]), (2, texts[1]))), key=repr)


def test_substring_dedup_of_an_empty_table(no_documents):
    assert substring_dedup.substring_dedup(no_documents).collect() == []


def test_words_and_ngrams_do_not_depend_on_chunks(monkeypatch):
    texts = ["a  b\tc", None, "", "é x\x0by " * 50, "long" * 300, "end"]
    whole = words.words_of(pa.array(texts))
    monkeypatch.setattr(words, "CHUNK_BYTES", 16)
    small = words.words_of(pa.array(texts))
    assert np.array_equal(whole.hashes, small.hashes) and np.array_equal(whole.first, small.first)
    assert list(np.diff(whole.first)) == [len(split(t)) for t in texts]
    grams, pos, docs = words.ngrams(whole, 3)
    again = words.ngrams(words.words_of(pa.array(texts[3:4])), 3)[0]
    assert np.array_equal(grams[docs == 3], again)


def test_reordered_benchmark_passages_are_found(spark):
    item = [f"i{k}" for k in range(30)]
    moved = item[15:] + ["x"] * 4 + item[:15]
    docs = [(1, " ".join(["q"] * 9 + item)), (2, " ".join(moved).upper()), (3, " ".join(item[:14])), (4, None), (5, ""), (2, " ".join(moved))]
    items = [(7, " ".join(item)), (8, None), (9, "q z"), (10, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 7, 1.0, 1, 30), (2, 7, 1.0, 2, 30), (2, 7, 1.0, 2, 30)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(df, none).collect() == []


def test_greedy_tiles_match_a_plain_tiling(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
        text = [rng.choice("abc") for _ in range(rng.randrange(1, 25))]
        least = 3
        free_i, free_t, want = [True] * len(item), [True] * len(text), []
        while True:
            best = None
            for i in range(len(item)):
                for t in range(len(text)):
                    n = 0
                    while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and free_i[i + n] and free_t[t + n]:
                        n += 1
                    if n >= least and (best is None or (-n, i, t) < (-best[2], best[0], best[1])):
                        best = (i, t, n)
            if best is None:
                break
            want.append(best)
            for k in range(best[2]):
                free_i[best[0] + k] = free_t[best[1] + k] = False
        hits = [(i, t) for i in range(len(item) - 2) for t in range(len(text) - 2) if item[i : i + 3] == text[t : t + 3]]
        at = np.array(hits, np.int64).reshape(-1, 2)
        got = decontamination.tiles(len(item), at[:, 0], at[:, 1], least) if len(at) else []
        assert got == want
        codes = [np.array([ord(c) for c in x], np.uint64) for x in (item, text)]
        assert decontamination.tiles_by_rows(*codes, least) == want


def test_long_repetitive_texts_against_repetitive_items(spark, monkeypatch):
    """Texts of few words agree with such items nearly everywhere; what is held grows with the text alone."""
    rng = random.Random(6)
    items = [(1, "word " * 200), (2, "a b " * 90), (3, " ".join(rng.choice("ab") for _ in range(40)))]
    docs = [(1, "word " * 100_000), (2, "a b " * 3000), (3, "word " * 80), (4, " ".join(rng.choice("ab") for _ in range(400))), (4, "word " * 120), (None, "a b " * 50)]
    found = {}
    for agreeing in (1 << 18, 50):
        monkeypatch.setattr(decontamination, "AGREEING", agreeing)
        df = spark.createDataFrame([(i, t, "x") for i, t in docs[(agreeing == 50):]], "doc_id long, text string, item_id string")
        got = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
        found[agreeing] = sorted(map(tuple, got.collect()), key=repr)
    assert (1, 1, 1.0, 1, 200) in found[1 << 18]
    assert [r for r in found[1 << 18] if r[0] != 1] == found[50] and (4, 1, 0.6, 1, 120) in found[50]
