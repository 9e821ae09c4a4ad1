"""Periodic runs, repeated lines and the manifest against brute force, on odd rows and at their small limits."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bipath.llm import line_dedup, merkle, periodic_runs
from bipath.llm.queries import looped_documents
from bipath.llm.words import words_of
from odd_rows import frame, no_documents, odd_documents  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs ------------------------------------------------------------------------------------------------


def plain_runs(words, least=6, exponent=4):
    """Every maximal stretch of each period, less those that a smaller period explains."""
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            inside = any(s <= start and s + m >= start + length for s, m, _ in found)
            if j > i and length >= max(least, exponent * q) and not inside:
                found.append((start, length, q))
            i = j + 1
    return sorted(found)


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looping_texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(4)
            block = [rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 12))]
            if kind == 0:
                words += block
            elif kind == 1:
                words += (block * 9)[: rng.randrange(1, 9 * len(block))]
            elif kind == 2:
                words += [f"u{rng.randrange(10**6)}" for _ in block]
            else:
                inner = block[:2] * rng.randrange(1, 6) + block[2:]
                words += inner * rng.randrange(3, 6)
        out.append(words)
    return out


@pytest.mark.parametrize("least,exponent", [(6, 4), (3, 3), (12, 5)])
def test_runs_of_looping_texts(spark, least, exponent):
    texts = looping_texts(exponent, 300)
    df = frame(spark, [(i, "\t ".join(words), None, None) for i, words in enumerate(texts)])
    got = periodic_runs.periodic_runs(df, least, exponent).collect()
    assert len(got) == len(texts)
    seen = 0
    for row in got:
        words = texts[row["doc_id"]]
        runs = plain_runs(words, least, exponent)
        seen += len(runs)
        assert [tuple(r) for r in row["runs"]] == runs, words
        assert row["collapsed"] == collapsed(words, runs)
        assert (row["n_words"], row["collapsed_sha256"]) == (len(words), sha(row["collapsed"]))
    assert seen > 50


def test_runs_of_odd_rows(odd_documents, no_documents):
    rows, df = odd_documents
    got = periodic_runs.periodic_runs(df).collect()
    want = []
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        runs = plain_runs(words) if len(words) < 500 else [(0, len(words), 1)]
        want.append((i, len(words), runs, collapsed(words, runs)))
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(no_documents).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, exponent=2)


def test_occurrences_stay_sparse():
    """A long text of few words, a long loop, and a text of one word have few lags for each word."""
    rng = random.Random(3)
    block = [f"w{i}" for i in range(7000)]
    texts = [[rng.choice("abc") for _ in range(40_000)], block * 6, ["same"] * 50_000]
    for words in texts:
        word, lag, context = periodic_runs.sparse_lags(words_of(pa.array([" ".join(words)])))
        assert len(word) <= 2 * len(words)
        assert ((lag <= context) & (lag > context // 2)).all() and np.all(np.diff(word) >= 0)
    word, lag, context = periodic_runs.sparse_lags(words_of(pa.array([" ".join(texts[1])])))
    assert periodic_runs.runs_of(word, lag, context) == [(0, 42_000, 7000)]


def test_looped_documents_are_those_of_the_contract(spark):
    rows = [(i, " \n".join(f"w{j}" for j in range(i % 90)), None, None) for i in range(200)] + [(None, "a b", None, None), (7, None, None, None)]
    got = looped_documents(frame(spark, rows)).collect()
    changed = 0
    for (i, text, *_), row in zip(rows, got):
        words = WORD.findall(text or "")
        h = 1 if i is None else int(np.uint32(__import__("zlib").crc32(str(i).encode())))
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
            changed += want != words
        else:
            want = words
        assert row["doc_id"] == i and WORD.findall(row["text"] or "") == want
    assert changed > 5


# --- repeated lines -----------------------------------------------------------------------------------------------

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows, characters=40, documents=5):
    """(doc_id, lines, dropped, kept) of each row; rows without an id are one document before all others."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= characters:
                holders.setdefault(key(line), set()).add(-1 if i is None else i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        own = -1 if i is None else i
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= documents and max(holders[key(x)]) != own)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lined_documents(seed=8, n=60):
    rng = random.Random(seed)
    shared = ["É" + "shared Line %d, of more than forty code points" % k for k in range(6)]
    shared += ["x" * 39, "y" * 40, "  " + "Z" * 41 + "\t\r", "é" * 39, "é" * 40, " " + "w" * 39]
    rows = []
    for i in range(n):
        lines = [f"line {i} {j} " + "own " * rng.randrange(0, 14) for j in range(rng.randrange(0, 5))]
        lines += rng.sample(shared, rng.randrange(0, 7))
        lines += ["", "   ", *([rng.choice(shared).upper() + " "] * rng.randrange(0, 3))]
        rng.shuffle(lines)
        rows.append((i * 2, "\n".join(lines), "en", "s"))
    hot = "the line that every third document holds, in several spellings"
    rows += [(1000 + i, hot if i % 2 else f"  {hot.upper()}\r\nown {i}", None, "s") for i in range(40)]
    rows += [rows[3], rows[3], (None, hot, None, None), (None, shared[0] + "\n" + hot, None, None), (5001, None, None, None), (5003, "", None, None), (5005, "\n\n", None, None)]
    return rows


@pytest.mark.parametrize("documents", [2, 5])
@pytest.mark.parametrize("most_bits", [1 << 13, 1 << 28])
def test_lines_against_brute_force(spark, documents, most_bits):
    rows = lined_documents()
    got = line_dedup.line_dedup(frame(spark, rows).repartition(5), least_documents=documents, most_bits=most_bits).collect()
    found = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got]
    want = plain_lines(rows, documents=documents)
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert all(r["kept_sha256"] == sha(r["kept"]) for r in got)
    assert sum(r[2] for r in want) > 60


def test_light_and_heavy_lines_agree(spark, monkeypatch):
    rows = lined_documents(9)
    monkeypatch.setattr(line_dedup, "HEAVY_DIGESTS", 2)
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got], key=repr) == sorted(plain_lines(rows), key=repr)


def test_lines_of_odd_rows(odd_documents, no_documents):
    rows, df = odd_documents
    got = line_dedup.line_dedup(df, 3, 2).collect()
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got], key=repr) == sorted(plain_lines(rows, 3, 2), key=repr)
    assert line_dedup.line_dedup(no_documents).collect() == []


def test_filters_miss_no_repeat_and_suspect_few_others():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.int64).astype(np.uint64)
    bits = 1 << (line_dedup.BITS_PER_LINE * 6000).bit_length()
    parts = [line_dedup.Filter(bits) for _ in range(3)]
    for k, part in enumerate(parts):
        part.add(keys[k * 1500 : k * 1500 + 2000])  # neighbours share 500 keys
    parts[2].add(keys[:10])
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for part in parts:
        twice |= part.twice | (once & part.once)
        once |= part.once
    repeated = np.zeros(5000, bool)
    repeated[1500:2000] = repeated[3000:3500] = repeated[:10] = True
    found = line_dedup.suspected(twice, keys)
    assert found[repeated].all()
    assert found[~repeated].mean() < 0.02


def test_few_documents_with_suspected_lines_cross_the_shuffle(spark):
    """Texts without a repeated line are settled where they are read."""
    rows = [(i, f"only document {i} holds this line of forty code points\nand {i}", None, None) for i in range(3000)]
    rows += [(9000 + i, "this line of more than forty code points comes six times", None, None) for i in range(6)]
    df = frame(spark, rows)
    bits = line_dedup.filter_bits(df.select("text"), 40)
    twice = line_dedup.twice_seen(df.select("text"), bits, 40)
    lines = line_dedup.Lines(pa.array([text for _, text, *_ in rows]), 40)
    suspects = line_dedup.suspected(twice, lines.hashes()[lines.long])
    assert 6 <= suspects.sum() < 60


# --- manifest -----------------------------------------------------------------------------------------------------


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fanout):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)])
    return levels


def plain_path(levels, at, fanout):
    """(place, siblings) of each level below the top."""
    path = []
    for level in levels[:-1]:
        run = level[at - at % fanout : at - at % fanout + fanout]
        path.append((at % fanout, run[: at % fanout] + run[at % fanout + 1 :]))
        at //= fanout
    return path


def plain_fold(digest, path):
    for place, others in path:
        digest = sha("".join([*others[:place], digest, *others[place:]]))
    return digest


def plain_proofs(rows, fanout, tampered=lambda doc_id: False):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row."""
    leaves = {}
    for i, text, lang, source in rows:
        values = (i, source, lang, len(text or ""), text)
        claimed = (i, source, lang, len(text or "") + 1, text) if tampered(i) else values
        leaves.setdefault(lang, []).append((i is not None, i or 0, plain_leaf(*values), i, plain_leaf(*claimed)))
    order = sorted(leaves, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: plain_tree([x[2] for x in sorted(leaves[lang])], fanout) for lang in order}
    top = plain_tree([trees[lang][-1][0] for lang in order], fanout)
    out = []
    for place, lang in enumerate(order):
        for at, (_, _, leaf, i, claimed) in enumerate(sorted(leaves[lang])):
            path = plain_path(trees[lang], at, fanout) + plain_path(top, place, fanout)
            proof = [d for _, others in path for d in others]
            out.append((i, leaf, trees[lang][-1][0], top[-1][0], proof, plain_fold(claimed, path)))
    return out


def proofs_of(df, fanout, digits, keep=None):
    made = merkle.manifest(df, keep={"doc_id": F.col("doc_id"), **(keep or {})}, fanout=fanout, digits=digits)
    claimed = F.col("kept_claimed") if keep else F.lit(None).cast("string")
    found = merkle.proofs(made, made.leaves.select("tree", "rank", F.col("kept_doc_id").alias("id"), claimed.alias("claimed")))
    return made, found.collect()


@pytest.mark.parametrize("fanout,digits,langs", [(2, 2, 7), (3, 1, 40), (2, 6, 1), (2, 10, 3), (5, 2, 2)])
def test_proofs_against_a_plain_tree(spark, fanout, digits, langs):
    rng = random.Random(digits)
    names = [None, "", "=", *(f"l{k}" for k in range(langs))][:langs]
    rows = [(i, f"text {i} é\n" * (i % 3), rng.choice(names[: 1 + i % len(names)]), rng.choice([None, "-", "3:abc"])) for i in range(150)]
    rng.shuffle(rows)
    tampered = F.when(F.col("doc_id") % 7 == 0, merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")))
    made, got = proofs_of(frame(spark, rows), fanout, digits, {"claimed": tampered})
    want = plain_proofs(rows, fanout, lambda i: i % 7 == 0)
    found = [(r["id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"]) for r in got]
    assert sorted(found) == sorted(want)
    assert all(r["verified"] == (r["id"] % 7 != 0) and r["proof_sha256"] == sha("".join(r["proof"])) for r in got)


def test_every_count_of_leaves_up_to_forty(spark):
    """Last runs of every size, at every level, with pages of four."""
    rows = list(itertools.chain.from_iterable([(100 * n + i, f"t{i}", f"{n:02d}", None) for i in range(n)] for n in range(1, 41)))
    _, got = proofs_of(frame(spark, rows), 2, 2)
    want = plain_proofs(rows, 2)
    assert sorted((r["id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"]) for r in got) == sorted(want)
    assert all(r["verified"] for r in got)


def test_manifest_of_odd_rows(spark, odd_documents, no_documents):
    rows, df = odd_documents
    _, got = proofs_of(df, 2, 3)
    found = [(r["id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"]) for r in got]
    assert sorted(found, key=repr) == sorted(plain_proofs(rows, 2), key=repr)
    made, nothing = proofs_of(no_documents, 2, 3)
    assert made.root is None and nothing == []


def test_one_row_and_requests_for_what_is_not_there(spark):
    made, got = proofs_of(frame(spark, [(1, "a", "en", "s")]), 2, 3)
    assert [(r["leaf"], r["subroot"], r["root"], r["proof"], r["proof_sha256"]) for r in got] == [(made.root, made.root, made.root, [], sha(""))]
    made = merkle.manifest(frame(spark, [(i, "a", "en", "s") for i in range(11)]), digits=2)
    asked = [("=en", 10, 0, None), ("=en", 11, 1, None), ("=en", 12, 2, None), ("=en", 40, 3, None), ("=de", 0, 4, None), ("=en", -1, 5, None), (None, 0, 6, None), ("=en", 10, 7, "00")]
    found = merkle.proofs(made, spark.createDataFrame(asked, "tree string, rank long, id int, claimed string")).collect()
    assert sorted((r["id"], r["verified"]) for r in found) == [(0, True), (7, False)]


def test_stored_records_are_content_addressed(spark):
    """The digest of a record's children is its own, and a changed record makes other proofs."""
    made = merkle.manifest(frame(spark, [(i, f"t{i}", f"l{i % 3}", "s") for i in range(90)]), digits=3)
    for records in (*made.records, *made.top_records):
        for r in records.collect():
            assert all(merkle.digest_of(run) == digest for digest, run in zip(r["node"], r["children"]))
            assert r["digest"] == (r["node"][-1] if r["node"] else r["digest"])
