"""Classifiers on held-out rows, the mix, the search, the archive, the quotes and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from conftest import rows as sorted_rows
from pyspark.sql import functions as F

import corpus_pipeline
from bipath.llm import language_id, mixing, quality, quotes, revisits, terms, topk_search, toxicity
from bipath.llm.asof import latest_before
from bipath.llm.hot import left_join_spread
from bipath.llm.queries import QUERIES
from bipath.llm.sql import ORACLE
from check_queries import as_rows, duck
from odd_rows import frame, no_documents, odd_documents  # noqa: F401

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    df, result = QUERIES[name](spark, sf_dir), duck(sf_dir).execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert as_rows(df.columns, [tuple(r) for r in df.collect()]) == as_rows(columns, result.fetchall())


def accuracy(found, truth, label, predicted):
    joined = found.join(truth, "doc_id").filter("held_out")
    return joined.groupBy(label).agg(F.avg((F.col(predicted) == F.col(label)).cast("double"))).collect()


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    found = language_id.language_of_documents(docs)
    assert all(share > 0.97 for _, share in accuracy(found, docs.select("doc_id", "lang"), "lang", "lang_pred"))
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_language_of_odd_rows(odd_documents, no_documents):
    rows, df = odd_documents
    got = language_id.language_of_documents(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
    assert language_id.language_of_documents(no_documents).collect() == []
    unlearned = language_id.language_of_documents(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in unlearned.collect()} == {("und", 0.0)}


def languages(scripts, n, seed=5):
    """Documents of languages with words of their own, and letters of one script each."""
    rng, rows = random.Random(seed), []
    for name, letters in scripts.items():
        own = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(40)]
        rows += [(name, " ".join(rng.choice(own) for _ in range(40))) for _ in range(n(name))]
    return [(i, text, name, "s") for i, (name, text) in enumerate(rows)]


def test_every_language_and_script_is_learned(spark):
    def script(first, count):
        return [chr(first + i) for i in range(count)]

    scripts = {f"l{i:02}": script(ord("a"), 26) for i in range(24)}
    scripts |= {f"{a}{i}": s for i in range(2) for a, s in (("cy", script(0x430, 32)), ("el", script(0x3B1, 24)), ("zh", script(0x4E00, 900)))}
    rows = languages(scripts, lambda name: 14 if name[0] == "l" else 12)
    got = language_id.language_of_documents(frame(spark, rows)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and {r["doc_id"]: r["lang_pred"] for r in got} == truth
    assert all(r["phrase_length"] >= corpus_pipeline.LEAST_PHRASE for r in got)
    kept = corpus_pipeline.language(spark, frame(spark, rows), None)
    assert {r["doc_id"] for r in kept.collect()} == set(truth)


def test_packed_automaton_equals_the_plain_table():
    rng = random.Random(9)
    for width, n in ((4, 300), (40, 2000), (900, 2000)):
        symbols = [rng.randrange(width) for _ in range(n)]
        plain, root = language_id.suffix_automaton(symbols, width)
        base, owner, table, packed_root = language_id.packed_automaton(symbols, width)
        assert np.array_equal(root, packed_root)
        for s in range(1, len(plain)):
            at = base[s] + np.arange(width)
            assert np.array_equal(np.where(owner[at] == s, table[at], 0), plain[s])


def test_phrases_equal_greedy_longest_matches(monkeypatch):
    rng = random.Random(2)
    samples = {name: "".join(rng.choice(letters) for _ in range(200)) for name, letters in (("x", "abcd"), ("y", "cdef"))}
    alphabet = "abcdef"
    built = [language_id.suffix_automaton(language_id.symbols_of([s], alphabet)[0].tolist(), 8) for s in samples.values()]
    model = language_id.Model(
        list(samples), alphabet, np.concatenate([t for t, _ in built]), np.array([r for _, r in built]),
        np.array([0, len(built[0][0])]), np.ones(2),
    )
    texts = ["".join(rng.choice("abcdefz ") for _ in range(n)) for n in (0, 1, 5, 40, 300)]
    symbols, first, _ = language_id.symbols_of(texts, alphabet)
    got = language_id.phrases(model, symbols, first)
    for k, sample in enumerate(samples.values()):
        known = "".join(map(chr, language_id.symbols_of([sample], alphabet)[0] + 65))
        for d in range(len(texts)):
            own = "".join(map(chr, symbols[first[d] : first[d + 1]] + 65))
            at = count = 0
            while at < len(own):
                n = 1
                while at + n < len(own) and own[at : at + n + 1] in known:
                    n += 1
                at, count = at + n, count + 1
            assert got[k, d] == count


def test_phrases_over_window_ends_count_once(monkeypatch):
    rng = random.Random(5)
    sample = "".join(rng.choice("abc") for _ in range(400))
    table, root = language_id.suffix_automaton(language_id.symbols_of([sample], "abc")[0].tolist(), 5)
    model = language_id.Model(["x"], "abc", table, root[None], np.array([0]), np.ones(1))
    texts = ["".join(rng.choice("abcz ") for _ in range(n)) for n in (700, 64, 65, 0, 3000)]
    symbols, first, _ = language_id.symbols_of(texts, "abc")
    whole = language_id.phrases(model, symbols, first)[0]
    monkeypatch.setattr(language_id, "SPAN", 64)
    cut = language_id.phrases(model, symbols, first)[0]
    assert np.abs(cut - whole).max() <= np.ceil(np.diff(first).max() / 64) and (np.abs(cut - whole) <= 0.05 * whole + 1).all()


def test_language_is_learned_from_all_of_a_text(spark):
    """The marking words of long documents come after thousands of characters that all languages share."""
    rng = random.Random(9)
    words = {lang: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(30)] for lang, letters in (("aa", "abcdef"), ("bb", "mnopqr"), ("both", "uvwxyz"))}
    rows = []
    for i in range(90):
        lang = ("aa", "bb")[i % 2]
        text = [rng.choice(words["both"]) for _ in range(1500)] + [rng.choice(words[lang]) for _ in range(1500)]
        rows.append((i, " ".join(text), lang, "s"))
    rows += [(1000 + i, " ".join(rng.choice(words[("aa", "bb")[i % 2]]) for _ in range(60)), None, "s") for i in range(20)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.language_of_documents(frame(spark, rows)).collect()}
    assert all(got[1000 + i] == ("aa", "bb")[i % 2] for i in range(20))
    sample = language_id._sample(frame(spark, rows)).collect()
    assert max(len(r["text"]) for r in sample) <= language_id.SYMBOLS and len({r["lang"] for r in sample}) == 2


def small_labelled(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    return docs, labels, {r["doc_id"]: r["text"] for r in docs.collect()}


def test_quality_equals_a_plain_neighbour_vote(spark):
    docs, labels, texts = small_labelled(spark)
    model = quality.learn(docs, labels)
    sample, rows, counts = quality.labelled_sample(docs, labels, "quality", quality.PER_CLASS)
    assert sorted(counts) == [0, 1] and len(rows) == model.vectors.shape[0]

    def plain_vector(text):
        raw = np.zeros(len(model.vocabulary) + 1)
        split = text.split()
        for word in split:
            for term in terms.form_terms(word):
                if term in model.vocabulary.ids:
                    raw[model.vocabulary.ids[term]] += 1
        raw = np.log1p(raw)
        raw[-1] = sum(a == b for a, b in zip(split, split[1:])) / max(len(split), 1)
        raw *= model.weight
        return raw / np.linalg.norm(raw) @ model.axes

    # The learned vectors are those of the whole texts of the sample.
    for row, vector in list(zip(rows.values(), model.vectors))[:20]:
        plain = plain_vector(texts[row["doc_id"]])
        assert plain / np.linalg.norm(plain) == pytest.approx(vector, abs=1e-4)
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    for doc_id in sorted(texts)[:60]:
        vector = plain_vector(texts[doc_id])
        similar = [float(vector @ v) / float(np.linalg.norm(vector)) for v in model.vectors]
        near = sorted(range(len(similar)), key=lambda i: -similar[i])[: quality.NEIGHBOURS]
        votes = [max(similar[i], 0) ** quality.SHARPNESS * model.class_weight[i] for i in near]
        want = sum(v * model.labels[i] for v, i in zip(votes, near)) / sum(votes)
        assert got[doc_id] == pytest.approx(want, abs=2e-3)


def test_quality_learns_from_the_end_of_long_texts(spark):
    """The words that tell good from poor come after 30,000 characters."""
    rng = random.Random(3)
    common = [f"w{i}" for i in range(200)]
    own = {0: ["bad", "poor", "spam"], 1: ["fine", "sound", "clear"]}
    rows = [(i, " ".join([rng.choice(common) for _ in range(8000)] + [rng.choice(own[i % 2]) for _ in range(400)]), "en", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for scores, label in ((quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")):
        found = scores(frame(spark, rows), labels).join(labels, "doc_id").filter("held_out").collect()
        assert found and all(r["predicted"] == r[label] for r in found)


def test_repeated_ids_bring_one_text_to_the_fit(spark):
    rows = [(i % 5, f"text {i} " + "word " * (i % 5), "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, "a") for i in range(5)] * 2, "doc_id long, quality int, note string")
    for parts in (1, 7):
        sample, by_key, _ = quality.labelled_sample(frame(spark, rows).repartition(parts), labels.select("doc_id", "quality"), "quality", 100)
        got = {by_key[r["key"]]["doc_id"]: r["text"] for r in sample.collect()}
        assert got == {i: min(text for j, text, *_ in rows if j == i) for i in got} and len(got) == len(by_key)


def plain_chain(x, targets):
    """The chain with its folds written out: each link's input is what models without the row's fold say of the links before."""
    earlier, models = np.zeros((len(x), 0), np.float32), []
    for j in range(targets.shape[1]):
        y, known = targets[:, j], ~np.isnan(targets[:, j])

        def fitted(keep):
            keep = [i for i in keep if known[i]]
            scale = np.concatenate([toxicity.log_odds(x[keep], y[keep]), np.ones(j + 1)]).astype(np.float32)
            rows = np.array([np.concatenate([x[i] * scale[: x.shape[1]], earlier[i]]) for i in keep], np.float32)
            return toxicity.fit_linear(rows, y[keep], toxicity._balanced(y[keep])) * scale

        column = np.zeros(len(x), np.float32)
        for fold in range(toxicity.FOLDS):
            model = fitted([i for i in range(len(x)) if i % toxicity.FOLDS != fold])
            for i in range(fold, len(x), toxicity.FOLDS):
                column[i] = 1 / (1 + np.exp(-(np.concatenate([x[i], earlier[i]]) @ model[:-1] + model[-1])))
        models.append(fitted(range(len(x))))
        earlier = np.hstack([earlier, column[:, None]])
    return models


def test_toxicity_equals_a_plain_chain(spark):
    rng = np.random.default_rng(4)
    x = (rng.random((90, 12)) < 0.3).astype(np.float32)
    toxic = (x[:, 0] + x[:, 1] + rng.random(90) > 1).astype(float)
    targets = np.array([toxicity.targets_of(int(t), [0, 1, None][i % 3]) for i, t in enumerate(toxic)])
    for got, want in zip(toxicity.fit_chain(x, targets), plain_chain(x, targets)):
        assert got == pytest.approx(want, abs=1e-4)
    assert toxicity.CATEGORIES[-1] == "toxic" and np.isnan(targets).any()


def test_earlier_categories_change_the_toxicity_score(spark):
    docs, labels, texts = small_labelled(spark)
    marks = labels.selectExpr("doc_id", "cast(toxic as int) toxic", "cast(quality as int) quality")
    chain = toxicity.learn(docs, marks)
    size = len(chain.vocabulary)
    weights = chain.coefficients[-1][size:-1]
    assert len(weights) == 2 and np.abs(weights).max() > 0.1
    blind = toxicity.Chain(chain.vocabulary, chain.categories, [*chain.coefficients[:-1], chain.coefficients[-1].copy()])
    blind.coefficients[-1][size:-1] = 0
    moved = [abs(chain.probabilities(t)[-1] - blind.probabilities(t)[-1]) for t in list(texts.values())[:200]]
    assert max(moved) > 0.01
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).limit(50).collect()}
    assert got == pytest.approx({i: chain.probabilities(texts[i])[-1] for i in got}, abs=1e-6)


def test_quality_and_toxicity_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    assert all(s > 0.9 for _, s in accuracy(quality.quality_scores(docs, labels), labels, "quality", "predicted"))
    assert all(s > 0.7 for _, s in accuracy(toxicity.toxicity_scores(docs, labels), labels, "toxic", "predicted"))


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_rows(spark, odd_documents, no_documents, scores):
    rows, df = odd_documents
    labels = spark.createDataFrame([(r[0], k % 2, k % 3 % 2, "x") for k, r in enumerate(rows)] + [(5, None, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, score string")
    got = scores(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert scores(no_documents, labels).collect() == []
    assert len(scores(df, labels.limit(0)).collect()) == len(rows)


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))


def waterfill(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(weight[s] for s in free), 1e-9)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("block", [8, 512])
def test_mix_reaches_its_targets(odd_documents, no_documents, block):
    rows, df = odd_documents
    got = mixing.mixed_documents(df, block=block).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = waterfill(sizes)
    for source, size in sizes.items():
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {size}
        assert all(abs(r["target"] - targets[source]) < 1e-6 * max(1, size) for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[source]) <= 1.001
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, mixing.mixed_documents(df, block=block).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mixed_documents(no_documents).collect() == []


def test_shards_hold_every_slot_once(odd_documents):
    _, drawn = mixing.mix(odd_documents[1], block=16)
    places = sorted(r["place"] for r in drawn.collect())
    assert places == list(range(len(places)))


def test_taken_words_are_those_of_the_packed_shards(spark):
    """The shards, filled word by word from the blocks, hold every document as often as the mix says."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"d{i}.{j}" for j in range(rng.randrange(0, 60))), None, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(80)]
    block = 16
    df = frame(spark, rows)
    pieces, drawn = mixing.mix(df, block=block)
    pieces = pieces.collect()
    blocks, taken, shards = {}, {}, {}
    for p in pieces:
        if p["block"] is not None:
            for k in range(p["lo"], p["hi"]):
                assert blocks.setdefault((p["src"], p["block"], k), p["doc_id"]) == p["doc_id"]
    slots = drawn.collect()
    for slot in slots:
        for k in range(slot["take"]):
            doc = blocks[slot["src"], slot["block"], k]
            taken[doc] = taken.get(doc, 0) + 1
            shards[slot["shard"], doc] = shards.get((slot["shard"], doc), 0) + 1
    got = {r["doc_id"]: r["taken"] for r in mixing.mixed_documents(df, block=block).collect()}
    assert got == {i: taken.get(i, 0) for i, *_ in rows}
    packed = mixing.packed_shards(*mixing.mix(df, block=block)).collect()
    found = {}
    for r in packed:
        found[r["shard"], r["doc_id"]] = found.get((r["shard"], r["doc_id"]), 0) + r["hi"] - r["lo"]
    assert found == shards


def test_sources_are_drawn_evenly_over_shards(spark):
    """In each shard the sources' slots come near their share of all slots."""
    rows = [(i, "word " * 64, None, "ab"[i % 4 == 0]) for i in range(6000)]
    _, drawn = mixing.mix(frame(spark, rows), block=16)
    drawn = drawn.groupBy("shard", "src").count().collect()
    size, share = {}, {}
    for r in drawn:
        size[r["shard"]] = size.get(r["shard"], 0) + r["count"]
        share[r["src"]] = share.get(r["src"], 0) + r["count"]
    total = sum(size.values())
    assert len(size) > 10
    for r in drawn:
        if size[r["shard"]] == mixing.SHARD:
            expected = mixing.SHARD * share[r["src"]] / total
            assert abs(r["count"] - expected) < 6 * np.sqrt(expected)


def test_slots_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    rows = [(i, "word " * 64, None, "s") for i in range(600)]
    _, drawn = mixing.mix(frame(spark, rows), block=16)
    by_task = drawn.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 10 and max(r["count"] for r in by_task) < 600


def test_topk_with_repeated_ids_and_several_lengths(spark):
    rng = random.Random(16)
    rows = [(rng.randrange(0, 260), [rng.choice([-0.5, 0.1, 0.25, 0.9]) for _ in range(rng.choice([2, 2, 5, 0]))], "x") for _ in range(300)]
    rows += [(50, [0.5, 0.0], "x"), (50, [0.9, 0.0], "x"), (1, [0.5, 0.0], "x"), (1, [0.9, 0.0], "x"), (1, [0.9, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    good = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int).tolist()) for i, v, _ in rows]
    scores = {}
    for i, q in good:
        if i % 50 == 0:
            scores.setdefault(i, []).extend((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)
    want = [(i, n + 1, j, -s) for i, found in scores.items() for n, (s, j) in enumerate(sorted(found)[:5])]
    for size in (16_384, 20):
        topk_search.SHARD_ROWS, kept = size, topk_search.SHARD_ROWS
        try:
            assert sorted_rows(topk_search.top_k(df, 5, 50)) == sorted(want, key=repr)
        finally:
            topk_search.SHARD_ROWS = kept


def test_topk_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.25]) for _ in range(6)], "x") for i in range(300)]
    rows += [(1000 + i, [0.25] * 6, "x") for i in range(150)]
    rows += [(50, None, "x") for _ in range(0)] + [(2000, None, "x"), (2050, [float("nan")] * 6, "x"), (2100, [None] * 6, "x"), (None, [0.1] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    good = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and not np.isnan(v).any()]
    want = []
    for i, q in good:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in good if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted_rows(topk_search.top_k(df, 5, 50)) == sorted(want, key=repr)
    assert topk_search.top_k(df.limit(0), 5, 50).collect() == []


def test_tree_search_prunes_but_finds_all():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-50, 50, (2000, 4)).astype(float)
    tree = topk_search.Tree(vectors, 16)
    query = vectors[0]
    bound = topk_search.bounds(query[None], tree.low, tree.high)[0]
    found = topk_search.search(tree, np.arange(2000), vectors, 0, query, bound, 5, -(10**9))
    assert found == sorted(((int(s), -i) for i, s in enumerate(vectors @ query) if i), reverse=True)[:5]


def test_as_of_join_with_a_hot_key(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.randrange(99) if rng.random() < 0.3 else None) for i in range(400)]
    rows += [(None, 1, 5), (None, 2, None)]
    df = spark.createDataFrame(rows, "key string, at long, value long").repartition(7)
    last, want = {}, []
    for key, at, value in rows:
        want.append((key, at, value, None if key is None else last.get(key)))
        if value is not None and key is not None:
            last[key] = value
    assert sorted_rows(latest_before(df, "key", ["at"], "value", "seen")) == sorted(want, key=repr)


@pytest.mark.parametrize("spread", [1, 7, 10_000])
def test_spread_join_with_hot_and_null_keys(spark, spread):
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 7}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int")
    one = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("other", 4)], "k string, v int")
    values = {"hot": 1, "k0": 2, "k3": 3}
    assert sorted_rows(left_join_spread(df, one, "k", "i", spread)) == sorted([(k, i, values.get(k)) for k, i in rows], key=repr)


def test_revisits_with_odd_headers_and_repeated_records(spark):
    schema = "record_id string, kind string, url string, captured long, status int, etag string, last_modified string, headers map<string,string>, payload string, fields string"
    stored = ("r", "response", "http://a.org/", 1, 200, '"e"', None, {"ETag": '"e"', "etag": '"e"', "X": "1", "x": "2", "Vary": "a"}, "B", "z")
    fresh = ("v", "revisit", "http://a.org", 2, 304, '"e"', None, {"Connection": "X-Own, close", "X-OWN": "1", "VARY": "b"}, None, "z")
    rows = [stored, stored, fresh, fresh, ("v", "revisit", "http://a.org", 3, 304, '"no"', None, None, None, "z"), (None, "revisit", "http://a.org", 3, 304, None, None, None, None, "z")]
    got = revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    assert [(r["record_id"], r["outcome"], r["source_id"], r["payload"]) for r in got] == [("v", "resolved", "r", "B")]
    assert got[0]["headers"] == {"etag": '"e"', "x": "1, 2", "vary": "b"}


def test_revisits_of_one_popular_page(spark):
    rows = [("r", "response", "http://a.org/", 0, 200, '"e"', None, {"x": "1"}, "B")]
    rows += [(f"v{i}", "revisit", "http://a.org/" if i % 3 else "http://lost.org", i + 1, 304, '"e"', None, None, None) for i in range(9000)]
    schema = "record_id string, kind string, url string, captured long, status int, etag string, last_modified string, headers map<string,string>, payload string"
    got = revisits.resolve_revisits(spark.createDataFrame(rows, schema))
    assert got.groupBy("outcome", "payload").count().orderBy("outcome").collect() == [("missing", None, 3000), ("resolved", "B", 6000)]


def test_revisits_with_validators_and_nulls(spark):
    def record(i, kind, url, at, etag=None, date=None, status=200, headers=None, body=None):
        return (i, kind, url, at, status, etag, date, headers, body, "x")

    rows = [
        record("r1", "response", "http://WWW.a.org:80/x/?b=2&a=1&utm_source=z#f", 1, '"e"', "d1", headers={"ETag": '"e"', "X": "1", "Content-Length": "9"}, body="B"),
        record("v1", "revisit", "https://a.org/x?a=1&b=2", 2, 'W/"e"', status=304, headers={"x": "2", "content-length": "0"}),
        record("v2", "revisit", "a.org/x?a=1&b=2", 3, '"other"', status=304),
        record("v3", "revisit", "a.org/x?a=1&b=2", 4, None, "d1", status=304),
        record("v4", "revisit", "a.org/x?a=1&b=2", 5, status=304),
        record("v5", "revisit", "a.org/x?a=1&b=2", 0, '"e"', status=304),
        record("v6", "revisit", None, 9, '"e"', status=304),
        record("q", None, "a.org/x", 1),
    ]
    schema = "record_id string, kind string, url string, captured long, status int, etag string, last_modified string, headers map<string,string>, payload string, full string"
    df = spark.createDataFrame(rows, schema)
    got = {r["record_id"]: r for r in revisits.resolve_revisits(df).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"v1": "resolved", "v2": "changed", "v3": "resolved", "v4": "unverified", "v5": "missing", "v6": "missing"}
    assert got["v1"]["headers"] == {"etag": '"e"', "x": "2", "content-length": "9"} and got["v1"]["payload"] == "B"
    assert got["v2"]["payload"] is None and got["v6"]["url_key"] is None
    assert revisits.resolve_revisits(df.limit(0)).collect() == []


def test_quotes_rebuild_threads(spark):
    rows = [
        ("a", 1, "Hello\nthere"),
        ("b", 2, "> hello  THERE\nSure"),
        ("c", 3, "> > Hello there\n> Sure\nThanks"),
        ("d", 4, "> > Sure\n> lost reply\nStill here"),
        ("e", 5, None),
        ("f", 6, ""),
        ("g", 7, "> Hello\n> there\nAlso me"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "msg_id string, sent long, body string, level string")
    got = sorted_rows(quotes.conversations(df))
    assert got == [
        ("a", 0, "a", None, 0, "Hello\nthere"), ("a", 1, "b", "a", 1, "Sure"), ("a", 2, "c", "b", 2, "Thanks"),
        ("a", 3, "d", "b", 2, "Still here"), ("a", 4, "g", "a", 1, "Also me"), ("e", 0, "e", None, 0, ""), ("f", 0, "f", None, 0, ""),
    ]
    assert quotes.conversations(df.limit(0)).collect() == []


def test_trimmed_and_interleaved_quotes_find_their_message(spark):
    rows = [
        ("a", 1, "First point\nof two lines.\n\nSecond point.\n\nThird point\nends."),
        ("b", 2, "Something else\nfrom somebody."),
        ("inline", 3, "> First point\n> of two lines.\nYes.\n> Second point.\nNo."),
        ("trimmed", 4, "> Third  point ends.\nGood"),
        ("a line", 5, "> from somebody.\nWho?"),
        ("two", 6, "> Second point.\nHm\n> Something else\n> from somebody.\nAll right"),
        ("nested", 7, "> > Second point.\n> No.\nReally not?"),
        ("whole inline", 8, "> > First point\n> > of two lines.\n> Yes.\n> > Second point.\n> No.\nSee"),
        ("lost", 9, "> unknown\n> > Third point\nStill"),
    ]
    df = spark.createDataFrame(rows, "msg_id string, sent long, body string")
    got = {r["msg_id"]: (r["thread_id"], r["parent_id"], r["depth"]) for r in quotes.conversations(df).collect()}
    assert got == {
        "a": ("a", None, 0), "b": ("b", None, 0), "inline": ("a", "a", 1), "trimmed": ("a", "a", 1), "a line": ("b", "b", 1),
        "two": ("b", "b", 1), "nested": ("a", "inline", 2), "whole inline": ("a", "inline", 2), "lost": ("a", "a", 1),
    }


def test_common_lines_and_attributions_link_nothing(spark):
    rows = [
        ("a", 1, "The first message says a lot of things"),
        ("b", 2, "Something quite different\nthanks"),
        ("c", 3, "On Monday a wrote:\n> The first message says\n> thanks\nMy answer"),
        ("d", 4, "thanks"),
        ("e", 5, "On Tuesday d wrote:\n> thanks\nYou are welcome"),
        ("f", 6, "Am Montag schrieb e:\n> On Tuesday d wrote:\n> > thanks\n> You are welcome\nOn we go with this:\nno quote"),
        ("f", 6, "Am Montag schrieb e:\n> On Tuesday d wrote:\n> > thanks\n> You are welcome\nOn we go with this:\nno quote"),
    ]
    df = spark.createDataFrame(rows[:-1], "msg_id string, sent int, body string")
    got = {r["msg_id"]: (r["thread_id"], r["parent_id"], r["text"]) for r in quotes.conversations(df).collect()}
    assert got == {
        "a": ("a", None, rows[0][2]), "b": ("b", None, rows[1][2]), "c": ("c", None, "My answer"), "d": ("d", None, "thanks"),
        "e": ("d", "d", "You are welcome"), "f": ("d", "e", "On we go with this:\nno quote"),
    }


def test_pipeline_with_columns_named_like_its_own(spark, odd_documents, sf_dir):
    names = ["key", "own_id", "found_key", "left_text", "kept", "text_key", "_id", "_key", "_text_key", "lang_pred", "score_", "phrase_length", "n_shingles", "in0", "row"]
    rows, df = odd_documents
    docs = df.withColumns({name: F.col("doc_id") * 10 + i for i, name in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, found = stage(spark, df, sf_dir), stage(spark, docs, sf_dir)
        assert found.columns == docs.columns, name
        assert sorted_rows(found.select(df.columns)) == sorted_rows(plain), name
        for r in found.collect():
            assert r["doc_id"] is None or [r[n] for n in names] == [r["doc_id"] * 10 + i for i in range(len(names))]


def test_pipeline_stages_on_odd_rows(spark, odd_documents, no_documents, sf_dir):
    for docs in (odd_documents[1], no_documents):
        for (name, stage), last in zip(corpus_pipeline.STAGES, itertools.chain([False] * 4, [True])):
            found = stage(spark, docs, sf_dir)
            assert last or found.columns == docs.columns, name
            assert found.count() <= docs.count()


def test_near_copies_with_repeated_and_missing_ids(spark):
    rng = random.Random(31)
    one, two, three, four = ([f"n{rng.randrange(10_000)}" for _ in range(80)] for _ in range(4))
    near = {"one": [*one[:-1], "x"], "three": [*three[:-1], "x"], "four": [*four[:-1], "x"]}
    texts = [(1, one), (2, near["one"]), (2, two), (5, four), (None, near["four"]), (None, three), (None, three), (None, near["three"])]
    rows = [(i, " ".join(words), "en", "s") for i, words in texts] + [(7, "", "en", "s"), (7, "", "en", "s"), (8, None, "en", "s")]
    for parts in (1, 4):
        kept = [(r["doc_id"], (r["text"] or "").split()) for r in corpus_pipeline.near_copies(spark, frame(spark, rows).repartition(parts), None).collect()]
        known = [r for r in kept if r[0] is not None]
        assert sorted(known) == sorted([(1, one), (2, two), (5, four), (7, []), (8, [])])
        (missing,) = [words for i, words in kept if i is None]
        assert missing in (three, near["three"])


def test_pipeline_keeps_one_of_each_group_and_drops_leaks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = {r["doc_id"]: r["component_id"] for r in corpus_pipeline.jaccard_components(docs, 80, 5).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()} == set(groups.values())
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    leak = docs.limit(1).withColumns({"doc_id": F.lit(-5).cast("long"), "text": F.lit(f"so {item} it is")})
    assert corpus_pipeline.benchmark_leaks(spark, leak, sf_dir).count() == 0
    result = corpus_pipeline.run(spark, sf_dir)
    assert 0 < result.count() <= docs.count() and result.filter("taken > 3 * size").count() == 0
