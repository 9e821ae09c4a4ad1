"""What keeps tasks bounded as the tables grow: dealt rows, short shuffles, lookups without a sort."""

import random

import pytest
from pyspark.sql import functions as F

from bipath import schemas
from bipath.models import als
from bipath.operators import candidates, features, joins, matrices, ranking, splits, twohop
from bipath.plans import sql_profile
from bipath.registry.queries import QUERIES
from conftest import rows

AMOUNT = [("D1", "P3", 2), ("D1", "P4", 1), ("D2", "P1", 1), ("D2", "P3", 1)]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def dealt(monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 2)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def unsorted_lookup(df):
    text = executed(df)
    return "ShuffledHashJoin" in text and "SortMergeJoin" not in text


def test_paths_are_dealt_by_their_number(hand_dti, hand_ppi, dealt, no_broadcast):
    counts = twohop.amount_interactions(hand_dti, hand_ppi)
    assert "RepartitionByExpression [drugId" in optimized(counts)
    assert any("ShuffledHashJoin" in line and "LeftAnti" in line for line in executed(counts).splitlines())
    assert rows(counts) == [("D1", "P3", 2), ("D1", "P4", 1), ("D2", "P1", 1), ("D2", "P3", 1)]


def test_manual_counts_are_dealt_by_their_number(hand_dti, hand_ppi, dealt):
    manual = sql_profile.amount_manual(hand_dti, sql_profile.ppis_for_analysis(hand_ppi))
    assert "RepartitionByExpression [drugId" in optimized(manual)
    assert rows(manual) == [("D1", "P2", 1), ("D1", "P3", 2), ("D2", "P3", 2)]


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_dealt_joins_keep_every_pair(spark, dealt, block_rows):
    rng = random.Random(3)
    left = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}", i) for i in range(60)] + [(None, 1)]
    right = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}", i) for i in range(40)] + [(None, 2)]
    frames = [spark.createDataFrame(left, "key string, l int"), spark.createDataFrame(right, "key string, r int")]
    joined, n = joins.joined_pairs(*frames, "key", block_rows)
    want = sorted(((k, a, b) for k, a in left for j, b in right if k is not None and k == j), key=repr)
    assert rows(joined, "key", "l", "r") == want and n == len(want)


def test_cells_and_not_tiles_cross_the_shuffle(spark, dealt):
    cells = spark.createDataFrame([*AMOUNT, ("D1", "P3", 5), ("D1", None, 7)], schemas.AMOUNT)
    tiles = matrices.tile_matrix(cells, "drugId", "proteinId", "amount_interactions", width=2)
    text = optimized(tiles)
    assert 0 <= text.index("Aggregate [drugId") < text.index("RepartitionByExpression [drugId")
    assert rows(tiles) == [("D1", 1, 5, 1), ("D2", 0, 0, 1), ("D2", 1, 1, 0)]  # a null column has number 0


def test_lookups_do_not_sort_the_rows(spark, no_broadcast):
    amount = spark.createDataFrame(AMOUNT, schemas.AMOUNT)
    assert unsorted_lookup(matrices.others_interactions(amount))
    assert unsorted_lookup(splits.restrict_to_keys(amount, amount.filter("amount_interactions = 1")))
    assert unsorted_lookup(ranking.rank_per_group(amount, "amount_interactions"))
    ratings = als.index_ratings(amount)
    assert unsorted_lookup(als.name_indexes(ratings.data.select(als.DRUG, als.PROTEIN), ratings))


def test_best_rows_come_from_counted_levels(spark, no_broadcast):
    data = [("a", f"P{i}", 3 if i < 2 else 2 if i < 4 else None) for i in range(6)] + [(None, "Q", 1)]
    df = spark.createDataFrame(data, "drugId string, proteinId string, amount_interactions int")
    top = ranking.topk_per_group(df, 3, "amount_interactions")
    text = optimized(top)
    assert unsorted_lookup(top) and "Window" in text and text.rindex("Window") < text.rindex("Aggregate")
    assert rows(top, "proteinId", "rank") == [("P0", 1), ("P1", 1), ("P2", 3), ("P3", 3), ("Q", 1)]


def test_counts_are_not_joined_to_themselves(spark):
    amount = spark.createDataFrame(AMOUNT, schemas.AMOUNT)
    cells = features.feedback_cells(amount)
    own = features.feature_profile(amount, cells)
    other = features.feature_profile(amount.select("*"), cells)
    assert "LeftOuter" not in optimized(own) and "LeftOuter" in optimized(other)
    assert rows(own) == rows(other)


def test_the_order_samples_written_counts(spark, sf_dir):
    ordered = QUERIES["order_result"](spark, sf_dir)
    assert "Aggregate" not in optimized(ordered) and "Join" not in optimized(ordered)


def test_all_pairs_are_spread_over_tasks(spark):
    """3,200,000 pairs of two short sides, which adaptive execution would leave to one task."""
    drugs = spark.range(320).select(F.concat(F.lit("D"), "id").alias("drugId"))
    proteins = spark.range(10000).select(F.concat(F.lit("P"), "id").alias("proteinId"))
    pairs = candidates.candidate_pairs(drugs, proteins)
    by_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 3_200_000 and max(by_task) < 1_600_000


def test_all_pairs_in_short_runs_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(candidates, "RUN_ROWS", 3)
    monkeypatch.setattr(candidates, "CHUNK_ROWS", 2)
    monkeypatch.setattr(candidates, "PAIR_ROWS", 10)
    counts = spark.createDataFrame(
        [(f"D{i % 7}", f"P{i % 11}") for i in range(200)] + [(None, "P1"), ("D1", None), (None, None)], "drugId string, proteinId string"
    )
    pairs = candidates.candidate_pairs(counts, counts)
    drugs, proteins = [None, *(f"D{i}" for i in range(7))], [None, *(f"P{i}" for i in range(11))]
    assert rows(pairs) == sorted(((d, p) for d in drugs for p in proteins), key=repr)
    by_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) > 4 and max(by_task) < 48
    assert candidates.candidate_pairs(counts.limit(0), counts).count() == 0
