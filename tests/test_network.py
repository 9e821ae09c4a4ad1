"""The hand-made graph, with answers worked out by hand, and brute-force checks on random ones."""

import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from bipath import schemas
from bipath.operators import degrees, edges, graph, joins, matrices, neighbourhood, ranking, twohop

AMOUNT = [("D1", "P3", 2), ("D1", "P4", 1), ("D2", "P1", 1), ("D2", "P3", 1)]


def test_amount_interactions(hand_dti, hand_ppi):
    assert rows(twohop.amount_interactions(hand_dti, hand_ppi)) == AMOUNT


def test_symmetrize_keeps_best_score_and_single_self_loop(hand_ppi):
    symmetric = {(a, b): s for a, b, s in rows(edges.symmetrize_ppi(hand_ppi))}
    assert symmetric[("P1", "P3")] == symmetric[("P3", "P1")] == 0.9
    assert symmetric[("P5", "P5")] == 0.7
    assert len(symmetric) == 11
    assert rows(edges.symmetrize_ppi(hand_ppi, 0.5)) == rows(
        edges.filter_score(edges.symmetrize_ppi(hand_ppi))
    )


def random_graph(seed, drugs=12, proteins=25, hub=True):
    rng = random.Random(seed)
    dti = [(f"D{rng.randrange(drugs)}", f"P{rng.randrange(proteins)}") for _ in range(60)]
    ppi = [
        (f"P{rng.randrange(proteins)}", f"P{rng.randrange(proteins)}", rng.randrange(51) / 50)
        for _ in range(80)
    ]
    if hub:
        dti += [(f"D{i}", "P0") for i in range(drugs)]
        ppi += [("P0", f"P{i}", 0.9) for i in range(proteins)]
    return dti, ppi


def brute_force(dti, ppi):
    best = {}
    for a, b, s in ppi:
        for pair in ((a, b), (b, a)):
            best[pair] = max(s, best.get(pair, 0.0))
    targets = {}
    for d, p in dti:
        targets.setdefault(d, set()).add(p)
    found = {}
    for d, known in targets.items():
        for (a, b), s in best.items():
            if s >= 0.5 and a in known and b not in known:
                found[(d, b)] = found.get((d, b), 0) + 1
    return sorted(((d, p, n) for (d, p), n in found.items()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_amount_interactions_with_hub_matches_brute_force(spark, seed):
    dti, ppi = random_graph(seed)
    got = twohop.amount_interactions(
        spark.createDataFrame(dti, schemas.DTI), spark.createDataFrame(ppi, schemas.PPI)
    )
    assert rows(got) == brute_force(dti, ppi)


@pytest.mark.parametrize("block_rows", [1, 3, 10, 4096])
def test_hot_key_join_equals_plain_join(spark, block_rows):
    rng = random.Random(7)
    left = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", i) for i in range(120)]
    right = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", i) for i in range(90)]
    left += left[:10]  # repeated rows stay repeated
    left_df = spark.createDataFrame(left, "key string, l int")
    right_df = spark.createDataFrame(right, "key string, r int")
    got = joins.hot_key_join(left_df, right_df, "key", block_rows)
    want = sorted(((k, a, b) for (k, a), (j, b) in itertools.product(left, right) if k == j), key=repr)
    assert rows(got, "key", "l", "r") == want


def test_targets_per_drug_pieces_hold_every_target_once(spark):
    dti = [("D1", f"P{i}") for i in range(100)] + [("D2", "P1"), ("D2", "P1")]
    lists = rows(twohop.targets_per_drug(spark.createDataFrame(dti, schemas.DTI), list_size=30))
    of = {d: [p for row in lists if row[0] == d for p in row[3]] for d in ("D1", "D2")}
    assert sorted(of["D1"]) == sorted(f"P{i}" for i in range(100)) and of["D2"] == ["P1"]
    assert {row[2] for row in lists if row[0] == "D1"} == {4}


def test_flag_known_targets(hand_dti, hand_ppi):
    strong = edges.symmetrize_ppi(hand_ppi, 0.5)
    paths = twohop.two_hop_paths(edges.distinct_dti(hand_dti), strong)
    flagged = twohop.flag_known_targets(paths, hand_dti)
    assert ("D1", "P1", "P2", 2, True) in rows(flagged)
    unknown = flagged.filter(~F.col("interactor_drug_target"))
    assert rows(unknown.groupBy("drugId", "proteinBId").count()) == AMOUNT


def test_degrees(hand_dti, hand_ppi):
    symmetric = edges.symmetrize_ppi(hand_ppi)
    assert rows(degrees.ppi_degree(symmetric)) == [
        ("P1", 6, 3), ("P2", 6, 3), ("P3", 4, 2), ("P4", 4, 2), ("P5", 2, 1),
    ]
    # P9 is a target without any PPI.
    assert rows(degrees.degree_total(hand_dti, symmetric)) == [("P1", 7), ("P2", 8), ("P9", 1)]
    shares = degrees.degree_frequency(degrees.degree_distribution(degrees.ppi_degree(symmetric)))
    assert sum(r.frequency for r in shares.collect()) == pytest.approx(1.0)


def test_graph_tables(hand_dti, hand_ppi):
    nodes = dict(rows(graph.graph_nodes(hand_dti, hand_ppi)))
    assert nodes["D3"] == "drug" and nodes["P9"] == nodes["P5"] == "protein" and len(nodes) == 9
    assert len(rows(graph.graph_edges(hand_dti, hand_ppi))) == 4 + 6


def test_seed_neighbourhood(hand_ppi):
    assert rows(neighbourhood.seed_neighbourhood(hand_ppi, ["P1"])) == [
        ("P1", "P2", 0.8), ("P1", "P3", 0.9), ("P3", "P1", 0.4), ("P4", "P1", 0.6),
    ]
    assert rows(neighbourhood.seed_neighbourhood(hand_ppi, ["P9"])) == []
    assert len(rows(neighbourhood.seed_neighbourhood(hand_ppi, ["P1"], limit=1))) == 2
    assert neighbourhood.seed_neighbourhood(hand_ppi).count() == hand_ppi.count()


def test_ego_network_matches_brute_force(spark):
    _, ppi = random_graph(3, hub=False)
    ppi = sorted(set(ppi))

    def first(candidates, n):
        return sorted(candidates, key=lambda e: (-e[2], e[0], e[1]))[:n]

    strong = [e for e in ppi if e[2] >= 0.5]
    hop = first([e for e in strong if "P3" in e[:2]], 4)
    want = set(hop)
    for a, b, _ in hop:
        want |= set(first([e for e in strong if {a, b} & set(e[:2])], 4))
    got = neighbourhood.ego_network(spark.createDataFrame(ppi, schemas.PPI), "P3", limit=4)
    assert rows(got) == sorted(want, key=repr) and hop


@pytest.mark.parametrize("hops", [1, 2, 3, 5])
def test_edges_within_hops_match_a_search(spark, hops):
    _, ppi = random_graph(5, hub=False)
    ppi = sorted(set(ppi))[:60] + [("P3", "P3", 0.9), (None, "P3", 0.9)]
    nodes, want = {"P3", "absent"}, set()
    for _ in range(hops):
        touched = {e for e in ppi if nodes & set(e[:2])}
        want |= touched
        nodes |= {n for e in touched for n in e[:2] if n is not None}
    start = spark.createDataFrame([("P3",), ("P3",), ("absent",), (None,)], "node string")
    assert rows(neighbourhood.edges_within(spark.createDataFrame(ppi, schemas.PPI), start, hops)) == sorted(want, key=repr)
    strong = [e for e in ppi if e[0] and e[2] >= 0.5]
    if hops == 2:
        first = {e for e in strong if "P3" in e[:2]}
        second = {e for e in strong if {n for f in first for n in f[:2]} & set(e[:2])}
        assert rows(neighbourhood.ego_network(spark.createDataFrame(ppi[:-1], schemas.PPI), "P3")) == sorted(first | second, key=repr)


def test_a_star_of_many_edges_is_no_square(spark):
    """Two steps from a hub of 100,000 edges move each edge a few times: no join pairs edges."""
    star = spark.range(100_000).select(F.lit("hub").alias("proteinAId"), F.concat(F.lit("P"), "id").alias("proteinBId"), F.lit(0.9).alias("score"))
    ego = neighbourhood.ego_network(star, "hub")
    assert ego.count() == 100_000
    plan = ego._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Inner" not in plan and "Cross" not in plan


def test_equal_rows_of_a_hot_key_are_spread(spark):
    left, right = spark.createDataFrame([("k",)] * 40, "key string"), spark.createDataFrame([("k", 1)] * 30, "key string, v int")
    assert joins.hot_key_join(left, right, "key", block_rows=5).count() == 1200
    slots = joins._spread(left, spark.createDataFrame([("k", 8, 6)], "key string, l_slots int, r_slots int"), "key", "ls", "rs")
    assert slots.select("ls").distinct().count() > 3 and slots.count() == 240


def test_pivot_tiles_and_masks(spark, hand_dti, hand_ppi):
    dti = edges.distinct_dti(hand_dti)
    wide = matrices.pivot_matrix(dti, "drugId", "proteinId", values=["P1", "P2", "P9"])
    assert rows(wide) == [("D1", 1, 1, 0), ("D2", 0, 1, 0), ("D3", 0, 0, 1)]
    assert rows(matrices.tile_matrix(dti, "drugId", "proteinId", width=2)) == [
        ("D1", 0, 1, 1), ("D2", 0, 0, 1), ("D3", 1, 1, 0),
    ]
    amount = spark.createDataFrame(AMOUNT, schemas.AMOUNT)
    assert rows(matrices.masked_tiles(amount, width=3)) == [
        ("D1", "P3", 0, 0, 0, 1), ("D1", "P4", 0, 0, 2, 0), ("D2", "P1", 0, 0, 1, 0), ("D2", "P3", 0, 1, 0, 0),
    ]
    joined = matrices.pivot_matrix(amount, "drugId", "proteinId", "amount_interactions").join(
        amount.select("drugId", "proteinId"), "drugId"
    )
    masked = matrices.mask_current_target(joined, "proteinId", ["P1", "P3", "P4"])
    assert rows(masked.drop("drugId")) == [("P1", 0, 1, 0), ("P3", 0, 0, 1), ("P3", 1, 0, 0), ("P4", 0, 2, 0)]
    assert rows(matrices.others_interactions(amount)) == [
        ("D1", "P3", 1, 1, 2), ("D1", "P4", 1, 2, 1), ("D2", "P1", 1, 1, 1), ("D2", "P3", 1, 1, 1),
    ]


def test_masked_tiles_meet_no_table_of_tiles(spark):
    """Each row is shuffled to its tile once: no wide tiles are aggregated and joined. Repeated rows stay, rows without a drug go."""
    amount = spark.createDataFrame([*AMOUNT, AMOUNT[0], (None, "P1", 3)], schemas.AMOUNT)
    masked = matrices.masked_tiles(amount, width=3)
    first = ("D1", "P3", 0, 0, 0, 1)
    assert rows(masked) == [first, first, ("D1", "P4", 0, 0, 2, 0), ("D2", "P1", 0, 0, 1, 0), ("D2", "P3", 0, 1, 0, 0)]
    plan = masked._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not any("Aggregate [drugId" in line for line in plan.splitlines())


def test_ranks_keep_null_scores_and_many_ties(spark):
    data = [("a", f"P{i}", 1) for i in range(50)] + [("a", "Q", 2), ("b", "P", None)]
    df = spark.createDataFrame(data, "drugId string, proteinId string, amount_interactions int")
    assert len(rows(ranking.topk_per_group(df, 3, "amount_interactions"))) == 52
    assert len(rows(ranking.rank_per_group(df, "amount_interactions"))) == 52


def test_null_ends_make_no_edges(spark):
    ppi = spark.createDataFrame([("P1", None, 0.9), ("P1", "P2", 0.8)], "proteinAId string, proteinBId string, score double")
    assert rows(edges.symmetrize_ppi(ppi)) == [("P1", "P2", 0.8), ("P2", "P1", 0.8)]


def test_a_key_hot_by_its_product_is_split(spark):
    hot = joins._hot_slots(
        spark.range(30).selectExpr("'k' AS key", "id AS l").union(spark.range(9000).selectExpr("cast(id AS string)", "id")),
        spark.range(30).selectExpr("'k' AS key", "id AS r").union(spark.range(9000).selectExpr("cast(id AS string)", "id")),
        "key", 10,
    )
    assert rows(hot) == [("k", 3, 3)]


def test_rank_matches_window_with_ties_and_a_hot_group(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.5 else f"D{rng.randrange(4)}", f"P{i}", rng.randrange(20)) for i in range(400)]
    df = spark.createDataFrame(data, "drugId string, proteinId string, amount_interactions int")
    want = sorted(
        ((d, p, n, 1 + sum(1 for e, _, m in data if e == d and m > n)) for d, p, n in data), key=repr
    )
    columns = ["drugId", "proteinId", "amount_interactions", "rank"]
    assert rows(ranking.rank_per_group(df, "amount_interactions"), *columns) == want
    top = ranking.topk_per_group(df, 3, "amount_interactions")
    assert rows(top, *columns) == [r for r in want if r[3] <= 3]


def test_network_summary_counts_nulls_as_one_entity_and_empty_sets_as_zero(spark, hand_ppi):
    dti = spark.createDataFrame([("D1", "P1"), ("D1", "P1"), (None, "P2"), ("D2", None)], "drugId string, proteinId string")
    symmetric = edges.symmetrize_ppi(hand_ppi)
    got = dict(rows(degrees.network_summary(dti, hand_ppi, symmetric, symmetric.limit(0))))
    assert (got["dti_rows"], got["dti"], got["drugs"], got["targets"]) == (4, 3, 3, 3)
    assert (got["ppi_rows"], got["interactors_a"], got["ppi_matrix_width"]) == (7, 5, 0)
    assert got["ppi"] == symmetric.count() and got["proteins"] == symmetric.select("proteinAId").distinct().count()
