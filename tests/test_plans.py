"""What the plans must keep: pruned scans, filters below aggregates, limits before shuffles."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bipath.operators import degrees, edges, neighbourhood, ranking, twohop
from bipath.registry.queries import QUERIES

# Queries whose plan is cheap to build, i.e. that start no job before their result is asked for.
LAZY = [
    "amount_interactions", "attach_target_list", "two_hop_paths", "exclude_known_targets", "clean_ppi_text",
    "degree_total", "degree_frequency", "dti_of_edges", "ego_network_2hop", "graph_edges", "graph_nodes",
    "network_summary", "others_interactions", "seed_neighbourhood", "sql_amount_match", "sql_complete_profile",
    "symmetrize_ppi", "targets_per_drug", "topk_per_drug", "rmse_eval", "split_semi_join",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ppi_file(spark, hand_ppi, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "ppi")
    hand_ppi.withColumn("unused", F.lit("x")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_pruned_scans(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text
    assert "l_extendedprice" not in text and "l_shipdate" not in text


def test_score_filter_reaches_the_scan(ppi_file):
    text = plan(edges.symmetrize_ppi(ppi_file, 0.5))
    assert "GreaterThanOrEqual(score,0.5)" in text and "unused" not in text
    assert text.count("Exchange hashpartitioning") == 1 and text.count("FileScan") == 1


def test_limits_are_taken_before_the_shuffle(ppi_file, hand_dti):
    amount = degrees.drug_degree(hand_dti)
    for df in (
        ranking.topk_per_group(amount, 3, "degree"),
        neighbourhood.seed_neighbourhood(ppi_file, ["P1"], limit=20),
        neighbourhood.dti_of_edges(hand_dti, ppi_file, limit=10),
        neighbourhood.ego_network(ppi_file, "P1", limit=20),
    ):
        assert "WindowGroupLimit" in plan(df)


def test_count_and_anti_join_share_one_shuffle(spark, ppi_file, hand_dti):
    """Without broadcasts: the counted paths are not shuffled again for the anti join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = twohop.count_paths(
            hand_dti.join(ppi_file.withColumnRenamed("proteinAId", "proteinId"), "proteinId")
        )
        targets = edges.distinct_dti(hand_dti)
        before = plan(counted).count("Exchange hashpartitioning")
        both = plan(twohop.exclude_known_targets(counted, targets)).count("Exchange hashpartitioning")
        assert both == before + 1  # that of the distinct targets
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry_plan(spark):
    assert "WindowGroupLimit" in plan(entry.entry(spark))
