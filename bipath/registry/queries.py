"""One callable per operator: (spark, folder of the test tables) -> DataFrame."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bipath import sources, standins as net
from bipath.models import als, comparison, fm
from bipath.operators import (
    candidates,
    cleaning,
    degrees,
    edges,
    evaluation,
    features,
    graph,
    indexing,
    matrices,
    neighbourhood,
    ranking,
    splits,
    twohop,
)
from bipath.plans import etl, sql_profile
from bipath.registry.settings import (
    ALS_GRID, DRUG, FEEDBACK_GRID, FEEDBACK_STEP, FM_GRID, FM_STEP, FOLDS, SEED, WHOLE_ALS_GRID, WHOLE_FM_GRID,
)
from bipath.runtime import scratch_path, written
from bipath.sinks import append_edges, insert_into_table, overwrite_csv, write_lines
from bipath.schemas import AMOUNT, PPI

# -- shared inputs ---------------------------------------------------------------------------


def at_seed() -> Column:
    return (F.col("proteinAId") == "P0") | (F.col("proteinBId") == "P0")


def symmetric(spark: SparkSession, d: str) -> DataFrame:
    return edges.symmetrize_ppi(net.ppi_raw(spark, d))


def strong(spark: SparkSession, d: str) -> DataFrame:
    return edges.symmetrize_ppi(net.ppi_raw(spark, d), edges.SCORE_THRESHOLD)


def stored_ppi(spark: SparkSession, d: str) -> DataFrame:
    """The PPI collection as the load leaves it: each edge once."""
    return net.ppi_raw(spark, d).distinct()


def amount(spark: SparkSession, d: str) -> DataFrame:
    return twohop.amount_interactions(net.dti_rows(spark, d), net.ppi_raw(spark, d))


def amount_once(spark: SparkSession, d: str) -> DataFrame:
    """The counts, computed once for the queries that go over them many times; a drug's rows of a task stand together and pack well."""
    return written(amount(spark, d).sortWithinPartitions(F.xxhash64("drugId")))


def table_name(tag: str) -> str:
    return f"{tag}_{uuid.uuid4().hex}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# -- scans -----------------------------------------------------------------------------------


def _text_file(spark, df, sep, tag):
    path = scratch_path(spark, tag)
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


def scan_delimited(spark, d):
    path = _text_file(spark, net.ppi_text(spark, d), "\t", "ppi-text")
    return sources.read_delimited(spark, path, "\t").select(
        F.col(f"`{cleaning.RAW_A}`").alias("a"),
        F.col(f"`{cleaning.RAW_B}`").alias("b"),
        F.col(f"`{cleaning.RAW_SCORE}`").alias("confidence"),
    )


def scan_delimited_dti(spark, d):
    path = _text_file(spark, net.dti_text(spark, d), ",", "dti-text")
    return sources.read_delimited(spark, path, ",").select(
        F.col(f"`{cleaning.RAW_PROTEIN}`").alias("uniprot_id"),
        F.col(f"`{cleaning.RAW_DRUGS}`").alias("drug_ids"),
    )


def scan_json_dti(spark, d):
    path = scratch_path(spark, "dti-json")
    net.dti(spark, d).withColumn("_id", F.struct(F.lit("x").alias("oid"))).write.json(path)
    return sources.read_dti_json(spark, path)


def scan_json_ppi(spark, d):
    path = scratch_path(spark, "ppi-json")
    net.ppi_raw(spark, d).write.json(path)
    return sources.read_ppi_json(spark, path)


def edges_from_rows(spark, d):
    seeds = sources.ids_from_list(spark, net.SEEDS, "proteinAId")
    extra = sources.edges_from_rows(spark, [("P0", "P_new", 0.75)], PPI)
    return net.ppi_raw(spark, d).unionByName(extra).join(seeds, "proteinAId", "left_semi").select(
        "proteinAId", "proteinBId", "score"
    )


def _xml_file(spark, d):
    path = scratch_path(spark, "drug-xml")
    net.drug_xml(spark, d).write.text(path)
    return sources.read_drug_xml(spark, path)


def xml_drug_smiles(spark, d):
    return sources.drug_smiles(_xml_file(spark, d))


def xml_protein_sequences(spark, d):
    return sources.protein_sequences(_xml_file(spark, d))


def dedup_structures(spark, d):
    path = scratch_path(spark, "drug-xml")
    net.drug_xml(spark, d).write.text(path)
    net.drug_xml(spark, d).write.mode("append").text(path)
    drugs, proteins = scratch_path(spark, "drugs"), scratch_path(spark, "proteins")
    etl.structures_to_collections(spark, path, drugs, proteins, scratch_path(spark, "rejected"))

    def tagged(p, kind):
        return spark.read.parquet(p).toDF("id", "structure").withColumn("kind", F.lit(kind))

    return tagged(drugs, "drug").unionByName(tagged(proteins, "protein"))


# -- sinks -----------------------------------------------------------------------------------


def sink_append_edges(spark, d):
    path = scratch_path(spark, "ppi")
    append_edges(net.ppi_raw(spark, d), path)
    append_edges(net.ppi_raw(spark, d), path)
    return spark.read.schema(PPI).parquet(path)


def sink_table_insert(spark, d):
    name, path = table_name("dti"), scratch_path(spark, "dti-table")
    insert_into_table(net.dti(spark, d), name, path=path)
    insert_into_table(net.dti_rows(spark, d), name, path=path)
    return spark.table(name)


def copy_edges(spark, d):
    text = _text_file(spark, net.ppi_text(spark, d), "\t", "ppi-text")
    collection = scratch_path(spark, "ppi-collection")
    etl.ppi_text_to_collection(spark, text, collection, scratch_path(spark, "rejected"))
    name = table_name("ppi")
    etl.collection_to_table(spark, collection, name, path=scratch_path(spark, "ppi-table"))
    return spark.table(name)


def copy_edges_dti(spark, d):
    text = _text_file(spark, net.dti_text(spark, d), ",", "dti-text")
    collection = scratch_path(spark, "dti-collection")
    etl.dti_text_to_collection(spark, text, collection, scratch_path(spark, "rejected"))
    path = scratch_path(spark, "dti-json")
    spark.read.parquet(collection).write.json(path)
    name = table_name("dti")
    etl.dti_json_to_table(spark, path, name, scratch_path(spark, "rejected"), path=scratch_path(spark, "dti-table"))
    return spark.table(name)


def copy_edges_json(spark, d):
    """PPI from JSON lines to a table, a null score in one of seventeen orders: the good rows."""
    path, name = scratch_path(spark, "ppi-json"), table_name("ppi")
    net.dirty_ppi(spark, d).write.json(path)
    etl.ppi_json_to_table(spark, path, name, scratch_path(spark, "rejected"), path=scratch_path(spark, "ppi-table"))
    return spark.table(name)


def copy_edges_rejected(spark, d):
    """The same load's rejected rows with their reason."""
    path, name, rejected = scratch_path(spark, "ppi-json"), table_name("ppi"), scratch_path(spark, "rejected")
    net.dirty_ppi(spark, d).write.json(path)
    etl.ppi_json_to_table(spark, path, name, rejected, path=scratch_path(spark, "ppi-table"))
    return spark.read.parquet(rejected).select("proteinAId", "proteinBId", "reason")


def sink_csv(spark, d):
    path = scratch_path(spark, "amount-csv")
    overwrite_csv(amount(spark, d), path)
    return spark.read.schema(AMOUNT).option("header", True).csv(path)


def sink_text_lines(spark, d):
    path = scratch_path(spark, "lines")
    write_lines(net.dti(spark, d), F.concat_ws(" ", "drugId", "proteinId"), path)
    return spark.read.text(path)


# -- cleaning --------------------------------------------------------------------------------


def _raw_names(df):
    return df.toDF("a", "b", "confidence")


def clean_protein_id(spark, d):
    parsed = cleaning.parse_ppi_text(net.ppi_text(spark, d))
    return parsed.select("proteinAId", "proteinBId")


def validate_edges(spark, d):
    dti = cleaning.validate(net.dirty_dti(spark, d), ["drugId", "proteinId"])
    ppi = cleaning.validate(net.dirty_ppi(spark, d), ["proteinAId", "proteinBId"], "score")
    reasons = [
        df.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).withColumn("edges", F.lit(kind))
        for df, kind in ((dti, "dti"), (ppi, "ppi"))
    ]
    return reasons[0].unionByName(reasons[1]).fillna("valid", ["reason"])


def rename_columns(spark, d):
    return cleaning.add_suffix(
        degrees.drug_degree(net.dti_rows(spark, d)).withColumn("isDrug", F.lit(1)), "_DTI", "drugId"
    )


def drop_columns(spark, d):
    profile = feature_join(spark, d)
    return profile.drop("drugId", "proteinId", "drugId_one_hot", "proteinId_one_hot", "drugId_Tot")


def fill_zero(spark, d):
    proteins = symmetric(spark, d).select(F.col("proteinAId").alias("proteinId")).distinct()
    weak = net.ppi_raw(spark, d).filter(F.col("score") < edges.SCORE_THRESHOLD)
    weak = weak.groupBy(F.col("proteinAId").alias("proteinId")).agg(F.count(F.lit(1)).alias("weak"))
    return proteins.join(weak, "proteinId", "left").fillna(0, ["weak"])


# -- joins -----------------------------------------------------------------------------------


def two_hop_paths(spark, d):
    return twohop.two_hop_paths(net.dti(spark, d), strong(spark, d))


def attach_target_list(spark, d):
    return twohop.flag_known_targets(two_hop_paths(spark, d), net.dti_rows(spark, d))


def exclude_known_targets(spark, d):
    paths = two_hop_paths(spark, d)
    return twohop.exclude_known_targets(paths, net.dti(spark, d)).select(
        "drugId", "proteinId", "proteinBId", "score"
    )


def feature_join(spark, d):
    cells = features.interaction_cells(written(net.dti(spark, d)), written(strong(spark, d)))
    return rounded(features.feature_profile(amount(spark, d), cells), "protein_sum", "drug_sum")


def feedback_join(spark, d):
    counts = amount_once(spark, d)
    cells = features.feedback_cells(counts)
    return features.feature_profile(counts, cells)


def feedback_folds(spark, d):
    """The features of each drug in the runs of a cross-validation, without the counts of the fold left out."""
    cells = features.feedback_cells(amount_once(spark, d), folds=FOLDS, seed=SEED)
    return features.fold_profile(cells, FOLDS)


def split_semi_join(spark, d):
    counts = amount_once(spark, d)
    train, _ = splits.train_test_split(counts.select("drugId", "proteinId"), SEED)
    return splits.restrict_to_keys(counts, train)


def candidate_pairs(spark, d):
    counts = amount_once(spark, d)
    return candidates.candidate_pairs(counts, counts)


def seed_neighbourhood(spark, d):
    return neighbourhood.seed_neighbourhood(stored_ppi(spark, d), net.SEEDS)


def seed_neighbourhood_first_20(spark, d):
    return neighbourhood.seed_neighbourhood(stored_ppi(spark, d), net.SEEDS, limit=20)


def ego_network_2hop(spark, d):
    return neighbourhood.ego_network(stored_ppi(spark, d), "P0")


def ego_network_2hop_first_20(spark, d):
    return neighbourhood.ego_network(stored_ppi(spark, d), "P0", limit=20)


def ego_network_2hop_dti(spark, d):
    return neighbourhood.dti_of_network(net.dti(spark, d), ego_network_2hop(spark, d))


def ego_network_2hop_first_10_dti(spark, d):
    return neighbourhood.dti_of_network(net.dti(spark, d), ego_network_2hop_first_20(spark, d), limit=10)


def directed(spark, d):
    return sql_profile.ppis_for_analysis(net.ppi_raw(spark, d))


def sql_amount_manual(spark, d):
    return sql_profile.amount_manual(net.dti_rows(spark, d), directed(spark, d))


def sql_amount_match(spark, d):
    return sql_profile.amount_match(amount(spark, d), sql_amount_manual(spark, d))


# -- aggregates ------------------------------------------------------------------------------


def targets_per_drug(spark, d):
    lists = twohop.targets_per_drug(net.dti_rows(spark, d), list_size=256)
    return lists.withColumn("proteins", F.array_join("proteins", ","))


def pivot_dti(spark, d):
    return matrices.tile_matrix(written(net.dti(spark, d)), "drugId", "proteinId")


def pivot_ppi_flag(spark, d):
    return matrices.tile_matrix(written(strong(spark, d)), "proteinBId", "proteinAId").withColumnRenamed(
        "proteinBId", "proteinId"
    )


def pivot_ppi_score(spark, d):
    return matrices.tile_matrix(
        written(strong(spark, d)), "proteinBId", "proteinAId", "score"
    ).withColumnRenamed("proteinBId", "proteinId")


def pivot_amount(spark, d):
    return matrices.tile_matrix(amount_once(spark, d), "drugId", "proteinId", "amount_interactions")


def mask_current_target(spark, d):
    return matrices.masked_tiles(amount_once(spark, d))


def others_interactions(spark, d):
    """Each row with its drug's other counts, as text."""
    rows = matrices.others_cells(amount_once(spark, d))
    text = F.transform("cells", lambda c: F.concat(c["proteinId"], F.lit(":"), c["amount_interactions"].cast("string")))
    return rows.withColumn("cells", F.array_join(text, ","))


def network_summary(spark, d):
    return degrees.network_summary(
        net.dti_rows(spark, d), net.ppi_raw(spark, d), symmetric(spark, d), strong(spark, d)
    )


def _distributions(spark, d):
    dti, ppi = net.dti(spark, d), symmetric(spark, d)
    by_kind = {
        "ppi": degrees.ppi_degree(ppi),
        "drug": degrees.drug_degree(dti),
        "target": degrees.target_degree(dti),
        "total": degrees.degree_total(dti, ppi),
    }
    return {kind: degrees.degree_distribution(frame) for kind, frame in by_kind.items()}


def _stacked(frames):
    result = None
    for kind, frame in frames.items():
        tagged = frame.withColumn("kind", F.lit(kind))
        result = tagged if result is None else result.unionByName(tagged)
    return result


def degree_distribution(spark, d):
    return _stacked(_distributions(spark, d))


def degree_frequency(spark, d):
    frames = {k: degrees.degree_frequency(v) for k, v in _distributions(spark, d).items()}
    return _stacked(frames).withColumn("frequency", F.round("frequency", 9))


# -- ranks, order, keys ----------------------------------------------------------------------


def distinct_keys(spark, d):
    dti = net.dti_rows(spark, d)
    kinds = {"drug": dti.select(F.col("drugId").alias("id")), "protein": dti.select(F.col("proteinId").alias("id"))}
    return _stacked({kind: frame.distinct() for kind, frame in kinds.items()})


def index_entities(spark, d):
    counts = amount_once(spark, d)
    kinds = {"drug": "drugId", "protein": "proteinId"}
    return _stacked(
        {k: indexing.index_by_frequency(counts, c).withColumnRenamed(c, "id") for k, c in kinds.items()}
    )


def one_hot(spark, d):
    counts = amount_once(spark, d)
    kinds = {"drug": "drugId", "protein": "proteinId"}
    return _stacked(
        {k: features.one_hot_positions(counts, c).withColumnRenamed(c, "id") for k, c in kinds.items()}
    )


# -- features, models, evaluation ------------------------------------------------------------


def _interaction_model(spark, d):
    counts = amount_once(spark, d)
    cells = features.interaction_cells(written(net.dti(spark, d)), written(strong(spark, d)))
    return counts, features.scaled_cells(cells)


def _shown(metrics):
    return rounded(metrics, "rmse", "train_rmse", "mean_rmse")


def assemble_features(spark, d):
    """The shape of every pair's feature row, from blocks of bounded length."""
    cells = features.interaction_cells(written(net.dti(spark, d)), written(strong(spark, d)))
    rows = features.assembled_rows(amount_once(spark, d), features.feature_blocks(cells))
    return rows.withColumn("total", F.round("total", 6))


def rmse_eval(spark, d):
    marked = splits.with_split(amount_once(spark, d), SEED)
    predicted = evaluation.mean_predictor(marked, marked.filter(F.col("split") == "train"))
    return evaluation.rmse(predicted, "split").withColumn("rmse", F.round("rmse", 9))


def select_best(spark, d):
    """The best of five constant predictors on the test rows."""
    guesses = F.array(*[F.struct(F.lit(i).alias("grid_id"), F.lit(1 + i / 4).alias("prediction")) for i in range(5)])
    _, test = splits.train_test_split(amount(spark, d), SEED)
    predicted = test.select("amount_interactions", F.explode(guesses).alias("g")).select("amount_interactions", "g.*")
    return evaluation.select_best(evaluation.rmse(predicted, "grid_id")).withColumn("rmse", F.round("rmse", 9))


def als_fit_grid(spark, d):
    return als.train(als.index_ratings(amount_once(spark, d)), WHOLE_ALS_GRID, seed=SEED).metrics


def _als_ranking(spark, counts, n, grid=ALS_GRID):
    ratings = als.index_ratings(counts)
    model = als.train(ratings, grid, seed=SEED).model
    return als.recommend(model, ratings, n)


def als_recommend(spark, d):
    return _als_ranking(spark, amount_once(spark, d), 30)


def index_to_name(spark, d):
    ratings = als.index_ratings(amount_once(spark, d))
    return als.name_indexes(ratings.data.select(als.DRUG, als.PROTEIN, "amount_interactions"), ratings).select(
        "drugId", "proteinId", "amount_interactions"
    )


def als_cross_validate(spark, d):
    return als.cross_validation(als.index_ratings(amount_once(spark, d)), ALS_GRID, seed=SEED).metrics


def fm_fit_grid(spark, d):
    return _shown(fm.train(*_interaction_model(spark, d), WHOLE_FM_GRID, seed=SEED, step_size=FM_STEP).metrics)


def fm_cross_validate(spark, d):
    counts, cells = _interaction_model(spark, d)
    return _shown(fm.cross_validation(counts, cells, WHOLE_FM_GRID, folds=FOLDS, seed=SEED, step_size=FM_STEP).metrics)


def _fm_factors(spark, d, grid=FM_GRID):
    counts, cells = _interaction_model(spark, d)
    model = fm.train(counts, cells, grid, seed=SEED, step_size=FM_STEP).model
    return counts, fm.entity_factors(model, cells)


def fm_rank_all(spark, d):
    return rounded(fm.rank_all(_fm_factors(spark, d)[1], 10), "prediction")


def fm_rank_all_feedback(spark, d):
    counts = amount_once(spark, d)
    cells = features.feedback_cells(counts, splits.train_test_split(counts, SEED)[0])
    model = fm.train(counts, cells, FEEDBACK_GRID, seed=SEED, step_size=FEEDBACK_STEP).model
    return fm.rank_all(fm.entity_factors(model, cells), 10)


def fm_rank_one_drug(spark, d):
    return rounded(fm.rank_one_drug(_fm_factors(spark, d)[1], DRUG, k=10), "prediction")


def rank_specific_pairs(spark, d):
    listed = sources.ids_from_list(spark, net.SEEDS, "proteinId")
    return rounded(fm.rank_one_drug(_fm_factors(spark, d, WHOLE_FM_GRID)[1], DRUG, listed, k=10), "prediction")


def compare_models(spark, d):
    counts, cells = _interaction_model(spark, d)
    return comparison.compare_models(counts, als.index_ratings(counts), cells, [SEED], WHOLE_ALS_GRID, WHOLE_FM_GRID, FM_STEP)


def compare_rankings(spark, d):
    counts, factors = _fm_factors(spark, d, WHOLE_FM_GRID)
    return comparison.compare_rankings(_als_ranking(spark, counts, 30, WHOLE_ALS_GRID), fm.rank_all(factors, 30))


QUERIES = {
    "scan_delimited": scan_delimited,
    "scan_delimited_dti": scan_delimited_dti,
    "scan_json_dti": scan_json_dti,
    "scan_json_ppi": scan_json_ppi,
    "scan_edges_all": lambda s, d: sources.scan_edges(net.dti_rows(s, d)),
    "scan_edges_filtered": lambda s, d: sources.scan_edges(net.ppi_raw(s, d), at_seed()),
    "scan_edges_filtered_dti": lambda s, d: sources.scan_edges(net.dti(s, d), F.col("proteinId") == "P0"),
    "scan_edges_first_20": lambda s, d: sources.scan_edges(net.ppi_raw(s, d), at_seed(), 20),
    "scan_edges_first_10_dti": lambda s, d: sources.scan_edges(net.dti(s, d), F.col("proteinId") == "P0", 10),
    "find_one_edge": lambda s, d: sources.find_one(net.ppi_raw(s, d), at_seed()),
    "xml_drug_smiles": xml_drug_smiles,
    "xml_protein_sequences": xml_protein_sequences,
    "edges_from_rows": edges_from_rows,
    "sink_append_edges": sink_append_edges,
    "sink_table_insert": sink_table_insert,
    "copy_edges": copy_edges,
    "copy_edges_dti": copy_edges_dti,
    "copy_edges_json": copy_edges_json,
    "copy_edges_rejected": copy_edges_rejected,
    "sink_csv": sink_csv,
    "sink_text_lines": sink_text_lines,
    "filter_id_prefix": lambda s, d: _raw_names(cleaning.filter_id_prefix(net.ppi_text(s, d))),
    "filter_self_loops": lambda s, d: _raw_names(cleaning.filter_self_loops(net.ppi_text(s, d))),
    "clean_protein_id": clean_protein_id,
    "parse_score": lambda s, d: cleaning.parse_ppi_text(net.ppi_text(s, d)).select("score"),
    "clean_ppi_text": lambda s, d: cleaning.clean_ppi_text(net.ppi_text(s, d)),
    "split_drug_ids": lambda s, d: cleaning.split_drug_ids(net.dti_text(s, d)),
    "validate_edges": validate_edges,
    "filter_score": lambda s, d: edges.filter_score(net.ppi_raw(s, d)),
    "filter_edge_predicate": lambda s, d: net.ppi_raw(s, d).filter(at_seed() & (F.col("score") >= 0.5)),
    "filter_one_drug": lambda s, d: net.dti(s, d).filter(F.col("drugId") == DRUG),
    "swap_edge": lambda s, d: edges.swap_edge(net.ppi_raw(s, d)),
    "rename_columns": rename_columns,
    "drop_columns": drop_columns,
    "mask_current_target": mask_current_target,
    "fill_zero": fill_zero,
    "two_hop_paths": two_hop_paths,
    "attach_target_list": attach_target_list,
    "exclude_known_targets": exclude_known_targets,
    "amount_interactions": amount,
    "feature_join": feature_join,
    "feedback_join": feedback_join,
    "feedback_folds": feedback_folds,
    "split_semi_join": split_semi_join,
    "candidate_pairs": candidate_pairs,
    "seed_neighbourhood": seed_neighbourhood,
    "seed_neighbourhood_first_20": seed_neighbourhood_first_20,
    "dti_of_edges_first_10": lambda s, d: neighbourhood.dti_of_edges(net.dti(s, d), net.ppi_raw(s, d), limit=10),
    "ego_network_2hop_first_20": ego_network_2hop_first_20,
    "ego_network_2hop_first_10_dti": ego_network_2hop_first_10_dti,
    "dti_of_edges": lambda s, d: neighbourhood.dti_of_edges(net.dti(s, d), net.ppi_raw(s, d)),
    "ego_network_2hop": ego_network_2hop,
    "ego_network_2hop_dti": ego_network_2hop_dti,
    "sql_amount_manual": sql_amount_manual,
    "sql_amount_match": sql_amount_match,
    "sql_complete_profile": lambda s, d: sql_profile.complete_profile(net.dti_rows(s, d), directed(s, d)),
    "degree_total": lambda s, d: degrees.degree_total(net.dti_rows(s, d), symmetric(s, d)),
    "max_score_per_pair": lambda s, d: edges.max_score_per_pair(net.ppi_raw(s, d)),
    "targets_per_drug": targets_per_drug,
    "count_paths": lambda s, d: twohop.count_paths(two_hop_paths(s, d)),
    "pivot_dti": pivot_dti,
    "pivot_ppi_flag": pivot_ppi_flag,
    "pivot_ppi_score": pivot_ppi_score,
    "pivot_amount": pivot_amount,
    "others_interactions": others_interactions,
    "network_summary": network_summary,
    "label_histogram": lambda s, d: degrees.label_histogram(amount(s, d)),
    "ppi_degree": lambda s, d: degrees.ppi_degree(symmetric(s, d)),
    "sql_ppi_degree": lambda s, d: sql_profile.sql_ppi_degree(directed(s, d)),
    "drug_degree": lambda s, d: degrees.drug_degree(net.dti_rows(s, d)),
    "target_degree": lambda s, d: degrees.target_degree(net.dti_rows(s, d)),
    "target_distribution_raw": lambda s, d: degrees.target_distribution_raw(net.dti_rows(s, d)),
    "degree_distribution": degree_distribution,
    "degree_frequency": degree_frequency,
    "rank_per_drug": lambda s, d: ranking.rank_per_group(amount_once(s, d), "amount_interactions"),
    "topk_per_drug": lambda s, d: ranking.topk_per_group(amount_once(s, d), 10, "amount_interactions"),
    "order_result": lambda s, d: amount_once(s, d).orderBy("drugId", F.desc("amount_interactions"), "proteinId"),
    "limit_rows": lambda s, d: amount(s, d).orderBy(F.desc("amount_interactions"), "drugId", "proteinId").limit(20),
    "distinct_dti": net.dti,
    "distinct_keys": distinct_keys,
    "dedup_subset": lambda s, d: _raw_names(cleaning.dedup_ppi_text(net.ppi_text(s, d))),
    "symmetrize_ppi": symmetric,
    "dedup_structures": dedup_structures,
    "graph_edges": lambda s, d: graph.graph_edges(net.dti_rows(s, d), net.ppi_raw(s, d)),
    "graph_nodes": lambda s, d: graph.graph_nodes(net.dti_rows(s, d), net.ppi_raw(s, d)),
    "index_entities": index_entities,
    "index_all_proteins": lambda s, d: indexing.index_all_proteins(net.ppi_raw(s, d)),
    "index_to_name": index_to_name,
    "one_hot": one_hot,
    "assemble_features": assemble_features,
    "train_test_split": lambda s, d: splits.with_split(amount(s, d), SEED),
    "als_fit_grid": als_fit_grid,
    "als_recommend": als_recommend,
    "als_cross_validate": als_cross_validate,
    "fm_fit_grid": fm_fit_grid,
    "fm_cross_validate": fm_cross_validate,
    "fm_rank_all": fm_rank_all,
    "fm_rank_all_feedback": fm_rank_all_feedback,
    "fm_rank_one_drug": fm_rank_one_drug,
    "rank_specific_pairs": rank_specific_pairs,
    "rmse_eval": rmse_eval,
    "select_best": select_best,
    "compare_models": compare_models,
    "compare_rankings": compare_rankings,
}
