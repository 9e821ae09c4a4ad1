"""DuckDB SQL for every query that SQL can express, over the same tables."""

import re

from bipath import standins
from bipath.registry import fm_sql
from bipath.registry.settings import DRUG, FM_GRID, FM_STEP, FOLDS, SEED, WHOLE_FM_GRID

WIDTH = 25  # columns of a matrix tile
LIST_SIZE = 256
OTHERS_SIZE = 1024

VIEWS = {
    "dti_rows": "SELECT 'D' || l_suppkey AS drugId, 'P' || l_partkey AS proteinId FROM lineitem",
    "dti": "SELECT DISTINCT drugId, proteinId FROM dti_rows",
    "interactions": """
        SELECT a.l_orderkey AS okey, 'P' || a.l_partkey AS proteinAId, 'P' || b.l_partkey AS proteinBId,
               least(a.l_quantity, b.l_quantity) / 50 AS score
        FROM lineitem a JOIN lineitem b
          ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
         AND b.l_linenumber = a.l_linenumber + 1""",
    "ppi_raw": "SELECT proteinAId, proteinBId, score FROM interactions",
    "stored_ppi": "SELECT DISTINCT proteinAId, proteinBId, score FROM ppi_raw",
    "ppi": """
        SELECT proteinAId, proteinBId, max(score) AS score FROM (
          SELECT proteinAId, proteinBId, score FROM ppi_raw
          UNION ALL SELECT proteinBId, proteinAId, score FROM ppi_raw) u
        GROUP BY proteinAId, proteinBId""",
    "strong": "SELECT * FROM ppi WHERE score >= 0.5",
    "ppi_text": """
        SELECT a, CASE WHEN okey % 11 = 0 THEN a ELSE b END AS b, confidence FROM (
          SELECT okey,
                 CASE WHEN okey % 5 = 0 THEN 'chebi:' ELSE 'uniprotkb:' END || proteinAId AS a,
                 CASE WHEN okey % 7 = 0 THEN 'chebi:' ELSE 'uniprotkb:' END || proteinBId AS b,
                 'intact-miscore:' || score || CASE WHEN okey % 3 = 0 THEN '|other:1' ELSE '' END
                   AS confidence
          FROM interactions) t""",
    "clean_ppi": """
        SELECT a[11:] AS proteinAId, b[11:] AS proteinBId,
               split_part(split_part(confidence, 'intact-miscore:', 2), '|', 1)::DOUBLE AS score
        FROM (SELECT DISTINCT a, b, confidence FROM ppi_text
              WHERE a LIKE 'uniprotkb:%' AND b LIKE 'uniprotkb:%' AND a <> b) t""",
    "split_dti": """
        SELECT 'D' || l_suppkey AS drugId, 'P' || l_partkey AS proteinId FROM lineitem
        UNION SELECT 'D' || l_linenumber, 'P' || l_partkey FROM lineitem""",
    "paths": """
        SELECT d.drugId, d.proteinId, p.proteinBId, p.score
        FROM dti d JOIN strong p ON d.proteinId = p.proteinAId""",
    "amount": """
        SELECT t.drugId, t.proteinBId AS proteinId, count(*) AS amount_interactions
        FROM paths t
        WHERE NOT EXISTS (SELECT 1 FROM dti k WHERE k.drugId = t.drugId AND k.proteinId = t.proteinBId)
        GROUP BY t.drugId, t.proteinBId""",
    "one_way": "SELECT proteinAId, proteinBId FROM ppi_raw GROUP BY ALL HAVING max(score) >= 0.5",
    "drug_hits": "SELECT drugId, proteinId, count(*) AS hits FROM dti_rows GROUP BY ALL",
    "derived": """
        SELECT h.drugId, e.proteinBId, sum(h.hits)::BIGINT AS paths
        FROM one_way e, drug_hits h WHERE h.proteinId = e.proteinAId GROUP BY ALL""",
    "out_degree": "SELECT proteinAId AS proteinId, count(*) AS protein_degree FROM one_way GROUP BY ALL",
    "hits_of_drug": "SELECT drugId, sum(hits)::BIGINT AS drug_targets FROM drug_hits GROUP BY ALL",
    "hits_of_protein": "SELECT proteinId, sum(hits)::BIGINT AS protein_drugs FROM drug_hits GROUP BY ALL",
    "ppi_deg": """
        SELECT proteinId, count(*) AS degree FROM (
          SELECT proteinAId AS proteinId FROM ppi UNION ALL SELECT proteinBId FROM ppi) e
        GROUP BY proteinId""",
    "drug_deg": "SELECT drugId, count(*) AS degree FROM dti GROUP BY drugId",
    "target_deg": "SELECT proteinId, count(*) AS degree FROM dti GROUP BY proteinId",
    "total_deg": """
        SELECT t.proteinId, t.degree + coalesce(p.degree, 0) AS degree
        FROM target_deg t LEFT JOIN ppi_deg p ON p.proteinId = t.proteinId""",
    "distribution": """
        SELECT 'ppi' AS kind, degree, count(*) AS n FROM ppi_deg GROUP BY degree
        UNION ALL SELECT 'drug', degree, count(*) FROM drug_deg GROUP BY degree
        UNION ALL SELECT 'target', degree, count(*) FROM target_deg GROUP BY degree
        UNION ALL SELECT 'total', degree, count(*) FROM total_deg GROUP BY degree""",
    "others_rows": """
        SELECT *, count(*) OVER (PARTITION BY drugId) AS n, (sum(amount_interactions) OVER (PARTITION BY drugId))::BIGINT AS total
        FROM amount""",
    "amount_idx": """
        SELECT proteinId, row_number() OVER (ORDER BY proteinId) - 1 AS idx
        FROM (SELECT DISTINCT proteinId FROM amount) t""",
    "amount_cells": "SELECT a.*, i.idx FROM amount a JOIN amount_idx i ON i.proteinId = a.proteinId",
    "split_rows": """
        SELECT *, CASE WHEN ('0x' || substr(md5(drugId || '|' || proteinId || '|42'), 1, 8))::BIGINT
                            % 100 < 80 THEN 'train' ELSE 'test' END AS split
        FROM amount""",
    "drug_block": "SELECT drugId, count(*) AS drug_cells, count(*)::DOUBLE AS drug_sum FROM dti GROUP BY drugId",
    "protein_block": """
        SELECT proteinBId AS proteinId, count(*) AS protein_cells, round(sum(score), 6) AS protein_sum
        FROM strong GROUP BY proteinBId""",
    "ego_first": """
        SELECT * FROM stored_ppi WHERE score >= 0.5 AND (proteinAId = 'P0' OR proteinBId = 'P0')
        ORDER BY score DESC, proteinAId, proteinBId LIMIT 20""",
    "ego_second": """
        SELECT proteinAId, proteinBId, score FROM (
          SELECT e.*, row_number() OVER (PARTITION BY f.proteinAId, f.proteinBId, f.score
                        ORDER BY e.score DESC, e.proteinAId, e.proteinBId) AS nth
          FROM ego_first f JOIN stored_ppi e
            ON e.proteinAId IN (f.proteinAId, f.proteinBId) OR e.proteinBId IN (f.proteinAId, f.proteinBId)
          WHERE e.score >= 0.5) t
        WHERE nth <= 20""",
    "ego": "SELECT * FROM ego_first UNION SELECT * FROM ego_second",
    "at_p0": "SELECT * FROM stored_ppi WHERE score >= 0.5 AND 'P0' IN (proteinAId, proteinBId)",
    "whole_ego": """
        SELECT DISTINCT e.* FROM stored_ppi e WHERE e.score >= 0.5 AND EXISTS (
          SELECT 1 FROM at_p0 f WHERE e.proteinAId IN (f.proteinAId, f.proteinBId) OR e.proteinBId IN (f.proteinAId, f.proteinBId))""",
    "nth_dti": """
        SELECT drugId, proteinId FROM (
          SELECT *, row_number() OVER (PARTITION BY proteinId ORDER BY drugId) AS nth FROM dti) t
        WHERE nth <= 10""",
    "drug_smiles": "SELECT DISTINCT 'DB' || p_partkey AS drugId, p_type AS smiles FROM part WHERE p_size > 10",
    "protein_fasta": "SELECT DISTINCT 'P' || p_partkey AS proteinId, p_brand || p_name AS fasta FROM part",
}


def with_views(body: str) -> str:
    """``body`` behind a WITH clause of every view it uses, directly or through others."""
    used: list[str] = []

    def visit(sql):
        words = set(re.findall(r"\w+", sql))
        for name, text in VIEWS.items():
            if name in words and name not in used and text is not sql:
                visit(text)
                used.append(name)

    visit(body)
    if not used:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used) + "\n" + body


def _tiles(cells: str, row: str, column: str, value: str, alias: str | None = None) -> str:
    slots = ", ".join(
        f"max(CASE WHEN idx % {WIDTH} = {i} THEN {value} ELSE 0 END) AS c{i}" for i in range(WIDTH)
    )
    return f"""
        SELECT c.{row} AS {alias or row}, (i.idx // {WIDTH})::INTEGER AS tile, {slots}
        FROM {cells} c JOIN (
          SELECT {column} AS k, row_number() OVER (ORDER BY {column}) - 1 AS idx
          FROM (SELECT DISTINCT {column} FROM {cells}) t) i ON i.k = c.{column}
        GROUP BY c.{row}, i.idx // {WIDTH}"""


def _masked() -> str:
    slots = ", ".join(
        f"CASE WHEN o.idx % {WIDTH} = {i} THEN 0 ELSE max(CASE WHEN c.idx % {WIDTH} = {i} "
        f"THEN c.amount_interactions ELSE 0 END) END AS c{i}"
        for i in range(WIDTH)
    )
    return f"""
        SELECT o.drugId, o.proteinId, (o.idx // {WIDTH})::INTEGER AS tile, {slots}
        FROM amount_cells o JOIN amount_cells c
          ON c.drugId = o.drugId AND c.idx // {WIDTH} = o.idx // {WIDTH}
        GROUP BY o.drugId, o.proteinId, o.idx"""


def _metric(name: str, body: str) -> str:
    return f"SELECT '{name}' AS metric, (SELECT {body}) AS value"


FEATURES = """
    SELECT a.drugId, a.proteinId, p.protein_cells, p.protein_sum, d.drug_cells, d.drug_sum
    FROM amount a JOIN protein_block p ON p.proteinId = a.proteinId
    JOIN drug_block d ON d.drugId = a.drugId"""

BODIES = {
    "scan_delimited": "SELECT a, b, confidence FROM ppi_text",
    "scan_delimited_dti": """
        SELECT 'P' || l_partkey AS uniprot_id,
               'D' || l_suppkey || '; D' || l_linenumber || '; D' || l_suppkey AS drug_ids
        FROM lineitem""",
    "scan_json_dti": "SELECT drugId, proteinId FROM dti",
    "scan_json_ppi": "SELECT * FROM ppi_raw",
    "scan_edges_all": "SELECT * FROM dti_rows",
    "scan_edges_filtered": "SELECT * FROM ppi_raw WHERE proteinAId = 'P0' OR proteinBId = 'P0'",
    "scan_edges_filtered_dti": "SELECT drugId, proteinId FROM dti WHERE proteinId = 'P0'",
    "scan_edges_first_20": """
        SELECT * FROM ppi_raw WHERE proteinAId = 'P0' OR proteinBId = 'P0'
        ORDER BY score DESC, proteinAId, proteinBId LIMIT 20""",
    "scan_edges_first_10_dti": """
        SELECT drugId, proteinId FROM dti WHERE proteinId = 'P0' ORDER BY drugId, proteinId LIMIT 10""",
    "find_one_edge": """
        SELECT * FROM ppi_raw WHERE proteinAId = 'P0' OR proteinBId = 'P0'
        ORDER BY score DESC, proteinAId, proteinBId LIMIT 1""",
    "xml_drug_smiles": "SELECT * FROM drug_smiles",
    "xml_protein_sequences": "SELECT * FROM protein_fasta",
    "edges_from_rows": """
        SELECT * FROM ppi_raw WHERE proteinAId IN ('P0', 'P1', 'P2', 'P3')
        UNION ALL SELECT 'P0', 'P_new', 0.75""",
    "sink_append_edges": "SELECT * FROM ppi_raw UNION ALL SELECT * FROM ppi_raw",
    "sink_table_insert": "SELECT drugId, proteinId FROM dti UNION ALL SELECT drugId, proteinId FROM dti_rows",
    "copy_edges": "SELECT * FROM clean_ppi",
    "copy_edges_dti": "SELECT * FROM split_dti",
    "sink_csv": "SELECT * FROM amount",
    "sink_text_lines": "SELECT drugId || ' ' || proteinId AS value FROM dti",
    "filter_id_prefix": "SELECT a, b, confidence FROM ppi_text WHERE a LIKE 'uniprotkb:%' AND b LIKE 'uniprotkb:%'",
    "filter_self_loops": "SELECT a, b, confidence FROM ppi_text WHERE a <> b",
    "clean_protein_id": """
        SELECT CASE WHEN a LIKE 'uniprotkb:%' THEN a[11:] END AS proteinAId,
               CASE WHEN b LIKE 'uniprotkb:%' THEN b[11:] END AS proteinBId
        FROM ppi_text""",
    "parse_score": "SELECT score FROM interactions",
    "clean_ppi_text": "SELECT * FROM clean_ppi",
    "split_drug_ids": "SELECT * FROM split_dti",
    "validate_edges": """
        SELECT 'dti' AS edges, CASE WHEN l_orderkey % 13 = 0 THEN 'drugId is blank'
               ELSE 'valid' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL
        UNION ALL
        SELECT 'ppi', CASE WHEN okey % 17 = 0 THEN 'score is absent' ELSE 'valid' END, count(*)
        FROM interactions GROUP BY ALL""",
    "filter_score": "SELECT * FROM ppi_raw WHERE score >= 0.5",
    "filter_edge_predicate": """
        SELECT * FROM ppi_raw WHERE (proteinAId = 'P0' OR proteinBId = 'P0') AND score >= 0.5""",
    "filter_one_drug": "SELECT drugId, proteinId FROM dti WHERE drugId = 'D1'",
    "swap_edge": "SELECT proteinBId AS proteinAId, proteinAId AS proteinBId, score FROM ppi_raw",
    "rename_columns": """SELECT drugId, degree AS "degree_DTI", 1 AS "isDrug_DTI" FROM drug_deg""",
    "drop_columns": f"SELECT protein_cells, protein_sum, drug_cells, drug_sum FROM ({FEATURES}) f",
    "mask_current_target": _masked(),
    "fill_zero": """
        SELECT p.proteinId, count(w.proteinAId) AS weak
        FROM (SELECT DISTINCT proteinAId AS proteinId FROM ppi) p
        LEFT JOIN ppi_raw w ON w.proteinAId = p.proteinId AND w.score < 0.5 GROUP BY p.proteinId""",
    "two_hop_paths": "SELECT * FROM paths",
    "attach_target_list": """
        SELECT t.drugId, t.proteinId, t.proteinBId, g.degree AS n_targets,
               EXISTS (SELECT 1 FROM dti k WHERE k.drugId = t.drugId AND k.proteinId = t.proteinBId)
                 AS interactor_drug_target
        FROM paths t JOIN drug_deg g ON g.drugId = t.drugId""",
    "exclude_known_targets": """
        SELECT * FROM paths t
        WHERE NOT EXISTS (SELECT 1 FROM dti k WHERE k.drugId = t.drugId AND k.proteinId = t.proteinBId)""",
    "amount_interactions": "SELECT * FROM amount",
    "feature_join": FEATURES,
    "feedback_join": """
        SELECT drugId, proteinId, 1 AS protein_cells, 1.0::DOUBLE AS protein_sum,
               count(*) OVER (PARTITION BY drugId) AS drug_cells,
               (1 + sum(amount_interactions) OVER (PARTITION BY drugId) - amount_interactions)::DOUBLE
                 AS drug_sum
        FROM amount""",
    "feedback_folds": """
        SELECT drugId, held::INTEGER AS held, 1 + count(*) FILTER (fold <> held) AS drug_cells,
               (1 + coalesce(sum(amount_interactions) FILTER (fold <> held), 0))::DOUBLE AS drug_sum
        FROM (SELECT *, ('0x' || substr(md5(drugId || '|' || proteinId || '|42'), 1, 8))::BIGINT % 5 AS fold FROM amount) a,
             (SELECT unnest(range(5)) AS held) h
        GROUP BY drugId, held""",
    "split_semi_join": "SELECT drugId, proteinId, amount_interactions FROM split_rows WHERE split = 'train'",
    "candidate_pairs": """
        SELECT d.drugId, p.proteinId FROM (SELECT DISTINCT drugId FROM amount) d,
               (SELECT DISTINCT proteinId FROM amount) p""",
    "seed_neighbourhood": """
        SELECT * FROM stored_ppi WHERE proteinAId IN ('P0', 'P1', 'P2', 'P3')
        UNION SELECT * FROM stored_ppi
        WHERE proteinBId IN ('P0', 'P1', 'P2', 'P3') AND proteinBId IN (SELECT proteinAId FROM stored_ppi)""",
    "dti_of_edges": "SELECT * FROM dti WHERE proteinId IN (SELECT proteinAId FROM ppi_raw)",
    "ego_network_2hop": "SELECT * FROM whole_ego",
    "ego_network_2hop_dti": """
        SELECT * FROM dti
        WHERE proteinId IN (SELECT proteinAId FROM whole_ego UNION SELECT proteinBId FROM whole_ego)""",
    "seed_neighbourhood_first_20": """
        SELECT proteinAId, proteinBId, score FROM (
          SELECT *, row_number() OVER (PARTITION BY proteinAId ORDER BY score DESC, proteinBId) AS nth
          FROM stored_ppi WHERE proteinAId IN ('P0', 'P1', 'P2', 'P3')) o WHERE nth <= 20
        UNION
        SELECT proteinAId, proteinBId, score FROM (
          SELECT *, row_number() OVER (PARTITION BY proteinBId ORDER BY score DESC, proteinAId) AS nth
          FROM stored_ppi WHERE proteinBId IN ('P0', 'P1', 'P2', 'P3')
            AND proteinBId IN (SELECT proteinAId FROM stored_ppi)) i WHERE nth <= 20""",
    "dti_of_edges_first_10": "SELECT * FROM nth_dti WHERE proteinId IN (SELECT proteinAId FROM ppi_raw)",
    "ego_network_2hop_first_20": "SELECT * FROM ego",
    "ego_network_2hop_first_10_dti": """
        SELECT * FROM nth_dti
        WHERE proteinId IN (SELECT proteinAId FROM ego UNION SELECT proteinBId FROM ego)""",
    "copy_edges_json": "SELECT proteinAId, proteinBId, score FROM interactions WHERE okey % 17 <> 0",
    "copy_edges_rejected": """
        SELECT proteinAId, proteinBId, 'score is absent' AS reason FROM interactions WHERE okey % 17 = 0""",
    "sql_amount_manual": "SELECT * FROM derived",
    "sql_amount_match": """
        SELECT count(*) AS matches FROM (
          SELECT drugId, proteinId, amount_interactions FROM amount
          INTERSECT SELECT drugId, proteinBId, paths FROM derived) both_ways""",
    "sql_complete_profile": """
        SELECT derived.*, drug_targets, protein_degree, ifnull(protein_drugs, 0) AS protein_drugs
        FROM derived NATURAL JOIN hits_of_drug
        JOIN out_degree ON out_degree.proteinId = derived.proteinBId
        LEFT JOIN hits_of_protein ON hits_of_protein.proteinId = derived.proteinBId""",
    "degree_total": "SELECT * FROM total_deg",
    "max_score_per_pair": "SELECT proteinAId, proteinBId, max(score) AS score FROM ppi_raw GROUP BY ALL",
    "targets_per_drug": f"""
        SELECT drugId, piece::INTEGER AS piece, pieces::INTEGER AS pieces,
               string_agg(proteinId, ',' ORDER BY proteinId) AS proteins
        FROM (SELECT d.drugId, d.proteinId, ceil(g.degree / {LIST_SIZE}) AS pieces,
                     ('0x' || substr(md5(d.proteinId || '|0'), 1, 8))::BIGINT
                       % ceil(g.degree / {LIST_SIZE})::BIGINT AS piece
              FROM dti d JOIN drug_deg g ON g.drugId = d.drugId) t
        GROUP BY drugId, piece, pieces""",
    "count_paths": "SELECT drugId, proteinBId, count(*) AS amount_interactions FROM paths GROUP BY ALL",
    "pivot_dti": _tiles("dti", "drugId", "proteinId", "1"),
    "pivot_ppi_flag": _tiles("strong", "proteinBId", "proteinAId", "1", "proteinId"),
    "pivot_ppi_score": _tiles("strong", "proteinBId", "proteinAId", "score", "proteinId"),
    "pivot_amount": _tiles("amount", "drugId", "proteinId", "amount_interactions"),
    "others_interactions": f"""
        SELECT t.drugId, t.proteinId, t.n - 1 AS others, t.total - t.amount_interactions AS others_sum, t.amount_interactions,
               l.piece::INTEGER AS piece, l.pieces::INTEGER AS pieces,
               array_to_string(list_transform(list_filter(l.cells, lambda c: c.proteinId <> t.proteinId),
                                              lambda c: c.proteinId || ':' || c.n), ',') AS cells
        FROM others_rows t JOIN (
          SELECT drugId, piece, pieces, list({{'proteinId': proteinId, 'n': amount_interactions}} ORDER BY proteinId) AS cells
          FROM (SELECT *, ceil(n / {OTHERS_SIZE})::BIGINT AS pieces,
                       ('0x' || substr(md5(proteinId || '|0'), 1, 8))::BIGINT % ceil(n / {OTHERS_SIZE})::BIGINT AS piece
                FROM others_rows) p
          GROUP BY drugId, piece, pieces) l ON l.drugId = t.drugId""",
    "network_summary": "\nUNION ALL ".join(
        [
            _metric("dti_rows", "count(*) FROM dti_rows"),
            _metric("dti", "count(*) FROM dti"),
            _metric("drugs", "count(DISTINCT drugId) FROM dti"),
            _metric("targets", "count(DISTINCT proteinId) FROM dti"),
            _metric("ppi_rows", "count(*) FROM ppi_raw"),
            _metric("interactors_a", "count(DISTINCT proteinAId) FROM ppi_raw"),
            _metric("ppi", "count(*) FROM ppi"),
            _metric("proteins", "count(DISTINCT proteinAId) FROM ppi"),
            _metric("ppi_matrix_width", "count(DISTINCT proteinAId) FROM strong"),
        ]
    ),
    "label_histogram": "SELECT amount_interactions, count(*) AS n FROM amount GROUP BY ALL",
    "ppi_degree": "SELECT proteinId, degree, degree // 2 AS neighbours FROM ppi_deg",
    "sql_ppi_degree": "SELECT * FROM out_degree",
    "drug_degree": "SELECT * FROM drug_deg",
    "target_degree": "SELECT * FROM target_deg",
    "target_distribution_raw": "SELECT proteinId, count(*) AS amount FROM dti_rows GROUP BY proteinId",
    "degree_distribution": "SELECT degree, n, kind FROM distribution",
    "degree_frequency": """
        SELECT degree, n, round(n / sum(n) OVER (PARTITION BY kind), 9) AS frequency, kind
        FROM distribution""",
    "rank_per_drug": """
        SELECT *, rank() OVER (PARTITION BY drugId ORDER BY amount_interactions DESC)::INTEGER AS rank
        FROM amount""",
    "topk_per_drug": """
        SELECT * FROM (
          SELECT *, rank() OVER (PARTITION BY drugId ORDER BY amount_interactions DESC)::INTEGER AS rank
          FROM amount) t
        WHERE rank <= 10""",
    "order_result": "SELECT * FROM amount ORDER BY drugId, amount_interactions DESC, proteinId",
    "limit_rows": "SELECT * FROM amount ORDER BY amount_interactions DESC, drugId, proteinId LIMIT 20",
    "distinct_dti": "SELECT drugId, proteinId FROM dti",
    "distinct_keys": """
        SELECT DISTINCT drugId AS id, 'drug' AS kind FROM dti_rows
        UNION ALL SELECT DISTINCT proteinId, 'protein' FROM dti_rows""",
    "dedup_subset": "SELECT DISTINCT a, b, confidence FROM ppi_text",
    "symmetrize_ppi": "SELECT * FROM ppi",
    "dedup_structures": """
        SELECT drugId AS id, smiles AS structure, 'drug' AS kind FROM drug_smiles
        UNION ALL SELECT proteinId, fasta, 'protein' FROM protein_fasta""",
    "graph_edges": """
        SELECT DISTINCT least(drugId, proteinId) AS src, greatest(drugId, proteinId) AS dst FROM dti
        UNION SELECT least(proteinAId, proteinBId), greatest(proteinAId, proteinBId) FROM ppi_raw""",
    "graph_nodes": """
        SELECT id, CASE WHEN max(p) = 1 THEN 'protein' ELSE 'drug' END AS kind FROM (
          SELECT drugId AS id, 0 AS p FROM dti UNION ALL SELECT proteinId, 1 FROM dti
          UNION ALL SELECT proteinAId, 1 FROM ppi_raw UNION ALL SELECT proteinBId, 1 FROM ppi_raw) e
        GROUP BY id""",
    "index_entities": """
        SELECT id, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, id) - 1 AS idx, kind FROM (
          SELECT drugId AS id, count(*) AS n, 'drug' AS kind FROM amount GROUP BY drugId
          UNION ALL SELECT proteinId, count(*), 'protein' FROM amount GROUP BY proteinId) t""",
    "index_all_proteins": """
        SELECT proteinId, row_number() OVER (ORDER BY proteinId) AS "idNum" FROM (
          SELECT proteinAId AS proteinId FROM ppi_raw UNION SELECT proteinBId FROM ppi_raw) t""",
    "index_to_name": "SELECT * FROM amount",
    "one_hot": """
        SELECT id, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS idx, kind FROM (
          SELECT DISTINCT drugId AS id, 'drug' AS kind FROM amount
          UNION ALL SELECT DISTINCT proteinId, 'protein' FROM amount) t""",
    "assemble_features": f"""
        SELECT f.drugId, f.proteinId, a.amount_interactions,
               ((SELECT count(DISTINCT proteinAId) FROM strong)
                 + (SELECT count(DISTINCT proteinId) FROM dti))::INTEGER AS width,
               (protein_cells + drug_cells)::INTEGER AS cells, round(protein_sum + drug_sum, 6) AS total
        FROM ({FEATURES}) f JOIN amount a ON a.drugId = f.drugId AND a.proteinId = f.proteinId""",
    "train_test_split": "SELECT * FROM split_rows",
    "rmse_eval": """
        SELECT split, count(*) AS n,
               round(sqrt(avg(power((SELECT avg(amount_interactions) FROM split_rows WHERE split = 'train')
                                    - amount_interactions, 2))), 9) AS rmse
        FROM split_rows GROUP BY split""",
    "select_best": """
        SELECT grid_id, count(*) AS n, round(sqrt(avg(power(1 + grid_id / 4 - amount_interactions, 2))), 9) AS rmse
        FROM split_rows, (SELECT unnest(range(5))::INTEGER AS grid_id) g
        WHERE split = 'test' GROUP BY grid_id ORDER BY rmse, grid_id LIMIT 1""",
}

ORACLE = {
    **{name: with_views(body) for name, body in BODIES.items()},
    **fm_sql.oracles(FM_GRID, WHOLE_FM_GRID, SEED, FM_STEP, FOLDS, DRUG, standins.SEEDS, with_views),
}
