from bipath.sources.delimited import read_delimited
from bipath.sources.edges import edges_from_rows, ids_from_list, find_one, scan_edges
from bipath.sources.json_edges import parse_edges, read_dti_json, read_ppi_json
from bipath.sources.splitting import split_elements
from bipath.sources.structures import (
    drug_smiles,
    drugs_of,
    parse_drug_xml,
    protein_sequences,
    read_drug_xml,
    rejected_elements,
)

__all__ = [
    "drug_smiles",
    "drugs_of",
    "edges_from_rows",
    "find_one",
    "ids_from_list",
    "parse_drug_xml",
    "parse_edges",
    "protein_sequences",
    "read_delimited",
    "read_dti_json",
    "read_drug_xml",
    "read_ppi_json",
    "rejected_elements",
    "scan_edges",
    "split_elements",
]
