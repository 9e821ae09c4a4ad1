"""Column expressions for identifiers, confidence texts and FASTA sequences."""

import re

from pyspark.sql import Column, functions as F

# Fixed values of the input files: the accepted protein id prefix and the score tag.
PROTEIN_ID_PREFIXES = ("uniprotkb:",)
SCORE_TAG = "intact-miscore:"


def _prefix_pattern(prefixes) -> str:
    return "^(" + "|".join(re.escape(p) for p in prefixes) + ")"


def has_known_prefix(column: Column, prefixes=PROTEIN_ID_PREFIXES) -> Column:
    return column.rlike(_prefix_pattern(prefixes))


def strip_known_prefix(column: Column, prefixes=PROTEIN_ID_PREFIXES) -> Column:
    """The id without its source prefix; null where the prefix is not a known one."""
    pattern = _prefix_pattern(prefixes)
    return F.when(column.rlike(pattern), F.regexp_replace(column, pattern, ""))


def confidence_score(column: Column, tag: str = SCORE_TAG) -> Column:
    """The number behind the score tag, also where other ``|``-separated values follow it."""
    return F.regexp_extract(column, re.escape(tag) + r"([^|]+)", 1).try_cast("double")


def fasta_body(column: Column) -> Column:
    """The residues of a FASTA text: header line and newlines dropped, null without a header."""
    residues = F.regexp_replace(F.regexp_replace(column, r"^[^\n]*\n", ""), r"\n", "")
    return F.when(F.instr(column, "\n") > 0, residues)


def is_blank(column: Column) -> Column:
    return column.isNull() | (column == "")
