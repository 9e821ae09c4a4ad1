"""Delimited text with a header line."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_RAW = "_raw_line"


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", rejected: bool = False) -> DataFrame:
    """All columns of a header file as strings.

    Lines with fewer fields than the header are kept, padded with nulls; lines with more fields
    are dropped, or returned as raw text instead of the good ones with ``rejected=True``.
    """
    if not path:
        raise ValueError("the file name is empty")
    names = spark.read.option("header", True).option("sep", sep).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names + [_RAW]])
    lines = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)  # with fewer columns parsed, surplus fields go unnoticed
        .option("columnNameOfCorruptRecord", _RAW)
        .csv(path)
    )
    # Only malformed lines carry their raw text; separators inside quotes are no field ends.
    unquoted = F.regexp_replace(F.col(_RAW), '"[^"]*"', "")
    surplus = F.size(F.split(unquoted, "\\Q" + sep + "\\E")) > len(names)
    too_long = F.col(_RAW).isNotNull() & surplus
    if rejected:
        # Spark reads the raw text only together with a parsed column.
        return lines.filter(too_long).select(F.coalesce(F.col(_RAW), F.col(f"`{names[0]}`")).alias("line"))
    return lines.filter(~too_long).drop(_RAW)
