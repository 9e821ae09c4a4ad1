"""Edge lists as JSON: one array in a file, one object or array per line, or any mix of these.

A file is cut at its objects wherever they stand, so a pretty-printed array is read by many tasks as well. Fields outside
the schema, such as stored document ids, are ignored. What gives no edge, be it a broken object or
something else between objects, is rejected with a reason and never becomes a row of nulls.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bipath import schemas
from bipath.sources.splitting import JSON_OBJECTS, split_elements

_CORRUPT = "_malformed"


def parse_edges(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The fields of ``schema``, plus element (its text) and reason, which is null where the object could be read.

    Numbers may be written as texts. A field that is absent is null.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = split_elements(spark, path, JSON_OBJECTS).select("element", F.from_json("element", texts, options).alias("row"))
    broken = F.col("row").isNull() | F.col(f"row.{_CORRUPT}").isNotNull()
    reason = F.when(broken, "not well formed")
    for f in schema:
        if f.dataType != T.StringType():
            read = F.col(f"row.{f.name}")
            reason = reason.when(read.isNotNull() & read.try_cast(f.dataType).isNull(), f"{f.name} is no {f.dataType.simpleString()}")
    fields = [F.col(f"row.{f.name}").try_cast(f.dataType).alias(f.name) for f in schema]
    return parsed.select(*fields, "element", reason.alias("reason"))


def _read(spark, path, schema, rejected):
    parsed = parse_edges(spark, path, schema)
    if rejected:
        return parsed.filter(F.col("reason").isNotNull()).select("element", "reason")
    return parsed.filter(F.col("reason").isNull()).select(schema.names)


def read_dti_json(spark: SparkSession, path: str, one_document: bool = False, rejected: bool = False) -> DataFrame:
    """(drugId, proteinId) of every object; with ``rejected`` the (element, reason) of what gives none.

    ``one_document`` changes nothing, as an array over the whole file is read like any other.
    """
    return _read(spark, path, schemas.DTI, rejected)


def read_ppi_json(spark: SparkSession, path: str, one_document: bool = False, rejected: bool = False) -> DataFrame:
    """(proteinAId, proteinBId, score); otherwise as :func:`read_dti_json`."""
    return _read(spark, path, schemas.PPI, rejected)
