"""Explicit schemas of the inputs, so that no scan has to infer one."""

from pyspark.sql import types as T

DTI = T.StructType(
    [T.StructField("drugId", T.StringType()), T.StructField("proteinId", T.StringType())]
)

PPI = T.StructType(
    [
        T.StructField("proteinAId", T.StringType()),
        T.StructField("proteinBId", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

AMOUNT = T.StructType(
    [
        T.StructField("drugId", T.StringType()),
        T.StructField("proteinId", T.StringType()),
        T.StructField("amount_interactions", T.LongType()),
    ]
)

_PROPERTIES = T.StructType(
    [
        T.StructField(
            "property",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kind", T.StringType()),
                        T.StructField("value", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

_POLYPEPTIDE = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField(
            "amino-acid-sequence",
            T.StructType(
                [
                    T.StructField("_VALUE", T.StringType()),
                    T.StructField("_format", T.StringType()),
                ]
            ),
        ),
    ]
)

DRUG_XML = T.StructType(
    [
        T.StructField(
            "drugbank-id",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("_VALUE", T.StringType()),
                        T.StructField("_primary", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("calculated-properties", _PROPERTIES),
        T.StructField("experimental-properties", _PROPERTIES),
        T.StructField(
            "targets",
            T.StructType(
                [
                    T.StructField(
                        "target",
                        T.ArrayType(
                            T.StructType(
                                [T.StructField("polypeptide", T.ArrayType(_POLYPEPTIDE))]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)
