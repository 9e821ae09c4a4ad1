"""Training-corpus pipeline: language, near copies, repeated passages, benchmark leaks, and the mix.

Each stage takes the documents that the one before kept, as a table of its own, and all but the last return
the columns of ``documents``. Other columns may be there as well; they pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bipath.llm.decontamination import contaminated
from bipath.llm.jaccard_join import jaccard_components
from bipath.llm.language_id import UNKNOWN, identify_language, learn
from bipath.llm.mixing import mixed_documents
from bipath.llm.queries import ship, table
from bipath.llm.substring_dedup import substring_dedup
from bipath.runtime import written

LEAST_PHRASE = 1.5  # mean symbols of a phrase; below, a text is in none of the languages
NEAR_PERCENT, NEAR_SHINGLE = 80, 5
PASSAGE_WORDS = 50


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that match no learned language beyond single letters."""
    ship(spark)
    models = learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    # Every column crosses to Python and back once, under a name that the result's own can't clash with.
    inside = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    found = identify_language(docs.toDF(*inside.values()), models, inside["text"])
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("phrase_length") >= LEAST_PHRASE))
    return kept.select(*inside.values()).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies one row: that of the least id, those without an id last.

    Rows are compared by a key of id and text, so neither a repeated nor a missing id hides one; of rows alike in both one stays.
    Texts without words are near nothing; of such rows each id stays once, and all without an id.
    """
    ship(spark)
    key, own = unused(docs, "key", "own_id")
    lone = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text").isNull(), "text")
    keyed = docs.filter(~lone).withColumn(key, named)
    found = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), NEAR_PERCENT, NEAR_SHINGLE).distinct()
    blank = F.col("n_shingles") == 0
    ids = keyed.select(key, F.col("doc_id").alias(own)).distinct()
    kept = found.select(F.col("doc_id").alias(key), "n_shingles", "component_id").join(ids, key).groupBy(
        F.when(~blank, F.col("component_id")).alias("component"), F.when(blank, F.col(own)).alias("id")
    ).agg(F.min_by(key, F.struct(F.col(own).isNull(), own, key)).alias(key))
    first = keyed.join(kept.select(key), key, "left_semi").dropDuplicates([key])
    return first.select(docs.columns).unionByName(docs.filter(lone))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of PASSAGE_WORDS words or more out of all documents but the first that holds them.

    Texts that lose nothing stay as they are; the others become their kept words, joined by spaces, with n_chars
    counted anew. A document that loses all its words goes.
    """
    ship(spark)
    key, own, found_key, left = unused(docs, "key", "own_id", "found_key", "left_text")
    found = substring_dedup(docs, window=PASSAGE_WORDS, gram=PASSAGE_WORDS // 3)
    cut = found.filter("n_removed > 0").select(
        F.col("doc_id").alias(own), F.col("text_key").alias(found_key), F.col("kept").alias(left)
    ).dropDuplicates([own, found_key])
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (F.col(key) == F.col(found_key)) & F.col(own).eqNullSafe(F.col("doc_id"))
    changed = {"text": F.coalesce(left, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(left).isNotNull(), F.length(left)).otherwise(F.col("n_chars"))
    joined = keyed.join(cut, same, "left").filter(F.col(left).isNull() | (F.col(left) != ""))
    return joined.withColumns(changed).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover half the words of a benchmark item."""
    (key,) = unused(docs, "key")
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    leaks = contaminated(docs.select(text_key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = leaks.select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, text_key).join(leaks, key, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, and its source's target."""
    ship(spark)
    return mixed_documents(docs)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("mixing", mix),
]

# Models and pseudorandom draws: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
