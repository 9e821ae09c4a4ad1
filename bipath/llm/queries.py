"""The registered query of each operator, over its whole tables, and the SQL where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import bipath
from bipath.llm import (
    decontamination,
    jaccard_join,
    language_id,
    line_dedup,
    merkle,
    mixing,
    periodic_runs,
    quality,
    quotes,
    revisits,
    substring_dedup,
    topk_search,
    toxicity,
)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the session's own path does not hold it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(bipath.__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}" if paths else root


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def capture_records(pages: DataFrame) -> DataFrame:
    """Archive records of the pages: a response for each (one in thirteen is no full one) and a later
    revisit under another spelling of its URL, with validators that agree, differ or are absent."""
    page, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    day = F.concat(F.lit("day "), (page % 28).cast("string"))

    def fields(**named):
        return F.create_map(*(x for k, v in named.items() for x in (F.lit(k.replace("_", "-")), v)))

    response = pages.select(
        F.concat(F.lit("r"), page.cast("string")).alias("record_id"), F.lit("response").alias("kind"), "url",
        (page * 2).alias("captured"), F.when(page % 13 == 3, 404).otherwise(200).alias("status"),
        tag.alias("etag"), day.alias("last_modified"),
        fields(Content_Type=F.lit("text/html"), Content_Length=F.length("html").cast("string"), ETag=tag, Cache_Control=F.lit("max-age=60"), Date=day).alias("headers"),
        F.col("html").alias("payload"),
    )
    fresh_tag = (
        F.when(page % 7 == 1, F.lit(None)).when(page % 5 == 0, F.lit('"stale"')).when(page % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    )
    fresh_day = F.when(page % 7 == 1, F.when(page % 11 != 2, day)).otherwise(day)
    revisit = pages.select(
        F.concat(F.lit("v"), page.cast("string")).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat(F.lit("HTTP://WWW."), F.regexp_replace("url", "^https?://(www\\.)?", ""), F.lit("#again")).alias("url"),
        (page * 2 + 1).alias("captured"), F.lit(304).alias("status"), fresh_tag.alias("etag"), fresh_day.alias("last_modified"),
        fields(Content_Length=F.lit("0"), Cache_Control=F.lit("max-age=600"), X_Cache=F.lit("hit"), Connection=F.lit("close")).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def op1_revisits(spark: SparkSession, d: str) -> DataFrame:
    found = revisits.resolve_revisits(capture_records(table(spark, d, "pages")))
    shown = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.col("headers")[k]))
    return found.select(
        "record_id", "url_key", "outcome", "source_id",
        F.array_join(shown, "\n").alias("headers"), F.sha2("payload", 256).alias("payload_sha256"),
    )


def op2_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, d, "documents"))


def op3_topk_search(spark: SparkSession, d: str) -> DataFrame:
    return topk_search.top_k(table(spark, d, "embeddings"), k=5, every=50)


def op4_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language_id.language_of_documents(table(spark, d, "documents"))


def op5_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, d, "documents"))


def quoted_messages(turns: DataFrame) -> DataFrame:
    """A message for each text of each turn, which quotes the least text of each of the two turns before it, the second one
    level deeper. Rows without a conversation or a turn quote nothing."""
    said = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).distinct()
    least = said.filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))

    def before(n: int, marks: str) -> DataFrame:
        quoted = F.regexp_replace("text", "(?m)^", marks)
        return least.select("conv_id", (F.col("turn") + n).alias("turn"), quoted.alias(f"back{n}"))

    whole = said.join(before(1, "> "), ["conv_id", "turn"], "left").join(before(2, "> > "), ["conv_id", "turn"], "left")
    number = [F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("conv_id", "turn")]
    return whole.select(
        F.concat_ws("-", *number, F.md5("text")).alias("msg_id"),
        F.struct("conv_id", "turn").alias("sent"),
        F.concat_ws("\n", "back2", "back1", "text").alias("body"),
    )


def op6_quotes(spark: SparkSession, d: str) -> DataFrame:
    return quotes.conversations(quoted_messages(table(spark, d, "conversations")))


def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def op8_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op9_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, d, "documents"), with_text=False).drop("kept", "text_key")


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def looped_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the words of one document in ten, by the crc32 of its id, go round in a loop from some word on."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10).cast("long"), F.size("words")
    looped = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).select(
        "doc_id", "text", "words", F.when((h % 10 == 0) & (n > 0), g % n).cast("int").alias("a"), n.alias("n"), g.alias("g")
    )
    looped = looped.select("*", (F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int").alias("p"))
    rest = F.col("n") - F.col("a")
    rounds = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))
    loop = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(rounds), F.lit(1), rest))
    return looped.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(loop, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    found = periodic_runs.periodic_runs(looped_documents(table(spark, d, "documents")), with_text=False)
    shown = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r.alias("r"))))["r"]
    best = F.col("best")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat(shown, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), "collapsed_sha256",
    )


def op12_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, d, "documents"), with_text=False).drop("kept")


def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every row's proof; of one row in seven a tampered leaf, with one more in n_chars, is checked."""
    documents = table(spark, d, "documents")
    claimed = [
        F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in merkle.LEAF_COLUMNS
    ]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_digest(*claimed))
    made = merkle.manifest(documents, keep={"doc_id": F.col("doc_id"), "tampered": tampered})
    requests = made.leaves.select("tree", "rank", F.col("kept_doc_id").alias("id"), F.col("kept_tampered").alias("claimed"))
    found = merkle.proofs(made, requests, with_proof=False)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_revisits, op2_jaccard_join, op3_topk_search, op4_language_id, op5_mixing,
        op6_quotes, op7_quality, op8_decontamination, op9_substring_dedup, op10_toxicity,
        op11_periodic_runs, op12_line_dedup, op13_merkle_manifest,
    )
}
