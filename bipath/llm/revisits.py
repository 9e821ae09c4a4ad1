"""Not-modified revisits of a web archive, resolved to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bipath.llm.asof import latest_before
from bipath.llm.hot import left_join_spread
from bipath.runtime import written

# Fields of a not-modified answer that describe its own transfer and not the stored response.
OWN_FIELDS = (
    "connection keep-alive proxy-authenticate proxy-authorization proxy-connection te trailer transfer-encoding "
    "upgrade content-length content-encoding content-range content-type"
).split()


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without end slashes, sorted parameters without
    tracking ones; scheme and fragment go. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^https?://", "")
    raw_host = F.regexp_extract(bare, "^([^/?]*)", 1)
    rest = F.substring(bare, F.length(raw_host) + 1, F.length(bare))
    host = F.regexp_replace(F.regexp_replace(F.lower(raw_host), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _names(headers: Column) -> Column:
    """Field names in lower case; values of one field that comes several times are joined by a comma, each once."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), e["value"].alias("v")))

    def field(name):
        values = F.array_sort(F.array_distinct(F.transform(F.filter(entries, lambda e: e["k"] == name), lambda e: e["v"])))
        return F.struct(name.alias("k"), F.when(F.size(values) == 1, values[0]).otherwise(F.array_join(values, ", ")).alias("v"))

    fields = F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["k"])), field))
    return F.coalesce(fields, F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields, replaced by those of the answer that may replace them: none of its own transfer, nor those its
    Connection field names."""
    named = F.transform(F.split(F.lower(F.coalesce(fresh["connection"], F.lit(""))), ","), F.trim)
    permitted = F.map_filter(fresh, lambda k, v: ~k.isin(OWN_FIELDS) & ~F.array_contains(named, k))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, url_key, outcome, source_id, headers, payload): one row for each revisit record.

    ``records`` has record_id (string), kind (response or revisit), url, captured (long), status, etag,
    last_modified, headers (map) and payload; other columns are ignored. A revisit belongs to the latest full
    response (status 200) of its canonical URL that was captured before it. Its ETag must then equal the
    stored one (weak comparison), or without an ETag its Last-Modified. The outcome is

    - ``resolved``: headers are merged and the payload is the stored one;
    - ``changed``: the validators differ; ``unverified``: there is none on either side to compare;
    - ``missing``: there is no earlier response, or the URL is null.

    All but the first have null headers and payload; ``missing`` has a null source_id. Records captured at the
    same time are in the order of record_id. Rows of other kinds, and a null kind, are ignored. Header names differ in
    case only by the way they are written: such fields are one. Revisits that share a record_id are one, the least by captured,
    URL, validators and headers, and so are responses; where responses are alike in all that any payload of theirs may come. Rows
    without a record_id are ignored.

    Only keys and validators go through the as-of join; payloads meet the resolved revisits by record id, those of a popular
    page in many places.
    """
    response = (F.col("kind") == "response") & (F.col("status") == 200)
    keyed = records.filter(F.col("record_id").isNotNull())
    fields = F.array_sort(F.map_entries("headers")).alias("fields")
    order = ["captured", canonical_url(F.col("url")).alias("url_key"), "etag", "last_modified"]

    def single(rows: DataFrame, kind: str, *more: Column) -> DataFrame:
        least = rows.groupBy("record_id").agg(F.min(F.struct(*order, *more)).alias("r"), F.count(F.lit(1)).alias("copies"))
        return least.select("record_id", F.lit(kind).alias("kind"), "copies", "r.*")

    revisits = single(keyed.filter("kind = 'revisit'"), "revisit", fields)
    responses = single(keyed.filter(response), "response")
    validators = F.struct("record_id", "etag", "last_modified", "copies")
    slim = responses.withColumn("full", validators).withColumn("fields", F.lit(None).cast(revisits.schema["fields"].dataType))
    slim = slim.unionByName(revisits.withColumn("full", F.lit(None).cast(slim.schema["full"].dataType)))
    found = latest_before(slim, "url_key", ["captured", "record_id"], "full", "stored").filter("kind = 'revisit'")
    by_etag = _weak(F.col("etag")) == _weak(F.col("stored.etag"))
    by_date = F.col("last_modified") == F.col("stored.last_modified")
    same = F.when(F.col("etag").isNotNull() & F.col("stored.etag").isNotNull(), by_etag).otherwise(by_date)
    outcome = (
        F.when(F.col("stored.record_id").isNull(), "missing")
        .when(same, "resolved")
        .when(same.isNull(), "unverified")
        .otherwise("changed")
    )
    judged = found.select(
        "record_id", "url_key", outcome.alias("outcome"), F.col("stored.record_id").alias("source_id"),
        F.col("stored.copies").alias("copies"), _names(F.map_from_entries("fields")).alias("fresh"),
    )
    judged = written(judged.withColumn("from_id", F.when(F.col("outcome") == "resolved", F.col("source_id"))), "judged")
    kept = keyed.filter(response).select(F.col("record_id").alias("from_id"), "headers", "payload")
    if not judged.filter("from_id IS NOT NULL AND copies > 1").isEmpty():
        # Payloads are only shuffled for it where a wanted response has a namesake.
        kept = kept.dropDuplicates(["from_id"])
    stored = kept.select("from_id", _names(F.col("headers")).alias("stored"), "payload")
    return left_join_spread(judged, stored, "from_id", "record_id").select(
        "record_id", "url_key", "outcome", "source_id",
        F.when(F.col("from_id").isNotNull(), merged_headers(F.col("stored"), F.col("fresh"))).alias("headers"),
        "payload",
    )
