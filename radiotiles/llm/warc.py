"""Resolution of not-modified revisits in a web archive.

A revisit (a 304 record without payload) is resolved to the latest earlier full response for its
canonical URL: an as-of join.  Records are dealt by sampled ranges of (URL, time, id), so that a URL with very
many records lies in many buckets however its times are spread: within (URL, bucket) a window carries the last
full response forward, and a second, small window over one row for each (URL, bucket) carries it across
buckets.  The validators
are then checked (entity tag before modification date), and the stored headers are updated with
those headers of the revisit that a 304 may change.

Status of a revisit: `resolved`, `mismatch` (its validator differs from the stored one), `unverified`
(no validator in common), `no_response` (no earlier full response).  A record is earlier when its
(time, id) is smaller; repeated records keep the order in which Spark meets them.  Null URL, time or
id: `no_response`.  Null header maps are empty.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiotiles.llm.common import stage

#: Header fields of a 304 response that replace stored ones.
UPDATED_BY_304 = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, no scheme, fragment, utm_ parameters or slash at the end."""
    plain = F.regexp_replace(url, "#.*$", "")
    start = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, start, 1)), r"^www\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(plain, start + "(.*)$", 2), "([?&])utm_[a-z]+=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "&&+", "&"), r"\?&", "?")
    return F.when(plain.rlike(start), F.concat(host, F.regexp_replace(rest, "/+$", ""))).otherwise(plain)


def strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, buckets: int | None = None) -> DataFrame:
    """`records`: record_id long, url string, ts long, revisit boolean, headers map<string,string> (names
    in lower case).  One row for each revisit: record_id, canonical_url, ts, status, target_id, headers.  `buckets`: as
    many as there are shuffle partitions unless given."""
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("canonical_url"),
        F.col("ts").cast("long").alias("ts"),
        F.coalesce("revisit", F.lit(False)).alias("revisit"),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
    )
    order = ("canonical_url", "ts", "record_id")
    dealt = rows.repartitionByRange(buckets, *order) if buckets else rows.repartitionByRange(*order)
    rows = stage(dealt.withColumn("bucket", F.spark_partition_id()), "captures")  # written, so that the buckets stay
    full = F.when(~F.col("revisit") & F.col("ts").isNotNull() & F.col("record_id").isNotNull(), F.struct("ts", "record_id", "headers"))
    in_order = Window.partitionBy("canonical_url", "bucket").orderBy("ts", "record_id")
    local = rows.withColumn("own", F.last(full, True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    ends = rows.where("canonical_url is not null").groupBy("canonical_url", "bucket").agg(F.max_by(full, F.when(full.isNotNull(), F.struct("ts", "record_id"))).alias("end"))
    carried = ends.select(
        F.col("canonical_url").alias("u"),
        F.col("bucket").alias("b"),
        F.last("end", True).over(Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
    ).where("carry is not null")
    known = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    found = (
        local.where("revisit")
        .join(carried, (F.col("canonical_url") == F.col("u")) & (F.col("bucket") == F.col("b")), "left")
        .withColumn("target", F.when(known, F.coalesce("own", "carry")))
    )
    stored, sent = F.col("target.headers"), F.col("headers")
    tags = strong(stored["etag"]), strong(sent["etag"])
    dates = stored["last-modified"], sent["last-modified"]
    status = (
        F.when(F.col("target").isNull(), "no_response")
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(tags[0] == tags[1], "resolved").otherwise("mismatch"))
        .when(dates[0].isNotNull() & dates[1].isNotNull(), F.when(dates[0] == dates[1], "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    updates = F.map_filter(sent, lambda k, v: k.isin(*UPDATED_BY_304))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(updates, k)), updates)
    return found.select("record_id", "canonical_url", "ts", status.alias("status"), F.col("target.record_id").alias("target_id"), F.when(status == "resolved", merged).alias("headers"))


def header_block(headers: Column) -> Column:
    """The header lines in order of name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
