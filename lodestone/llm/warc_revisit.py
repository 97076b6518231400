"""WARC not-modified revisits: as-of join by canonical URL to the latest earlier full response.

Records are dealt by ranges of (url, time), so a hot URL is many blocks of like size, whatever its times. Within a block
a window finds the latest earlier response, and the blocks' last ones serve later blocks. Only numbers and times of
records go through the windows; validators and headers are joined to the pairs found. Payloads never travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

#: Header names (RFC 9110, section 15.4.5) that a 304 answer may replace; others stay as stored.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical(url: Column) -> Column:
    """Scheme, a leading www., fragment, tracking parameters, default port and trailing slashes dropped; host lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "^[^?]*[?](.*)$", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)="))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def folded(headers: Column) -> Column:
    """Header names in lower case; of names that differ only in case the one first in code order gives the value."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == n), F.lit(0))["value"]))


def resolve_revisits(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """Resolve each revisit record against the latest earlier full response of its canonical URL.

    Input: record_id long, ts long, uri string, kind string (``response`` or ``revisit``), status int, etag string,
    digest string, headers map<string,string>; other columns are not read. Output per revisit: record_id, canonical_url,
    refers_to (record_id of the response or null), outcome, headers (permitted ones of the revisit over the stored
    ones), digest. ``blocks`` is the number of ranges, by default that of shuffle partitions.

    outcome: ``resolved`` when a validator agrees (etag, else digest), ``mismatch`` when it differs, ``unvalidated``
    when neither side has one in common, ``missing`` without an earlier response. Only ``resolved`` and
    ``unvalidated`` merge headers and carry the stored digest. Responses with status 304 or a null ts are no full
    responses. On equal ts the larger record_id is the later one. Null uri: ``missing``. Header names compare in
    lower case, see folded(). Rows of other kinds are ignored; repeated revisit rows are each answered; of repeated
    responses any one answers. Urls and headers of any length are kept whole. Empty table: empty result.
    """
    spark = records.sparkSession
    blocks = blocks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = records.where(F.col("kind").isin("response", "revisit")).select("record_id", F.col("ts").cast("long").alias("ts"), canonical(F.col("uri")).alias("url"), "kind", "status", "etag", "digest", folded(F.col("headers")).alias("headers"))
    dealt = base.repartitionByRange(blocks, "url", "ts", "record_id").withColumn("block", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    dealt = materialize(dealt, "records")
    full = (F.col("kind") == "response") & F.col("ts").isNotNull() & F.col("url").isNotNull() & (F.coalesce("status", F.lit(200)) != 304)
    slim = dealt.select("row", "record_id", "ts", "url", "block", full.alias("full"))
    lasts = slim.groupBy("url", "block").agg(F.max_by(F.when(F.col("full"), F.col("row")), F.when(F.col("full"), F.struct("ts", "record_id", "row"))).alias("last"))
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.where("url IS NOT NULL").select("url", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("url", "block").orderBy("ts", "record_id", F.desc("full"), "row").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(F.col("full"), F.col("row")), ignorenulls=True).over(inside)
    found = slim.withColumn("near", near).join(carried, ["url", "block"], "left")
    found = found.where(F.col("ts").isNotNull() & F.col("url").isNotNull()).select("row", F.coalesce("near", "carried").alias("old_row")).where("old_row IS NOT NULL")
    stored = dealt.where(full).select(F.col("row").alias("old_row"), F.struct("record_id", "etag", "digest", "headers").alias("old"))
    met = dealt.where("kind = 'revisit'").join(found, "row", "left").join(stored, "old_row", "left")
    agree = F.coalesce(F.col("etag") == F.col("old.etag"), F.col("digest") == F.col("old.digest"))
    outcome = F.when(F.col("old").isNull(), "missing").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")
    usable = outcome.isin("resolved", "unvalidated")
    permitted = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter("old.headers", lambda k, _: ~F.array_contains(F.map_keys(permitted), k))
    return met.select(
        "record_id", F.col("url").alias("canonical_url"), F.col("old.record_id").alias("refers_to"), outcome.alias("outcome"),
        F.when(usable, F.map_concat(kept, permitted)).alias("headers"), F.when(usable, F.col("old.digest")).alias("digest"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """WARC-like records from the pages table.

    Each page gives a full response at time 2 * page_id, but every eleventh none and every seventh one without
    validators; and each page gives a revisit of the same url, by the other scheme and with a fragment, half the table
    later, with its own etag."""
    top = pages.agg(F.coalesce(F.max("page_id"), F.lit(0))).first()[0]
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    bare = F.col("page_id") % 7 == 3
    response = pages.where("page_id % 11 <> 5").select(
        (F.col("page_id") * 2).alias("record_id"), (F.col("page_id") * 2).alias("ts"), F.col("url").alias("uri"), F.lit(200).alias("status"),
        F.lit("response").alias("kind"), F.when(~bare, tag).alias("etag"), F.when(~bare, digest).alias("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), (F.col("page_id") * 2).cast("string"), F.lit("Content-Length"), F.length(F.coalesce("html", F.lit(""))).cast("string")).alias("headers"),
    )
    later = F.col("page_id") * 2 + 1 + (top // 2) * 2
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), later.alias("ts"), F.concat(F.regexp_replace("url", "^https?://", "HTTP://"), F.lit("#again")).alias("uri"), F.lit(304).alias("status"),
        F.lit("revisit").alias("kind"), tag.alias("etag"), digest.alias("digest"),
        F.create_map(F.lit("Date"), later.cast("string"), F.lit("date"), F.lit("other"), F.lit("ETag"), tag, F.lit("Content-Length"), F.lit("0")).alias("headers"),
    )
    return response.unionByName(revisit)
