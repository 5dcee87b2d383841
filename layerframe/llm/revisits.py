"""Resolution of not-modified captures against the latest earlier full response.

A capture with status 304 carries no payload.  It is resolved by an as-of join:
among the captures of the same canonical URL, the latest earlier full response
whose validators agree.  The response's headers are merged with those that a
304 may update.

The as-of join works in two levels, so a URL with a third of all captures is in
no single task: captures are cut into cells of equal size by URL and time;
inside a cell a window carries the last full response along; the last one of
each cell is carried over the cells, which are as few as the partitions.
Payloads stay out of it, only ids, validators and headers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerframe.llm.common import store

#: Headers of a 304 that replace those of the stored response (fixed values, RFC 9110 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not name another document.
TRACKING = r"(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Scheme, "www." and "m.", fragment, tracking parameters, index page and last slash removed; host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"(/index\.html?|\.html?|/+)$", "")
    asked = F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), TRACKING, "")
    asked = F.regexp_replace(asked, r"^&+|&+$", "")
    return F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))


def in_cells(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cell``: the part of a range partition on URL and time that they lie in.

    Parts hold as many rows each, so a URL with very many captures has many
    cells wherever in time they lie; a later cell of a URL holds its later
    captures.  Rows equal in URL, time and id share a cell.  Stored once, so
    that a task run again sees the same parts.
    """
    ranged = rows.repartitionByRange("url_key", "time", "record_id")
    return store(ranged.withColumn("cell", F.spark_partition_id().cast("long")), "captures")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per capture of (record_id, url, time, status, etag, modified, digest, headers).

    Returns record_id, url_key, outcome, source_id, digest, headers:
    ``response`` for a full response (status 200) as it is; ``resolved`` for a
    304 with the source's id and digest and the merged headers; ``mismatch``
    where the latest earlier response has other validators (source named, no
    digest); ``unresolved`` where there is none; ``other`` for other statuses.

    Earlier means a smaller time, or the same and a smaller record_id; nulls in
    either come first.  Validators agree when the entity tags are equal, weak
    prefixes aside, or, where either has no tag, the modification dates are; a
    304 with neither agrees with anything.  A null URL has no history, so its
    304s stay unresolved.  Repeated rows give repeated results, and none is
    earlier than its copy.  A permitted header of the 304 replaces the stored one
    of its name whatever the case of either.  Other columns are dropped.
    """
    rows = captures.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("url_key"),
        F.col("time").cast("long").alias("time"),
        F.col("status").cast("int").alias("status"),
        F.col("etag"),
        F.col("modified"),
        F.col("digest"),
        F.col("headers"),
    )
    celled = in_cells(rows)
    full = F.when(
        F.col("status") == 200, F.struct("time", "record_id", "etag", "modified", "digest", "headers")
    )
    last_in_cell = celled.filter("status = 200").groupBy("url_key", "cell").agg(
        F.max_by(full, F.struct("time", "record_id")).alias("last")
    )
    cells = celled.select("url_key", "cell").distinct().join(last_in_cell, ["url_key", "cell"], "left")
    over_cells = Window.partitionBy("url_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("url_key", "cell", F.last("last", ignorenulls=True).over(over_cells).alias("carried"))
    in_cell = Window.partitionBy("url_key", "cell").orderBy(F.col("time").asc_nulls_first(), F.col("record_id").asc_nulls_first())
    ranked = celled.withColumn("place", F.rank().over(in_cell)).withColumn("full", full)
    # rows with equal time and id see the same past: the frame ends before them
    before = Window.partitionBy("url_key", "cell").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    met = (
        ranked.withColumn("inner", F.last("full", ignorenulls=True).over(before))
        .join(carried, ["url_key", "cell"], "left")
        .withColumn("from", F.when(F.col("status") == 304, F.coalesce("inner", "carried")))
    )
    bare = lambda tag: F.regexp_replace(tag, "^W/", "")
    agree = F.when(
        F.col("etag").isNotNull() & F.col("from.etag").isNotNull(), bare(F.col("etag")) == bare(F.col("from.etag"))
    ).when(F.col("modified").isNotNull() & F.col("from.modified").isNotNull(), F.col("modified") == F.col("from.modified")).otherwise(
        F.col("etag").isNull() & F.col("modified").isNull()
    )
    outcome = (
        F.when(F.col("status") == 200, "response")
        .when(F.coalesce(F.col("status"), F.lit(0)) != 304, "other")
        .when(F.col("from").isNull(), "unresolved")
        .when(agree, "resolved")
        .otherwise("mismatch")
    )
    none = F.create_map().cast("map<string,string>")
    mine = F.map_filter(F.coalesce("headers", none), lambda k, _: F.lower(k).isin(*PERMITTED))
    named = F.transform(F.map_keys(mine), F.lower)
    theirs = F.map_filter(F.coalesce("from.headers", none), lambda k, _: ~F.array_contains(named, F.lower(k)))
    return met.withColumn("outcome", outcome).select(
        "record_id",
        "url_key",
        "outcome",
        F.when(F.col("outcome").isin("resolved", "mismatch"), F.col("from.record_id")).alias("source_id"),
        F.when(F.col("outcome") == "resolved", F.col("from.digest")).otherwise(F.when(F.col("status") == 200, F.col("digest"))).alias("digest"),
        F.when(F.col("outcome") == "resolved", F.map_concat(theirs, mine)).otherwise(F.col("headers")).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures as a crawler would have recorded ``pages``: (page_id, url, html).

    Every page is visited twice: as a full response at its own time (its id),
    with a strong tag over the payload and a modification day, and later as a
    304 that repeats the validators.  One page in seven sends no tag and one in
    five of the revisits a tag that no longer holds, so every outcome occurs.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("id"), "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest")
    ).filter("id IS NOT NULL")
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("id") % 365).cast("string"))
    first = page.select(
        (F.col("id") * 2).alias("record_id"),
        "url",
        F.col("id").alias("time"),
        F.lit(200).alias("status"),
        F.when(F.col("id") % 7 != 0, tag).alias("etag"),
        day.alias("modified"),
        "digest",
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), day, F.lit("etag"), tag).alias("headers"),
    )
    again = page.select(
        (F.col("id") * 2 + 1).alias("record_id"),
        "url",
        (F.col("id") + 1000).alias("time"),
        F.lit(304).alias("status"),
        F.when(F.col("id") % 5 == 0, F.lit('"changed"')).when(F.col("id") % 7 != 0, F.concat(F.lit("W/"), tag)).alias("etag"),
        day.alias("modified"),
        F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), F.lit("later")).alias("headers"),
    )
    return first.unionByName(again)
