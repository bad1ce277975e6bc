"""WARC not-modified revisits: find the response a revisit stands for and merge headers.

A revisit record has no payload. By RFC 9110 a 304 answer confirms a stored
response that its validators select, and only some header fields of the answer
replace stored ones. Here that is an as-of join by canonical URL to the latest
earlier full response, without a window over all captures of a URL: a range
exchange sorts all captures, fixed blocks of ranks are filled forward on their
own, and what a block ends with is carried to the next over a table with one
row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from somatlas.runtime import Scratch, ordered_rank

# The fields that a 304 answer may bring (RFC 9110, 15.4.5). Last-Modified is one only where the answer has no ETag.
PERMITTED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that campaigns add and that name no other resource.
TRACKING_PARAMETERS = "utm_[a-z]+|fbclid|gclid"
BLOCK = 4096


def decode_unreserved(c: Column) -> Column:
    """Percent codes of unreserved characters as the characters, all others with capital letters (RFC 3986, 6.2.2)."""

    def piece(s: Column, i: Column) -> Column:
        code = F.conv(F.substring(s, 1, 2), 16, 10).cast("int")
        plain = code.isin(45, 46, 95, 126) | code.between(48, 57) | code.between(65, 90) | code.between(97, 122)
        decoded = F.concat(F.when(plain, F.char(code)).otherwise(F.concat(F.lit("%"), F.upper(F.substring(s, 1, 2)))), F.substr(s, F.lit(3)))
        return F.when(i == 0, s).when(s.rlike("^[0-9A-Fa-f]{2}"), decoded).otherwise(F.concat(F.lit("%"), s))

    return F.when(F.contains(c, F.lit("%")), F.array_join(F.transform(F.split(c, "%"), piece), "")).otherwise(c)


def remove_dot_segments(path: Column) -> Column:
    """``.`` and ``..`` segments taken out (RFC 3986, 5.2.4)."""
    parts = F.split(path, "/")

    def step(out: Column, s: Column) -> Column:
        up = F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)
        return F.when(s == ".", out).when(s == "..", up).otherwise(F.concat(out, F.array(s)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def canonical_url(url: Column) -> Column:
    """The URL that captures are compared by; null stays null.

    Scheme and, after one, a leading ``www.`` are dropped, and the host is in
    lower case. Dropped too: the scheme's default port (80 without a scheme),
    the fragment, empty and tracking parameters, and a trailing slash of a
    path that no query follows. Percent codes and dot segments are normalized.
    """
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    secure = u.rlike(r"^(?i)https://")
    u = F.regexp_replace(u, r"^(?i)https?://(?:www\.)?", "")
    raw = F.regexp_extract(u, r"^[^/?]*", 0)
    host = F.regexp_replace(F.lower(raw), F.when(secure, ":443$").otherwise(":80$"), F.lit(""))
    path = remove_dot_segments(decode_unreserved(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1)))
    params = F.filter(F.split(decode_unreserved(F.regexp_extract(u, r"^[^?]*\?(.*)$", 1)), "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{TRACKING_PARAMETERS})(=|$)"))
    query = F.array_join(params, "&")
    return F.concat(host, F.when(query == "", F.regexp_replace(path, "/$", "")).otherwise(F.concat(path, F.lit("?"), query)))


def lower_names(headers: Column) -> Column:
    """The header map with names in lower case; the values of one field that comes several times are joined by commas (RFC 9110, 5.3). Null is no header."""
    entries = F.array_sort(F.map_entries(headers))  # a map has no order of its own
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(F.trim(e["key"]))))
    values = lambda n: F.filter(F.transform(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == n), lambda e: e["value"]), lambda v: v.isNotNull())
    joined = F.transform(names, lambda n: F.when(F.size(values(n)) > 0, F.array_join(values(n), ", ")))
    plain = F.transform_keys(headers, lambda k, v: F.lower(F.trim(k)))  # where no field comes twice, which is nearly always
    out = F.when(F.size(names) == F.size(headers), plain).otherwise(F.map_from_arrays(names, joined))
    return F.coalesce(out, F.expr("map()").cast("map<string,string>"))


def merge_headers(stored: Column, answer: Column) -> Column:
    """The stored header map, with the permitted fields of the 304 answer in place of its own. Names are in lower case."""
    new = F.map_filter(answer, lambda k, v: v.isNotNull() & (k.isin(*PERMITTED_HEADERS) | ((k == "last-modified") & answer["etag"].isNull())))
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def resolve_revisits(captures: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each revisit in ``captures``.

    ``captures`` has capture_id, url, at (any ordered type), kind ('response'
    or 'revisit'), headers (a map, names in any case), digest. Returns
    capture_id, canonical, original_id, status, digest, headers (names in
    lower case). A null ``at`` comes before all others. The original
    is the response before the revisit with the same canonical URL and the
    largest (at, capture_id). status is 'resolved' if its validators agree:
    equal ETags (a W/ prefix aside) if the revisit has one, else equal
    Last-Modified if it has one, else equal digests; 'validator_mismatch' if
    they don't; 'no_original' if there is none. Only a resolved row has the
    original's digest and merged headers; otherwise its own. A null URL has no
    original. Captures with equal (at, capture_id): responses come first.
    """
    c = captures.select(
        "capture_id", canonical_url(F.col("url")).alias("canonical"), "at", (F.col("kind") == "revisit").alias("is_revisit"),
        lower_names(F.col("headers")).alias("headers"), "digest",
    )
    c = ordered_rank(scratch, scratch.save(c, "captures"), [F.col(x) for x in ("canonical", "at", "capture_id", "is_revisit", "digest")], "ranked")
    c = c.withColumn("block", F.floor(F.col("__rank") / BLOCK))
    full = F.when(~F.col("is_revisit"), F.struct("capture_id", "headers", "digest"))
    inside = Window.partitionBy("block", "canonical").orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    ends = c.where(~F.col("is_revisit")).groupBy("canonical", "block").agg(F.max_by(F.struct("capture_id", "headers", "digest"), "__rank").alias("last"))
    # A block has at most one URL that goes on from the block before it: its first row's.
    heads = c.where(F.col("__rank") % BLOCK == 0).select("canonical", "block", F.lit(None).cast(ends.schema["last"].dataType).alias("last"), F.lit(True).alias("is_head"))
    line = Window.partitionBy("canonical").orderBy("block", F.col("is_head").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.unionByName(ends.withColumn("is_head", F.lit(False))).withColumn("carried", F.last("last", ignorenulls=True).over(line)).where("is_head and carried is not null").select("canonical", "block", "carried")
    found = c.withColumn("own", F.last(full, ignorenulls=True).over(inside)).where("is_revisit").join(carried, ["canonical", "block"], "left")
    found = found.withColumn("o", F.when(F.col("canonical").isNotNull(), F.coalesce("own", "carried")))
    tag = lambda m: F.regexp_replace(m["etag"], "^W/", "")
    mine, theirs = F.col("headers"), F.col("o.headers")
    agree = F.when(mine["etag"].isNotNull(), tag(mine).eqNullSafe(tag(theirs))).when(mine["last-modified"].isNotNull(), mine["last-modified"].eqNullSafe(theirs["last-modified"])).otherwise(F.col("digest").eqNullSafe(F.col("o.digest")))
    status = F.when(F.col("o").isNull(), "no_original").when(agree, "resolved").otherwise("validator_mismatch")
    found = found.withColumn("status", status)
    good = F.col("status") == "resolved"
    return found.select(
        "capture_id", "canonical", F.col("o.capture_id").alias("original_id"), "status",
        F.when(good, F.col("o.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(good, merge_headers(theirs, mine)).otherwise(mine).alias("headers"),
    )
