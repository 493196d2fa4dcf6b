"""Not-modified revisits of web captures, resolved to full responses.

A revisit record stands for a capture whose server said that nothing had changed. It is joined, as of its time, to the
latest earlier full response of the same canonical URL. Their validators must agree: entity tags (weak and strong alike)
if both have one, else dates of last modification if both have one. Then the response's headers, overlaid with those that
a not-modified answer may update, and its payload make the revisit a full record. The as-of join is one window over
narrow rows by URL, or by URL and span of time where rows are many; payloads move once, by record, and those that many
revisits want are repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.sources.tables import cut

#: Headers that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Rows that one task orders, about; revisits of one response that one task joins, about.
SPAN_ROWS, HOT_REVISITS = 20_000_000, 50_000
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query: without scheme, user, www, usual ports, fragment, closing slashes and tracking
    parameters; hosts in lower case. Null for null and for a URL without a host."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#[\\s\\S]*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "\\?([\\s\\S]*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    joined = F.array_join(kept, "&")
    return F.when(host != "", F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def _header(headers: Column, name: str) -> Column:
    return F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), 0)


def _merged(old: Column, new: Column) -> Column:
    update = F.map_filter(new, lambda k, v: F.lower(k).isin(*PERMITTED) & v.isNotNull())
    names = F.transform(F.map_keys(update), lambda k: F.lower(k))
    keep = F.map_filter(old, lambda k, _: ~F.array_contains(names, F.lower(k)))
    both = F.concat(F.map_entries(keep), F.map_entries(update))
    return F.array_sort(F.transform(both, lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value"))))


def _as_of(rows: DataFrame) -> DataFrame:
    """rows (site, at, full, ..) with r, the greatest full of the same site at an earlier time.

    Where there are more rows than one task should order, time is cut into spans: the greatest of each site and span is
    carried to the later ones, and only the rows of one span are ordered together, so that one site may have any share."""
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("at"), F.max("at")).head()
    spans = -(-n // SPAN_ROWS)
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    if spans < 2 or low is None or low == high:
        return rows.withColumn("r", F.max("full").over(earlier("site")))
    rows = rows.withColumn("span", F.coalesce(F.floor((F.col("at") - low).cast("double") / float(high - low) * spans), F.lit(-1)))
    before = Window.partitionBy("site").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("site", "span").agg(F.max("full").alias("greatest")).withColumn("carried", F.max("greatest").over(before)).select("site", "span", "carried")
    both = rows.join(carried.hint("merge"), ["site", "span"])
    return both.withColumn("r", F.greatest(F.max("full").over(earlier("site", "span")), F.col("carried"))).drop("carried", "span")


def resolved_revisits(records: DataFrame) -> DataFrame:
    """A row for each revisit: revisit_id, response_id, canonical_url, status, headers, payload.

    records has record_id long, url string, at long, type string ("response", "revisit", others are left out), headers
    map<string,string> and payload string. status is resolved, no_response, unvalidated (no validator that both have) or
    mismatch; headers (an array of name and value by name, lower-case) and payload are null unless resolved, and
    response_id is null only for no_response. Only responses strictly earlier count; of several at one time the one of
    the greatest record_id. A null URL, time or a URL without host has no response; null headers count as none. Repeated
    rows of a revisit have a row each; of a response they count as one, with the headers and payload that come first as
    text. Extra columns play no part.
    """
    empty = F.create_map().cast("map<string,string>")
    mine = records.select("record_id", F.col("at").cast("long").alias("at"), "type", canonical_url(F.col("url")).alias("curl"), F.coalesce("headers", empty).alias("headers"), "payload")
    narrow = mine.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", "at", "type", "curl", _tag(_header(F.col("headers"), "etag")).alias("etag"), F.trim(_header(F.col("headers"), "last-modified")).alias("modified"),
        F.when(F.col("type") == "revisit", F.col("headers")).alias("new"),
    )
    narrow = narrow.withColumn("site", F.coalesce("curl", F.concat(F.lit("\x00"), F.col("record_id").cast("string"))))
    full = F.when((F.col("type") == "response") & F.col("at").isNotNull() & F.col("curl").isNotNull(), F.struct("at", "record_id", "etag", "modified"))
    found = _as_of(narrow.withColumn("full", full)).filter("type = 'revisit'").withColumn("r", F.when(F.col("at").isNotNull() & F.col("curl").isNotNull(), F.col("r")))
    agree = F.coalesce(F.col("etag") == F.col("r.etag"), F.col("modified") == F.col("r.modified"))
    status = F.when(F.col("r").isNull(), "no_response").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")
    found = found.select(F.col("record_id").alias("revisit_id"), F.col("r.record_id").alias("response_id"), F.col("curl").alias("canonical_url"), status.alias("status"), "new")
    found = found.withColumn("want", F.when(F.col("status") == "resolved", F.col("response_id")))
    bodies = mine.filter("type = 'response'").select(F.col("record_id").alias("have"), F.col("headers").alias("old"), "payload")
    found = cut(found)
    rows = Window.partitionBy("have").orderBy(F.to_json("old"), "payload")
    one = bodies.withColumn("n", F.row_number().over(rows)).filter("n = 1").drop("n")
    hot = cut(found.groupBy("want").count().filter(F.col("want").isNotNull() & (F.col("count") > HOT_REVISITS)).select("want", F.ceil(F.col("count") / HOT_REVISITS).alias("parts")))
    # a salt for rows that want nothing, so that they don't meet in one task
    salt = F.xxhash64("revisit_id", "canonical_url")
    key = F.coalesce(F.col("want"), -1 - F.abs(salt % 1_000_003))
    found, part = found.withColumn("key", key), F.lit(0).cast("long")
    if not hot.isEmpty():
        # a response that many revisits want is repeated, a copy for each so many of them
        found = found.join(hot.hint("merge"), "want", "left").withColumn("part", F.coalesce(F.pmod(salt, F.col("parts")), F.lit(0))).drop("parts")
        one = one.join(hot.withColumnRenamed("want", "have").hint("merge"), "have", "left").withColumn("there", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    else:
        found, one = found.withColumn("part", part), one.withColumn("there", part)
    joined = found.hint("merge").join(one, (F.col("key") == F.col("have")) & (F.col("part") == F.col("there")) & F.col("want").isNotNull(), "left")
    headers = F.when(F.col("status") == "resolved", _merged(F.col("old"), F.col("new")))
    return joined.select("revisit_id", "response_id", "canonical_url", "status", headers.alias("headers"), F.when(F.col("status") == "resolved", F.col("payload")).alias("payload"))


def capture_log(pages: DataFrame) -> DataFrame:
    """Records of captures made of pages: a page stands for a capture of its site's section (host and first step of the
    path), at twice its page_id. Two of three are full responses; two of three are (also) revisited a second later, at the
    URL by another scheme and with tracking, so that a revisit refers to an earlier page's response, to its own or to none.
    Validators change every 64 pages (tags) or 7 (dates); revisits have by turns the tag, the same as a weak one, another
    one, a date alone, or none."""
    section = F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*/*[^/?#]*", 0)
    mark = F.md5(F.concat(canonical_url(section), F.lit("|"), F.expr("page_id div 64").cast("string")))
    tag = F.concat(F.lit('"'), mark, F.lit('"'))
    turn, day = F.col("page_id") % 5, F.concat(F.lit("day "), F.expr("page_id div 7").cast("string"))
    at = F.col("page_id") * 2
    pairs = lambda **kv: F.map_filter(F.create_map(*(x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v))), lambda _, v: v.isNotNull())
    response = F.struct(
        at.alias("record_id"), section.alias("url"), at.alias("at"), F.lit("response").alias("type"),
        pairs(Content_Type=F.lit("text/html"), Content_Length=F.length("html").cast("string"), ETag=tag, Last_Modified=day, Date=at.cast("string")).alias("headers"), F.col("html").alias("payload"),
    )
    etag = F.when(turn == 0, tag).when(turn == 1, F.concat(F.lit("W/"), tag)).when(turn == 2, F.lit('"other"'))
    revisit = F.struct(
        (at + 1).alias("record_id"), F.concat(F.regexp_replace(section, "^http:", "https:"), F.lit("?utm_source=log#top")).alias("url"), (at + 1).alias("at"), F.lit("revisit").alias("type"),
        pairs(Date=(at + 1).cast("string"), Cache_Control=F.lit("max-age=60"), Content_Length=F.lit("0"), Server=F.lit("edge"), ETag=etag, Last_Modified=F.when(turn == 3, day)).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    kind = F.col("page_id") % 3
    made = F.array_compact(F.array(F.when(kind != 2, response), F.when(kind != 0, revisit)))
    return pages.select(F.explode(made).alias("r")).select("r.*")
