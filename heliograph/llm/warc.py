"""Not-modified revisits in web archives, resolved to the full response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

# Header fields that describe the body or the connection; a 304 must not change them.
KEPT_OF_ORIGINAL = ["connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)([?]?[^#]*)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, path and query; without scheme, user, its scheme's default port, fragment or a bare
    query mark. A host may be an address in brackets. What isn't a URL stays as it is, without spaces around it."""
    u = F.trim(url)
    part = lambda i: F.regexp_extract(u, _URL, i)
    default = F.when(F.lower(part(1)) == "https", "443").otherwise("80")
    port = F.when(part(3).isin("") | (part(3) == default), "").otherwise(F.concat(F.lit(":"), part(3)))
    path = F.when(part(4) == "", "/").otherwise(part(4))
    query = F.when(part(5) == "?", "").otherwise(part(5))
    return F.when(part(2) == "", u).otherwise(F.concat(F.regexp_replace(F.lower(part(2)), r"^www[.]", ""), port, path, query))


def _plain(headers: Column) -> Column:
    """Header names in lower case; of names that then repeat, the last counts."""
    e = F.transform(F.map_entries(headers), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
    names = F.transform(e, lambda x: x["key"])
    return F.map_from_entries(F.filter(e, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), x["key"])))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per record: record_id, url_key, ts, status, original_id, outcome, headers, digest, length.

    records: record_id, url, ts, status, headers map<string, string>, digest, length. A record of status 200 is a full
    response; a 304 takes the latest full response of its canonical URL at an earlier (ts, record_id). Their validators are
    compared: ETags (weakly) if both have one, else Last-Modified if both have one. outcome is full, resolved, unverified
    (no common validator), mismatch (original_id tells which), missing (no earlier response) or other (another status).
    Resolved and unverified revisits get the original's digest and length, and its headers updated by those of the 304
    that a 304 may change. Records are ordered in ranges of (URL, time), so that a hot URL is many ranges; the last full
    response before a range is carried into it. Defined cases: null headers are none; a null URL is one key; records
    without time come before others; records equal in URL, time and id are ordered by status, digest, length and headers,
    nulls first, so a full response precedes a revisit; repeated rows are resolved each; very long URLs and headers are kept
    whole; empty tables give no rows; other columns are ignored.
    """
    ties = ["status", "digest", "length", "shown"]
    r = records.select("record_id", F.coalesce(canonical_url(F.col("url")), F.lit("")).alias("url_key"), "ts", "status", _plain(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).alias("headers"), "digest", "length").withColumn("shown", F.array_sort(F.map_entries("headers")).cast("string"))
    r = r.repartitionByRange("url_key", "ts", "record_id").withColumn("pid", F.spark_partition_id())
    r = written(r, "records")
    full = F.when(F.col("status") == 200, F.struct("record_id", "headers", "digest", "length"))
    w = W.partitionBy("pid", "url_key").orderBy("ts", "record_id", *ties)
    own = r.withColumn("seen", F.last(full, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    last = r.where("status = 200").groupBy("pid", "url_key").agg(F.max_by(F.struct("record_id", "headers", "digest", "length"), F.struct("ts", "record_id", *ties)).alias("last"))
    ranges = r.select("pid", "url_key").distinct().join(last, ["pid", "url_key"], "left")
    carry = ranges.select("pid", "url_key", F.last("last", ignorenulls=True).over(W.partitionBy("url_key").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)).alias("carried")).where("carried is not null")
    own = own.join(carry, ["pid", "url_key"], "left").withColumn("o", F.when(F.col("status") == 304, F.coalesce("seen", "carried")))
    tag, otag = _tag(F.col("headers")["etag"]), _tag(F.col("o.headers")["etag"])
    when, owhen = F.col("headers")["last-modified"], F.col("o.headers")["last-modified"]
    fits = F.when(tag.isNotNull() & otag.isNotNull(), tag == otag).when(when.isNotNull() & owhen.isNotNull(), when == owhen)
    outcome = F.when(F.col("status") == 200, "full").when(F.col("status").isNull() | (F.col("status") != 304), "other").when(F.col("o").isNull(), "missing").when(fits, "resolved").when(fits.isNull(), "unverified").otherwise("mismatch")
    own = own.withColumn("outcome", outcome)
    taken = F.col("outcome").isin("resolved", "unverified")
    update = F.map_filter("headers", lambda k, v: ~k.isin(KEPT_OF_ORIGINAL))
    merged = F.map_concat(F.map_filter("o.headers", lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    pick = lambda c: F.when(taken, F.col(f"o.{c}")).when(F.col("outcome") != "mismatch", F.col(c))
    return own.select("record_id", "url_key", "ts", "status", F.col("o.record_id").alias("original_id"), "outcome", F.when(taken, merged).otherwise(F.col("headers")).alias("headers"), pick("digest").alias("digest"), pick("length").alias("length"))


def page_records(pages: DataFrame) -> DataFrame:
    """A capture log of pages (page_id, url, html): each page in full, and two later 304s, by other spellings of its URL;
    the validators of the second, for every fifth page, are stale. record_id: 4 * page_id, and 1 and 2 more."""
    h = lambda **kw: F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in kw]), F.array(*[v.cast("string") for v in kw.values()]))
    md5, n = F.md5(F.coalesce("html", F.lit(""))), F.length(F.coalesce("html", F.lit("")))
    day = (F.col("page_id") * 7919 % 100000).cast("long")
    base = pages.select("page_id", "url", md5.alias("md5"), n.cast("long").alias("n"), day.alias("t"))
    loud = F.regexp_replace(F.col("url"), "#.*$", "")
    kinds = F.array(
        F.struct(F.lit(0).alias("k"), F.col("url").alias("url"), F.col("t").alias("ts"), F.lit(200).alias("status"), h(**{"Content-Type": F.lit("text/html"), "Content-Length": F.col("n"), "ETag": F.col("md5"), "Date": F.col("t")}).alias("headers")),
        F.struct(F.lit(1).alias("k"), F.concat(loud, F.lit("#again")).alias("url"), (F.col("t") + 100000).alias("ts"), F.lit(304).alias("status"), h(**{"etag": F.concat(F.lit("W/"), F.col("md5")), "date": F.col("t") + 100000, "content-length": F.lit(0)}).alias("headers")),
        F.struct(F.lit(2).alias("k"), F.regexp_replace(F.col("url"), "^https?", "HTTP").alias("url"), (F.col("t") + 50000).alias("ts"), F.lit(304).alias("status"), h(**{"etag": F.when(F.col("page_id") % 5 == 0, "stale").otherwise(F.col("md5")), "date": F.col("t") + 50000}).alias("headers")),
    )
    e = base.select("page_id", "md5", "n", F.explode(kinds).alias("e"))
    own = F.col("e.k") == 0
    return e.select((F.col("page_id") * 4 + F.col("e.k")).alias("record_id"), "e.url", "e.ts", "e.status", "e.headers", F.when(own, F.col("md5")).alias("digest"), F.when(own, F.col("n")).alias("length"))


_KEY = "CASE WHEN h = '' THEN u ELSE regexp_replace(lower(h), '^www[.]', '') || CASE WHEN p = '' OR p = CASE WHEN lower(s) = 'https' THEN '443' ELSE '80' END THEN '' ELSE ':' || p END || CASE WHEN pa = '' THEN '/' ELSE pa END || CASE WHEN q = '?' THEN '' ELSE q END END"
SQL = f"""
WITH b AS (SELECT page_id, url, md5(coalesce(html, '')) AS m, length(coalesce(html, ''))::BIGINT AS n, (page_id * 7919 % 100000)::BIGINT AS t FROM pages),
r AS (
  SELECT page_id * 4 AS record_id, url, t AS ts, 200 AS status, m AS etag, t AS day, m AS digest, n AS length FROM b
  UNION ALL SELECT page_id * 4 + 1, regexp_replace(url, '#.*$', '') || '#again', t + 100000, 304, m, t + 100000, NULL, NULL FROM b
  UNION ALL SELECT page_id * 4 + 2, regexp_replace(url, '^https?', 'HTTP'), t + 50000, 304, CASE WHEN page_id % 5 = 0 THEN 'stale' ELSE m END, t + 50000, NULL, NULL FROM b),
x AS (SELECT *, trim(url) AS u, regexp_extract(trim(url), '{_URL}', 1) AS s, regexp_extract(trim(url), '{_URL}', 2) AS h, regexp_extract(trim(url), '{_URL}', 3) AS p, regexp_extract(trim(url), '{_URL}', 4) AS pa, regexp_extract(trim(url), '{_URL}', 5) AS q FROM r),
k AS (SELECT record_id, {_KEY} AS url_key, ts, status, etag, day, digest, length FROM x),
o AS (SELECT *, CASE WHEN status = 304 THEN last_value(CASE WHEN status = 200 THEN struct_pack(id := record_id, etag := etag, digest := digest, length := length) END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS orig FROM k),
f AS (SELECT *, CASE WHEN status = 200 THEN 'full' WHEN orig IS NULL THEN 'missing' WHEN orig.etag = etag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM o)
SELECT record_id, url_key, ts, status, coalesce(orig.id, -1) AS original_id, outcome,
  CASE WHEN outcome = 'full' THEN 'content-length=' || length || '&content-type=text/html&date=' || day || '&etag=' || etag
       WHEN outcome = 'resolved' THEN 'content-length=' || orig.length || '&content-type=text/html&date=' || day || '&etag=' || CASE WHEN record_id % 4 = 1 THEN 'W/' ELSE '' END || etag
       ELSE CASE WHEN record_id % 4 = 1 THEN 'content-length=0&' ELSE '' END || 'date=' || day || '&etag=' || CASE WHEN record_id % 4 = 1 THEN 'W/' ELSE '' END || etag END AS headers,
  CASE WHEN outcome = 'resolved' THEN orig.digest ELSE digest END AS digest, coalesce(CASE WHEN outcome = 'resolved' THEN orig.length ELSE length END, -1) AS length
FROM f
"""
