"""Boilerplate lines by their frequency on a site, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_as, written

SALTS = 16  # a line is dealt over so many keys in the join; what is then still large is split as a skewed join at run time
RATIO, PAGES = 0.05, 5  # a line on more than one page in twenty is a site's template; fewer than five pages are none


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("l1"), F.xxhash64(F.lit(1), line).alias("l2")]


def drop_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_ratio: float = RATIO, min_pages: int = PAGES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_lines, n_dropped and the columns keep for every row: its text without lines that are boilerplate on its host.

    A line, without spaces at its ends, is boilerplate if more than max_ratio of its host's pages have it, and min_pages at
    least. Pages of equal text on a host count once, so copies don't make their own lines boilerplate. Defined cases: a
    null text stays null with no lines; empty lines are never dropped; a null host is a host of its own; repeated rows
    are cleaned each; a very long text is split into its lines whole; empty tables give no rows; other columns of docs are
    ignored, and kept ones named as a result get the suffix _of_docs.
    """
    results = ["doc_id", "text", "n_lines", "n_dropped"]
    text, host = F.col(text_col), F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.struct(F.col(host_col).isNull().alias("none"), host.alias("name")).alias("host"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("keep"))
    page = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    lines = d.where("text is not null").select("host", *page, F.explode(F.array_distinct(F.transform(F.split("text", "\n"), F.trim))).alias("line")).where("line <> ''")
    having = lines.select("host", "t1", "t2", *_hashes(F.col("line"))).distinct().groupBy("host", "l1", "l2").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    total = d.where("text is not null").select("host", *page).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    frequent = written(having.join(total, "host").where(F.col("pages") > F.lit(max_ratio) * F.col("total")).select("host", "l1", "l2"), "frequent")
    places = d.where("text is not null").select("doc_id", "host", *page, F.posexplode(F.transform(F.split("text", "\n"), F.trim)).alias("at", "line")).where("line <> ''")
    places = places.select("doc_id", "host", "t1", "t2", "at", *_hashes(F.col("line"))).withColumn("salt", F.pmod(F.xxhash64("t1", "doc_id"), F.lit(SALTS)).cast("int"))
    dealt = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    drop = places.join(dealt, ["host", "l1", "l2", "salt"]).groupBy("doc_id", "host", "t1", "t2").agg(F.collect_set("at").alias("drop"))
    drop = drop.select(F.col("doc_id").alias("d"), F.col("host").alias("h"), "t1", "t2", "drop")
    out = d.select("doc_id", "text", "host", "keep", *page).alias("x").join(drop.alias("y"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("x.t1") == F.col("y.t1")) & (F.col("x.t2") == F.col("y.t2")) & (F.col("host") == F.col("h")), "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("drop", i))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"), n.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_dropped"), *[F.col("keep")[f"k{i}"].alias(kept_as(c, results)) for i, c in enumerate(keep)])


SQL = f"""
WITH d AS (SELECT doc_id, text, source IS NULL AS no_host, coalesce(source, '') AS host, string_split(text, chr(10)) AS ls FROM documents),
pages AS (SELECT DISTINCT no_host, host, text, ls FROM d WHERE text IS NOT NULL),
total AS (SELECT no_host, host, count(*) AS total FROM pages GROUP BY ALL),
lines AS (SELECT no_host, host, line, count(*) AS pages FROM (SELECT no_host, host, unnest(list_distinct(list_transform(ls, lambda x: trim(x)))) AS line FROM pages) WHERE line <> '' GROUP BY ALL),
frequent AS (SELECT no_host, host, list(line) AS lines FROM lines JOIN total USING (no_host, host) WHERE pages >= {PAGES} AND pages > {RATIO} * total GROUP BY ALL),
kept AS (SELECT doc_id, text, ls, CASE WHEN text IS NULL THEN NULL ELSE list_filter(ls, lambda x: NOT list_contains(coalesce(lines, []), trim(x))) END AS left_ FROM d LEFT JOIN frequent USING (no_host, host))
SELECT doc_id, coalesce(len(ls), 0)::INT AS n_lines, coalesce(len(ls) - len(left_), 0)::INT AS n_dropped, md5(coalesce(array_to_string(left_, chr(10)), '')) AS text_md5 FROM kept
"""
