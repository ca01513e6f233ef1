"""Mixing sources to target weights by hierarchical budgets.

A tree of domain, language and source shares a token budget by weight. A node that can't use its share (its tokens times
the epochs allowed) leaves the rest to its siblings first; only what a whole subtree can't use reaches its ancestors'
siblings. Each leaf then takes the prefix of its seeded epochs that its budget pays for.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

DIGITS = 3  # hex digits of an order's hash that deal a leaf's last epoch over 16^DIGITS tasks, so that a hot leaf is many


def weight(level: str, weights: Mapping[str, int], other: int = 1) -> Column:
    """The integer weight of a node's name; other for names that aren't listed."""
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def share(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """children (parent, level, cap, w, budget of the parent) with share: each takes budget by weight, up to its cap.

    Children that are full at their weight's share, in order of cap per weight, take their caps; the others split what
    remains by weight, rounded down. Integers throughout, products in 38 digits. Siblings are ordered in ranges, whose sums
    are carried across, so a parent of any number of children is many tasks.
    """
    df = children.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(0)).withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(float("inf")))
    df = written(df.repartitionByRange(*parent, "ratio", level).withColumn("pid", F.spark_partition_id()), "children")
    sums = df.groupBy("pid", *parent).agg(F.sum("cap").alias("c"), F.sum("w").alias("v"))
    along, own = W.partitionBy(*parent).orderBy("pid"), W.partitionBy("pid", *parent).orderBy("ratio", level)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    sums = sums.select("pid", *parent, before("c", along).alias("c0"), after("v", along).alias("v1"))  # a row a range and parent
    df = df.withColumn("own_c", before("cap", own)).withColumn("own_v", after("w", own)).join(sums, ["pid", *parent])
    df = df.withColumn("rem", F.col("budget") - F.col("c0") - F.col("own_c")).withColumn("rest", F.col("w") + F.col("own_v") + F.col("v1"))
    df = df.withColumn("full", (F.col("w") > 0) & (_wide("cap") * _wide("rest") <= _wide("rem") * _wide("w"))).select(*parent, level, "cap", "w", "budget", "full")
    df = written(df, "full")
    total = df.groupBy(*parent).agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0)).alias("taken"), F.sum(F.when(~F.col("full"), F.col("w"))).alias("open"))
    df = df.join(total, parent) if parent else df.crossJoin(F.broadcast(total))  # one row
    left = F.expr("cast((budget - taken) as decimal(38,0)) * w div open")
    return df.select(*parent, level, F.when(F.col("full"), F.col("cap")).when(F.col("w") > 0, left).otherwise(0).cast("long").alias("share"))


def budgets(leaves: DataFrame, levels: list[str], weights: list[Mapping[str, int]], other: list[int], budget: Column) -> DataFrame:
    """leaves (levels, tokens, cap), in few rows and already written, with the budget of each leaf."""
    given = leaves.agg(F.coalesce(budget, F.lit(0)).cast("long").alias("budget"))  # one row
    for i, level in enumerate(levels):
        child = leaves.groupBy(*levels[: i + 1]).agg(F.sum("cap").alias("cap")).withColumn("w", weight(level, weights[i], other[i]))
        child = child.join(given, levels[:i]) if i else child.crossJoin(F.broadcast(given))
        given = share(child, levels[:i], level).withColumnRenamed("share", "budget")
    return leaves.join(given, levels)


def mix(docs: DataFrame, levels: list[tuple[str, Column]], weights: list[Mapping[str, int]], *, id_col: str = "doc_id", tokens: Column, fraction: float = 0.8, max_epochs: int = 2, seed: int = 1, other: list[int] | None = None) -> DataFrame:
    """doc_id, the levels, tokens, epoch: the documents taken, once for each epoch that takes them.

    The budget is fraction of all tokens. A leaf's epochs follow each other, each in the order of md5(seed|epoch|id); a
    document is taken whole if its first token is within the leaf's budget. Defined cases: null names of a level are
    'unknown'; null tokens count as 0; rows that repeat an id are one document, the smallest by path and tokens; a weight
    of 0 takes nothing; a text of any length counts as a whole; empty tables give no rows; other columns of docs are
    ignored.
    """
    names = [n for n, _ in levels]
    d = docs.select(F.col(id_col).alias("doc_id"), F.struct(*[F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in levels], F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens")).alias("x"))
    d = written(d.groupBy("doc_id").agg(F.min("x").alias("x")).select("doc_id", "x.*"), "mix")
    leaves = written(d.groupBy(*names).agg(F.sum("tokens").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs), "leaves")
    plan = budgets(leaves, names, weights, other or [1] * len(names), F.floor(F.sum("tokens") * F.lit(fraction)))
    plan = written(plan.where("tokens > 0 and budget > 0").select(*names, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("part")), "plan")
    all_ = d.join(plan, names).select("doc_id", *names, "tokens", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("epoch"), "whole")
    full = all_.where("epoch < whole").select("doc_id", *names, "tokens", "epoch")
    last = all_.where("epoch = whole and part > 0").withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string"))))
    last = last.withColumn("bucket", F.conv(F.substring("h", 1, DIGITS), 16, 10).cast("int"))
    starts = last.groupBy(*names, "bucket").agg(F.sum("tokens").alias("t"))
    starts = starts.select(*names, "bucket", F.coalesce(F.sum("t").over(W.partitionBy(*names).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    w = W.partitionBy(*names, "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    prefix = last.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0))).join(starts, [*names, "bucket"]).where("start + before < part")
    return full.unionByName(prefix.select("doc_id", *names, "tokens", "epoch"))


def production(docs: DataFrame, **given) -> DataFrame:
    """mix() with the production tree, weights and token measure of documents (text, lang, source)."""
    n = F.regexp_extract(F.col("source"), r"(\d+)$", 1)
    domain = F.when(F.col("source").isNull(), "unknown").when(n == "0", "crawl").when(F.try_to_number(n, F.lit("999999999")) % 2 == 1, "books").otherwise("forums")
    tokens = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1
    weights = [{"crawl": 40, "books": 35, "forums": 25}, {"en": 60, "de": 15, "fr": 15, "es": 10}, {}]
    return mix(docs, [("domain", domain), ("lang", F.col("lang")), ("source", F.col("source"))], weights, tokens=tokens, **given)


def _level(i: int, names: list[str], w: str) -> str:
    path, parent = ", ".join(names[: i + 1]), ", ".join(names[:i])
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"ORDER BY CASE WHEN w > 0 THEN cap / w END NULLS LAST, {names[i]}"
    return f"""
c{i} AS (SELECT {path}, budget, sum(cap)::BIGINT AS cap, ({w})::BIGINT AS w FROM n{i} GROUP BY {path}, budget),
a{i} AS (SELECT *, budget - coalesce(sum(cap) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem, sum(w) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c{i}),
f{i} AS (SELECT *, w > 0 AND cap * rest <= rem * w AS is_full FROM a{i}),
s{i} AS (SELECT {path}, CASE WHEN is_full THEN cap WHEN w > 0 THEN ((budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({by}), 0)) * w) // sum(CASE WHEN NOT is_full THEN w END) OVER ({by}) ELSE 0 END AS budget FROM f{i}),
n{i + 1} AS (SELECT n.* EXCLUDE (budget), s.budget FROM n{i} n JOIN s{i} s USING ({path})),"""


SQL = (
    """
WITH d AS (SELECT doc_id, min(struct_pack(domain := CASE WHEN source IS NULL THEN 'unknown' WHEN regexp_extract(source, '(\\d+)$', 1) = '0' THEN 'crawl' WHEN TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 2 = 1 THEN 'books' ELSE 'forums' END, lang := coalesce(lang, 'unknown'), source := coalesce(source, 'unknown'), tokens := coalesce(length(text) - length(replace(text, ' ', '')) + 1, 0))) AS x FROM documents GROUP BY doc_id),
docs AS (SELECT doc_id, x.domain AS domain, x.lang AS lang, x.source AS source, x.tokens AS tokens FROM d),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * 2)::BIGINT AS cap FROM docs GROUP BY ALL),
n0 AS (SELECT *, (SELECT floor(sum(tokens) * 0.8::DOUBLE)::BIGINT FROM leaves) AS budget FROM leaves),"""
    + _level(0, ["domain"], "CASE domain WHEN 'crawl' THEN 40 WHEN 'books' THEN 35 WHEN 'forums' THEN 25 ELSE 1 END")
    + _level(1, ["domain", "lang"], "CASE lang WHEN 'en' THEN 60 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 10 ELSE 1 END")
    + _level(2, ["domain", "lang", "source"], "1")
    + """
plan AS (SELECT domain, lang, source, (budget // tokens)::BIGINT AS whole, (budget % tokens)::BIGINT AS part FROM n3 WHERE tokens > 0 AND budget > 0),
every AS (SELECT doc_id, domain, lang, source, tokens, part, whole, unnest(range(whole + 1)) AS epoch FROM docs JOIN plan USING (domain, lang, source)),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('1|' || epoch || '|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM every)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, epoch::BIGINT AS epoch FROM placed WHERE epoch < whole OR before < part
"""
)
