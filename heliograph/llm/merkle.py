"""A Merkle manifest of a dataset: leaves of rows, a tree for each group, a root over the groups, and every leaf's proof.

Leaves are numbered in ranges, so a hot group is many tasks. A level is one aggregation of the level below, written as a
table. A proof is looked up: each leaf explodes the coordinates (level, place) of the siblings that its place and its
group's size require, joins the node table on them, and folds what comes back in order.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

BLOCK_LEVELS = 4  # leaves of one block, fanout^BLOCK_LEVELS, share a copy of a node they ask for; no join key is hotter
LEVELS = 20  # of a tree at most: 8^20 leaves


def encoded(*cols: str) -> Column:
    """'-' for a null, else UTF-8 byte count, ':', value; concatenated."""
    text = [F.col(c).cast("string") for c in cols]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _levels(bits: int) -> Column:
    """The levels of the tree of n leaves that have more than one node."""
    return F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.col("n") > F.call_function("shiftleft", F.lit(1).cast("long"), k * bits))


def _up(c: Column, levels: Column) -> Column:
    return F.call_function("shiftright", c, levels)


def nodes(leaves: DataFrame, depth: int, bits: int) -> DataFrame:
    """leaves (tree, idx, n, digest), n the tree's number of leaves -> all nodes (tree, n, level, at, digest)."""
    cur = leaves.select("tree", "n", F.lit(0).alias("level"), F.col("idx").alias("at"), "digest")
    out = cur
    for level in range(depth):
        run = F.array_sort(F.collect_list(F.struct("at", "digest")))
        joined = F.concat_ws("", F.transform(run, lambda x: _hex(x["digest"])))
        up = cur.where(F.col("n") > 1 << bits * level).groupBy("tree", "n", F.shiftright("at", bits).alias("at")).agg(F.unhex(digest(joined)).alias("digest"))
        cur = written(up.select("tree", "n", F.lit(level + 1).alias("level"), "at", "digest"), "nodes")
        out = out.union(cur)
    return out


def siblings(leaves: DataFrame, tree: DataFrame, bits: int) -> DataFrame:
    """(tree, idx, proof): of each leaf that has siblings on some level, those in order, as (level, at, hex digest)."""
    fan, block = 1 << bits, BLOCK_LEVELS * bits

    def of_level(k: Column) -> Column:
        own = _up(F.col("idx"), k * bits)
        first = _up(F.col("idx"), (k + 1) * bits) * fan
        last = F.least(first + (fan - 1), _up(F.col("n") - 1, k * bits))
        return F.transform(F.filter(F.sequence(first, last), lambda s: s != own), lambda s: F.struct(k.alias("level"), s.alias("at")))

    asked = leaves.select("tree", "idx", F.explode(F.flatten(F.transform(_levels(bits), of_level))).alias("x")).select("tree", F.shiftright("idx", block).alias("block"), "x.level", "x.at", "idx")
    width = (F.col("level") + 1) * bits
    first = F.call_function("shiftleft", F.shiftright("at", bits), width)
    last = F.least(first + F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1, F.col("n") - 1)
    given = tree.where(F.col("n") > F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level") * bits))
    given = given.select("tree", F.explode(F.sequence(F.shiftright(first, block), F.shiftright(last, block))).alias("block"), "level", "at", "digest")
    # both sides are exploded, which Spark's sizes leave out: either could be taken for small enough to broadcast
    found = asked.join(given.hint("merge"), ["tree", "block", "level", "at"])
    proof = F.array_sort(F.collect_list(F.struct("level", "at", "digest")))
    return found.groupBy("tree", "idx").agg(F.transform(proof, lambda x: F.struct(x["level"].alias("level"), x["at"].alias("at"), _hex(x["digest"]).alias("digest"))).alias("proof"))


def _joined(proof: Column) -> Column:
    return F.concat_ws("", F.transform(proof, lambda x: x["digest"]))


def folded(start: Column, idx: Column, depth: Column, proof: Column, bits: int) -> Column:
    """The tree's root as a leaf's hex digest, its place, the number of levels above it and its siblings give it."""

    def step(acc: Column, k: Column) -> Column:
        own = _up(idx, k * bits)
        side = lambda before: _joined(F.filter(proof, lambda s: (s["level"] == k) & ((s["at"] < own) if before else (s["at"] > own))))
        return digest(F.concat(side(True), acc, side(False)))

    return F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: k < depth), start, step)


def _depth(n: int, bits: int) -> int:
    return next(k for k in range(LEVELS + 1) if n <= 1 << bits * k)


def manifest(docs: DataFrame, fields: list[str], *, id_col: str = "doc_id", group_col: str = "lang", tampered: dict[str, Column] | None = None, where: Column | None = None, bits: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each of docs.

    A leaf hashes the encoded fields. Per group_col leaves ascend by id_col; every 2^bits consecutive nodes become their
    hash until one is left, the subroot; subroots, by group (null first, bytewise), likewise give the root. folded_root is
    what a leaf and its proof give: where `where` holds, the leaf of the row with `tampered` columns in place of its own.

    Defined cases: null fields are '-'; a null id comes before all others and is not tampered with if `where` is null for
    it; rows that repeat an id are leaves each, ordered by their digests; a lone leaf is its subroot, and a lone subroot
    the root, with the hash of nothing as its proof where no level has siblings; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    names = {f: f"_{i}" for i, f in enumerate(fields)}
    both = docs.select(group.alias("grp"), F.col(id_col).alias("doc_id"), digest(encoded(*fields)).alias("leaf"), *[F.col(f).alias(names[f]) for f in fields], *[c.alias(f"t{names[f]}") for f, c in (tampered or {}).items()], F.coalesce(where if where is not None else F.lit(False), F.lit(False)).alias("changed"))
    # the leaf of the tampered row, where there is one
    again = digest(encoded(*[f"t{names[f]}" if f in (tampered or {}) else names[f] for f in fields]))
    base = written(both.select("grp", "doc_id", F.unhex("leaf").alias("leaf"), F.when(F.col("changed"), F.unhex(again)).alias("other")), "leaves")
    groups = numbered(base.groupBy("grp").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), "all", ["grp"])
    groups = written(groups.select("grp", "n", F.col("idx").alias("tree")), "groups")
    most, n_groups = groups.agg(F.max("n"), F.count("*")).first()  # two numbers
    placed = numbered(base, "grp", ["doc_id", "leaf"]).join(groups, "grp")
    leaves = written(placed.select("tree", "n", "idx", "doc_id", "leaf", "other"), "placed")
    inner = nodes(leaves.withColumn("digest", F.col("leaf")), _depth(most or 1, bits), bits)
    tops = inner.where(F.col("n") <= F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level") * bits)).select("tree", "digest", "level")
    subroots = written(tops.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_groups).cast("long").alias("n"), "digest", F.col("level").alias("depth")), "subroots")
    top = _depth(n_groups or 1, bits)
    outer = nodes(subroots, top, bits)
    root = outer.where(F.col("level") == top).select("digest").first()  # one digest
    upper = subroots.join(siblings(subroots, outer, bits).drop("tree"), "idx", "left")
    upper = written(upper.select(F.col("idx").alias("tree"), _hex(F.col("digest")).alias("subroot"), "depth", F.col("proof").alias("upper")), "upper")

    none = F.array().cast("array<struct<level:int,at:bigint,digest:string>>")
    out = leaves.join(siblings(leaves, inner, bits), ["tree", "idx"], "left").join(upper, "tree")
    out = out.select("*", F.coalesce("proof", none).alias("low"), F.coalesce("upper", none).alias("high"), F.lit(_as_hex(root)).alias("root"))
    end = folded(folded(_hex(F.coalesce("other", "leaf")), F.col("idx"), F.col("depth"), F.col("low"), bits), F.col("tree"), F.lit(top), F.col("high"), bits)
    out = out.select("doc_id", _hex(F.col("leaf")).alias("leaf"), "subroot", "root", digest(F.concat(_joined(F.col("low")), _joined(F.col("high")))).alias("proof_sha256"), end.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _as_hex(row) -> str | None:
    return bytes(row[0]).hex() if row else None


def ascii_lower(c: str) -> Column:
    return F.translate(F.col(c), string.ascii_uppercase, string.ascii_lowercase)


def _sql(depth: int = 8) -> str:
    """DuckDB SQL of the manifest of documents, for groups of up to 8^depth leaves."""
    enc = lambda t: " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ["doc_id", "source", "lang", "n_chars", t])
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    steps = [f"s{i + 1} AS (SELECT i, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END AS x FROM s{i})" for i in range(8)]
    out = [
        "WITH s0 AS (SELECT i, i AS x FROM range(256) r(i))",
        *steps,
        "tab AS (SELECT list(x ORDER BY i) AS t FROM s8)",
        "crc AS (SELECT doc_id AS cid, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS c FROM (SELECT DISTINCT doc_id FROM documents), tab)",
        f"base AS (SELECT row_number() OVER () AS r, d.doc_id, lang, sha256({enc('text')}) AS leaf, CASE WHEN c % 3 = 0 THEN sha256({enc(f"translate(text, '{upper}', '{lower}')")}) ELSE sha256({enc('text')}) END AS other FROM documents d LEFT JOIN crc ON doc_id = cid)",
        "numbered AS (SELECT r, doc_id, leaf, other, dense_rank() OVER (ORDER BY lang IS NOT NULL, lang) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM base)",
        "g0 AS (SELECT tree, n, idx, leaf AS d FROM numbered)",
        "p0 AS (SELECT r, tree, idx, n, other AS acc, '' AS proof FROM numbered)",
    ]

    def levels(g: str, p: str, k: int) -> list[str]:
        many, own = f"n > {8**k}", f"p.idx // {8**k}"
        up = f"{g}{k + 1} AS (SELECT tree, n, CASE WHEN {many} THEN idx // 8 ELSE idx END AS idx, CASE WHEN {many} THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE min(d) END AS d FROM {g}{k} GROUP BY tree, n, CASE WHEN {many} THEN idx // 8 ELSE idx END)"
        side = lambda op: f"coalesce(string_agg(g.d, '' ORDER BY g.idx) FILTER (g.idx {op} {own}), '')"
        fold = f"{p}{k + 1} AS (SELECT r, p.tree, p.idx, p.n, CASE WHEN any_value(p.{many}) THEN sha256({side('<')} || any_value(acc) || {side('>')}) ELSE any_value(acc) END AS acc, CASE WHEN any_value(p.{many}) THEN any_value(proof) || {side('<')} || {side('>')} ELSE any_value(proof) END AS proof FROM {p}{k} p JOIN {g}{k} g ON p.tree = g.tree AND p.idx // {8 ** (k + 1)} = g.idx // 8 GROUP BY r, p.tree, p.idx, p.n)"
        return [up, fold]

    for k in range(depth):
        out += levels("g", "p", k)
    out.append(f"h0 AS (SELECT 0 AS tree, count(*) OVER () AS n, tree AS idx, d FROM g{depth})")
    out.append(f"q0 AS (SELECT r, 0 AS tree, p.tree AS idx, h0.n AS n, acc, proof, p.tree AS own FROM p{depth} p JOIN h0 ON h0.idx = p.tree)")
    for k in range(depth):
        up, fold = levels("h", "q", k)
        out += [up, fold]
    out.append(f"root AS (SELECT d AS root FROM h{depth})")
    return ", ".join(out) + f" SELECT doc_id, leaf, g{depth}.d AS subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM q{depth} q JOIN numbered USING (r) JOIN g{depth} ON g{depth}.tree = numbered.tree, root"


SQL = _sql()
