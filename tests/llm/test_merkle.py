"""The dataset manifest against a plain version of its definition and against its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from heliograph.llm import merkle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, idx string, n string, level string, digest string, grp int, leaf int, other int, changed string, _u int, _p int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(lv, i):
    for nodes in lv[:-1]:
        b = i // 8 * 8
        yield nodes[b:i], nodes[i + 1 : b + 8]
        i //= 8


def plain(rows):
    """rows (doc_id, source, lang, n_chars, text) -> the results, sorted."""
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in langs:
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, levels([leaf(r) for r in own])))
    top = levels([lv[-1][0] for _, lv in trees])
    out = []
    for k, (own, lv) in enumerate(trees):
        for i, r in enumerate(own):
            sides = [*path(lv, i), *path(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            acc = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if hit else lv[0][i]
            for a, b in sides:
                acc = h("".join(a) + acc + "".join(b))
            out.append((r[0], lv[0][i], lv[-1][0], top[-1][0], h("".join(x for a, b in sides for x in a + b)), acc, acc == top[-1][0]))
    return sorted(out, key=str)


def manifest(docs):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.manifest(docs, FIELDS, tampered={"text": merkle.ascii_lower("text")}, where=changed)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 9, 700])
def test_groups_of_every_size(spark, n):
    """Groups of n, of one and of a few rows; nulls in every column, repeated rows and ids, long texts, clashing names."""
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} ÄÖ 🎉 Z") for i in range(n)]
    if n > 1:
        rows += [(5, None, None, None, None), (None, "s", "en", 1, "No Id"), (None, None, None, 2, "X"), (3, "s", "en", 3, "Again"), (3, "s", "en", 3, "Again"), (9, "s", "é", 4, ""), (10, "s", "", 5, "Q" * 300_000), (-4, "s", "z", 6, "a b")]
        rows += [(i, "s", f"lang{i}", 1, "ABC") for i in range(20)]
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], 1, "a", "b", "c", "d", 2, 3, 4, "e", 5, 6) for r in rows], SCHEMA)
    assert manifest(docs) == plain(rows)


def test_a_changed_fan_out(spark):
    docs = spark.createDataFrame([(i, "t", "x", "s", 1) for i in range(37)], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs, FIELDS, bits=1).collect()
    assert len(got) == 37 and all(r.verified for r in got) and len({r.proof_sha256 for r in got}) == 37


def test_query_and_sql(spark):
    df = queries.op11_merkle(spark, SF)
    rows = sorted((tuple(r) for r in df.collect()), key=str)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*FIELDS)
    assert rows == plain([tuple(r) for r in docs.collect()])
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = c.execute(queries.ORACLE_SQL["op11_merkle"])
    assert [d[0] for d in got.description] == df.columns
    assert sorted(got.fetchall(), key=str) == rows


def test_proofs_are_looked_up_without_a_broadcast(spark):
    """Explodes are not in Spark's sizes, so a table that looks small may be thirty times as large."""
    leaves = spark.range(5000).select(F.lit(0).cast("long").alias("tree"), F.lit(5000).cast("long").alias("n"), F.col("id").alias("idx"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    plan = merkle.siblings(leaves, merkle.nodes(leaves, 5, 3), 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
