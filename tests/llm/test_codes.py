"""Vector codes against a plain Lloyd iteration and their SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from heliograph.llm import codes, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code int, q string, part string, n string, sums string, error string, of string, v int"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows (vec_id, vector, label) -> (vec_id, code, error, label_error, digest), sorted; Python's integers throughout."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    w = width // parts
    cut = [[(v + [0] * (width - len(v)))[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def nearest(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(x[p], books[p])[0] for x in cut]
            for e in range(len(books[p])):
                own = [x[p] for x, a in zip(cut, at, strict=True) if a == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    got = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    error = [sum(d for _, d in g) for g in got]
    by = {}
    for (_, _, g), e in zip(kept, error, strict=True):
        by[g] = by.get(g, 0) + e
    return sorted(((i, "".join(f"{a:02x}" for a, _ in c), e, by[g], digest) for (i, _, g), c, e in zip(kept, got, error, strict=True)), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, 1, "a", "b", "c", "d", "e", "f", 2) for i, v, g in rows], SCHEMA)


def coded(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [0, 5, 300])
def test_equals_the_plain_iteration(spark, n):
    """Null vectors, null, NaN and infinite components, repeated and null ids, equal vectors, null labels, clashing columns."""
    g = np.random.default_rng(n)
    rows = [(int(g.integers(0, 10_000)), [float(x) for x in np.float32(g.normal(0, 0.1, 16))], int(g.integers(0, 3)) or None) for _ in range(n)]
    if n:
        same = [0.25, -0.125] * 8
        rows += [(3, None, 1), (4, [None] + [0.1] * 15, 1), (5, [float("nan")] * 16, 1), (6, [0.1] * 15 + [float("inf")], 1), (None, [0.5] * 16, 1), (rows[0][0], same, 2), *[(-i, same, None) for i in range(30)]]
    assert coded(codes.encode(vectors(spark, rows))) == plain(rows)


def test_odd_lengths_and_large_values(spark):
    rows = [(i, [float(i * j % 7) for j in range(i % 4 + 3)], i) for i in range(40)] + [(100, [], 1), (101, [200_000.0, -250_000.0, 3.0], 1)]
    assert coded(codes.encode(vectors(spark, rows), entries=3, rounds=3)) == plain(rows, entries=3, rounds=3)
    far = coded(codes.encode(vectors(spark, [(1, [3e38, -3e38], 1), (2, [0.0, 0.0], 1)]), entries=1))
    assert len(far) == 2 and all(0 <= r[2] <= codes.MOST and len(r[1]) == 16 for r in far)


def test_only_changed_parts_travel():
    g = np.random.default_rng(1)
    x, books = g.integers(-50, 50, (400, 16)), g.integers(-50, 50, (8, 4, 2))
    old, error = codes.assign(x, books)
    assert error.tolist() == [sum(int(((x[i, p * 2 : p * 2 + 2] - books[p, old[i, p]]) ** 2).sum()) for p in range(8)) for i in range(400)]
    sums, count = np.zeros((8, 4, 2), np.int64), np.zeros((8, 4), np.int64)
    codes.differences(x, None, old, sums, count)
    new, _ = codes.assign(x, books + g.integers(-9, 9, books.shape))
    codes.differences(x, old, new, sums, count)
    fresh, n = np.zeros((8, 4, 2), np.int64), np.zeros((8, 4), np.int64)
    codes.differences(x, None, new, fresh, n)
    assert (sums == fresh).all() and (count == n).all() and count.sum() == 3200


def test_query_and_sql(spark):
    df = queries.op12_codes(spark, SF)
    rows = coded(df)
    own = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    assert rows == plain([tuple(r) for r in own])
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = c.execute(queries.ORACLE_SQL["op12_codes"])
    assert [d[0] for d in got.description] == df.columns
    assert sorted(got.fetchall(), key=str) == rows


def test_decoded_vectors_are_near(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(0, 1, 8)], 1) for i in range(16)]
    state = spark.createDataFrame([(i, 1, [math.floor(4096 * np.float32(x)) for x in v]) for i, v, _ in rows], "vec_id long, label int, q array<int>")
    books, _ = codes.codebooks(codes.written(state, "t"), "int", 8, 16, 0)
    out = codes.decode(codes.encode(vectors(spark, rows), rounds=0), books).collect()
    assert all(np.abs(np.array(r["vector"]) - np.array(rows[r["vec_id"]][1])).max() < 1e-3 for r in out) and len(out) == 16
