"""Repeated passages against a plain version; suffix arrays against sorting."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm import queries, suffixes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, place string, anchor string, found string, a int, z int, c string, row string, kind int, b string"


def plain(rows, length=100):
    """rows (doc_id, text) in order -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256), sorted."""
    seen, out = set(), []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for t in range(len(raw) - length + 1):
            s = raw[t : t + length]
            if s in seen:
                gone[t : t + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((i, len(raw), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", 1, 2, "e", "f", 3, "g") for i, t in rows], SCHEMA)


def removed(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 50])
def test_suffix_array(alphabet):
    g = np.random.default_rng(alphabet)
    for n in (1, 2, 3, 10, 60, 300):
        for _ in range(20):
            s = np.append(g.integers(1, alphabet + 1, n), 0)
            if n > 10:
                k = n // 3
                s[k : 2 * k] = s[:k]
            want = sorted(range(n + 1), key=lambda i: s[i:].tolist())
            assert suffixes.suffix_array(s).tolist() == want
            group, before = suffixes.lyndon_groups(s)

            def prefix(i):
                j = next((j for j in range(i + 1, n + 1) if s[j:].tolist() < s[i:].tolist()), n + 1)
                return s[i:j].tolist()

            p = [prefix(i) for i in range(n + 1)]
            assert all((group[i] == group[j]) == (p[i] == p[j]) and (group[i] < group[j]) == (p[i] < p[j]) for i in range(0, n + 1, 7) for j in range(n + 1))
            assert all(before[i] == max((j for j in range(i) if group[j] < group[i]), default=-1) for i in range(n + 1))


def mixture(g, n):
    """Texts that share passages, words, copies with edits, and runs of one character."""
    passage = ["".join(chr(g.integers(97, 123)) for _ in range(g.integers(60, 400))) for _ in range(12)]
    out = []
    for k in range(n):
        parts = []
        for _ in range(g.integers(0, 6)):
            kind = g.integers(0, 6)
            p = passage[g.integers(0, 12)]
            if kind < 3:
                a = int(g.integers(0, len(p) // 2))
                parts.append(p[a : int(g.integers(a, len(p)))] if kind else p)
            elif kind == 3:
                parts.append("x" * int(g.integers(1, 250)))
            elif kind == 4:
                parts.append("ÄÖ🎉 and " * int(g.integers(1, 30)))
            else:
                parts.append("".join(chr(g.integers(97, 123)) for _ in range(g.integers(1, 200))))
        out.append((int(k * 3 % n if n % 3 else k), " ".join(parts)))
    return out


def test_equals_the_plain_version(spark):
    g = np.random.default_rng(3)
    rows = mixture(g, 100)
    rows = [(1000, None), (1001, ""), (1002, "y" * 99), (1003, "y" * 100), (1004, "y" * 101), *rows]
    assert removed(suffixes.drop_repeats(frame(spark, rows).repartition(7))) == plain(sorted(rows))


def test_anchors_of_many_contexts_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "WIDE", 3)
    g = np.random.default_rng(5)
    line = "".join(chr(g.integers(97, 123)) for _ in range(70))
    rows = mixture(g, 40) + [(500 + i, f"{'abcdefgh'[i % 8] * (i % 5)}{i % 4} {line} {i % 3} tail {'zyx'[i % 3] * 40}") for i in range(60)]
    assert removed(suffixes.drop_repeats(frame(spark, rows))) == plain(sorted(rows))


def test_repeated_ids_null_ids_and_empty_tables(spark):
    t = "".join(f"{i * i % 977} " for i in range(200))
    rows = [(None, t), (None, t[:300]), (4, t), (4, t), (2, t[50:400]), (9, t + t)]
    got = removed(suffixes.drop_repeats(frame(spark, rows).coalesce(1)))
    assert got == plain([rows[0], rows[1], rows[4], rows[2], rows[3], rows[5]])
    assert removed(suffixes.drop_repeats(frame(spark, []))) == []


def test_long_texts_in_pieces(spark, monkeypatch):
    g = np.random.default_rng(8)
    base = "".join(chr(x) for x in g.integers(97, 123, 6000))
    rows = [(1, base), (2, base[3000:] + base[:2500]), (3, "q" * 50 + base[100:5000])]
    small, whole = suffixes._pieces, suffixes.BATCH

    def pieces(texts, length):
        suffixes.BATCH = 1500
        return small(texts, length)

    import pyarrow as pa

    texts = pa.array([r[1] for r in rows])
    seen = []
    try:
        for rows_, data, at, base_ in pieces(texts, 100):
            text, lo, n, _, _ = suffixes.runs(data, at, 100)
            seen += [(int(rows_[i]), int(x - at[i] + base_ + k)) for i, x, m in zip(text, lo, n, strict=True) for k in range(m)]
    finally:
        suffixes.BATCH = whole
    assert sorted(seen) == [(i, k) for i, (_, t) in enumerate(rows) for k in range(len(t) - 99)]
    assert removed(suffixes.drop_repeats(frame(spark, rows))) == plain(rows)


def test_kept_text(spark):
    rows = [(1, "a" * 40 + "é" * 80), (2, "start " + "é" * 80 + " end")]
    out = suffixes.drop_repeats(frame(spark, rows), keep_text=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in out)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy(F.col("doc_id")).collect()
    assert removed(queries.op13_suffixes(spark, SF)) == plain([tuple(r) for r in docs])
