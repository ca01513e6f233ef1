"""The training-data operators against brute-force versions, exact round trips and SQL, with the edge cases each defines."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from heliograph.llm import chat, common, crf, embgraph, langid, linededup, minhash, mixing, omh, packing, queries, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt int, rank string, label string, x double, tree int, component string"
LONG = " ".join(f"w{i * i % 9973}" for i in range(60_000))
TEXTS = [(1, "The quick brown fox jumps over the lazy dog\nagain and again"), (2, "the quick BROWN fox jumps over the lazy dog\nagain and again"), (3, None), (4, ""), (5, " \n\t "), (6, "word"), (6, "word"), (7, LONG), (8, LONG + " tail"), (None, "no id here\nat all"), (9, "Ünïcode “text” 🎉 <|endoftext|> </s>[INST]"), (10, "x" * 5000), (11, "word")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "site-1" if (i or 0) % 3 else None, len(t or ""), 1, "a", "b", 0.5, 3, "c") for i, t in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def smallest_reachable(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    got = packing.pack_documents(docs(spark), queries.tokenizer_path()).toPandas()
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in TEXTS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(-1 if i is None else i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    g = got.fillna({"doc_id": -1})
    assert sorted(map(tuple, g[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype("int64").to_numpy().tolist())) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum([0, *s["length"]])[:-1]).all() and s["length"].sum() <= 4096


def test_packing_plan_places_everything():
    rng = np.random.default_rng(2)
    hist = {int(k): int(v) for k, v in zip(rng.integers(1, 100, 40), rng.integers(1, 50, 40), strict=True)}
    used: dict = {}
    for count, runs in packing.plan(hist, 100):
        assert sum(length * times for length, times in runs) <= 100
        for length, times in runs:
            used[length] = used.get(length, 0) + count * times
    assert used == hist


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate({97: "b", 98: "a"})
    return w


def test_long_words_are_told_apart(spark):
    """Words that a polynomial hash modulo 2^64 takes for equal: each with its complement."""
    rows = []
    for i, n in enumerate((1024, 2048, 4096)):
        w = thue_morse(n)
        rows += [(10 * i, f"begin {w} end"), (10 * i + 1, f"begin {w.translate({97: 'b', 98: 'a'})} end"), (10 * i + 2, f"BEGIN {w}  end")]
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(docs(spark, rows), k=2).collect()}
    assert got == {10 * i + j: (10 * i + j % 2, 2) for i in range(3) for j in range(3)}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_numbered_shingles_equal_tuples(k):
    rng = np.random.default_rng(k)
    texts = [" ".join(rng.choice(["a", "B", "b", "c\t", "d\n"], n)) for n in (0, 1, 2, 3, 9, 30, 30)]
    got = common.numbered_shingles([t.encode() for t in texts], k)
    name: dict = {}
    for t, s in zip(texts, got):
        assert len(s) == len(shingles(t, k)) == len(common.shingle_hashes(t.encode(), k)[0]) and (np.diff(s) > 0).all()
    for t, s in zip(texts, got):
        for u, v in zip(texts, got):
            assert len(np.intersect1d(s, v)) == len(shingles(t, k) & shingles(u, k)), name
    assert [w for part in common.words(b" ".join(b"w%d" % i for i in range(999)), 50) for w in part] == [b"w%d" % i for i in range(999)]


def test_regions_across_ranges_and_batches():
    """Rows of sorted regions, cut into ranges and batches anywhere: small regions give all pairs, dense ones all rows, joined."""
    rng = np.random.default_rng(9)
    label = np.sort(np.concatenate([np.full(n, i) for i, n in enumerate((1, 5, 2, 40, 1, 12, 13, 90, 3))]))
    rows = pd.DataFrame({"tree": 0, "label": [np.array([x, x, x, x, 7, 7, 7, 7], ">u2").tobytes() for x in label], "doc_id": np.arange(len(label)), "n_shingles": 10})
    for _ in range(60):
        ranges = np.split(np.arange(len(rows)), np.sort(rng.integers(0, len(rows), rng.integers(0, 6))))
        met = []
        for at in ranges:
            batches = [rows.iloc[x].reset_index(drop=True) for x in np.split(at, np.sort(rng.integers(0, len(at) + 1, 3)))]
            met += list(minhash._ranges(iter(batches), 80, 100))
        met = pd.concat(met)
        edges = met[met["kind"].isin([minhash.FEW, minhash.END])].assign(prefix=lambda p: [x[:8] for x in p["label"]])
        more = pd.concat([minhash.edges(g, 80, 100) for _, g in edges.groupby("prefix")]) if len(edges) else pd.DataFrame(columns=["tree", "prefix", "a", "b"])
        pairs = {(int(a), int(b)) for a, b in [*met.loc[met["kind"] == minhash.PAIR, ["a", "b"]].to_numpy(), *more.loc[more["b"].notna(), ["a", "b"]].to_numpy()]}
        dense = sorted([*met.loc[met["kind"] == minhash.DENSE, "doc_id"], *more.loc[more["b"].isna(), "a"]])
        size = np.bincount(label)
        assert dense == [i for i, x in enumerate(label) if size[x] > minhash.NEAR]
        assert pairs >= {(i, j) for i in range(len(label)) for j in range(i + 1, len(label)) if label[i] == label[j] and size[label[i]] <= minhash.NEAR}
        assert smallest_reachable(range(len(label)), pairs) == {i: int(np.searchsorted(label, x)) for i, x in enumerate(label)}


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    rows = list(TEXTS[:6]) + TEXTS[7:9]
    for i in range(20):
        base = [f"t{x}" for x in rng.integers(0, 3000, 80)]
        for j in range(4):
            own = list(base)
            for _ in range(j * 2):
                own[rng.integers(0, 80)] = f"e{rng.integers(0, 99999)}"
            rows.append((100 + i * 10 + j, " ".join(own)))
    rows += [(5000 + i, " ".join(rows[10][1].split())) for i in range(50)]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, rows), k=k).collect()}
    sets = {i: shingles(t, k) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, linked)
    assert {i: got[i]["component_id"] for i in sets} == want
    assert all(got[i]["n_shingles"] == len(s) and got[i]["kept"] == (want[i] == i) for i, s in sets.items())


def test_minhash_links_within_a_dense_group(spark):
    """600 pairs at 0.803 among 1200 sets at 0.76 of one another: nothing else links their documents."""
    core = [f"c{x}" for x in range(190)]
    rows = [(i, " ".join(core + [f"p{i // 2}x{x}" for x in range(6)] + [f"o{i}x{x}" for x in range(24)])) for i in range(1200)]
    rows += [(1200 + i, rows[0][1] + f" n{i}") for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), k=1).collect()}
    assert got == {i: i // 2 * 2 if i < 1200 else 0 for i, _ in rows}


def duck(spark, sql, **tables):
    c = duckdb.connect()
    for k, df in tables.items():
        c.register(f"_{k}", df.toArrow())
        c.execute(f"CREATE VIEW {k} AS SELECT * FROM _{k}")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(repr(sorted(dict(zip(names, r, strict=True)).items())) for r in cur.fetchall())


def spark_rows(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


def test_mixing_and_lines_equal_sql(spark):
    rows = [(i, f"common line here\nown {i} " + "w " * (i % 17), "en" if i % 3 else None, f"site-{i % 4}" if i % 5 else None, 1) for i in range(300)]
    d = spark.createDataFrame([*rows, (300, LONG, "en", "site-0", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert spark_rows(mixing.production(d, fraction=0.8, max_epochs=2, seed=1)) == duck(spark, mixing.SQL, documents=d)
    out = linededup.drop_boilerplate(d).select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    assert spark_rows(out) == duck(spark, linededup.SQL, documents=d) and out.where("n_dropped = 1").count() == 300


def test_lines_keep_edge_cases(spark):
    got = linededup.drop_boilerplate(docs(spark), max_ratio=0.9)
    assert got.count() == len(TEXTS) and got.where("doc_id = 3 and text is null and n_lines = 0").count() == 1


def test_mixing_takes_a_repeated_id_once(spark):
    got = mixing.production(docs(spark), fraction=1.0, max_epochs=1, seed=1)
    assert got.where("doc_id = 6").count() <= 1 and got.groupBy("doc_id").count().where("count > 1").isEmpty()


def test_revisits(spark):
    m = {"ETag": "a", "Content-Type": "t", "Date": "1"}
    rows = [
        (1, "http://www.x.org:80/p", 10, 200, m, "d1", 5), (2, "https://X.org:443/p#f", 20, 304, {"etag": "W/a", "date": "2", "content-length": "0"}, None, None), (3, "http://x.org/p", 30, 304, {"etag": "b"}, None, None),
        (4, "http://x.org/p", 5, 304, None, None, None), (5, None, 1, 200, m, "d5", 1), (6, "http://x.org/p", 40, 304, None, None, None), (7, "http://x.org/p", 50, 404, None, None, None), (8, "http://x.org/p", None, 304, {"etag": "a"}, None, None),
    ]
    r = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, digest string, length long")
    got = {x["record_id"]: x for x in warc.resolve_revisits(r.withColumn("pid", F.lit(1)).withColumn("last", F.lit("x"))).collect()}
    assert {k: v["outcome"] for k, v in got.items()} == {1: "full", 2: "resolved", 3: "mismatch", 4: "missing", 5: "full", 6: "unverified", 7: "other", 8: "missing"}
    assert got[2]["headers"] == {"etag": "W/a", "date": "2", "content-type": "t"} and got[2]["digest"] == "d1" and got[3]["original_id"] == 1


def test_urls(spark):
    want = {"http://X.org:443": "x.org:443/", "https://x.org:80/a": "x.org:80/a", "HTTPS://u@www.x.org:443?": "x.org/", "//x.org:80": "x.org/", "http://[::1]:8080/p": "[::1]:8080/p", "http://[FE::1]": "[fe::1]/", "no url ": "no url"}
    d = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r["u"]: r["k"] for r in d.select("u", warc.canonical_url(F.col("u")).alias("k")).collect()} == want


def test_equal_records_have_an_order(spark):
    rows = [(1, "http://x.org", 1, s, {"etag": e}, d, None) for s, e, d in [(304, "a", None), (200, "a", "d1"), (200, "b", "d2"), (304, "b", None), (304, "b", None)]]
    r = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, digest string, length long")
    got = [sorted((x["outcome"], x["digest"]) for x in warc.resolve_revisits(r.repartition(n).select(*r.columns, F.lit(1).alias("url_key"), F.lit(2).alias("shown"))).select("outcome", F.coalesce("digest", F.lit("")).alias("digest")).collect()) for n in (1, 4)]
    assert got[0] == got[1] == [("full", "d1"), ("full", "d2"), ("mismatch", ""), ("resolved", "d2"), ("resolved", "d2")]


def test_fingerprints(spark):
    rows = omh.fingerprint_edits(docs(spark)).collect()
    got = {r["doc_id"]: r for r in rows}
    order = sorted([(i, t or "") for i, t in TEXTS], key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)  # each row; the two of id 6 are equal
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    assert got[6]["fingerprint"] == got[11]["fingerprint"] and got[3]["fingerprint"] == got[4]["fingerprint"]
    assert 0.05 < got[7]["near_edited"] <= 1 and got[8]["near_next"] > 0.9 - 0.3 * ([i for i, _ in order][[i for i, _ in order].index(8) + 1] != 7)


def test_order_matters_to_fingerprints(spark):
    w = [f"a{i}" for i in range(300)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:299] + ["zz"])), (3, " ".join(w[150:] + w[:150]))]
    f = {r["k"]: r["fingerprint"] for r in omh.fingerprints(spark.createDataFrame(rows, "k long, t string"), ["k"], "t").collect()}
    same = lambda a, b: sum(f[a][i : i + 4] == f[b][i : i + 4] for i in range(0, 256, 4))
    assert same(1, 2) > 55 and same(1, 3) < same(1, 2)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hashed(*values):
    """Chained 64-bit xxHash from seed 42 of strings and longs."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True) if not isinstance(v, np.int32) else int(v).to_bytes(4, "little", signed=True), seed)
    return signed(seed)


def fingerprint(text):
    """The fingerprint by its definition: of each bin of numbered k-mers the least, two bins in text order hashed together."""
    w = re.findall(r"[^\x20\x09-\x0D]{1,24}", text)
    least, count = {}, {}
    for pos in range(len(w)):
        kmer = hashed(w[pos], w[pos + 1]) if pos + 1 < len(w) else hashed(w[pos])
        count[kmer] = count.get(kmer, 0) + 1
        h = hashed(kmer, np.int32(count[kmer]))
        u = h & (1 << 64) - 1
        at = (u & 1, (h >> 1) & (omh.SIZE - 1))
        least[at] = min(least.get(at, (1 << 64, 0)), (signed((u >> 33) << 32 | pos), pos))
    out = []
    for j in range(omh.SIZE):
        a, b = least.get((0, j)), least.get((1, j))
        if not a and not b:
            out.append(omh.NONE)
            continue
        chosen = [x for x in ((a, b) if a and (not b or b[1] >= a[1]) else (b, a)) if x]
        out.append(f"{hashed(*[x[0] >> 32 for x in chosen]) & 0xFFFF:04x}")
    return "".join(out)


def test_fingerprints_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = ["one", "two words", "a a a a b a a", "x" * 80, "ünï cödé 🎉 x", *(" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in (5, 60, 900))]
    got = {r["k"]: r["fingerprint"] for r in omh.fingerprints(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), ["k"], "t").collect()}
    assert got == {i: fingerprint(t) for i, t in enumerate(texts)}


def line_features(text):
    """The features of a text's lines, one at a time."""
    lines = [x for x in re.findall(r"[^\n]*\n|[^\n]+", text)]
    own = []
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    for line in lines:
        b, w = line.encode(), words(line)
        c = [0] * 40
        for x in b:
            c[1 if 97 <= x <= 122 else 2 if 65 <= x <= 90 else 3 if 48 <= x <= 57 else 4 if x == 32 else 5 if x == 9 else 6 if x >= 128 else 7 + marks.index(chr(x)) if chr(x) in marks else 0] += 1
        n, gaps, letters, m = len(b), c[4] + c[5] + 1, c[1] + c[2] + c[6], sum(c[7:])
        shape = [sum(x == y for x, y in zip(w, w[1:])) / gaps, len(set(w)) / max(1, len(w)) ** 0.5 / 8, np.log1p(n) / 8, letters / gaps / 10, m / gaps, letters / n, c[2] / max(1, letters), float(n < 4), c[3] / gaps]
        own.append([*(np.sqrt(np.array(c) / n)), *np.minimum(shape, 4)])
    none = [0.0] * 49
    return np.array([[*x, *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), 1.0] for i, x in enumerate(own)]).reshape(-1, crf._WIDTH), [len(x.encode()) for x in lines]


def chains(x, theta, pair):
    """(labels, unnormalised probability) of every labelling of a text's lines."""
    s = x @ theta
    for y in np.ndindex(*[2] * len(x)):
        yield y, np.exp(sum(s[i] for i in range(len(x)) if y[i]) + sum(pair[a, b] for a, b in zip(y, y[1:])))


LINES = ["Good words here.\nAnd here TOO 12\n\nthe the the end", "!!! $$$\n\ttab\n~", "einzig", "a\n" * 6, "Ünï\nß ẞ\n"]


def test_quality_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    theta, pair = rng.normal(size=crf._WIDTH), rng.normal(size=(2, 2))
    got = {r["doc_id"]: r["score"] for r in crf.score(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(LINES)], "doc_id long, text string, lang string, source string, n_chars long"), {"theta": theta, "pair": pair, "prior": 0.5}).collect()}
    for i, t in enumerate(LINES):
        x, n = line_features(t)
        total, good = 0.0, np.zeros(len(x))
        for y, p in chains(x, theta, pair):
            total, good = total + p, good + p * np.array(y)
        assert got[i] == pytest.approx((good / total) @ n / sum(n))


def test_quality_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(6)
    p, y, weights = rng.normal(size=crf._WIDTH + 4) * 0.3, np.array([1, 0, 1, 0, 1]), np.array([1.0, 2.0, 0.5, 1.0, 1.0])
    parts = [line_features(t)[0] for t in LINES]

    def likelihood(p):
        theta, pair = p[: crf._WIDTH], p[crf._WIDTH :].reshape(2, 2)
        out = 0.0
        for x, label, w in zip(parts, y, weights):
            every = dict(chains(x, theta, pair))
            out += w / len(x) * np.log(every[(label,) * len(x)] / sum(every.values()))
        return out / weights.sum()

    got = crf.gradient(p, np.concatenate(parts), np.cumsum([0, *map(len, parts)]), y, weights)
    for i in [*rng.integers(0, crf._WIDTH, 6), *range(crf._WIDTH, crf._WIDTH + 4)]:
        e = np.zeros_like(p)
        e[i] = 1e-5
        assert got[i] == pytest.approx((likelihood(p + e) - likelihood(p - e)) / 2e-5, abs=1e-6)


def test_language_takes_the_smallest_encoding(spark):
    import zstandard as z

    model = {"en": b"the quick brown fox jumps over the lazy dog and again", "de": "der schnelle braune fuchs springt über den faulen hund".encode()}
    texts = ["the brown fox and the dog", "DER braune HUND, 12!", "x" * 20000 + " über den hund", LONG]
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        letters = b" ".join(bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in t.lower().encode()).split())
        size = {k: sum(len(z.ZstdCompressor(level=langid.LEVEL, dict_data=z.ZstdCompressionDict(v, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(letters[j : j + langid.CHUNK])) for j in range(0, len(letters), langid.CHUNK)) for k, v in model.items()}
        margin = max(size.values()) / min(size.values()) - 1
        assert got[i]["margin"] == pytest.approx(margin, abs=0.02) and got[i]["rejected"] == (got[i]["margin"] < 0.01)
        assert margin < 0.02 or got[i]["lang_pred"] == min(size, key=size.get)


def test_quality_and_language_on_held_out_rows(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    q = queries.op7_quality(spark, SF).join(lab, "doc_id").where("held_out").toPandas()
    assert (q["predicted"] == q["quality"]).mean() > 0.9
    lang = queries.op9_language(spark, SF).join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (lang["lang_pred"] == lang["lang"]).mean() > 0.9


def test_models_take_odd_texts(spark):
    p = crf.descend(pa.array(["good words in a row\nand more", "!!! $$$ @@@\n###"]), np.array([1, 0]), np.ones(2))
    model = {"theta": p[: crf._WIDTH], "pair": p[crf._WIDTH :].reshape(2, 2), "prior": 0.5}
    got = crf.score(docs(spark).withColumn("score", F.lit("own")), model, keep=("score", "rank")).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["score_of_docs"] == "own" and r["rank"] == "a" for r in got)
    lang = langid.predict(docs(spark), {"en": b"the quick brown fox", "de": b"der schnelle braune fuchs"}).collect()
    assert len(lang) == len(TEXTS) and {r["lang_pred"] for r in lang if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert {r["lang_pred"] for r in langid.predict(docs(spark), {}).collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    u, t = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    g, pairs = crf.forward_backward(u, t, np.array([0, 4]))
    p = np.zeros((4, 2))
    total = 0.0
    for y in np.ndindex(2, 2, 2, 2):
        w = np.exp(sum(u[i, y[i]] for i in range(4)) + sum(t[y[i], y[i + 1]] for i in range(3)))
        total += w
        for i in range(4):
            p[i, y[i]] += w
    assert np.allclose(g, p / total) and np.isclose(pairs.sum(), 3)


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]\\l\\"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "assistant", None), (2, 0, None, ""), (2, 1, "we\nird[role", "x\n\ny"), (None, 0, "user", "u"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(chat.fold_events(chat.event_log(conv)))).collect()}
    for c in (1, 2, None, 3):
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)


def test_chat_takes_repeats_long_texts_and_other_columns(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, "system", "first"), (2, 0, "assistant", LONG), (2, 1, "user", LONG)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(3).alias(c) for c in ("i", "n", "e", "seq", "message_id", "hc", "reset", "turns")])
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(chat.fold_events(chat.event_log(conv)))).collect()}
    sha = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha([("system", "first"), ("user", "x"), ("user", "x")])
    assert got[2]["turns_sha256"] == sha([("assistant", LONG), ("user", LONG)]) and got[2]["loss_chars"] == len(LONG)


def test_events_fold(spark):
    log = [(1, 1, "m", "open", "assistant", None), (1, 2, "m", "delta", None, "draft"), (1, 3, "m", "regenerate", None, None), (1, 4, "m", "delta", None, "a"), (1, 5, "m", "edit", None, "E"), (1, 6, "m", "delta", None, "b"), (1, 7, "m", "unknown", None, "z"), (2, 1, "n", "delta", "user", "t")]
    got = {r["conv_id"]: (r["role"], r["text"]) for r in chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, message_id string, event string, role string, text string")).collect()}
    assert got == {1: ("assistant", "Eb"), 2: ("user", "t")}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    x = [(i, (base[i % 30] + rng.normal(size=16) * 0.12).tolist(), i % 3) for i in range(240)]
    x += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, x[0][1], x[0][2]), (1004, x[0][1], None), (1005, [1.0], 0), (1006, [None] * 16, 1), (0, x[0][1], x[0][2])]
    d = spark.createDataFrame(x, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("k")).withColumn("n", F.lit(1))
    ok = [(i, np.array(v), c) for i, v, c in x[:-1] if c is not None and i not in (1000, 1001, 1002, 1006)]  # the last row repeats the first
    linked = [(a, b) for a, v, c in ok for b, w, e in ok if a < b and c == e and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
    want = smallest_reachable([r[0] for r in x], linked)
    got = {r["vec_id"]: r for r in embgraph.near_duplicates(d, per_shard=40).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    n = {i: sum(i in p for p in linked) for i in want}
    assert {i: r["n_links"] for i, r in got.items()} == n
    dealt = {r["vec_id"]: r for r in embgraph.near_duplicates(d, per_shard=40, block=12).collect()}  # shards of several blocks
    assert {i: (r["component_id"], r["n_links"]) for i, r in dealt.items()} == {i: (want[i], n[i]) for i in want}
    deep = {r["vec_id"]: r for r in embgraph.near_duplicates(d, per_shard=4, fan=3, sample=30).collect()}  # shards split again and again
    assert {i: (r["component_id"], r["n_links"]) for i, r in deep.items()} == {i: (want[i], n[i]) for i in want}
    assert embgraph.audit(d, embgraph.near_duplicates(d, per_shard=40), every=10).first()["recall"] >= 0.9


def test_embeddings_without_clusters_keep_their_links(spark):
    """Diffuse vectors, where shards have no gaps between them, and a partner for each at a cosine of 0.93 to 0.95."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    c = rng.uniform(0.93, 0.95, size=(len(x), 1))
    y = c * x + np.sqrt(1 - c * c) * e / np.linalg.norm(e, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>, label int")
    shared = embgraph.shards(embgraph.usable(d, "vec_id", "embedding", "label").withColumn("n", F.lit(1).cast("long")), 0.93, 100, 1000, 32)
    assert shared.where("home").count() == len(x) * 2 and shared.select("grp").distinct().count() > 8
    got = embgraph.near_duplicates(d, per_shard=100, sample=1000)
    assert embgraph.audit(d, got, every=5).first()["recall"] > 0.95


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 900)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(e).collect()}
    assert got == dict.fromkeys(range(201), 0)


EMPTY = {
    "packing": lambda d: packing.pack_documents(d, queries.tokenizer_path()), "minhash": minhash.near_duplicates, "mixing": lambda d: mixing.production(d, fraction=0.8, max_epochs=2, seed=1), "lines": linededup.drop_boilerplate, "fingerprints": omh.fingerprint_edits,
    "quality": lambda d: crf.score(d, crf.train(d, d.select("doc_id", F.lit(1).alias("quality")))), "language": lambda d: langid.predict(d, langid.train(d)),
    "warc": lambda d: warc.resolve_revisits(warc.page_records(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html")))),
    "chat": lambda d: chat.digests(chat.format_conversations(chat.fold_events(chat.event_log(d.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("lang").alias("role"), "text"))))),
    "embeddings": lambda d: embgraph.near_duplicates(d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), "label")),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables_give_no_rows(spark, name):
    assert EMPTY[name](docs(spark, [])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 50 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, SF).collect()}
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in d.collect()}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert kept == {i for i, c in smallest_reachable(sets, linked).items() if i == c}


@pytest.fixture(scope="module")
def odd(spark):
    """The smallest documents and rows with nulls, repeats, very long texts, an id of two texts, and columns of clashing names."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    own = [(1, "same id, other text entirely", "en", "site-1", None), (None, None, None, None, None), (None, "no id and a few words", "en", None, 3), (None, "no id and a few words", "en", None, 3), (9001, "", "en", "site-2", 0), (9002, "  \n ", "de", "site-2", 1), (9003, LONG, "en", "site-3", 5), (9004, LONG + " end", "en", "site-3", 5), (None, "another one without id", None, "site-1", 1)]
    own += [(9100 + i, f"menu of the site\nabout the number {i} and its own page", "en", "site-9", 1) for i in range(8)]
    names = ["row", "key", "keep", "host", "score", "predicted", "salt", "kind", "tree", "label", "epoch", "tokens", "pid", "rank", "sample", "h", "t1", "drop", "share", "w"]
    return d.union(spark.createDataFrame(own, d.schema)).select("*", *[F.lit(7).alias(c) for c in names])


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(spark, odd):
    import corpus_pipeline

    out = corpus_pipeline.quality(spark, odd, SF)
    assert out.columns == COLUMNS
    model = crf.train(odd, spark.read.parquet(f"{SF}/labels.parquet"))
    want = []
    for r in odd.select(*COLUMNS).collect():
        x, n = line_features(r["text"] or "")
        g = crf.forward_backward(np.stack([np.zeros(len(x)), x @ model["theta"]], 1), model["pair"], np.array([0, len(x)]))[0][:, 1] if len(x) else np.zeros(0)
        if (g @ n / sum(n) if len(x) else model["prior"]) >= 0.3:
            want.append(tuple(r))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert out.where("doc_id is null and text is null").count() == 1


def test_lines_stage(spark, odd):
    import corpus_pipeline

    out = corpus_pipeline.lines(spark, odd, SF)
    assert out.columns == COLUMNS
    rows = odd.select(*COLUMNS).collect()
    pages: dict = {}
    for host, text in {(r["source"], r["text"]) for r in rows if r["text"] is not None}:
        pages.setdefault(host, []).append({x.strip(" ") for x in text.split("\n")} - {""})
    drop = {h: {x for x in set().union(*p) if sum(x in q for q in p) >= 5 and sum(x in q for q in p) > 0.05 * len(p)} for h, p in pages.items()}
    clean = lambda r: None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if x.strip(" ") not in drop[r["source"]])
    want = [(r["doc_id"], clean(r), r["lang"], r["source"], None if r["text"] is None else len(clean(r))) for r in rows]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want)) and any(drop.values())


def test_boilerplate_on_either_side_of_the_ratio(spark):
    rows = [(i, "\n".join([f"own words of page {i}", *["menu"] * (i < 6), *["rights"] * (i < 5), *["rare"] * (i < 4)]), "en", "small" if i < 20 else "big", 1) for i in range(120)]
    rows += [(1000 + i, f"page {i}\n" + "\n".join(["footer"] * (i < 11) + ["quote"] * (i < 10)), "en", "wide", 1) for i in range(200)]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[0] == "own words of page 0\nrare" and got[4].endswith("page 4") and got[1000] == "page 0\nquote"


def test_near_duplicates_stage(spark, odd):
    import corpus_pipeline

    out = corpus_pipeline.near_duplicates(spark, odd, SF)
    assert out.columns == COLUMNS
    rows = odd.select(*COLUMNS).collect()
    sets = {i: shingles(r["text"], 5) for i, r in enumerate(rows)}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    groups: dict = {}
    for i, c in smallest_reachable(sets, linked).items():
        groups.setdefault(c, []).append(rows[i])
    first = lambda g: min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(tuple(first(g))) for g in groups.values())
    assert out.where("doc_id is null").count() == 3 and out.where("doc_id in (1, 9001, 9002)").count() >= 4


def test_mixing_stage(spark, odd):
    import corpus_pipeline

    out = corpus_pipeline.mixture(spark, odd, SF)
    assert out.columns == COLUMNS
    rows = odd.select(*COLUMNS).collect()
    key = lambda r: hashlib.md5("|".join(["none" if r["doc_id"] is None else str(r["doc_id"]), str(r["text"] is None).lower(), *([r["text"]] if r["text"] is not None else [])]).encode()).hexdigest()
    keyed = spark.createDataFrame([(key(r), *r[1:]) for r in rows], "doc_id string, text string, lang string, source string, n_chars long")
    taken = duckdb.connect()
    taken.register("documents", keyed.toArrow())
    cur = taken.execute(mixing.SQL)
    at = [x[0] for x in cur.description].index("doc_id")
    of: dict = {}
    for r in rows:
        of.setdefault(key(r), []).append(tuple(r))
    want = [x for r in cur.fetchall() for x in of[r[at]]]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want)) and len(want) > len(rows) / 2


def test_packing_stage(spark, odd):
    from tokenizers import Tokenizer

    import corpus_pipeline

    got = corpus_pipeline.packed(spark, odd, SF).toPandas()
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(-1 if r["doc_id"] is None else r["doc_id"], s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    assert sorted(map(tuple, got.fillna({"doc_id": -1})[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype("int64").to_numpy().tolist())) == sorted(want)
    fill = got.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 4096 and len(fill) <= -(-fill.sum() // 4096) + 1


def test_stages_of_an_empty_table(spark, odd):
    import corpus_pipeline

    assert all(stage(spark, odd.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_labels_and_vectors_are_kept_apart(spark):
    rows = [(1, [2.0, 3.0], "1"), (2, [3.0], "1,2.0"), (3, [2.0, 3.0], "1"), (4, [5.0], "1,2.0")]
    got = {r["vec_id"]: r for r in embgraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (1, 2, 3, 4)] == [(1, 1), (1, 2), (1, 1), (1, 2)]


def test_dense_regions_compared_without_values_give_the_same(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:40] + [f"x{i}_{j}" for j in range(i % 12)] + base[40:])) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(tuple(r) for r in minhash.near_duplicates(d, k=2, slack=s).collect()) for s in (minhash.SLACK, None))
    assert a == b
    sets = {i: shingles(t, 2) for i, t in rows}
    linked = [(i, j) for i, s in sets.items() for j, t in sets.items() if i < j and 100 * len(s & t) >= 80 * len(s | t)]
    assert {r[0]: r[3] for r in a} == smallest_reachable(sets, linked)


def test_minhash_reads_texts_twice_and_merges_them_at_any_size(spark, monkeypatch, capsys):
    """Texts are read for the sketches and dealt out once more, for pairs and dense regions together; none is broadcast, or
    meets broadcast rows, where tables are small, so that the shuffle follows the input."""
    base, plans = [f"w{i}" for i in range(60)], {}
    rows = [(i, " ".join(base[:40] + [f"x{i}_{j}" for j in range(i % 12)] + base[40:])) for i in range(60)] + [(60 + i, f"alone {i} " * 3) for i in range(40)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def planned(links):
        capsys.readouterr()
        links.explain()
        plans["links"] = capsys.readouterr().out
        return links

    links = minhash.dense_links
    monkeypatch.setattr(minhash, "dense_links", lambda *a: planned(links(*a)))
    d = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(d, k=2).collect()}
    sets = {i: shingles(t, 2) for i, t in rows}
    assert got == smallest_reachable(sets, [(i, j) for i, s in sets.items() for j, t in sets.items() if i < j and 100 * len(s & t) >= 80 * len(s | t)])
    assert seen.value == 2 * len(rows)
    assert "SortMergeJoin" in plans["links"] and "BroadcastHashJoin" not in plans["links"]


def test_every_row_has_a_fingerprint_of_its_own(spark):
    """Rows that share an id or have none are documents each; the least possible id is one like others."""
    rows = [(5, "alpha beta gamma delta " * 3), (5, "one two three four"), (None, "no id at all here"), (None, "another one without"), (-(1 << 63), "the least id"), (9, None), (7, "alpha beta gamma delta " * 3), (5, "one two three four")]
    got = omh.fingerprint_edits(docs(spark, rows)).collect()
    assert len(got) == 8
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""), r[1] != "one two three four"))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i is not None, i or 0, len(t or "")) for i, t in rows)
    texts = [t or "" for _, t in order][::-1]  # descending
    want = []
    for k, t in enumerate(texts):
        following, half = texts[(k + 1) % 8], len(t) // 2
        want.append(hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest())
    assert sorted(r["edited_sha256"] for r in got) == sorted(want)
    same = {r["fingerprint"] for r in got if r["n_chars"] == len(rows[0][1])}
    assert len(same) == 1
