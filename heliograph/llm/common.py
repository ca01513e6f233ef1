"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured: a temporary one if Spark is one local process
    (tests), else ValueError, as executors could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str, release: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends here and lost executors don't redo it. release: the job's
    shuffle files go with its end, not when the driver next collects its garbage."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", spark.conf.get(FREE, None)
    try:
        if release:
            spark.conf.set(FREE, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            spark.conf.set(FREE, before) if before else spark.conf.unset(FREE)
    return spark.read.parquet(path)


def bucketed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """df as a table in buckets of key in the shared folder: joins and groups by key need no shuffle of it.

    It has a bucket for each of spark.sql.shuffle.partitions, so that what joins it is dealt alike."""
    spark, name = df.sparkSession, f"{tag}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def removed(df: DataFrame) -> None:
    """Takes a table made by written() off the shared folder, once nothing will read it again; other files stay."""
    spark, own = df.sparkSession, lambda p: re.sub(r"^\w+:(//[^/]*)?", "", p).rstrip("/")
    root = own(shared_dir(spark))
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own(path).startswith(f"{root}/"):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df, a table that is written already, with idx: a row's place, from 0, among those of its key in the given order.

    Rows are dealt by ranges of (key, order), so a key of any number of rows is many tasks; equal rows are told apart by
    their place in the table. The sums that are carried across are a row for each range and key.
    """
    at = df.withColumn("_u", F.monotonically_increasing_id()).repartitionByRange(key, *order, "_u").sortWithinPartitions(key, *order, "_u")
    at = written(at.drop("_u").withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_p", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = at.groupBy(key, "_p").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).select(key, "_p", (before - F.col("_first")).alias("_shift"))
    return at.join(starts, [key, "_p"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_p", "_shift")


def kept_as(name: str, results: list[str]) -> str:
    """The name that a column carried along gets beside an operator's results."""
    return f"{name}_of_docs" if name in results else name


def held_out(doc_id: Column | str) -> Column:
    """True for the ids whose crc32, as text, leaves no rest by 5; those rows never teach a model."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(ids: DataFrame, key: str, order: list[str], n: int, salts: int = 64) -> DataFrame:
    """Up to n rows of each key, the smallest by md5 of the order columns: alike at every size and in any partitioning.

    Two rounds: n of each (key, salt), then n of each key, so a hot key is never sorted in one task.
    """
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order]))
    df = ids.withColumn("_h", h).withColumn("_s", F.pmod(F.xxhash64("_h"), F.lit(salts)))
    for by in ([key, "_s"], [key]):
        df = df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_h", *order))).where(F.col("_r") <= n)
    return df.drop("_h", "_s", "_r")


# ---- words of many texts at once -------------------------------------------------------------

_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_R = 0x9E3779B97F4A7C15
_POW = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for k, base in (("p", _R), ("i", pow(_R, -1, 1 << 64))):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _POW[k] = np.multiply.accumulate(full)
    return _POW["p"], _POW["i"]


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string array as its bytes and the n+1 places where texts begin; null: empty."""
    import pyarrow as pa

    texts = texts.fill_null("").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, size: int = 1 << 20):
    """Ranges of texts of about size bytes together, one text at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased, runs without white space), and the number of words before each text.

    For features only: a polynomial modulo 2^64, under which some words of a thousand and more characters are alike. What
    decides links uses shingle_hashes and numbered_shingles.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = ~_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, inverse = _powers(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * p[:n], out=c[1:])
    h = mix64((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, at)


class _Digests(dict):
    """128-bit hashes of words as bytes; those of words that aren't long are kept until too many are."""

    def __missing__(self, w: bytes) -> bytes:
        got = blake2b(w, digest_size=16).digest()
        if len(w) < 64:
            if len(self) >= 200_000:
                self.clear()
            self[w] = got
        return got


class _Numbers(dict):
    def __missing__(self, w) -> int:
        self[w] = n = len(self)
        return n


_digests = _Digests()
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words(text: bytes, size: int = 1 << 20):
    """The words of a text (A-Z lower-cased, runs without white space), in lists: those of about size bytes at once."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each distinct k-word shingle of a text (of all words together if fewer), sorted by
    the first."""
    h = np.frombuffer(b"".join(b"".join(map(_digests.__getitem__, w)) for w in words(text)), np.uint64).reshape(-1, 2)
    n = min(k, len(h))
    s = np.full((len(h) - n + 1 if n else 0, 2), n, np.uint64)
    for i in range(n):
        s = mix64(s * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(s)])
    first = np.unique(s[:, 0], return_index=True)[1]
    return s[first, 0], s[first, 1]


def numbered_shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct numbers of its k-word shingles (of all words together if fewer). Shingles of these
    texts have equal numbers if and only if their words are equal: nothing is hashed."""
    number, short = _Numbers(), _Numbers()
    of = [np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words(t))]) for t in texts]
    w = np.concatenate([np.zeros(0, np.int64), *of])
    at = np.cumsum([0, *map(len, of)])
    s = w
    for i in range(1, k):
        s = np.unique(s[: max(0, len(w) - i)] * len(number) + w[i:], return_inverse=True)[1]
    most = len(w)
    return [np.unique(s[a : b - k + 1]) if b - a >= k else np.full(min(1, b - a), most + (short[tuple(w[a:b].tolist())] if b > a else 0)) for a, b in zip(at[:-1], at[1:], strict=True)]


# ---- connected components ---------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any ids -> (id, component): the smallest id that each id of an edge reaches.

    Each round hooks every vertex to its smallest neighbour, follows the pointers once, and contracts the graph; the rounds
    grow with the logarithm of the graph's size. All of it stays in Spark tables.
    """
    cur = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    while not cur.isEmpty():
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        hook = written(hook.join(up, "p").select("a", F.col("pp").alias("p")), "hook")
        to = lambda side: hook.select(F.col("a").alias(side), F.col("p").alias(f"p{side}"))
        cur = written(cur.join(to("a"), "a").join(to("b"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        label = written(label.join(hook.withColumnRenamed("a", "component"), "component", "left").select("id", F.coalesce("p", "component").alias("component")), "label")
    return label
