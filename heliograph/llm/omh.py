"""Order MinHash fingerprints of documents, in DataFrame functions only.

Words are the letters of the sketch and k-mers are pairs of neighbouring words, numbered by occurrence. The hash space of
numbered k-mers is dealt over 2 x SIZE bins; each bin keeps its minimal k-mer. Two bins form a component: their k-mers in
text order, hashed together. Equal components mean equal k-mers in equal order, so the share of equal components falls
with edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import numbered, written

SIZE, HEX = 64, 4  # components, and the hex digits of one
NONE = "." * HEX  # a component without k-mers
_WORD = r"[^\x20\x09-\x0D]{1,24}"  # longer runs are cut, so that texts without spaces have k-mers too


def likeness(a: Column, b: Column) -> Column:
    """The share of equal components among those that either fingerprint has; of two empty ones 1."""
    part = lambda s, j: F.substring(s, j * HEX + 1, F.lit(HEX))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda j: F.struct(part(a, j).alias("a"), part(b, j).alias("b")))
    some = F.filter(pairs, lambda p: (p["a"] != NONE) | (p["b"] != NONE))
    same = F.size(F.filter(some, lambda p: p["a"] == p["b"]))
    return F.when(F.size(some) == 0, F.lit(1.0)).otherwise(same / F.size(some))


def fingerprints(texts: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """key, fingerprint of each row; rows of texts must have distinct keys.

    Where texts is already partitioned by the first of key, all steps stay in that partition: no row is shuffled, and a
    very long text is sorted on disk rather than held. A text without words gives no row.
    """
    words = texts.select(*key, F.regexp_extract_all(F.col(text_col), F.lit(_WORD), F.lit(0)).alias("w"))
    grams = words.select(*key, F.posexplode(F.arrays_zip(F.col("w").alias("x"), F.expr("slice(w, 2, size(w))").alias("y"))).alias("pos", "g"))
    grams = grams.select(*key, "pos", F.xxhash64("g.x", "g.y").alias("kmer"))
    nth = F.row_number().over(W.partitionBy(*key, "kmer").orderBy("pos"))
    h = grams.select(*key, "pos", F.xxhash64("kmer", nth).alias("h"))
    h = h.select(*key, F.col("h").bitwiseAND(1).alias("half"), F.shiftright("h", 1).bitwiseAND(SIZE - 1).alias("part"), F.shiftleft(F.shiftrightunsigned("h", 33), 32).bitwiseOR(F.col("pos").cast("long")).alias("code"))
    least = h.groupBy(*key, "part").agg(F.min(F.when(F.col("half") == 0, F.col("code"))).alias("c0"), F.min(F.when(F.col("half") == 1, F.col("code"))).alias("c1"))
    at = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    r0, r1 = F.shiftright("c0", 32), F.shiftright("c1", 32)
    pair = F.when(F.col("c0").isNull() | (at("c1") < at("c0")), F.xxhash64(r1, r0)).otherwise(F.xxhash64(r0, r1))
    shown = F.lpad(F.lower(F.hex(pair.bitwiseAND((1 << 4 * HEX) - 1))), HEX, "0")
    parts = least.select(*key, F.struct("part", shown.alias("shown")).alias("p")).groupBy(*key).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    text = F.aggregate("ps", F.lit(""), lambda acc, p: F.concat(F.rpad(acc, (p["part"] * HEX).cast("int"), F.lit(".")), p["shown"]))
    return parts.select(*key, F.rpad(text, SIZE * HEX, ".").alias("fingerprint"))


def next_ids(ids: DataFrame) -> DataFrame:
    """ids (k, n_chars), distinct k -> k, next_k, before_k, before_chars in the circle of descending k.

    Ranges of k are ordered each for itself; what crosses them comes from a table of one row per range.
    """
    r = written(ids.repartitionByRange(F.col("k").desc()).withColumn("pid", F.spark_partition_id()), "ids")
    w, all_ = W.partitionBy("pid").orderBy(F.col("k").desc()), W.orderBy("pid")
    ends = r.groupBy("pid").agg(F.max("k").alias("first"), F.min(F.struct("k", "n_chars")).alias("last"))
    whole = W.partitionBy(F.lit(1))
    ends = ends.select("pid", F.coalesce(F.lead("first").over(all_), F.max("first").over(whole)).alias("next_first"), F.coalesce(F.lag("last").over(all_), F.min("last").over(whole)).alias("before_last"))
    r = r.select("k", "pid", F.lead("k").over(w).alias("next_k"), F.lag(F.struct("k", "n_chars")).over(w).alias("before")).join(F.broadcast(ends), "pid")  # ends: a row a partition
    before = F.coalesce("before", "before_last")
    return r.select("k", F.coalesce("next_k", "next_first").alias("next_k"), before["k"].alias("before_k"), before["n_chars"].alias("before_chars"))


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(k, text, n_chars), a row for each of docs, and None where k is the id; where ids repeat or are null, k is the row's place
    in order of id (null first), length and text's hash, and (k, doc_id) comes with it."""
    d = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    if d.groupBy("k").count().where("k is null or count > 1").isEmpty():
        return d, None
    d = written(d.withColumnRenamed("k", "doc_id").withColumn("row", F.monotonically_increasing_id()), "rows")
    ids = written(d.select("row", "doc_id", "n_chars", F.xxhash64("text").alias("th"), F.lit(0).alias("all")), "ids")
    names = written(numbered(ids, "all", ["doc_id", "n_chars", "th", "row"]).select("row", "doc_id", F.col("idx").alias("k")), "names")
    return d.join(names.select("row", "k"), "row").select("k", "text", "n_chars"), names.select("k", "doc_id")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    A document's edited text has its last floor(n_chars / 2) characters replaced by the first as many (or all) of the next
    document in descending id, after the last the first. Defined cases: a null text is empty; a text without words has a
    fingerprint of dots, like another such one only; rows that repeat an id are documents each, by length and then by their
    texts' hashes within the id; a lone document is its own next; a null id counts as the smallest; empty tables give no
    rows; other columns of docs are ignored.
    """
    d, names = told_apart(docs, id_col, text_col)
    ids = next_ids(d.select("k", "n_chars"))
    # every k is one row; the window asks for whole rows, so that one shuffle of the texts serves all that follows
    own = d.join(ids.hint("merge"), "k").withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("n_chars", "text"))).where("r = 1").drop("r")
    lent = own.select(F.col("before_k").alias("k"), F.expr("substring(text, 1, cast(before_chars div 2 as int))").alias("lent"))
    both = own.select("k", "next_k", "n_chars", "text").join(lent.hint("merge"), "k")
    both = both.select("k", "next_k", "n_chars", "text", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), lent)").alias("edited"))
    two = both.select("k", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("x")).select("k", "x.v", "x.t")
    prints = fingerprints(two, ["k", "v"], "t").groupBy("k").agg(F.max(F.when(F.col("v") == 0, F.col("fingerprint"))).alias("a"), F.max(F.when(F.col("v") == 1, F.col("fingerprint"))).alias("b"))
    none = F.lit(NONE * SIZE)
    done = both.select("k", "next_k", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")).join(prints.hint("merge"), "k", "left")
    done = written(done.select("k", "next_k", "n_chars", "edited_sha256", F.coalesce("a", none).alias("fingerprint"), F.coalesce("b", none).alias("edited_fingerprint")), "prints")
    following = done.select(F.col("k").alias("next_k"), F.col("fingerprint").alias("next_fingerprint"))
    out = done.join(following.hint("merge"), "next_k")
    out = out.withColumn("doc_id", F.col("k")) if names is None else out.join(names, "k")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
