"""Language identification by compression with one zstandard raw-content dictionary per language."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_sample, held_out, written

CHUNK = 8192  # bytes compressed at once: a long text must not become its own dictionary
LEVEL = 7  # of compression, for texts of every length
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_kept: dict = {}


def _letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split())


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1000, dict_bytes: int = 131072) -> dict[str, bytes]:
    """lang -> raw dictionary content, of rows that aren't held out and have text and lang.

    The sample is bounded by two parameters and made of whole texts: of docs_per_lang documents of each language (smallest
    md5 of the id), those of at most an eighth of dict_bytes, in that order, as long as they fit dict_bytes together; and in
    any case the shortest. Bytes are those of the text's letters. Languages are the distinct values of lang_col; what
    reaches the driver is one dictionary a language. Defined cases: null texts and langs teach nothing, nor do null ids,
    which are in no fold; rows that repeat an id may teach each; a very long text teaches nothing unless it is all there is.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    some = bounded_sample(rows.select("doc_id", "lang"), "lang", ["doc_id"], docs_per_lang).distinct()

    def letters(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_letters(t.as_py()) for t in b.column(2)], pa.binary())], ["doc_id", "lang", "data"])

    got = written(rows.join(F.broadcast(some), ["doc_id", "lang"]).select("doc_id", "lang", "text").mapInArrow(letters, "doc_id long, lang string, data binary"), "letters")  # docs_per_lang ids a language
    size, order = F.length("data"), [F.md5(F.col("doc_id").cast("string")), "doc_id", "data"]
    kept = got.withColumn("n", F.when(size <= dict_bytes // 8, size + 1)).withColumn("short", F.row_number().over(W.partitionBy("lang").orderBy(size, *order)) == 1)
    kept = kept.withColumn("upto", F.sum("n").over(W.partitionBy("lang").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where("short or (n is not null and upto <= %d)" % dict_bytes)
    parts: dict[str, list[bytes]] = {}
    for r in kept.select("lang", order[0].alias("h"), "doc_id", "data").orderBy("lang", "h", "doc_id", "data").collect():
        parts.setdefault(r["lang"], []).append(bytes(r["data"]))
    seen = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    return {k: b" ".join(parts[k]) for k in sorted(parts, key=lambda k: (-seen.get(k, 0), k))}


def _compressors(model: dict[str, bytes]) -> list:
    import zstandard as z

    key = hash(tuple(model.items()))
    if key not in _kept:
        _kept.clear()
        out = []
        for lang, data in model.items():
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(z.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        _kept[key] = out
    return _kept[key]


def code_lengths(model: dict[str, bytes], text: str) -> list[int]:
    data = _letters(text)
    return [sum(len(c.compress(data[i : i + CHUNK])) for i in range(0, len(data), CHUNK)) for c in _compressors(model)]


def judge(model: dict[str, bytes], text: str | None) -> tuple[str, float, float]:
    """(language, score, margin); margin: the share by which the second best encoding is longer."""
    if not text or not model or not any(c.isalpha() for c in text):
        return "und", 0.0, 0.0
    sizes = np.array(code_lengths(model, text), float)
    best = int(sizes.argmin())
    likely = np.exp(-(sizes - sizes[best]) / max(4.0, 0.01 * sizes[best]))
    margin = float(np.partition(sizes, 1)[1] / sizes[best] - 1) if len(sizes) > 1 else 1.0
    return list(model)[best], float(1 / math.fsum(likely)), margin


def predict(docs: DataFrame, model: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for every row; whole texts are encoded, in chunks.

    lang_pred is the language whose dictionary gives the smallest encoding (ties: the commonest in training); rejected marks
    margins under min_margin, where a caller should take none. Defined cases: null, empty and letterless texts, and an
    empty model, give und, score 0, rejected; a very long text is encoded whole, a chunk after the other; repeated rows are
    judged each; empty tables give no rows; other columns of docs are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [judge(model, t.as_py()) for t in b.column(1)]
            lang, score, margin = ([x[i] for x in got] for i in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([m < min_margin for m in margin], pa.bool_())], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
