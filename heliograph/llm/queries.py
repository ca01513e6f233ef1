"""The operators of this subpackage as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, codes, crf, embgraph, langid, linededup, merkle, minhash, mixing, omh, packing, suffixes, warc
from .common import held_out, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=2)


def op2_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, num=80, den=100).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op3_mixing(spark, sf_dir):
    return mixing.production(table(spark, sf_dir, "documents"), fraction=0.8, max_epochs=2, seed=1)


def op4_warc(spark, sf_dir):
    out = warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "&")
    return out.withColumn("headers", shown).withColumn("original_id", F.coalesce("original_id", F.lit(-1).cast("long"))).withColumn("length", F.coalesce("length", F.lit(-1).cast("long")))


def op5_lines(spark, sf_dir):
    out = linededup.drop_boilerplate(table(spark, sf_dir, "documents"), host_col="source")
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op6_fingerprints(spark, sf_dir):
    return omh.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = crf.train(docs, table(spark, sf_dir, "labels"))
    return crf.score(docs, model, threshold=0.3).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_lines")


def op8_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(chat.fold_events(chat.event_log(rows.unionByName(own)))))


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_embeddings(spark, sf_dir):
    return embgraph.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op11_merkle(spark, sf_dir):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": merkle.ascii_lower("text")}, where=changed)


def op12_codes(spark, sf_dir):
    return codes.encode(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


def op13_suffixes(spark, sf_dir):
    return suffixes.drop_repeats(table(spark, sf_dir, "documents"), length=100)


QUERIES = {f.__name__: f for f in (op1_packing, op2_minhash, op3_mixing, op4_warc, op5_lines, op6_fingerprints, op7_quality, op8_chat, op9_language, op10_embeddings, op11_merkle, op12_codes, op13_suffixes)}
ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.SQL, "op4_warc": warc.SQL, "op5_lines": linededup.SQL, "op11_merkle": merkle.SQL, "op12_codes": codes.SQL}
