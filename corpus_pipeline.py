"""From raw documents to packed sequences: quality, boilerplate lines, near duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the
last returns the pieces of the packed sequences. Other columns of docs are ignored, whatever their names; empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import crf, linededup, minhash, mixing, packing
from heliograph.llm.common import table, written
from heliograph.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for good; trained on the labelled ones among them.

    Null and empty texts are judged by the share of good labels; repeated rows and rows without id are judged each, very
    long texts whole.
    """
    model = crf.train(docs, table(spark, sf_dir, "labels"))
    scored = crf.score(docs.select(*COLUMNS), model, threshold=0.3, keep=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are boilerplate in their source; n_chars follows the text.

    A null text stays null, with a null n_chars; a null source is a source of its own; repeated rows are cleaned each.
    """
    out = linededup.drop_boilerplate(docs, host_col="source", keep=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8 or more: that of the smallest id (a null
    one is the largest), then of the smallest text.

    Every row is a document of its own, so those that share an id, or have none, are told apart; rows equal in id and text
    are a group like other copies. Null texts and those without words are in no group and all stay.
    """
    rows = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(rows, id_col="row", k=5, num=80, den=100).select(F.col("doc_id").alias("row"), "component_id")
    # the texts that tie are equal or of one id: their hash orders them
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), "row")
    first = rows.select("row", order.alias("o")).join(found.hint("merge"), "row").groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o.row").alias("row"))
    return rows.join(first.hint("merge"), "row", "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the sources' budgets take, a row for each epoch that takes them.

    A document is an id and its text, so those that share an id, or have none, are taken apart; identical rows are one and
    come together. Null languages and sources are 'unknown'; null texts have no tokens.
    """
    keyed = docs.select(*COLUMNS, F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text").isNull().cast("string"), "text")).alias("key"))
    taken = mixing.production(keyed, id_col="key", fraction=0.8, max_epochs=2, seed=1).select(F.col("doc_id").alias("key"), "epoch")
    return keyed.join(taken.hint("merge"), "key").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of up to 4096 tokens. Null and empty texts are their end mark; repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=4096, end_id=2)


STAGES = [("quality", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("mixing", mixture), ("packing", packed)]

# Line fields, MinHash forests and tokenizers are beyond SQL: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
