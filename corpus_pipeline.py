"""A training-corpus pipeline in five stages, each applying one operator to all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.llm.common import shared_folder
from annulus.llm.mixing import mix
from annulus.llm.packing import default_tokenizer, pack_documents
from annulus.llm.quality import classify
from annulus.llm.simhash import first_of_similar
from annulus.llm.substrings import repeated_words

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language.

    Text and language alone decide, so rejections are known by their digest and each row is judged by itself, whatever its id.
    """
    content = F.md5(F.concat_ws("|", F.coalesce("lang", F.lit("\0")), F.coalesce("text", F.lit(""))))
    docs = docs.select(*COLUMNS, content.alias("content"))
    rejected = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("content",)).where(~F.col("kept")).select("content").distinct()
    return docs.join(rejected, "content", "left_anti").select(*COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of texts linked by 5-word shingles at similarity 0.8 or more: that of smallest id, null ids last.

    Rows are told apart by their contents and not by their ids: different texts under one id, or under none, all stay.
    """
    return first_of_similar(docs.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that occur before; a changed text has one space between words, others stay as they are."""
    cut_texts = repeated_words(docs, carry=("lang", "source", "n_chars"), original=True)
    changed = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return cut_texts.select("doc_id", F.col("kept").alias("text"), "lang", "source", changed.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows are told apart by id, source and text, and numbered where these are equal."""
    keyed = docs.select(*COLUMNS, F.md5(F.coalesce("text", F.lit(""))).alias("content"))
    copies = mix(keyed, carry=("content",)).where("copies > 0").select("doc_id", "source", "content", "nth", "copies")
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "content").orderBy("lang", "n_chars")))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("doc_id", "source", "content", "nth")]
    taken = keyed.alias("d").join(copies.alias("m"), same[0] & same[1] & same[2] & same[3]).select(*[f"d.{c}" for c in COLUMNS], "copies")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack_documents(docs, default_tokenizer())


STAGES = [("quality", quality), ("simhash", simhash), ("substrings", substrings), ("mixture", mixture), ("packing", packing)]

#: SQL can't express the language model, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
