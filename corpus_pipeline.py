"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the
columns of documents. run() applies them to the documents of a folder. SQL can't express the classifier, so ORACLE_SQL is
None; the tests compare every stage with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.llm import bpe, decontaminate, lines, quality, simhash
from novelspark.llm.common import documents, stored

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the compression classifier, fitted on the labelled documents, scores below one half."""
    model = quality.fit(docs, quality.learnt_from(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = quality.score(docs, model, score_col="_score")
    return scored.where("_score >= 0.5").drop("_score")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated line runs; n_chars follows the text. A document that loses all its lines stays, empty."""
    out = lines.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that chains of a Jaccard similarity of 0.8 or more (shingles of five words) connect, keeps the row with the least doc_id."""
    return simhash.keep_one_near_copy(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digest of the text that the ids decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path), path)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_repeated_lines),
    ("simhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("byte-level bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
