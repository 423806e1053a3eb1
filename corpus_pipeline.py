"""Corpus pipeline: toxic documents go, near duplicates go, repeated passages are cut, sources are mixed, texts are encoded.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last give the columns of ``documents``; all but the mix, whose
files are ranges of its order, give no more files than a stage table has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import bpe, mixing, simhash, substring, toxicity
from peptrail.llm.queries import tokenizer_file
from peptrail.llm.shared import fresh_path, in_files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold; labels teach the model and decide nothing else.

    Each row is judged by its own text: null and empty texts stay, rows with a null or repeated doc_id are
    judged each, equal texts alike. An empty table stays empty; without labels of both classes all stay.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_scores(docs, model, "__toxicity_score")
    return in_files(scored.where(F.col("__toxicity_score") < toxicity.THRESHOLD).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates.

    Null, empty and blank texts are alike, so one of them stays. Rows with a null doc_id stay all; of rows with
    one kept doc_id the one with the least text stays. An empty table stays empty.
    """
    return in_files(simhash.keep_first(docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a smaller doc_id holds; documents of which nothing stays go.

    Null ids and texts stay as they are; of several texts with one doc_id only the one with the least MD5 is
    cut. Texts without repeats keep every sign. An empty table stays empty.
    """
    return in_files(substring.cut_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow the Pfair mix of their sources.

    No row is dropped or repeated; a null source is a source; rows with a null or repeated doc_id keep their
    own places. An empty table stays empty.
    """
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row a document.

    Null and empty texts have no ids; rows with a null or repeated doc_id keep their rows. An empty table
    stays empty.
    """
    return in_files(bpe.digests(bpe.encode_decode(docs, tokenizer_file())))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]

#: trained models, fuzzy chains and merges are beyond SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
