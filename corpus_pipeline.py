"""A corpus pipeline over the language-model operators: each stage works on what the one before it kept.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.llm import line_crf, piece_codec, quality_cascade, shingle_sets, simhash, source_mix
from ledgerscope.session import work_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_cascade.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores as good, fitted on the labelled ones among them and the table's others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_crf.keep_good(docs, line_crf.train(every, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints within four bits, or five-word shingles of similarity
    0.8 or more, which finds near copies that the fingerprints set too far apart."""
    return shingle_sets.keep_one(docs, also=simhash.groups)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return piece_codec.round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_weights", source_weights),
    ("encoded", encoded),
]

# SQL cannot express the fitted field, XXH64 fingerprints or the tokenizer: tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        place = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
