"""A training corpus from raw documents, in stages of rampart.llm's operators; part of that package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rampart.llm.bpe_automaton import digests, encode_decode, vocabulary
from rampart.llm.common import drop, scope, stored_path
from rampart.llm.mixing import mixed_documents
from rampart.llm.quality_classifier import keep_by_classifier
from rampart.llm.quality_rules import keep_by_rules
from rampart.llm.similar import one_of_similar


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_by_rules(docs, _labels(spark, sf_dir))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling takes."""
    return keep_by_classifier(docs, _labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest doc_id.

    A class is joined by SimHash links, as in the operator's query, and by a similarity of 0.8 or more of the
    sets of five-word shingles, which 4 bits alone would miss.
    """
    return one_of_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of the text decoded from them."""
    return digests(encode_decode(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("BPE encoding", encoding),
]

#: Hashes of n-grams, shingles and byte pairs are beyond SQL; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder and read again.

    What a stage stores on its way, and its input, are deleted when its result is written. Documents may have
    null ids, texts and sources, empty and very long texts, repeated rows and any further columns; what
    becomes of them is each stage's operator's to say: rows without words go with the quality rules, rows
    equal in id and text are one after the near-dedup, and an empty table gives an empty result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = stored_path(spark, name.replace(" ", "-"))
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
