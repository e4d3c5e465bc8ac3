"""The corpus pipeline: language identification, near-duplicates, decontamination, mixing and sharding of ``documents``.

Each stage takes (spark, docs, sf_dir), with all that its predecessor kept as docs, and is written as Parquet and read again before
the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldmark.llm.common import settled
from fieldmark.llm.decontam import drop_leaks
from fieldmark.llm.langid import keep_identified
from fieldmark.llm.mixing import take_mix
from fieldmark.llm.neardup import drop_near_duplicates
from fieldmark.llm.sharding import assign_shards, number_slots

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, or of none of the languages learned, go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked at five-word shingles and a similarity of 0.8."""
    return drop_near_duplicates(docs, ngram=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item stands."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    return take_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, its slot there, and its shard were there one more. Copies of a row are alike."""
    content = F.crc32(F.encode("text", "UTF-8"))
    return number_slots(assign_shards(docs, "doc_id", SHARDS), "doc_id", SHARDS, ["source", "lang", content])


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources", source_mix), ("sharding", sharding)]

#: A kernel classifier and spaced seeds are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote for itself, and its input, go when its output is written."""
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), *spent)
        spent = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
