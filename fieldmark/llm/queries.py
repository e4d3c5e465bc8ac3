"""Queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracle
from .chat import format_chats
from .decontam import find_leaks
from .exactdup import exact_duplicates, one_space
from .filteraudit import audit_filters, words_of
from .langid import identify_languages
from .linededup import dedup_lines
from .mixing import mix_documents
from .neardup import near_duplicates
from .runs import find_runs, longest_run
from .sharding import shard_manifest
from .toxicity import rate_documents
from .urlrules import judge_urls
from .vecdup import near_duplicate_vectors

SHARDS = 40
#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", F.array_join("removed_lines", ",").alias("removed_lines"), "text")


def op2_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), ngram=2, percent=80)


def op5_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op6_pq_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op7_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op8_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), "leaked_items", "leaked_words")


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_manifest(_table(spark, sf_dir, "documents"), SHARDS)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_table(spark, sf_dir, "documents"))


def some_periodic(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with one text in ten made periodic from some word on: which, from where and with what period says crc32 of
    the doc_id as decimal text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words, n = words_of(F.col("text")), F.size("words")
    g, a = F.floor(F.col("h") / 10), F.col("a")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    chosen = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("a", (F.col("g") % F.nullif(n, F.lit(0))).cast("int"))
    copies = F.flatten(F.array_repeat(F.slice("words", a + 1, p), (F.ceil((n - a) / p)).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(copies, F.lit(1), n - a)), " ")
    return chosen.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = some_periodic(_table(spark, sf_dir, "documents"))
    top = longest_run(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.concat(listed, F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = find_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), listed.alias("listed"), "collapsed")
    exponent = F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli")
    return found.select("doc_id", "n_runs", "top.start", "top.length", "top.period", exponent, F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(one_space(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    return exact_duplicates(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = words_of(text)
    n = F.size(words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    failures = {"A": n < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * n, "C": 100 * capitals > 10 * F.char_length(text), "D": text.rlike(r"[#$%&*|]")}
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), failures, copies="E")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_factorization_toxicity, op3_url_filter, op4_minhash_near_dedup, op5_chat_role_repair, op6_pq_vector_dedup, op7_string_kernel_langid, op8_spaced_seed_decontamination, op9_jump_sharding, op10_source_mix, op11_periodic_runs, op12_exact_dedup, op13_filter_audit)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
