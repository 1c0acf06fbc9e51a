"""The queries of the operators over the whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .click_windows import deduplicate_clicks
from .common import table
from .decontaminate import find_contamination
from .langid import fit_language_model, predict_language
from .neighbours import nearest
from .oracles import ORACLES as ORACLES
from .packing import pack_documents
from .personal_data import find_personal_data, fit_field
from .prefix_trie import prefix_trie
from .quality import score_quality
from .repeats import remove_repeats
from .secrets import scan_secrets
from .sharding import shard_documents
from .simhash import near_duplicates
from .token_files import read_token_files, write_token_files

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences. Null or empty text is the separator alone; repeated and null ids are packed row by row."""
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document. Null text has fingerprint zero; a null id names no group; repeated ids each give a row."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors of every twentieth id. Null ids and unusable vectors take no part; ties go to the smaller id."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes. Null text is empty; equal rows repeat each other."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; `und` with score 0 for null text and text without a letter."""
    docs = table(spark, sf_dir, "documents")
    return predict_language(docs, fit_language_model(docs))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Null text has no words, a null item no windows; repeated items count once."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_spans=False)
    return found.drop("items", "spans")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it lies within its language's quantiles; null text is not kept, a null language goes by the pool. Labels of one document with several values trust it if one does."""
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    return score_quality(table(spark, sf_dir, "documents"), good)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law `bytes`; null text has size 16, rows of one id are placed each for itself."""
    out = shard_documents(table(spark, sf_dir, "documents"), 40).drop("tokens")
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, read back from the files. Null text is its end id alone; a null id comes first, rows of one id in the order of their texts."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), TOKENIZER))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, without the texts; null text has none."""
    return scan_secrets(table(spark, sf_dir, "documents"), with_text=False).drop("redacted")


def op11_click_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of repeated clicks over eight batches. Rows without click_id or arrived_at take no part; other nulls count as empty."""
    return deduplicate_clicks(table(spark, sf_dir, "clicks"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations. Turns without conv_id take no part; null roles and texts are empty."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, without the texts; null text has none."""
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, fit_field(docs), with_text=False).drop("redacted")


QUERIES = {f.__name__: f for f in (op1_packing, op2_simhash, op3_neighbours, op4_repeats, op5_language, op6_decontaminate, op7_quality, op8_sharding, op9_token_files, op10_secrets, op11_click_windows, op12_prefix_trie, op13_personal_data)}
