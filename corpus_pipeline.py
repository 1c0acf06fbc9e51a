"""Five stages from raw documents to packed sequences; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import table, written
from lexweave.llm.decontaminate import find_contamination
from lexweave.llm.langid import fit_language_model, predict_language
from lexweave.llm.packing import pack_documents
from lexweave.llm.queries import TOKENIZER
from lexweave.llm.secrets import scan_secrets
from lexweave.llm.similar import similar_documents, with_nodes


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go, null texts and those without a letter among them; equal rows share their fate."""
    return predict_language(docs, fit_language_model(docs), carry=True).where(~F.col("rejected")).select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at a similarity of 0.8 in shingles of five words, one row stays, whatever its id.

    It is the row with the least id, rows without an id coming last, then with the least node and the least text. Rows whose
    id does not tell them apart, for it is missing or has several rows, are found by their words.
    """
    groups = written(similar_documents(docs), "near-copy-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k")
    kept = written(groups.groupBy("component").agg(first).select("k.doc_id", "k.node"), "kept-ids")
    shared = written(groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("doc_id"), "shared-ids")
    single = kept.join(shared.hint("merge"), "doc_id", "left_anti").select("doc_id")
    out = docs.join(single.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
    vague = docs.where(F.col("doc_id").isNull())
    if not shared.isEmpty():
        vague = vague.unionByName(docs.join(shared.hint("merge"), "doc_id", "left_semi").select(*docs.columns))
    elif kept.where(F.col("doc_id").isNull()).isEmpty():
        return out
    rows = with_nodes(vague).alias("r").join(kept.alias("k").hint("merge"), (F.col("r.node") == F.col("k.node")) & F.col("r.row.doc_id").eqNullSafe(F.col("k.doc_id")))
    least = F.min_by("r.row", F.struct("r.row.text", F.xxhash64("r.row.*"))).alias("row")
    return out.unionByName(rows.groupBy(F.col("r.node"), F.col("r.row.doc_id")).agg(least).select("row.*"))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null texts have no words and stay."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), with_spans=False, carry=True)
    return found.where(~F.col("contaminated")).select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows the text. No row goes; one without a secret stays as it is, null text too."""
    found = scan_secrets(docs, carry=True)
    hit = F.col("spans") != ""
    fresh = {"text": F.when(hit, F.col("redacted")).otherwise(F.col("row.text")), "n_chars": F.when(hit, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of several lengths; null text is a separator alone."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_near_copies),
    ("benchmark", not_in_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL has no form for the models, the hashes and the tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
