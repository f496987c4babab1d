"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept: quality rules reject, one
document of each near-duplicate group stays, secrets are redacted, sources are mixed to target weights (a
document stays once per copy), and the texts are encoded. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm import bpe, secrets, simhash
from corpusmill.llm.common import materialize, table
from corpusmill.llm.mixing import mix_sources
from corpusmill.llm.quality import judge_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs.

    A null or empty text fails the base rules; very long ones are read whole; a null language is a stratum of its
    own; repeated rows stay or go each; more columns than those of documents are dropped; no rows give no rows.
    """
    return judge_quality(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).where("kept").select("carried.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of linked fingerprints; of groups without any doc_id, one document.

    Null and empty texts are one group; of repeated rows one stays; very long texts are read whole; no rows give no rows.
    Rows meet on doc_id and a hash of the text, null being a value, and equal rows are numbered on the same
    key, so texts are shuffled once. (No field of the key may be nullable on one side alone: a cast would
    come between, and the numbering would shuffle again.)
    """
    row = F.struct(F.coalesce(F.col("doc_id"), F.lit(0)).alias("a"), F.col("doc_id").isNull().alias("b"), F.xxhash64("text").alias("c"))
    judged = simhash.near_dedup(docs.select("doc_id", "text"), extra=F.xxhash64("text"))
    kept = simhash.kept_of_groups(judged).select(F.struct(F.coalesce(F.col("doc_id"), F.lit(0)).alias("a"), F.col("doc_id").isNull().alias("b"), F.coalesce("extra", F.lit(0)).alias("c")).alias("__row")).distinct()
    out = docs.select(*COLUMNS, row.alias("__row")).join(kept, "__row", "left_semi")
    return out.withColumn("__n", F.row_number().over(W.partitionBy("__row").orderBy("__row"))).where("__n = 1").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets redacted; n_chars follows the text.

    Null and empty texts stay as they are; very long ones are scanned whole; repeated rows are scanned each; no
    rows give no rows.
    """
    net = secrets.learn(docs.select("doc_id", "text"))
    out = secrets.scan_secrets(docs.select(*COLUMNS), net)
    n_chars = F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Documents without words (null texts too) are taken no times; a null source is a source of its own; ties and
    repeated rows are told apart by their number; no rows give no rows.
    """
    mixed = mix_sources(docs, carry=COLUMNS).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of each copy; null and empty texts have no tokens; no rows give no rows."""
    return bpe.encode_texts(docs, bpe.vocabulary()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("bpe_encode", bpe_encode)]

#: SQL can't express the hash, the network, the seeded rounding or the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
