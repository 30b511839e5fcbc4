"""Corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet and read
again as the next one's docs.  All but the last keep the columns of documents, with n_chars as the length of the text.

Cases, in every stage: an empty table gives no rows; a null text stays null (packing reads it as empty) and goes by no stage but
as a label or copy of its id does; rows without an id stay; repeated rows are rows each, of which near-dedup keeps those of the
least id; columns other than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import minhash_near_dedup, packing, secret_scans, substring_dedup, toxicity
from lodegraph.tables import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It is fitted on the labelled ones without the held-out third."""
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), toxicity.model_for(spark, docs, sf_dir), name="toxic_score")
    return scored.filter(F.col("toxic_score") < toxicity.REJECT).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id.  Rows that share an id stay or go
    together; documents without an id stay."""
    gone = minhash_near_dedup.near_dedup(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that repeat go.  Texts without such passages stay as they are, and so does every document."""
    keyed = saved(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()))  # ids may repeat; keys are given once
    found = substring_dedup.substring_dedup(keyed, id_column="row_key").filter("n_removed > 0").select(F.col("doc_id").alias("row_key"), "kept_text")
    n_chars = F.when(F.col("kept_text").isNotNull(), F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return keyed.join(found, "row_key", "left").select("doc_id", F.coalesce("kept_text", "text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    masked = secret_scans.mask_secrets(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences for training."""
    return packing.pack_documents(docs, packing.vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each other stage's are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
