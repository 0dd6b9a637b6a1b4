"""The corpus pipeline: documents without toxic ones, near copies, benchmark leaks and secrets, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows are only
dropped by what a stage finds: a row with a null doc_id can't be named by a finding and stays. In every stage null and empty texts are
texts without findings and stay, very long texts are read whole, ties go to the least id, an empty table gives an empty one with the
same columns, and columns beyond those of documents are left out, so that clashing names can't meet. Repeated rows of one id share its
finding and stay or go together, but for near copies, which keeps one of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, minhash, packing, secrets, toxicity
from gridloom.llm.common import checkpoint, shared_folder, table, text_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns on the documents given, by the labels' learning rows."""
    bad = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).where("score >= 0.5 and doc_id is not null").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(checkpoint(bad), "doc_id", "left_anti").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the least id; of rows that share an id, one."""
    found = checkpoint(minhash.classes(docs))
    # by sorted shuffles at every size: what goes grows with the corpus
    kept = docs.select(*COLUMNS).join(found.where("not kept").select("doc_id").hint("merge"), "doc_id", "left_anti").select(*COLUMNS)
    twice = checkpoint(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return kept.join(twice, "doc_id", "left_anti").select(*COLUMNS).unionByName(again)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bad = checkpoint(decontaminate.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.select(*COLUMNS).join(bad, "doc_id", "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the text."""
    got = secrets.scan(docs, secrets.train(secrets.samples(spark)), carry=COLUMNS)
    hit = F.size("found") > 0
    text = F.when(hit, secrets.redact(text_of("text"), F.col("found"))).otherwise(F.col("text"))
    return got.select("doc_id", text.alias("text"), "lang", "source", "n_chars", hit.alias("_hit")).select("doc_id", "text", "lang", "source", F.when(F.col("_hit"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("toxicity", toxic), ("near_copies", near_copies), ("decontamination", leaks), ("secrets", without_secrets), ("packing", packed)]

#: No stage's method is an expression of SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    place = f"{shared_folder(spark)}/pipeline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
