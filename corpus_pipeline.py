"""A training corpus from the documents table, in five stages.

Every stage is ``(name, function)``; a function takes the session, the documents
its predecessor left and the folder of the tables, and returns a DataFrame.  All
but the last return the columns of documents.  Each result is written before
the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm.decontaminate import contamination
from reelgrid.llm.mixing import draw
from reelgrid.llm.near_dup import near_duplicates
from reelgrid.llm.pii import fit as fit_pii, redact
from reelgrid.llm.store import Workspace
from reelgrid.llm.toxicity import fit as fit_toxicity, score_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``ids``; a null doc_id stays."""
    return docs.join(ids.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity of 0.7 or more.  Learned from ``labels``."""
    machine = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs.select(*COLUMNS), machine, threshold=0.7).where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group linked by a
    similarity of 0.8 or more over five-word shingles."""
    return _without(docs.select(*COLUMNS), near_duplicates(docs, shingle_words=5, percent=80).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a
    whole shorter one."""
    return _without(docs.select(*COLUMNS), contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text."""
    clean = redact(docs.select(*COLUMNS), fit_pii(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: lang, source and n_chars of each document with its size, its source's
    size and target, the words taken and the output shard of each copy.  The copies
    are drawn, shuffled and written with their texts; ``run`` returns them."""
    return draw(docs.select(*COLUMNS))[0]


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: A learned stage can't be said in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again;
    the copies drawn with their texts, shard and order inside the shard."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir))
    return draw(docs.select(*COLUMNS))[1]
