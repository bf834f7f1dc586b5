"""The corpus pipeline: toxicity, near duplicates, decontamination, secrets, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all
but the last return the columns of ``documents``.  ``run`` writes every stage as Parquet and reads it again, so
that a stage starts from files and lost executors cost no earlier stage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lumicube.llm import bpe_codec, decontaminate, minhash_dedup, secret_scan, toxicity
from lumicube.llm._spark import bounded_batches, delete_folder, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it is trained on labelled documents of the whole table.

    Null, empty and wordless texts stay; rows with a null id and repeated rows are judged by their texts; without
    labels of both kinds every row stays; an empty table gives no rows.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Five-word shingles, similarity 0.8.  Every row is judged by its own text: rows that share an id but not a text
    are different documents.  Rows without words and those with a null id stay, each; repeated rows become one.
    """
    return minhash_dedup.without_near_duplicates(docs, shingle_words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go.

    Null, empty and wordless texts stay; rows with a null id and repeated rows are judged by their texts; without
    items every row stays; an empty table gives no rows.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and ``n_chars`` is set anew where a text changed; every row stays.

    Null texts stay null; ids are not looked at; an empty table gives no rows.
    """
    bounded_batches(spark)
    return secret_scan.redacted(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, one row for each row of ``docs``.

    A null or empty text has no tokens; null ids stay null; an empty table gives no rows.
    """
    bounded_batches(spark)
    return bpe_codec.round_trip(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: The toxicity stage is a trained network, which SQL can't express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each is written beside the checkpoints, and deleted once the next is written."""
    shared = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = shared.get() if shared.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pipeline-")
    docs, at = table(spark, sf_dir, "documents"), f"{folder}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        if k:
            delete_folder(spark, f"{at}/{k - 1}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
