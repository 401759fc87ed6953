"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Stages keep the columns of documents, but for the last, which packs what is left into sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import decontamination, packing, quality_classifier, secrets, simhash
from meridia.llm.common import KEY, by_key, checkpointed, ensure_checkpoint_dir, keyed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.7 or more)."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    judged = quality_classifier.score(docs, model, keep=docs.columns, names=("__score", "__accepted"))
    return judged.where(F.col("__accepted") == 1).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least id, of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item, whatever their ids: the verdict is that of the text."""
    rows = keyed(docs, "text")
    found = decontamination.find_contamination(rows.select(F.col(KEY[0]).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = checkpointed(found.where(F.size("hits") > 0).select(F.col("doc_id").alias(KEY[0])).distinct())
    return by_key(rows, hit, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    return packing.best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: Fitting, fingerprints, decoding and packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what lies between them is Parquet in the shared folder.

    A stage's Parquet goes when the next one's is written; only the last, which the result reads, stays."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
