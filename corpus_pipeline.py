"""A training corpus from raw documents: toxicity, near copies, benchmark passages, personal data, packing.

Each stage works on all that its predecessor kept, and is written to the shared folder before the
next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.common import discard, stored, tuned
from seamline.llm.decontamination import decontaminate
from seamline.llm.near_dedup import deduplicate
from seamline.llm.packing import pack
from seamline.llm.pii import sanitise
from seamline.llm.toxicity import keep_clean


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Nulls and empty texts have no telling words and stay; repeated rows are judged alike; an empty table stays empty."""
    return keep_clean(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id; of rows without a doc_id one only where there is no other. Rows without words all stay; repeated rows are copies."""
    tuned(spark)
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single benchmark windows in others are cut out. Nulls and empty texts stay; an empty benchmark changes nothing."""
    return _counted(decontaminate(docs, _table(spark, sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal it, are taken out of the texts. Every row stays, nulls and empty texts as they are."""
    tuned(spark)
    return _counted(sanitise(docs, everywhere=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null text is its end token alone, repeated rows are packed each, an empty table gives no pieces."""
    tuned(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
#: SQL can express neither the learnt stages nor the tokens; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            kept = stored(kept, name)
            # nothing reads the stage before any more; the given table isn't touched
            discard(docs)
        docs = kept
    return docs
