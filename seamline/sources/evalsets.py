"""Evaluation suites: JSON query packs, and corpora with queries and relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HINT = "array<struct<hint:string>>"
SUITE = f"version string, queries array<struct<id:string,query:string,intent:string,expected_targets:{HINT},negative_targets:{HINT}>>"
# Names of header columns of judgement files.
FIRST = ("query-id", "query_id", "queryid", "qid", "query")
SECOND = ("corpus-id", "corpus_id", "corpusid", "doc-id", "docid", "document-id", "did", "corpus")
THIRD = ("doc-id", "docid", "document-id", "document_id", "corpus-id", "corpus_id")
FOURTH = ("score", "relevance", "rel", "label")


class SuiteError(ValueError):
    """A suite that can't be used."""


def suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, targets, negatives) of a query pack; checked to be complete and to have each id once."""
    raw = spark.read.schema(SUITE).json(path, multiLine=True)
    queries = raw.select("version", F.explode("queries").alias("q")).select("version", "q.*")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = queries.where(blank("version") | blank("id") | blank("query") | (F.coalesce(F.size("expected_targets"), F.lit(0)) < 1))
    if queries.isEmpty() or not bad.isEmpty():
        raise SuiteError("a suite needs a version, and queries with id, text and targets")
    if not queries.groupBy("id").count().where("count > 1").isEmpty():
        raise SuiteError("query ids have to be unique")
    of = lambda c: queries.select(F.col("id").alias("query_id"), F.explode(c).alias("t")).select("query_id", F.col("t.hint").alias("target"))
    return queries.select(F.col("id").alias("query_id"), "query", "intent"), of("expected_targets"), of("negative_targets")


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, score) of a judgement file of three or four columns; comments, a header, and scores of 0 or less are left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where((F.size("c") >= 3) & ~F.element_at("c", 1).startswith("#"))
    at = lambda i: F.try_element_at("c", F.lit(i))
    low = lambda i: F.lower(at(i))
    four = F.size("c") >= 4
    header = low(1).isin(*FIRST) & (low(2).isin(*SECOND) | (four & F.coalesce(low(3).isin(*THIRD) & low(4).isin(*FOURTH), F.lit(False))))
    rows = parts.where(~header).select(at(1).alias("query_id"), F.when(four, at(3)).otherwise(at(2)).alias("doc_id"), F.when(four, at(4)).otherwise(at(3)).try_cast("double").alias("score"))
    return rows.where("score > 0")


def beir(spark: SparkSession, corpus: str, queries: str, qrels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, targets): queries that have a judged document in the corpus."""
    docs = spark.read.schema("_id string, title string, text string").json(corpus).select(F.col("_id").alias("doc_id"), "title", "text")
    asked = spark.read.schema("_id string, text string").json(queries).select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    targets = judgements(spark, qrels).join(docs.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "score")
    return docs, asked.join(targets.select("query_id").distinct(), "query_id", "left_semi"), targets
