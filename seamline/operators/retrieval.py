"""Lexical retrieval: postings, BM25, channels, rank fusion, and exact lookups.

Queries come in batches: every operator takes a table of queries and works for all of them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions import scoring, text
from seamline.operators import scores
from seamline.sources.shared import materialised

K1, B = 1.2, 0.75


def postings(corpus: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(term, doc_id, tf, doc_len), one row per term of a document."""
    rows = corpus.select(F.col(doc).alias("doc_id"), tokens.alias("tokens")).select("doc_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    return rows.groupBy("term", "doc_id", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, query_id: str, tokens: Column) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens)).alias("term"))


def bm25(posts: DataFrame, corpus_stats: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): sum over the query's distinct terms, any of which may match.

    corpus_stats is one row (n_docs, avg_len). Document frequencies are taken for query terms alone,
    and postings of other terms are dropped before anything is shuffled by document.
    """
    wanted = posts.join(terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(corpus_stats)).select("term", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len")
    weighted = wanted.join(idf, "term").select(
        "term", "doc_id", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))).alias("part")
    )
    return weighted.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def corpus_stats(corpus: DataFrame, tokens: Column) -> DataFrame:
    return corpus.select(F.size(tokens).alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_len"))


def top_per_query(scored: DataFrame, limit: int, tie: str = "doc_id") -> DataFrame:
    """The `limit` best rows of each query with their rank; scores are compared to nine digits, ties go by id."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def counted_documents(corpus: DataFrame, doc: str, tokens: Column, terms: DataFrame) -> DataFrame:
    """The corpus read and tokenised once, in the shared folder: one row a document with its terms and their counts.

    Nothing is shuffled but ids, and the rows of ids that come more than once. Terms that nobody asks
    for are left out, where few are asked for.
    """
    few = [r["term"] for r in terms.select("term").distinct().limit(scores.FEW_TERMS + 1).toLocalIterator()]
    rows = corpus.select(F.col(doc).alias("doc_id"), tokens.alias("tokens"))
    again = materialised(corpus.select(F.col(doc).alias("doc_id")).where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    single = rows
    if not again.isEmpty():
        single = rows.join(again, "doc_id", "left_anti")
        several = rows.join(again, "doc_id", "left_semi").select("doc_id", F.struct("tokens").alias("t")).groupBy("doc_id").agg(F.collect_list("t")["tokens"].alias("lists"))
        single = single.select("doc_id", F.array("tokens").alias("lists")).unionByName(several)
    else:
        single = single.select("doc_id", F.array("tokens").alias("lists"))
    return materialised(scores.counted(single, few if len(few) <= scores.FEW_TERMS else None), "documents")


def search(corpus: DataFrame, doc: str, tokens: Column, queries: DataFrame, query_id: str, query_tokens: Column, limit: int) -> DataFrame:
    """Ranked BM25 search of one channel: each task scores its documents for all queries and keeps `limit` of each, so no pair of query and document is shuffled but these."""
    terms = query_terms(queries, query_id, query_tokens).where("term <> ''").distinct()
    docs = counted_documents(corpus, doc, tokens, terms)
    stats = docs.agg(F.sum("n").alias("n_docs"), (F.sum("length") / F.sum("texts")).alias("avg_len")).first()
    df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(stats["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", idf.alias("idf"), "df")).alias("terms"))
    found = scores.best(docs, materialised(asked, "asked"), stats["avg_len"] or 1.0, K1, B, limit)
    return top_per_query(found, limit)


def fuse(channels: dict[str, DataFrame], weights: DataFrame) -> DataFrame:
    """Reciprocal rank fusion inside each channel: BM25 gives way to weight / (60 + rank).

    weights has (query_id, channel, weight); a channel of weight 0 isn't searched for that query.
    """
    rows = None
    for name, ranked in channels.items():
        part = ranked.select("query_id", F.lit(name).alias("channel"), F.col("doc_id").cast("string").alias("doc_id"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    live = weights.where("weight > 0")
    return rows.join(live, ["query_id", "channel"]).withColumn("score", scoring.rrf(F.col("rank"), F.col("weight")))


def channel_plan(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """(query_id, channel, weight) by the intent of each query."""
    found = queries.select(F.col(query_id).alias("query_id"), scoring.intent(F.col(query))["intent"].alias("intent"))
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), scoring.channel_weight(F.col("intent"), i).alias("weight")) for i, c in enumerate(("symbol", "snippet", "file"))])
    return found.select("query_id", "intent", F.explode(pairs).alias("x")).select("query_id", "intent", "x.channel", "x.weight")


def locate(symbols: DataFrame, name: str, kind: str | None = None, role: str | None = None, language: str | None = None, ref: str | None = None, limit: int = 10) -> DataFrame:
    """Symbols of exactly this name, case and all."""
    rows = symbols.where(F.col("name") == name)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if role:
        rows = rows.where(scoring.role(scoring.parse_kind(F.col("kind"))) == role)
    if language:
        rows = rows.where(F.col("language") == language)
    if ref:
        rows = rows.where(F.col("ref") == ref)
    return rows.orderBy("path", "line_start", "symbol_id").limit(limit)


def retain_role(results: DataFrame, role: str) -> DataFrame:
    """Symbol rows of one role; no rows at all if there is no such role."""
    if role not in scoring.ROLE_WEIGHTS:
        return results.where(F.lit(False))
    return results.where((F.col("result_type") == "symbol") & (scoring.role(scoring.parse_kind(F.col("kind"))) == role))


def with_path_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.where(F.lower("path").startswith(prefix.lower()))


def rerank_tokens_overlap(query: Column, document: Column) -> Column:
    return scoring.token_overlap(text.rerank_tokens(query), text.rerank_tokens(document))
