"""Retrieval quality: targets, metrics, latencies, and the gate against a baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matches(target: Column, path: Column, name: Column, qualified_name: Column, stable_id: Column) -> Column:
    """Whether a result is what a target means: its path or the end of it, its name, the end of its qualified name, or its id."""
    t = F.lower(F.trim(target))
    p, n, q = F.lower(path), F.lower(name), F.lower(qualified_name)
    hit = (p == t) | p.endswith(F.concat(F.lit("/"), t)) | F.coalesce(n == t, F.lit(False)) | F.coalesce((q == t) | q.endswith(F.concat(F.lit("::"), t)), F.lit(False)) | F.coalesce(F.lower(stable_id) == t, F.lit(False))
    return (t != "") & hit


def metrics(run: DataFrame, targets: DataFrame) -> DataFrame:
    """Per query: reciprocal rank, recall and nDCG over run (query_id, rank, doc_id, path) and targets (query_id, doc_id).

    Gain is binary and each target counts once, at its best rank; the ideal has as many hits as there are targets or results.
    """
    wanted = targets.select("query_id", "doc_id").distinct()
    n_targets = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("targets"))
    hits = run.join(wanted, ["query_id", "doc_id"]).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    per_path = run.groupBy("query_id", "path").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_path.groupBy("query_id").agg(F.sum("n").alias("results"), F.max("n").alias("largest"))
    gains = hits.groupBy("query_id").agg(F.min("rank").alias("first_hit"), F.count(F.lit(1)).alias("found"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    rows = n_targets.join(sizes, "query_id", "left").join(gains, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("targets", F.coalesce("results", F.lit(0))), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return rows.select(
        "query_id",
        F.coalesce("first_hit", F.lit(0)).alias("first_hit"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("found") / F.col("targets"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.col("largest") / F.col("results"), F.lit(0.0)).alias("clustering"),
        F.coalesce("results", F.lit(0)).alias("results"),
    )


def summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("recall").alias("recall_at_k"),
        F.avg("ndcg").alias("ndcg_at_k"),
        F.avg("clustering").alias("clustering_ratio"),
        F.avg((F.col("results") == 0).cast("double")).alias("zero_result_rate"),
    )


def nearest_rank(column: str, p: float) -> Column:
    """The value at index ceil(p n) of the sorted values."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def latencies(samples: DataFrame, by: str = "intent") -> DataFrame:
    return samples.groupBy(by).agg(
        F.count(F.lit(1)).alias("samples"), nearest_rank("latency_ms", 0.5).alias("p50_ms"), nearest_rank("latency_ms", 0.95).alias("p95_ms"), F.avg("latency_ms").alias("mean_ms")
    )


@dataclass(frozen=True)
class Gate:
    """Floors and caps of a policy, a baseline, and tolerances against it, by metric; caps are metrics where less is better."""

    floors: dict[str, tuple[float, float, float]]
    caps: dict[str, tuple[float, float, float]]


# Labels of failed metrics.
TAXONOMY = {"recall_at_k": "recall_drop", "mrr": "ranking_shift", "ndcg_at_k": "ranking_shift", "p50_ms": "latency_regression", "p95_ms": "latency_regression"}


def gate(report: DataFrame, rules: Gate) -> DataFrame:
    """One row per metric of a one-row report: value, bound and verdict. A bound combines the policy's with the baseline and its tolerance, the stricter holds."""
    checks = []
    for name, (least, base, slack) in rules.floors.items():
        bound = max(least, base - slack)
        checks.append(F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"), F.lit(float(bound)).alias("bound"), (F.col(name) >= bound).alias("passed")))
    for name, (most, base, slack) in rules.caps.items():
        bound = min(most, base + slack) if base > 0 else most
        checks.append(F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"), F.lit(float(bound)).alias("bound"), (F.col(name) <= bound).alias("passed")))
    rows = report.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
    label = F.try_element_at(F.create_map(*[F.lit(x) for pair in TAXONOMY.items() for x in pair]), F.col("metric"))
    return rows.withColumn("label", F.when(~F.col("passed"), label))


def negative_hits(run: DataFrame, negatives: DataFrame) -> DataFrame:
    """Results per query that are what it should not find."""
    return run.join(negatives.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("negative_hits"))


def trec_run(run: DataFrame, tag: str = "seamline") -> DataFrame:
    """Lines of a TREC run."""
    return run.select(F.format_string("%s\tQ0\t%s\t%d\t%.6f\t" + tag, F.col("query_id").cast("string"), F.col("doc_id").cast("string"), F.col("rank").cast("int"), F.col("score")).alias("line"))


def trec_qrels(targets: DataFrame) -> DataFrame:
    return targets.select(F.format_string("%s\t0\t%s\t%d", F.col("query_id").cast("string"), F.col("doc_id").cast("string"), F.lit(1)).alias("line"))


def first_hits(run: DataFrame, targets: DataFrame) -> DataFrame:
    hits = run.join(targets.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "doc_id", "rank")
