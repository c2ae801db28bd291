"""Index tables: schemas, publishing, partition-wise replacement, bundles."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.operators.versions import upsert

#: Columns of the index tables.
SCHEMAS = {
    "symbols": "repo string, ref string, path string, language string, symbol_id string, symbol_stable_id string, name string, qualified_name string, kind string, signature string, line_start int, line_end int, parent_symbol_id string, visibility string, content string",
    "snippets": "repo string, ref string, path string, language string, chunk_type string, origin string, parent_symbol_stable_id string, chunk_index int, truncated boolean, line_start int, line_end int, content string",
    "files": "repo string, ref string, path string, filename string, language string, content_hash string, size_bytes long, content_head string",
    "symbol_edges": "repo string, ref string, from_symbol_id string, to_symbol_id string, to_name string, edge_type string, confidence string, edge_provider string, resolution_outcome string, confidence_weight double, source_file string, source_line int",
    "semantic_vectors": "repo string, ref string, symbol_stable_id string, snippet_hash string, model string, path string, line_start int, line_end int, vector array<float>",
}
#: What makes a row of a table unique inside a repo and ref.
KEYS = {
    "symbols": ["path", "qualified_name", "kind", "line_start"],
    "snippets": ["path", "chunk_index", "line_start"],
    "files": ["path"],
    "symbol_edges": ["from_symbol_id", "to_symbol_id", "to_name", "edge_type", "source_file", "source_line"],
    "semantic_vectors": ["symbol_stable_id", "snippet_hash", "model"],
}


class SchemaMismatch(ValueError):
    """A table that has to be built anew."""


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


def checked(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order; missing ones mean that the index is of another version."""
    missing = [f.name for f in schema(name) if f.name not in df.columns]
    if missing:
        raise SchemaMismatch(f"{name} lacks {', '.join(missing)}; index again")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema(name)])


def read(spark: SparkSession, root: str, name: str, repo: str | None = None, ref: str | None = None) -> DataFrame:
    """A table; repo and ref are its partitions, so others aren't read."""
    rows = spark.read.parquet(f"{root}/{name}")
    if repo is not None:
        rows = rows.where(F.col("repo") == repo)
    return checked(rows if ref is None else rows.where(F.col("ref") == ref), name)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p, jvm.org.apache.hadoop.fs.Path


def publish(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap folders; a failure puts the old one back."""
    spark = df.sparkSession
    staged, backup = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.backup-{uuid.uuid4().hex}"
    df.write.partitionBy(*[c for c in ("repo", "ref") if c in df.columns]).parquet(staged)
    fs, target, make = _filesystem(spark, path)
    had = fs.exists(target)
    if had and not fs.rename(target, make(backup)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(make(staged), target):
        if had:
            fs.rename(make(backup), target)
        raise OSError(f"{path} can't be published")
    if had:
        fs.delete(make(backup), True)


def replace_partitions(df: DataFrame, path: str) -> None:
    """Overwrite only the repo and ref partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "ref").parquet(path)


def merge(spark: SparkSession, path: str, name: str, new: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """The table with new rows in place of old ones of their key, and without the old rows of changed files (repo, ref, path)."""
    old = checked(spark.read.parquet(path), name)
    if changed is not None:
        where = "source_file" if name == "symbol_edges" else "path"
        old = old.join(changed.select("repo", "ref", F.col("path").alias(where)).distinct(), ["repo", "ref", where], "left_anti").select(*old.columns)
    return upsert(old, checked(new, name), ["repo", "ref", *KEYS[name]])


def without_ref(rows: DataFrame, repo: str, ref: str) -> DataFrame:
    return rows.where(~((F.col("repo") == repo) & (F.col("ref") == ref)))


def export_bundle(tables: dict[str, DataFrame], path: str, metadata: dict) -> None:
    """Tables as zstd Parquet, and their metadata, in a folder that can be carried elsewhere."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        spark = df.sparkSession
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def import_bundle(spark: SparkSession, path: str, names: list[str], repo: str | None = None) -> tuple[dict[str, DataFrame], dict]:
    """(tables, metadata) of a bundle, under another repo if one is given."""
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    return {n: df.withColumn("repo", F.lit(repo)) if repo else df for n, df in tables.items()}, metadata
