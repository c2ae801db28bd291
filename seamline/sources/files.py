"""Source trees as tables of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import text
from seamline.operators.policy import glob_regex

MAX_BYTES = 1 << 20
# Folders and endings that no index looks into.
IGNORED_FOLDERS = (".git", "node_modules", "target", "dist", "build", "vendor", ".venv", "venv", "__pycache__", ".idea", ".vscode")
IGNORED_ENDINGS = (".min.js", ".min.css", ".map", ".lock", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".gz", ".tar", ".so", ".dylib", ".dll", ".exe", ".class", ".jar", ".pyc", ".wasm")


def ignored(path: Column) -> Column:
    """Whether a relative path is left out by its folder or ending."""
    folders = "|".join(re.escape(f) for f in IGNORED_FOLDERS)
    return F.concat(F.lit("/"), path).rlike(f"/({folders})/") | path.rlike("(" + "|".join(re.escape(e) for e in IGNORED_ENDINGS) + ")$")


def ignore_rules(lines: list[str]) -> list[tuple[bool, str]]:
    """(ignored, pattern) of a .gitignore's lines, in order: later rules win, ! takes back."""
    rules = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        pattern = glob_regex(line.lstrip("/"))[1:-1]
        rules.append((not keep, ("^" if anchored else "(^|.*/)") + pattern + ("/.*$" if folder else "(/.*)?$")))
    return rules


def ignored_by(path: Column, rules: list[tuple[bool, str]]) -> Column:
    out = F.lit(False)
    for ignore, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(ignore)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, languages: list[str] | None = None, gitignore: list[str] | None = None) -> DataFrame:
    """(path, language, size_bytes, content) of the text files under a folder; the size is checked before a file is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + re.escape(re.sub("^/*", "/", base)) + "/", "")
    rows = rows.select(path.alias("path"), F.col("length").alias("size_bytes"), "content").where(~ignored(F.col("path")))
    if gitignore:
        rows = rows.where(~ignored_by(F.col("path"), ignore_rules(gitignore)))
    rows = rows.withColumn("language", text.language_of(F.col("path"))).where("language is not null")
    if languages:
        rows = rows.where(F.col("language").isin(*languages))
    return rows.select("path", "language", "size_bytes", F.decode("content", "UTF-8").alias("content"))


def records(files: DataFrame, repo: str, ref: str = "live") -> DataFrame:
    """File rows of the index: name, content hash, size and first lines."""
    return files.select(
        F.lit(repo).alias("repo"),
        F.lit(ref).alias("ref"),
        "path",
        F.regexp_extract("path", "([^/]*)$", 1).alias("filename"),
        "language",
        F.sha2("content", 256).alias("content_hash"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        text.content_head(F.col("content")).alias("content_head"),
    )
