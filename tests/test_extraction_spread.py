"""Files are parsed by all tasks, and once."""

from pyspark.sql import functions as F

from seamline.operators import extraction


def test_files_are_parsed_by_all_tasks(spark):
    files = spark.range(400).coalesce(1).select(F.concat(F.lit("m"), "id", F.lit(".rs")).alias("path"), F.lit("rust").alias("language"), F.lit("fn a() {}\n").alias("content"))
    found = extraction.extract(files)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.where("item = 'symbol'").count() == 400


def test_files_are_parsed_once(spark):
    files = spark.createDataFrame([("a.rs", "rust", "fn a() {}\n")], "path string, language string, content string")
    assert "MapInArrow" not in extraction.symbol_rows(extraction.extract(files), "r")._jdf.queryExecution().executedPlan().toString()
