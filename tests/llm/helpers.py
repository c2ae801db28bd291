"""Small tables with the awkward rows that every operator has to take."""

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a", 225),
    (2, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a", 225),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "   \t\n ", "en", "b", 6),
    (6, "one two", "en", "b", 7),
    (6, "one two", "en", "b", 7),
    (7, "ÉTÉ naïve 日本語 🙂 word " * 30, "fr", "c", 1),
    (8, "x" * 30000, "en", "c", 1),
    (None, "no id here", "en", "c", 10),
    (9, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 200, "en", "d", 1),
]


def documents(spark, rows=DOCS):
    """Documents with extra columns whose names operators may use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, `__n` string"
    return spark.createDataFrame([(*r, 1, "x") for r in rows], schema)


def empty(spark):
    return documents(spark, [])


def read(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
