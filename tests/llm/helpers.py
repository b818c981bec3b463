import random

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def rough(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names clash."""
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, " \t\n\x0b\r ", "en", None, 0),
        (4, LONG, "en", "a", 5),
        (5, "The same text, twice over here.", "en", "b", 5),
        (5, "The same text, twice over here.", "en", "b", 5),
        (6, "The same text, twice over here.", "de", "b", None),
        (None, "No id at all, in this row of text.", None, None, None),
        (7, "x", "fr", "b", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n_words", "score", "host", "kept", "host_verdict", "shard", "row", "sig", "key", "node", "chunk", "rank", "spans", "lang_pred", "rejected", "term"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def empty(spark):
    return rough(spark).limit(0)


def table(spark, texts, source="s"):
    """Documents numbered from 0."""
    rows = [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def prose(rng: random.Random, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))
