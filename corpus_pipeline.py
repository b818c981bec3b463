"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Each stage takes all that its predecessor kept. The first four return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwatch.llm import host_rules, jaccard_join, language_id, packing, secret_scan
from bandwatch.llm.common import reach_workers, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host rules keep."""
    return host_rules.keep(docs)


def language_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; lang becomes the predicted one."""
    return language_id.keep(docs, language_id.fit(language_id.learnable(docs)))


def jaccard_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, once; documents without words all stay.

    A document is an id with a text: different texts under one id, or under none, are judged each by itself. Rows
    without an id come last in a group. Of rows that differ in other columns alone, the first in order of these
    columns as JSON stays. Texts meet by 64-bit hashes of id and text; where two share one, both stay or go.
    """
    row = F.xxhash64("doc_id", "text")
    found = staged(jaccard_join.join(docs.select(row.alias("_row"), "text"), "_row").groupBy("doc_id").agg(F.count("*").alias("count"), F.min("component_id").alias("group")))
    # only groups of several need their documents' own ids to find the smallest
    several = found.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    several = found.join(several, "group", "left_semi").withColumnRenamed("doc_id", "_row")
    own = docs.select(row.alias("_row"), "doc_id").join(several, "_row")
    first = own.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"].alias("_row"))
    lost = several.select("_row").join(first, "_row", "left_anti")
    kept = staged(found.withColumnRenamed("doc_id", "_row").join(lost, "_row", "left_anti").select("_row", "count"))
    # numbers of 8 bytes: broadcast by how many there are, so that texts are not shuffled; beyond it they are
    few = kept.count() <= jaccard_join.BROADCAST_ROWS
    rows = [kept.where(how).select("_row") for how in ("count = 1", "count > 1")]
    numbered = docs.withColumn("_row", row)
    once, again = (numbered.join(F.broadcast(x) if few else x, "_row", "left_semi") for x in rows)
    return once.select(docs.columns).unionByName(one_each(again.select(docs.columns)))


def one_each(rows: DataFrame) -> DataFrame:
    """One row for each id and text: the first by its other columns."""
    keys = ["doc_id", "text"]
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    rest = F.struct(*others)
    chosen = rows.groupBy(*keys).agg(F.min_by(rest, F.to_json(rest)).alias("_rest"))
    return chosen.select(*keys, "_rest.*").select(rows.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind; n_chars follows the text."""
    masked = secret_scan.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens."""
    return packing.pack(packing.cut(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language ID", language_ids),
    ("n-gram Jaccard join", jaccard_groups),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    reach_workers(spark)
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        rows = staged(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)


#: SQL cannot express language ID, the similarity join and the packing: tested against brute force.
ORACLE_SQL = None
