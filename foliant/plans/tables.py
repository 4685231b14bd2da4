"""The test tables in the shapes of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Documents as cards: one created a second after the other."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("pos"),
        F.col("doc_id").cast("string").alias("guid"),
        F.col("text").alias("front"),
        F.concat_ws(":", "lang", "source").alias("back"),
        F.concat(F.lit("collection_"), F.substring("source", 4, 100), F.lit("_docs")).alias("collection"),
        F.concat(F.substring("lang", 1, 1), F.lit("_"), F.col("lang")).alias("category"),
        F.lit(None).cast("string").alias("sort_field"),
        F.array("lang").alias("tags"),
        F.timestamp_seconds("doc_id").alias("created_at"),
    )


def split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents are those that exist, the others come in."""
    all_, known = cards(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("pos"))
    return all_.join(known, "pos", "left_semi"), all_.join(known, "pos", "left_anti")


def dimension(spark: SparkSession, d: str) -> DataFrame:
    """Collections that are configured: those of a number of one digit."""
    n = F.substring("source", 4, 100)
    rows = table(spark, d, "documents").select(F.concat(F.lit("collection_"), n, F.lit("_docs")).alias("key"), n.cast("int").alias("ord")).distinct()
    return rows.filter("ord < 10").withColumns({"filename": F.concat("key", F.lit(".json")), "display_name": F.concat(F.lit("Docs "), F.col("ord").cast("string"))})


#: The same in SQL, to begin a query with.
CARDS = """cards AS (
  SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS guid, text AS front, lang || ':' || source AS back, 'collection_' || substr(source, 4) || '_docs' AS collection,
    substr(lang, 1, 1) || '_' || lang AS category, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm_front, doc_id IN (SELECT doc_id FROM labels) AS known
  FROM documents)"""
DIM = """dim AS (
  SELECT DISTINCT 'collection_' || substr(source, 4) || '_docs' AS key, CAST(substr(source, 4) AS INTEGER) AS ord FROM documents WHERE CAST(substr(source, 4) AS INTEGER) < 10)"""
SLUG = """trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '&', 'und'), 'é', 'e'), 'è', 'e'), 'á', 'a'), 'à', 'a'), ' ', '_'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')"""
