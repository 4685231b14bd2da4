"""Writers: decks, files by collection, sections, templates, logs, stage tables. Tables are staged and moved, never half written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str, keep_backup: bool = False, fmt: str = "parquet") -> str | None:
    """Writes beside `path` and then takes its place; the former table stays as a backup if asked for. A failed write leaves it as it was.

    The exchange is two renames: a reader may find no table for the moment between them, and a driver lost there leaves the former one as `.bak-*`.
    """
    spark = df.sparkSession
    stage, old = f"{path}.stage-{uuid.uuid4().hex}", f"{path}.bak-{uuid.uuid4().hex}"
    df.write.format(fmt).save(stage)
    target, fs = _fs(spark, path)
    staged, backup = _fs(spark, stage)[0], _fs(spark, old)[0]
    had = fs.exists(target)
    if had and not fs.rename(target, backup):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(staged, target):
        if had:
            fs.rename(backup, target)
        raise OSError(f"{stage} can't be moved")
    if had and not keep_backup:
        fs.delete(backup, True)
    return old if had and keep_backup else None


def restore(spark: SparkSession, path: str, backup: str) -> None:
    target, fs = _fs(spark, path)
    fs.delete(target, True)
    fs.rename(_fs(spark, backup)[0], target)


def collection_files(cards: DataFrame, dimension: DataFrame) -> DataFrame:
    """filename, collection and the fields of derived rows, in order of sort fields. Null and empty collections are unsorted."""
    key = F.coalesce(F.nullif("collection", F.lit("")), F.lit("collection_0_unsorted"))
    rows = cards.withColumn("collection", key).join(dimension.select(F.col("key").alias("collection"), "filename"), "collection", "left")
    return rows.select(F.coalesce("filename", F.concat("collection", F.lit(".json"))).alias("filename"), "collection", "front", "back", "tags", "guid", "sort_field")


def write_collections(cards: DataFrame, dimension: DataFrame, path: str) -> None:
    """One folder of JSON lines a file name; each sorted by sort field."""
    rows = collection_files(cards, dimension)
    rows.repartition("filename").sortWithinPartitions("filename", "sort_field").write.mode("overwrite").partitionBy("filename").json(path)


def deck_rows(cards: DataFrame, dimension: DataFrame) -> DataFrame:
    """Notes of decks as rows: deck_id, deck, model_id, guid, fields, tags, sort. What packs them into files reads these."""
    from ..functions.text import display_name, stable_id

    key = F.coalesce(F.nullif("collection", F.lit("")), F.lit("collection_0_unsorted"))
    rows = cards.withColumn("collection", key).join(dimension.select(F.col("key").alias("collection"), "display_name"), "collection", "left")
    deck = F.coalesce("display_name", display_name("collection", 2))
    return rows.select(stable_id("collection").alias("deck_id"), deck.alias("deck"), stable_id(F.concat(F.lit("model:"), F.col("collection"))).alias("model_id"), "guid", F.array("front", "back").alias("fields"), "tags", F.coalesce("sort_field", F.lit("")).alias("sort"))


def template(cards: DataFrame) -> DataFrame:
    """One row, json: collection to category to an empty list, and the categories of each collection."""
    per = cards.groupBy("collection").agg(F.array_sort(F.collect_set("category")).alias("c"))
    empty = F.map_from_entries(F.transform("c", lambda x: F.struct(x, F.array().cast("array<string>"))))
    rows = per.select(F.struct("collection", empty.alias("m")).alias("a"), F.struct("collection", "c").alias("b"))
    return rows.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list("b"))).alias("subcategories_reference"), F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("a.collection", F.to_json("a.m").alias("m")))), lambda s: F.struct(s.collection, s.m))).alias("generated_cards"))).alias("json"))


def may_replace(size: Column, force: Column, most: int) -> Column:
    """Whether a file may be written over: there is none, it is as good as empty, or it is asked for."""
    return F.coalesce(size <= most, F.lit(True)) | F.coalesce(force, F.lit(False))


def worth_logging(observations: DataFrame, least: int = 5) -> DataFrame:
    """Observations of few new pages say little, unless the run was paused."""
    return observations.filter((F.col("pages_completed") >= least) | F.coalesce("paused", F.lit(False)))


def append_log(df: DataFrame, path: str) -> None:
    """Rows as JSON lines behind those that are there."""
    df.write.mode("append").json(path)


def write_candidates(cards: DataFrame, path: str) -> None:
    """One file, {"new_cards": [...]} in order of pos: what a batch of new cards is exchanged as, a bounded table. Null fields are left out."""
    row = F.struct("pos", F.struct(*(c for c in cards.columns if c != "pos")).alias("c"))
    whole = F.transform(F.array_sort(F.collect_list(row)), lambda r: r.c)
    cards.agg(F.to_json(F.struct(whole.alias("new_cards"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_prompt(spark: SparkSession, path: str, text: str) -> str | None:
    """A rendered prompt as one file; what was there before stays beside it as `.backup`, whose path is given."""
    target, fs = _fs(spark, path)
    backup = _fs(spark, f"{path}.backup")[0]
    had = fs.exists(target)
    if had:
        fs.delete(backup, False)
        if not fs.rename(target, backup):
            raise OSError(f"{path} can't be moved")
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
    return f"{path}.backup" if had else None


def mark_processed(spark: SparkSession, path: str, at: str) -> str:
    """What was read in moves aside under the time `at`, so that it isn't read again."""
    done = f"{path}.processed_{at}"
    source, fs = _fs(spark, path)
    if not fs.rename(source, _fs(spark, done)[0]):
        raise OSError(f"{path} can't be moved")
    return done


def flush_trace(runs: DataFrame, path: str) -> None:
    """The runs so far, as a table that takes its predecessor's place; called after each phase."""
    replace_table(runs, path, fmt="json")


def read_trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Runs of a trace; one that is no JSON (a line that can't be read) is set aside as `.bak`, and a new one begins."""
    target, fs = _fs(spark, path)
    if not fs.exists(target):
        return spark.createDataFrame([], schema)
    broken = spark.read.text(path).filter((F.trim("value") != "") & ~F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT")), F.lit(False)))
    if not broken.isEmpty():
        aside = _fs(spark, f"{path}.bak")[0]
        fs.delete(aside, True)
        fs.rename(target, aside)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


class Stages:
    """Named stages as Parquet tables: a stage from `from_stage` on is computed, an earlier one is read."""

    def __init__(self, spark: SparkSession, path: str, from_stage: int = 1):
        self.spark, self.path, self.from_stage, self.n = spark, path, from_stage, 0

    def run(self, name: str, make) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n:02d}_{name}"
        target, fs = _fs(self.spark, at)
        if self.n >= self.from_stage or not fs.exists(target):
            replace_table(make(), at)
        return self.spark.read.parquet(at)
