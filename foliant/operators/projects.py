"""Projects as data: where documents stand, files and folders, materials, settings, the configuration and its checks."""

from __future__ import annotations

import copy
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import DERIVED
from .order import numbered

# ---- where documents stand ---------------------------------------------------------------------------------------------------------------------------


def run_states(files: DataFrame) -> DataFrame:
    """path, run_status of state files (path, value): running where a state says nothing, null where it can't be read."""
    state = F.try_parse_json("value")
    is_object = F.startswith(F.schema_of_variant(state), F.lit("OBJECT"))
    return files.select("path", F.when(is_object, F.coalesce(F.try_variant_get(state, "$.run_status", "string"), F.lit("running"))).alias("run_status"))


def document_status(documents: DataFrame, texts: DataFrame, states: DataFrame) -> DataFrame:
    """path, ocr (done, running, paused, pending) of documents, from the texts beside them and the states beside those.

    documents, texts: path. states: path, run_status, as `run_states` gives them. Without a text a document is pending; a text without a state is done, as states
    are put away at the end; an unreadable state is one that is being written.
    """
    text_of = F.regexp_replace("path", r"\.[^./]*$", ".txt")
    have = texts.select(F.col("path").alias("text"), F.lit(True).alias("has_text")).distinct()
    state = states.select(F.regexp_replace("path", r"\.ocr_state\.json$", "").alias("text"), F.struct(F.coalesce("run_status", F.lit("running")).alias("run_status")).alias("state"))
    rows = documents.withColumn("text", text_of).join(have, "text", "left").join(state, "text", "left")
    status = F.col("state.run_status")
    ocr = F.when(F.col("has_text").isNull(), "pending").when(F.col("state").isNull() | (status == "completed"), "done").when(status == "paused", "paused").otherwise("running")
    return rows.select("path", ocr.alias("ocr"))


def project_flags(projects: DataFrame, cards: DataFrame, exports: DataFrame) -> DataFrame:
    """project, ingest, export: done where the project has cards, or packed decks. cards, exports: project."""
    has = lambda df, name: df.select("project", F.lit("done").alias(name)).distinct()
    rows = projects.select("project").join(has(cards, "ingest"), "project", "left").join(has(exports, "export"), "project", "left")
    return rows.select("project", F.coalesce("ingest", F.lit("pending")).alias("ingest"), F.coalesce("export", F.lit("pending")).alias("export"))


def to_do(status: DataFrame, stage: str = "ocr") -> DataFrame:
    """What the stage has still to do: neither done nor being done."""
    return status.filter(F.col(stage) == "pending")


def ready_texts(status: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of finished documents that are there, in order of documents, for the stage that reads them."""
    done = status.filter("ocr = 'done'").select(F.col("path").alias("document"), F.regexp_replace("path", r"\.[^./]*$", ".txt").alias("path"))
    return done.join(texts.select("path").distinct(), "path", "left_semi")


def archived_name(path: Column, at: Column) -> Column:
    """The name under which a finished state is put away: its own with the time to the microsecond before the suffix."""
    name = F.substring_index(path, "/", -1)
    stamp = F.date_format(at, "yyyyMMdd_HHmmss_SSSSSS")
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), stamp, F.regexp_extract(name, r"(\.[^.]*)$", 1))


# ---- files and folders -------------------------------------------------------------------------------------------------------------------------------

IMAGES = (".png", ".jpg", ".jpeg")
# Files that no deck derives, by name and by how they begin, and derived ones of former versions.
OWN_FILES = ("project.json", "card_database.json", "workflow_config.json")
FORMER_FILES = ("All_collections_only_fronts.md", "All_fronts.md")


def file_class(name: Column, derived: tuple[str, ...] = ()) -> Column:
    """own (not derived from the deck), derived, or other."""
    own = name.isin(*OWN_FILES) | F.startswith(name, F.lit("new_cards_output.json")) | F.endswith(name, F.lit(".apkg"))
    return F.when(own, "own").when(name.isin(*FORMER_FILES, *derived), "derived").otherwise("other")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def folder_count(files: DataFrame) -> DataFrame:
    return files.agg(F.count_distinct(folder(F.col("path"))).alias("folders"))


def image_folders(files: DataFrame, base: str) -> DataFrame:
    """document, images: the folders that are read as one document each.

    A base folder with images of its own is the only document; without any, each of its direct subfolders that has images is one.
    """
    images = files.filter(F.regexp_extract(F.lower("path"), r"(\.[^.]*)$", 1).isin(*IMAGES)).withColumn("document", folder(F.col("path")))
    near = images.filter((F.col("document") == base) | (folder(F.col("document")) == base)).groupBy("document").agg(F.count("*").alias("images"))
    whole = F.max(F.col("document") == base).over(Window.partitionBy(F.lit(0)))  # one row a folder
    return near.withColumn("whole", whole).filter(~F.col("whole") | (F.col("document") == base)).drop("whole")


def directory_tree(files: DataFrame, ignored: tuple[str, ...] = (*DERIVED, "__pycache__", ".venv")) -> DataFrame:
    """pos, line: the tree of files (path relative to its root, note or null), folders before files and then by name, drawn with branches."""
    parts = F.split("path", "/")
    kept = files.filter(~T.any_of(ignored, "path") | ~F.contains("path", F.lit("/"))).withColumn("parts", parts)
    kept = kept.filter(F.size(F.array_intersect(F.slice("parts", 1, F.size("parts") - 1), F.array(*map(F.lit, ignored)))) == 0)
    at = F.explode(F.sequence(F.lit(1), F.size("parts")))
    nodes = kept.select("note", "parts", at.alias("depth")).select(F.slice("parts", F.lit(1), F.col("depth")).alias("node"), (F.col("depth") == F.size("parts")).alias("is_file"), F.when(F.col("depth") == F.size("parts"), F.col("note")).alias("note"))
    nodes = nodes.groupBy("node", "is_file").agg(F.max("note").alias("note"))
    name, up = F.element_at("node", -1), F.slice("node", F.lit(1), F.size("node") - 1)
    last = F.row_number().over(Window.partitionBy("up").orderBy(F.desc("is_file"), F.desc("name"))) == 1
    nodes = nodes.withColumns({"name": name, "up": up}).withColumn("last", last)
    # a node with each of its ancestors and itself, in order: how it is sorted, and what is drawn before it
    above = nodes.select(F.col("node").alias("a"), F.struct(F.size("node").alias("d"), "is_file", "name").alias("step"), F.col("last").alias("a_last"))
    each = nodes.select("node", "is_file", "name", "note", "last", F.explode(F.transform(F.sequence(F.lit(1), F.size("node")), lambda n: F.slice("node", F.lit(1), n))).alias("a"))
    # an ancestor is a folder; a file and a folder of one name are two nodes
    each = each.join(above, "a").filter((F.size("a") < F.size("node")) & ~F.col("step.is_file") | (F.size("a") == F.size("node")) & (F.col("step.is_file") == F.col("is_file")))
    rows = each.groupBy("node", "is_file", "name", "note", "last").agg(F.array_sort(F.collect_list(F.struct("step", "a_last"))).alias("way"))
    before = F.array_join(F.transform(F.slice("way", F.lit(1), F.size("way") - 1), lambda w: F.when(w.a_last, "    ").otherwise("│   ")), "")
    line = F.concat(before, F.when(F.col("last"), "└── ").otherwise("├── "), F.col("name"), F.when(F.col("is_file"), F.coalesce("note", F.lit(""))).otherwise("/"))
    order = F.transform("way", lambda w: F.struct(w.step.is_file.alias("f"), w.step["name"].alias("n")))
    placed = numbered(rows.select(order.alias("order"), line.alias("line")), "order", name="pos")
    return placed.select((F.col("pos") + 1).alias("pos"), "line")


# ---- materials ---------------------------------------------------------------------------------------------------------------------------------------


def add_material(materials: DataFrame, name: str, path: str, description: str | None = None) -> DataFrame:
    """materials (number, name, path, description, is_default) with one more, numbered behind the largest."""
    if not name.strip() or not path.strip():
        raise ValueError("a material needs a name and a path")
    more = materials.agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("number")).select("number", F.lit(name).alias("name"), F.lit(path).alias("path"), F.lit(description or f"Material: {name}").alias("description"), F.lit(False).alias("is_default"))
    return materials.unionByName(more.select(*(F.col(c).cast(materials.schema[c].dataType) for c in materials.columns)))


def remove_material(materials: DataFrame, number: int) -> DataFrame:
    """Without it, unless it is the default, which stays."""
    return materials.filter((F.col("number") != number) | F.col("is_default"))


def set_default(materials: DataFrame, number: int) -> DataFrame:
    """The material becomes the only default; an unknown number changes nothing."""
    known = F.max(F.col("number") == number).over(Window.partitionBy(F.lit(0)))  # a small list
    return materials.withColumn("is_default", F.when(known, F.col("number") == number).otherwise(F.col("is_default")))


def material(materials: DataFrame, texts: DataFrame, number: int | None = None) -> DataFrame:
    """number, path, text of one material, or of the default; text is null where there is no such file. texts: path, text."""
    one = materials.filter(F.col("is_default") if number is None else F.col("number") == number)
    return one.select("number", "path").join(texts.select("path", "text"), "path", "left").select("number", "path", "text")


# ---- configurations ----------------------------------------------------------------------------------------------------------------------------------

# What a new project begins with.
PROJECT = {
    "project_name": "MeinProjekt",
    "tag_prefix": "MeinProjekt",
    "language": "de",
    "domain": "",
    "orphan_collection_name": "Unsortierte_Karten",
    "files": {"db_path": "card_database.json", "markdown_file": "All_fronts.md", "new_cards_file": "new_cards_output.json", "material_file": "course_material.txt"},
    "collections": {f"collection_{i}_Kapitel{i + 1}": {"display_name": f"Kapitel {i + 1}", "filename": f"collection_{i}_Kapitel{i + 1}.json", "description": ""} for i in range(2)},
    "llm": {"model": "google/gemini-2.5-flash", "temperature": 0.1},
}


def with_defaults(config: dict, defaults: dict = PROJECT) -> dict:
    """Top-level keys that are missing come from the defaults; what is there stays whole."""
    return copy.deepcopy(defaults) | config


def new_project(name: str) -> dict:
    return with_defaults({"project_name": name, "tag_prefix": name.replace(" ", "_").upper()})


def project_problems(files: DataFrame) -> DataFrame:
    """path, ord, problem: what is wrong with configurations (path, value as JSON text); the first by ord is what a reader would stop at."""
    config = F.try_parse_json("value")
    kind = lambda v: F.coalesce(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1), F.lit("MISSING"))
    at = lambda p: F.try_variant_get(config, p, "variant")
    rows = files.select("path", "value", config.alias("c"), *(at(f"$.{k}").alias(k) for k in ("project_name", "tag_prefix", "collections")))
    empty = lambda k: (kind(F.col(k)) != "STRING") | (F.coalesce(T.strip(F.try_variant_get(F.col(k), "$", "string")), F.lit("")) == "")
    listed = F.coalesce(F.map_entries(F.when(kind(F.col("collections")) == "OBJECT", F.try_variant_get("collections", "$", "map<string,variant>"))), F.array().cast("array<struct<key:string,value:variant>>"))
    rows = rows.withColumn("entries", F.array_sort(F.transform(listed, lambda e: F.struct(e.key.alias("key"), kind(e.value).alias("kind"), F.try_variant_get(e.value, "$.filename", "string").alias("filename")))))
    one = lambda cond, n, text: F.when(cond, F.struct(F.lit(n).alias("ord"), F.lit(text).alias("problem")))
    readable = kind(F.col("c")) == "OBJECT"
    found = [one(~readable, 0, "not a JSON object")]
    found += [one(readable & F.col(k).isNull(), i, f"{k} is missing") for i, k in enumerate(("project_name", "tag_prefix", "collections"), 1)]
    found += [one(readable & F.col(k).isNotNull() & empty(k), i, f"{k} is empty") for i, k in enumerate(("project_name", "tag_prefix"), 4)]
    found += [one(readable & F.col("collections").isNotNull() & (F.size("entries") == 0), 6, "collections is no object with entries")]
    wrong = F.transform(
        "entries",
        lambda e: F.when(e["kind"] != "OBJECT", F.struct(F.lit(7).alias("ord"), F.concat(F.lit("collections."), e.key, F.lit(" is no object")).alias("problem")))
        .when(e.filename.isNull(), F.struct(F.lit(7).alias("ord"), F.concat(F.lit("collections."), e.key, F.lit(" has no filename")).alias("problem")))
        .when(~F.endswith(e.filename, F.lit(".json")), F.struct(F.lit(7).alias("ord"), F.concat(F.lit("collections."), e.key, F.lit(".filename does not end in .json")).alias("problem"))),
    )
    every = F.filter(F.concat(F.array(*found), wrong), lambda x: x.isNotNull())
    return rows.select("path", F.posexplode(every).alias("at", "x")).select("path", F.col("at").cast("long").alias("ord"), "x.problem")


def read_project(spark: SparkSession, path: str) -> dict:
    """A valid configuration, or ValueError with what is wrong."""
    files = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), "value")
    problem = project_problems(files).orderBy("ord").first()
    if problem:
        raise ValueError(f"{path}: {problem['problem']}")
    return json.loads(files.first()["value"])


def write_project(spark: SparkSession, path: str, config: dict, overwrite: bool = False) -> None:
    """One JSON file, checked before it is written; one that is there is only replaced if asked for."""
    said = json.dumps(config, indent=2, ensure_ascii=False)
    told = spark.range(1).select(F.lit(path).alias("path"), F.lit(said).alias("value"))
    problem = project_problems(told).orderBy("ord").first()
    if problem:
        raise ValueError(f"{path}: {problem['problem']}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(where) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(where, overwrite)
    out.write(bytearray(said.encode()))
    out.close()


# What can be set, and what of a preset.
SETTINGS = ("default_model", "default_anki_model", "default_judge_model", "defaults")
PRESET = ("model", "repeat", "judge_model", "judge_mode", "judge_with_image")


def _setting(key: str, subkey: str | None) -> Column:
    if key not in SETTINGS or (subkey is not None and (key != "defaults" or subkey not in PRESET)):
        raise ValueError(f"no such setting: {key} {subkey or ''}".rstrip())
    return (F.col("key") == key) & (F.lit(True) if subkey is None else F.col("subkey") == subkey)


def set_value(config: DataFrame, key: str, value: str, subkey: str | None = None) -> DataFrame:
    """config (key, subkey, value) with one setting changed or added."""
    if key == "defaults" and subkey is None:
        raise ValueError("defaults is set by its parts")
    new = config.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(subkey).cast("string").alias("subkey"), F.lit(value).alias("value"))
    return config.filter(~F.coalesce(_setting(key, subkey), F.lit(False))).unionByName(new)


def unset_value(config: DataFrame, key: str, subkey: str | None = None) -> DataFrame:
    """Without one setting; a preset goes as a whole, or with its last part."""
    return config.filter(~F.coalesce(_setting(key, subkey), F.lit(False)))
